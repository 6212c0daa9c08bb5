"""Incremental ingest: a stream of reads or pairs appended as blocks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixframe import schema
from helixframe.errors import FormatError
from helixframe.operators import layout, shared, store
from helixframe.sources import fastq

BATCH_READS = 640_000


def read_stream(spark: SparkSession, path: str, rows_per_slice: int = 10_000, slices_per_batch: int = 0) -> DataFrame:
    """Reads of a file, which may grow, of comma-separated ones, a glob or a folder.

    The driver looks for line ends only and hands out slices; tasks parse them. `slices_per_batch` bounds what is under way; 0 is as many as
    hold 640,000 reads.
    """
    fastq.register(spark)
    slices_per_batch = slices_per_batch or max(1, BATCH_READS // rows_per_slice)
    slices = spark.readStream.format("fastq_slices").option("rowsPerSlice", str(rows_per_slice)).option("slicesPerBatch", str(slices_per_batch)).load(path)
    return fastq.parse_slices(slices.repartition(spark.sparkContext.defaultParallelism))


def read_pair_stream(spark: SparkSession, path: str, path2: str, rows_per_slice: int = 10_000, slices_per_batch: int = 0) -> DataFrame:
    """pair_idx and both mates of two plain files, cut after the same pairs; a file with more reads is an error."""
    fastq.register(spark)
    slices_per_batch = slices_per_batch or max(1, BATCH_READS // rows_per_slice)
    source = spark.readStream.format("fastq_pairs").option("path2", path2).option("rowsPerSlice", str(rows_per_slice)).option("slicesPerBatch", str(slices_per_batch))
    return fastq.parse_pairs(source.load(path).repartition(spark.sparkContext.defaultParallelism))


def as_pairs(reads: DataFrame) -> DataFrame:
    """Pairs of interleaved reads; a read without its mate is an error."""
    one, two = (reads.where(F.col("read_idx") % 2 == m).withColumn("read_idx", F.floor(F.col("read_idx") / 2)) for m in (0, 1))
    return layout.zip_mates(one, two)


def append_blocks(reads: DataFrame, path: str, checkpoint: str, block_reads: int = schema.BLOCK_READS["short"], once: bool = False, pe_layout: str = "", **settings) -> StreamingQuery:
    """Each micro-batch becomes blocks in a folder named by its number, so a batch that runs again replaces itself.

    Blocks carry read_idx from the source, and need no state between batches. `reads` may be pairs; with a layout, pairs, or the
    reads of an interleaved file, are laid out by it, consecutive ones within each block. The query can be stopped at any time and goes on
    from its checkpoint; its progress tells the slices of each batch. With `once` it returns when all that the source holds is in, in as many batches as that takes:
    Spark's availableNow trigger would ask a source written in Python for one batch only, and end with that.
    """

    def batch(df: DataFrame, number: int) -> None:
        if pe_layout and "pair_idx" not in df.columns and pe_layout == "consecutive":
            df = as_pairs(df)
        if "pair_idx" in df.columns:
            df = layout.blocked_consecutive(df, block_reads) if pe_layout == "consecutive" else layout.arrange(df, "interleaved")
        store.encode_blocks(df.select(*store.READ_COLUMNS), block_reads, **settings).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    if once:
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    return query


def finish(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all batches, numbered by their first read; a block cut by a batch's end stays as it is."""
    if not shared.exists(spark, path):
        return spark.createDataFrame([], schema.BLOCK)
    blocks = spark.read.schema(f"{schema.BLOCK}, batch int").parquet(path).drop("batch", "block_id")
    numbers = layout.ranked(blocks.select(F.col("archive_id_start").alias("start")), ["start"])
    columns = [c.split()[0] for c in schema.BLOCK.split(", ")]
    return blocks.join(numbers, F.col("archive_id_start") == F.col("start")).withColumn("block_id", F.col("rank").cast("int")).select(*columns)


def finish_archive(spark: SparkSession, path: str, archive: str, paired: bool = False, pe_layout: str = "interleaved", kind: str = "", quality_mode: str = "none", id_mode: str = "tokenize", filename: str = "", force: bool = False) -> None:
    """The streamed blocks as an archive, the counts in its manifest. The length class that was taken for granted is medium."""
    if not force and shared.exists(spark, archive):
        raise FormatError(f"{archive} is already there")
    staged = f"{archive.rstrip('/')}.part-{uuid.uuid4().hex}"
    blocks = finish(spark, path)
    if paired and (blocks.agg(F.sum("read_count")).first()[0] or 0) % 2:
        raise FormatError("pairs need an even number of reads")
    blocks.write.parquet(f"{staged}/blocks")
    store.finish_archive(spark, staged, {"original_filename": filename, "is_paired": paired, "has_reorder_map": False, "preserve_order": True, "streaming_mode": True, "quality_mode": quality_mode, "id_mode": id_mode, "pe_layout": pe_layout, "read_length_class": kind or layout.default_stats("streaming")[0]})
    store.commit(spark, staged, archive)
