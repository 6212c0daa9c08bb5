"""The archive: blocks, manifest and reorder map as tables; writing, reading, checking."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe import schema
from helixframe.errors import FormatError, ResourceError, SourceError, UnsupportedFormat
from helixframe.functions import sequence as fn
from helixframe.operators import admission, codecs, container, layout, shared

READ_COLUMNS = [c.split()[0] for c in schema.READ.split(", ")]


def encode_blocks(reads: DataFrame, size: int, kind: str = "short", id_mode: str = "tokenize", quality_mode: str = "none", quality_codec: str = "zstd", level: int = 5) -> DataFrame:
    """One row per block, its reads in the order of read_idx; lossy qualities are quantised by columns first."""
    z = schema.ZSTD_LEVELS[level]
    rows = layout.with_blocks(reads, size).withColumn("quality", fn.quantized("quality", quality_mode))
    order = 1 if kind == "long" else 2

    def encode(t: pa.Table) -> pa.Table:
        t = t.sort_by("read_idx")
        idx, ids, comments, seqs, quals = (t.column(c).to_pylist() for c in READ_COLUMNS)
        heads = [i if not c else f"{i} {c}" for i, c in zip(ids, comments, strict=True)]
        id_codec, id_data = (codecs.codec_byte("raw"), b"") if id_mode == "discard" else codecs.encode_ids(heads, z) if id_mode == "tokenize" else (codecs.codec_byte("zstd"), codecs.encode_strings(heads, z))
        seq_codec, seq_data = codecs.encode_sequences(seqs, kind, z)
        if quality_mode == "discard":
            qual_codec, qual_data = codecs.codec_byte("raw"), b""
        elif quality_codec == "context":
            qual_codec, qual_data = codecs.codec_byte("quality_context"), codecs.encode_qualities(quals, order)
        else:
            qual_codec, qual_data = codecs.codec_byte("zstd"), codecs.squeeze("".join(quals).encode(), z)
        uniform, aux = codecs.encode_lengths([len(s) for s in seqs])
        stored = [f"read{i + 1}" for i in idx] if id_mode == "discard" else heads
        row = {"block_id": t.column("block_id")[0].as_py(), "archive_id_start": idx[0], "read_count": len(idx), "uniform_read_length": uniform, "codec_ids": id_codec, "codec_seq": seq_codec, "codec_qual": qual_codec, "codec_aux": codecs.codec_byte("delta_varint"), "checksum": codecs.checksum(stored, seqs, quals), "qual_order": order, "ids_data": id_data, "seq_data": seq_data, "qual_data": qual_data, "aux_data": aux}
        return pa.Table.from_pylist([row], schema=BLOCK_ARROW)

    return rows.select(*READ_COLUMNS, "block_id").groupBy("block_id").applyInArrow(encode, schema.BLOCK)


BLOCK_ARROW = pa.schema([("block_id", pa.int32()), ("archive_id_start", pa.int64()), ("read_count", pa.int32()), ("uniform_read_length", pa.int32()), *((f"codec_{c}", pa.int16()) for c in ("ids", "seq", "qual", "aux")), ("checksum", pa.int64()), ("qual_order", pa.int32()), *((f"{c}_data", pa.binary()) for c in ("ids", "seq", "qual", "aux"))])


def decode_block(row: dict) -> tuple[list[str], list[str], list[str]]:
    """Headers, sequences and qualities of a block row. Discarded identifiers count from the block's first read."""
    n, start = row["read_count"], row["archive_id_start"]
    codecs.family_of(row["codec_aux"], "aux")
    lengths = codecs.decode_lengths(row["uniform_read_length"], row["aux_data"], n)
    ids = [f"read{start + i + 1}" for i in range(n)] if codecs.family_of(row["codec_ids"], "ids") == "raw" else codecs.decode_ids(row["codec_ids"], row["ids_data"], n)
    seqs = codecs.decode_sequences(row["codec_seq"], row["seq_data"], lengths)
    family = codecs.family_of(row["codec_qual"], "qual")
    if family == "raw":
        quals = ["!" * k for k in lengths]
    elif family == "zstd":
        text, ends = codecs.expand(row["qual_data"]).decode(), np.cumsum([0, *lengths]).tolist()
        quals = [text[a:z] for a, z in zip(ends, ends[1:], strict=False)]
    else:
        quals = codecs.decode_qualities(row["qual_data"], lengths, row["qual_order"])
    if not len(ids) == len(seqs) == len(quals) == n:
        raise FormatError(f"block {row['block_id']}: streams of different length")
    return ids, seqs, quals


def decode_blocks(blocks: DataFrame, skip_corrupted: bool = False, placeholder: str = "", mates: bool = False) -> DataFrame:
    """All reads of the blocks. With skip_corrupted a block that fails gives a placeholder for each of its reads,
    of the bases given or else as many N as the block's reads have, or one. With mates a column tells the reads of a block's
    first half, 1, from those of its second, 2.
    """

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                try:
                    ids, seqs, quals = decode_block(row)
                except Exception as e:
                    if not skip_corrupted:
                        raise FormatError(f"block {row['block_id']}: {e}") from e
                    ids = [f"corrupted_block{row['block_id']}_read{i}" for i in range(row["read_count"])]
                    bases = placeholder or "N" * (row["uniform_read_length"] or 1)
                    seqs, quals = [bases] * len(ids), ["!" * len(bases)] * len(ids)
                split = [h.partition(" ") for h in ids]
                idx = list(range(row["archive_id_start"], row["archive_id_start"] + len(ids)))
                half = [1 + (2 * i >= len(ids)) for i in range(len(ids))]
                cols = [pa.array(idx, pa.int64()), *(pa.array(c, pa.string()) for c in ([h[0] for h in split], [h[2] for h in split], seqs, quals)), pa.array(half, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols if mates else cols[:-1], names=[*READ_COLUMNS, "mate"] if mates else READ_COLUMNS)

    return blocks.mapInArrow(run, schema.READ + (", mate int" if mates else ""))


def verify(blocks: DataFrame) -> DataFrame:
    """(block_id, ok, error, reads): every block decoded and held against its checksum of the stored reads."""

    def run(batches):
        for b in batches:
            rows = []
            for row in b.to_pylist():
                error, n = None, 0
                try:
                    ids, seqs, quals = decode_block(row)
                    n = len(ids)
                    if codecs.checksum(ids, seqs, quals) != row["checksum"]:
                        error = "the checksum does not match"
                except Exception as e:
                    error = str(e)
                rows.append({"block_id": row["block_id"], "ok": error is None, "error": error, "reads": n})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("block_id", pa.int32()), ("ok", pa.bool_()), ("error", pa.string()), ("reads", pa.int64())]))

    return blocks.mapInArrow(run, "block_id int, ok boolean, error string, reads bigint")


def split_mates(spark: SparkSession, path: str, reads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The first and the second mates of a paired archive, by parity, by half, or by half of each block where it was streamed."""
    head = info(spark, path).first()
    if head["streaming_mode"] and head["pe_layout"] == "consecutive":
        both = decode_blocks(spark.read.schema(schema.BLOCK).parquet(f"{path}/blocks"), mates=True)
    else:
        both = (read_archive(spark, path) if reads is None else reads).withColumn("mate", layout.mate_of(head["pe_layout"], head["total_reads"]))
    return tuple(both.where(F.col("mate") == m).drop("mate") for m in (1, 2))


def structure_errors(blocks: DataFrame, total_reads: int) -> DataFrame:
    """(block_id, error) for blocks that leave a gap, overlap or are empty; block -1 if the counts do not add up."""
    bare = blocks.select("block_id", "archive_id_start", "read_count")
    expected = layout.starts(bare.select("block_id", "read_count")).select("block_id", F.col("archive_id_start").alias("want"))
    gaps = bare.join(expected, "block_id").where((F.col("want") != F.col("archive_id_start")) | (F.col("read_count") <= 0)).select("block_id", F.lit("gap, overlap or empty block").alias("error"))
    total = bare.agg(F.coalesce(F.sum("read_count"), F.lit(0)).alias("n")).where(F.col("n") != total_reads).select(F.lit(-1).alias("block_id"), F.lit("read counts do not add up").alias("error"))
    return gaps.unionByName(total)


def verify_totals(checked: DataFrame) -> DataFrame:
    """One row of blocks checked, ok and failed, and the reads of those that are ok."""
    return checked.agg(F.count("*").alias("checked"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum("reads"), F.lit(0)).alias("reads"))


def headers(blocks: DataFrame) -> DataFrame:
    """The blocks without their streams, but with their sizes: no stream is read for the rest."""
    return blocks.drop(*(f"{c}_data" for c in container.STREAMS))


def stream_sizes(blocks: DataFrame) -> DataFrame:
    """block_id, size of each stream and of all."""
    sizes = [F.octet_length(f"{c}_data").alias(f"size_{c}") for c in container.STREAMS]
    rows = blocks.select("block_id", "read_count", *(f"codec_{c}" for c in container.STREAMS), *sizes)
    return rows.withColumn("compressed_size", sum(F.col(f"size_{c}") for c in container.STREAMS).cast("bigint"))


def contradictions(blocks: DataFrame, quality_mode: str, id_mode: str) -> DataFrame:
    """(block_id, error) for blocks whose identifiers or qualities are discarded where the archive says they aren't, or the other way round."""
    found = []
    for stream, mode in (("ids", id_mode), ("qual", quality_mode)):
        raw = F.shiftright(F.col(f"codec_{stream}").cast("int"), 4) == codecs.FAMILIES["raw"]
        found.append(blocks.where(raw != F.lit(mode == "discard")).select("block_id", F.lit(f"the codec of {stream} contradicts the mode {mode}").alias("error")))
    return found[0].unionByName(found[1])


def index_mismatches(index: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block_id, error) where an index of (block_id, archive_id_start, read_count) and the blocks' own headers differ."""
    own = blocks.select("block_id", F.col("archive_id_start").alias("start_"), F.col("read_count").alias("count_"))
    both = index.join(own, "block_id", "full")
    error = F.when(F.col("start_").isNull(), "no such block").when(F.col("archive_id_start").isNull(), "not in the index").when(F.col("archive_id_start") != F.col("start_"), "another first read").when(F.col("read_count") != F.col("count_"), "another number of reads")
    return both.select("block_id", error.alias("error")).where("error is not null")


def archive_stats(blocks: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """One row of reads, blocks, compressed and largest bytes of a block; with reads given (bases) also bases, raw bytes, ratio and bits a base."""
    sizes = stream_sizes(blocks).agg(F.coalesce(F.sum("read_count"), F.lit(0)).alias("reads"), F.count("*").alias("blocks"), F.coalesce(F.sum("compressed_size"), F.lit(0)).alias("compressed_bytes"), F.coalesce(F.max("compressed_size"), F.lit(0)).alias("largest_block"))
    if bases is None:
        return sizes
    n = F.length("sequence")
    raw = bases.agg(F.coalesce(F.sum(n), F.lit(0)).alias("bases"), F.coalesce(F.sum(F.length("id") + F.length("comment") + 2 * n + 6 + (F.col("comment") != "").cast("int")), F.lit(0)).alias("raw_bytes"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return sizes.crossJoin(F.broadcast(raw)).withColumn("ratio", ratio(F.col("raw_bytes"), F.col("compressed_bytes"))).withColumn("bits_per_base", ratio(8 * F.col("compressed_bytes"), F.col("bases")))


def throughput(stats: dict, seconds: float) -> dict:
    """Ratio and MB of raw reads a second; 0 where nothing was done."""
    return {"ratio": stats["raw_bytes"] / stats["compressed_bytes"] if stats["compressed_bytes"] else 0.0, "mb_per_second": stats["raw_bytes"] / 1e6 / seconds if seconds > 0 else 0.0}


def ingest_estimate(reads: DataFrame):
    return reads.agg((2 * F.sum(F.length("id") + F.length("comment") + F.length("sequence") + F.length("quality") + 128)).alias("peak_bytes"))


def admit(reads: DataFrame, limit_bytes: int) -> DataFrame:
    """The reads, if all of them may be held within the limit; an error before any of them is used otherwise."""
    if (reads.transform(ingest_estimate).first()[0] or 0) > limit_bytes:
        raise ResourceError("the reads need more memory than the limit allows")
    return reads


def running_estimate(reads: DataFrame) -> DataFrame:
    """(block, peak_bytes): what ingest needs once each block of 10,000 reads is in; one row a block is summed up in order."""
    each = reads.groupBy(F.floor(F.col("read_idx") / 10_000).alias("block")).agg((2 * F.sum(F.length("id") + F.length("comment") + F.length("sequence") + F.length("quality") + 128)).alias("own"))
    return each.select("block", F.sum("own").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)).alias("peak_bytes"))


def global_checksum(blocks: DataFrame, flags: int) -> str:
    """XXH64 over the flags and the XXH64 of each block's streams in block order: blocks are hashed where they are, 8 bytes each are folded on the driver."""

    def run(batches):
        for b in batches:
            sums = []
            for i in range(b.num_rows):
                h = xxhash.xxh64(seed=0)
                for c in container.STREAMS:
                    h.update(b.column(f"{c}_data")[i].as_buffer())
                sums.append(h.digest())
            yield pa.RecordBatch.from_arrays([b.column("block_id"), pa.array(sums, pa.binary())], names=["block_id", "sum"])

    h = xxhash.xxh64(struct.pack("<Q", flags), seed=0)
    for r in blocks.select("block_id", *(f"{c}_data" for c in container.STREAMS)).mapInArrow(run, "block_id int, sum binary").orderBy("block_id").toLocalIterator():
        h.update(bytes(r["sum"]))
    return h.hexdigest()


def write_archive(reads: DataFrame, path: str, mode: str = "errorifexists", limit_bytes: int | None = None, reorder_map: DataFrame | None = None, filename: str = "", paired: bool = False, pe_layout: str = "interleaved", streaming: bool = False, requested_block: int = 0, max_block_bases: int = 0, quality_mode: str = "none", id_mode: str = "tokenize", level: int = 5, quality_codec: str = "zstd", kind: str = "") -> None:
    """Writes a sibling folder whole, then renames it: what is at `path` is an old archive or a new one, never parts of both.

    An archive that is already there is an error unless `mode` is overwrite. kind: the length class, else found from all reads.
    """
    spark = reads.sparkSession
    if mode != "overwrite" and shared.exists(spark, path):
        raise SourceError(f"{path} is already there")
    if limit_bytes is not None:
        reads = admit(reads, limit_bytes)
    longest = 0
    if not kind or max_block_bases or not requested_block:
        stats = layout.length_stats(reads.select(F.length("sequence").alias("len"))).first()
        kind, longest = kind or (stats["length_class"] if stats["n"] else "short"), stats["max_length"] or 0
    size = layout.block_size(requested_block, kind, longest, max_block_bases)
    staged = f"{path.rstrip('/')}.part-{uuid.uuid4().hex}"
    try:
        ordered = reads
        if reorder_map is not None:
            reorder_map.write.parquet(f"{staged}/reorder_map")
            reorder_map = spark.read.schema(reorder_map.schema).parquet(f"{staged}/reorder_map")
            ordered = reads.join(reorder_map, reads.read_idx == reorder_map.orig_idx).select(F.col("archive_idx").alias("read_idx"), *READ_COLUMNS[1:])
        encode_blocks(ordered, size, kind, id_mode, quality_mode, quality_codec, level).write.parquet(f"{staged}/blocks")
        finish_archive(spark, staged, {"original_filename": filename, "is_paired": paired, "has_reorder_map": reorder_map is not None, "preserve_order": reorder_map is None, "streaming_mode": streaming, "quality_mode": quality_mode, "id_mode": id_mode, "pe_layout": pe_layout, "read_length_class": kind})
        commit(spark, staged, path)
    except BaseException:
        shared.remove(spark, staged)
        raise


def finish_archive(spark: SparkSession, path: str, says: dict) -> None:
    """Writes the manifest over the blocks that are at `path`: a folder without one is no archive."""
    blocks = spark.read.schema(schema.BLOCK).parquet(f"{path}/blocks")
    bits = fn.flags(int(says["is_paired"]), int(says["preserve_order"]), schema.QUALITY_MODES.index(says["quality_mode"]), schema.ID_MODES.index(says["id_mode"]), int(says["has_reorder_map"]), schema.PE_LAYOUTS.index(says["pe_layout"]), schema.LENGTH_CLASSES.index(says["read_length_class"]), int(says["streaming_mode"]))
    flags = spark.range(1).select(bits.alias("f")).first()["f"]
    count = blocks.agg(F.coalesce(F.sum("read_count"), F.lit(0)).alias("total_reads"), F.count("*").alias("num_blocks")).first()
    full = says | {"total_reads": count["total_reads"], "num_blocks": count["num_blocks"], "flags": flags, "global_checksum": global_checksum(blocks, flags)}
    row = [F.current_timestamp().alias(c) if c == "created" else F.lit(full[c]).cast(t).alias(c) for c, t in (f.split() for f in schema.MANIFEST.split(", "))]
    spark.range(1).select(*row).coalesce(1).write.parquet(f"{path}/manifest")


def commit(spark: SparkSession, staged: str, path: str) -> None:
    """Renames the staged folder to `path`; an old one steps aside first and goes when the new one is in place, or comes back."""
    if not shared.exists(spark, path):
        shared.rename(spark, staged, path)
        return
    aside = f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    shared.rename(spark, path, aside)
    try:
        shared.rename(spark, staged, path)
    except BaseException:
        shared.rename(spark, aside, path)
        raise
    shared.remove(spark, aside)


def commit_mates(spark: SparkSession, staged: tuple[str, str], paths: tuple[str, str]) -> None:
    """First the one mate's output, then the other's; a failure between leaves the first in place."""
    for a, b in zip(staged, paths, strict=True):
        commit(spark, a, b)


def info(spark: SparkSession, path: str) -> DataFrame:
    if not shared.exists(spark, f"{path}/manifest"):
        raise UnsupportedFormat(f"{path} has no manifest")
    return spark.read.schema(schema.MANIFEST).parquet(f"{path}/manifest")


def info_from_flags(manifest: DataFrame) -> DataFrame:
    """What an archive's flags say, beside what its manifest does."""
    flag = lambda low, width=1: fn.flag(F.col("flags"), low, width)
    pick = lambda names, low: F.element_at(F.array(*map(F.lit, names)), (flag(low, 2) + 1).cast("int"))
    return manifest.select("total_reads", "num_blocks", (flag(0) == 1).alias("is_paired"), (flag(1) == 1).alias("preserve_order"), pick((*schema.QUALITY_MODES,), 3).alias("quality_mode"), pick((*schema.ID_MODES, None), 5).alias("id_mode"), (flag(7) == 1).alias("has_reorder_map"), pick((*schema.PE_LAYOUTS, None, None), 8).alias("pe_layout"), pick((*schema.LENGTH_CLASSES, None), 10).alias("read_length_class"), (flag(12) == 1).alias("streaming_mode"))


def check_archive(spark: SparkSession, path: str, budget: admission.DecodeBudget | None = None) -> DataFrame:
    """(block_id, error): structure, index, modes and sizes of an archive's blocks, and its checksum as block -1; no stream is decoded."""
    head = info(spark, path).first()
    blocks = spark.read.schema(schema.BLOCK).parquet(f"{path}/blocks")
    found = structure_errors(blocks, head["total_reads"]).unionByName(contradictions(blocks, head["quality_mode"], head["id_mode"]))
    if budget:
        budget.check_reads(head["total_reads"])
        found = found.unionByName(stream_sizes(blocks).where(3 * F.col("compressed_size") > budget.limit).select("block_id", F.lit("its decoding needs more than the limit").alias("error")))
    if global_checksum(blocks, head["flags"]) != head["global_checksum"]:
        found = found.unionByName(spark.createDataFrame([(-1, "the archive's checksum does not match")], "block_id int, error string"))
    return found


def read_archive(spark: SparkSession, path: str, text_range: str = "", original_order: bool = False, skip_corrupted: bool = False, placeholder: str = "", budget: admission.DecodeBudget | None = None) -> DataFrame:
    """Reads of an archive; blocks outside the range are pruned before they are decoded. A budget refuses what it doesn't allow before any decoding."""
    head = info(spark, path).first()
    blocks = spark.read.schema(schema.BLOCK).parquet(f"{path}/blocks")
    if budget:
        largest = archive_stats(blocks).first()["largest_block"]
        budget.check_reads(head["total_reads"])
        budget.check_block(largest)
        if original_order:
            budget.check_original_order(head["total_reads"], largest)
    reads = layout.in_range(decode_blocks(layout.touching(blocks, text_range), skip_corrupted, placeholder), text_range)
    if not original_order:
        return reads
    if not head["has_reorder_map"]:
        raise FormatError("the archive has no reorder map")
    order_map = spark.read.parquet(f"{path}/reorder_map")
    return reads.join(order_map, reads.read_idx == order_map.archive_idx).select(F.col("orig_idx").alias("read_idx"), *READ_COLUMNS[1:])
