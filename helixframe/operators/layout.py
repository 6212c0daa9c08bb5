"""Pairs, blocks, ranges and orders of reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe import schema
from helixframe.errors import UsageError
from helixframe.operators import shared


def zip_mates(r1: DataFrame, r2: DataFrame, strict: bool = True) -> DataFrame:
    """Mates by position; with strict a missing mate is an error."""
    cols = [c for c in r1.columns if c != "read_idx"]
    a = r1.select(F.col("read_idx").alias("pair_idx"), *(F.col(c).alias(f"{c}_1") for c in cols), F.lit(True).alias("have_1"))
    b = r2.select(F.col("read_idx").alias("pair_idx"), *(F.col(c).alias(f"{c}_2") for c in cols), F.lit(True).alias("have_2"))
    both = a.join(b, "pair_idx", "full")
    if strict:
        missing = F.raise_error(F.concat(F.lit("pair "), (F.col("pair_idx") + 1).cast("string"), F.lit(" has one mate only")))
        both = both.withColumn("pair_idx", F.when(F.col("have_1").isNull() | F.col("have_2").isNull(), missing).otherwise(F.col("pair_idx")))
    return both.drop("have_1", "have_2")


def arrange(pairs: DataFrame, layout: str) -> DataFrame:
    """Reads of zipped pairs with read_idx by layout: mates side by side, or all first mates before all second ones."""
    cols = [c[:-2] for c in pairs.columns if c.endswith("_1")]
    each = F.array(*(F.struct(F.lit(m).alias("mate"), *(F.col(f"{c}_{m}").alias(c) for c in cols)) for m in (1, 2)))
    rows = pairs.select("pair_idx", F.explode(each).alias("r")).select("pair_idx", "r.*")
    if layout == "interleaved":
        idx = F.col("pair_idx") * 2 + F.col("mate") - 1
    elif layout == "consecutive":
        n = pairs.count()
        idx = F.col("pair_idx") + (F.col("mate") - 1) * n
    else:
        raise UsageError(f"no such layout: {layout}")
    return rows.select(idx.cast("bigint").alias("read_idx"), "mate", "pair_idx", *cols)


def mate_of(layout: str, total: int) -> Column:
    idx = F.col("read_idx")
    return (idx % 2 + 1 if layout == "interleaved" else F.when(idx < total // 2, 1).otherwise(2)).cast("int")


def blocked_consecutive(pairs: DataFrame, block_reads: int) -> DataFrame:
    """Reads of zipped pairs by blocks: within a block all its first mates, then its second ones.

    Blocks hold an even number of reads, so that mates stay in one block; the half of a block tells them apart again.
    """
    per = max(1, block_reads // 2)
    cols = [c[:-2] for c in pairs.columns if c.endswith("_1")]
    in_block = Window.partitionBy("block_id")
    rows = pairs.withColumn("block_id", F.floor(F.col("pair_idx") / per).cast("int")).withColumn("k", F.count("*").over(in_block)).withColumn("first", F.min("pair_idx").over(in_block))
    each = F.array(*(F.struct(F.lit(m).alias("mate"), *(F.col(f"{c}_{m}").alias(c) for c in cols)) for m in (1, 2)))
    rows = rows.select("block_id", "k", "first", "pair_idx", F.explode(each).alias("r")).select("block_id", "k", "first", "pair_idx", "r.*")
    idx = F.col("first") + F.col("pair_idx") + (F.col("mate") - 1) * F.col("k")
    return rows.select(idx.cast("bigint").alias("read_idx"), "block_id", "mate", "pair_idx", *cols)


def reorder_allowed(enabled: bool, kind: str, paired: bool) -> bool:
    """Only single short reads are ever reordered."""
    return enabled and kind == "short" and not paired


def default_stats(mode: str) -> tuple[str, int]:
    """Length class and length that are taken for granted where the input can't be looked at first."""
    n = schema.DEFAULT_LENGTH[mode]
    return length_class(n, n), n


def parse_range(text: str) -> tuple[int | None, int | None]:
    """1-based inclusive ends; `n` is n alone, 0 and nothing are open ends."""
    if ":" not in text:
        n = int(text or 0)
        return (n, n) if n else (None, None)
    low, _, high = text.partition(":")
    return int(low or 0) or None, int(high or 0) or None


def in_range(reads: DataFrame, text: str) -> DataFrame:
    low, high = parse_range(text)
    if low:
        reads = reads.where(F.col("read_idx") >= low - 1)
    return reads.where(F.col("read_idx") <= high - 1) if high else reads


def with_blocks(reads: DataFrame, size: int) -> DataFrame:
    return reads.withColumn("block_id", F.floor(F.col("read_idx") / size).cast("int")).withColumn("pos_in_block", F.col("read_idx") % size)


def block_index(reads: DataFrame, size: int) -> DataFrame:
    """block_id, archive_id_start, read_count, uniform_read_length (0 if lengths differ)."""
    n = F.length("sequence")
    return with_blocks(reads, size).groupBy("block_id").agg(F.min("read_idx").alias("archive_id_start"), F.count("*").alias("read_count"), F.when(F.min(n) == F.max(n), F.min(n)).otherwise(0).alias("uniform_read_length"))


def starts(blocks: DataFrame) -> DataFrame:
    """archive_id_start from the counts of the blocks before; one row a block, so one window is small."""
    before = Window.orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("archive_id_start", F.coalesce(F.sum("read_count").over(before), F.lit(0)))


def touching(index: DataFrame, text: str) -> DataFrame:
    low, high = parse_range(text)
    keep = F.lit(True)
    if low:
        keep &= F.col("archive_id_start") + F.col("read_count") >= low
    if high:
        keep &= F.col("archive_id_start") <= high - 1
    return index.where(keep)


RANK_BYTES = 2 << 20


def similarity_order(keys: DataFrame) -> DataFrame:
    """reorder map (orig_idx, archive_idx): reads by least minimizer, length and position, from `similarity.order_keys`.

    Reads with nothing in common end up side by side only at group borders. Ranks
    come from a range partitioning and the counts of the partitions before. The keys are
    written first, as the ranges are sampled: they would be found twice.
    """
    spark = keys.sparkSession
    path = shared.folder(spark, "order-keys")
    keys.write.parquet(path)
    order = ranked(spark.read.schema(keys.schema).parquet(path), ["h", "len", "orig_idx"])
    shared.remove(spark, path)
    return order.select("orig_idx", F.col("rank").alias("archive_idx"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with their 0-based rank in a total order, by one range shuffle to partitions whose number grows with the rows.

    The sorted rows are written with their place in their partition; the counts of the partitions, a row
    each, give every partition its offset.
    """
    spark = rows.sparkSession
    path = shared.folder(spark, "ranked")
    place = F.monotonically_increasing_id()
    n = shared.parts(rows, RANK_BYTES, spark.sparkContext.defaultParallelism)
    split = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.shiftright(place, 33).alias("_p"), place.bitwiseAND((1 << 33) - 1).alias("_r"))
    split.write.parquet(path)
    split = spark.read.schema(split.schema).parquet(path)
    base = split.groupBy("_p").agg((F.max("_r") + 1).alias("_n"))
    base = base.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return split.join(F.broadcast(base), F.col("_p") == F.col("_q")).withColumn("rank", F.col("_b") + F.col("_r")).drop("_p", "_q", "_r", "_b")


def reorder(reads: DataFrame, order: DataFrame) -> DataFrame:
    return reads.join(order, F.col("read_idx") == F.col("orig_idx")).drop("orig_idx")


def length_class(median: int, longest: int) -> str:
    if longest >= schema.LONG_MIN_LENGTH:
        return "long"
    return "medium" if longest > schema.SHORT_MAX_LENGTH or median >= schema.MEDIUM_MEDIAN else "short"


def block_size(requested: int, kind: str, longest: int, max_bases: int = 0) -> int:
    if requested > 0:
        return requested
    size = schema.BLOCK_READS["short" if longest < schema.SHORT_MAX_LENGTH else kind]
    if max_bases > 0 and kind != "short":
        size = min(size, max(1, max_bases // max(1, longest)))
    return size


def class_column(median, longest) -> Column:
    return F.when(longest >= schema.LONG_MIN_LENGTH, "long").when((longest > schema.SHORT_MAX_LENGTH) | (median >= schema.MEDIUM_MEDIAN), "medium").otherwise("short")


def length_stats(lengths: DataFrame) -> DataFrame:
    """One row of n, mean (floor), median (the upper one), longest, length_class from rows of (len).

    The lengths are counted first, so the median needs one row for each distinct length.
    """
    counts = lengths.groupBy("len").agg(F.count("*").alias("c"))
    w = Window.orderBy("len").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy()))
    return upto.agg(
        F.max("n").alias("n"),
        F.expr("sum(len * c) div max(n)").alias("mean_length"),
        F.min(F.when(F.col("upto") >= F.expr("n div 2 + 1"), F.col("len"))).alias("median_length"),
        F.max("len").alias("max_length"),
    ).withColumn("length_class", class_column(F.col("median_length"), F.col("max_length")))
