"""Reads derived from the driver's tables: orders gives one read a row, o_orderkey its position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import shared

HEX = "0123456789abcdef"
BASES, BASES_N, QUALITY = "ACGTACGTACGTACGT", "ACGTACGTACGTACGN", "#(-27;=?ACEFGHIJ"


SPREAD_BYTES = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """A scan is dealt out before expensive expressions, as a row costs far more than its few bytes: to each core, each of its splits to eight tasks, and large splits to more."""
    least = max(df.sparkSession.sparkContext.defaultParallelism, 8 * df.rdd.getNumPartitions())
    return df.repartition(shared.parts(df, SPREAD_BYTES, least))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 bases each."""
    return as_reads(spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")))


def as_reads(orders: DataFrame) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    digest = lambda c: F.md5(c.cast("string").cast("binary"))
    return orders.select(
        key.alias("read_idx"),
        F.concat(F.lit("SIM:1:FC:"), (cust % 8).cast("string"), F.lit(":"), cust.cast("string"), F.lit(":"), key.cast("string")).alias("id"),
        F.concat((1 + key % 2).cast("string"), F.lit(":N:0:"), "o_orderstatus").alias("comment"),
        F.translate(F.concat(digest(cust), digest(cust + 1)), HEX, BASES).alias("sequence"),
        F.translate(F.concat(digest(key), digest(key + 7)), HEX, QUALITY).alias("quality"),
    )


def varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 to 64 bases; As of every 50th read are N, and every 100th has lower-case g and the code R for C."""
    n = F.expr("cast(32 + read_idx % 33 as int)")
    seq = F.substring("sequence", F.lit(1), n)
    seq = F.when(F.col("read_idx") % 50 == 0, F.translate(seq, "A", "N")).otherwise(seq)
    seq = F.when(F.col("read_idx") % 100 == 0, F.translate(seq, "GC", "gR")).otherwise(seq)
    return reads(spark, sf_dir).select("read_idx", "id", "comment", seq.alias("sequence"), F.substring("quality", F.lit(1), n).alias("quality"))


SQL = f"""with reads as (select o_orderkey as read_idx,
  concat('SIM:1:FC:', cast(o_custkey % 8 as varchar), ':', cast(o_custkey as varchar), ':', cast(o_orderkey as varchar)) as id,
  concat(cast(1 + o_orderkey % 2 as varchar), ':N:0:', o_orderstatus) as comment,
  translate(concat(md5(cast(o_custkey as varchar)), md5(cast(o_custkey + 1 as varchar))), '{HEX}', '{BASES}') as sequence,
  translate(concat(md5(cast(o_orderkey as varchar)), md5(cast(o_orderkey + 7 as varchar))), '{HEX}', '{QUALITY}') as quality from orders),
cut as (select read_idx, id, comment, substr(sequence, 1, cast(32 + read_idx % 33 as int)) as s, substr(quality, 1, cast(32 + read_idx % 33 as int)) as quality from reads),
varied as (select read_idx, id, comment, case when read_idx % 100 = 0 then translate(translate(s, 'A', 'N'), 'GC', 'gR')
  when read_idx % 50 = 0 then translate(s, 'A', 'N') else s end as sequence, quality from cut)
"""
