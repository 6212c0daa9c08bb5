"""What the corpus operators share: tables, scratch space, hashing, components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches stay small because one text may be very long.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
}
#: Removes a query's shuffle files when it ends. Only writes ask for it, as they end with the query: a table that
#: is read row by row afterwards (toLocalIterator) would lose its files while it is read, and with them, silently, rows.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_kept: dict = {}
_roots: dict[str, str] = {}


def tune(spark: SparkSession) -> None:
    """Session settings the operators do best with. What the session has set itself stays as it is.

    They are not taken back, as results are computed after an operator has returned.
    """
    have = spark.conf.getAll
    for key, value in SETTINGS.items():
        if key not in have:
            spark.conf.set(key, value)


def worker_cache(owner: str) -> dict:
    """The caches of one operator in this process. Spark keeps Python workers for later
    stages, so another operator's caches are dropped and their memory is given back first.
    """
    if owner not in _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
        _kept[owner] = {}
    return _kept[owner]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, removed when the driver's JVM ends.

    Where that is unset, a temporary folder serves a local session; on a cluster,
    whose executors couldn't see one, it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='helixframe-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    key = f"{root} {spark.sparkContext.applicationId}"
    if key not in _roots:
        _roots[key] = f"{root.rstrip('/')}/helixframe-{uuid.uuid4().hex}"
        where = spark._jvm.org.apache.hadoop.fs.Path(_roots[key])
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)  # also after spark.stop()
    return _roots[key]


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder name in the shared folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def cleanup(spark: SparkSession):
    """Shuffle files of the writes within go when each write ends. What the session has set itself stays as it is."""
    own = CLEANUP in spark.conf.getAll
    if not own:
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if not own:
            spark.conf.unset(CLEANUP)


def store(df: DataFrame, label: str, **options) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here, and the write's shuffle files go with it."""
    spark = df.sparkSession
    path = scratch(spark, label)
    with cleanup(spark):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(*stored: DataFrame) -> None:
    """Removes the files of stored tables that nothing reads any more."""
    for df in stored:
        drop(df.sparkSession, df.scratch_path)


def held_out(doc_id):
    """True where crc32(doc_id as text) mod 3 is 1: rows no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for undirected edges (src, dst) of bigint; component is the smallest node.

    Alternating large-star and small-star rounds, each written to the shared
    folder, so a lost executor costs one round at most, until a round changes
    nothing: a logarithmic number of rounds, squared at worst, which no limit cuts short.
    Null ends and self loops are ignored; no edges give an empty result. Hubs
    are safe: minima are combined map-side, and the joins back, both of whose
    sides are dealt out for them alone, can be split for skew.
    """
    spark = edges.sparkSession
    now = store(
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
        .distinct(),
        "edges",
    )
    mark, done = _mark(now), False
    while mark[0] and not done:
        both = now.select("hi", "lo").union(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select((F.col("hi") + 0).alias("u"), F.least("hi", "m").alias("m"))
        large = both.where("lo > hi").join(least, F.col("hi") == F.col("u")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        large = store(large.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), "edges")
        # the smallest node of a star keeps its own edges through the mirrored rows above
        small_min = large.groupBy("hi").agg(F.min("lo").alias("m")).select((F.col("hi") + 0).alias("u"), "m")
        joined = large.join(small_min, F.col("hi") == F.col("u"))
        small = joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(small_min.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
        new = store(small.distinct(), "edges")
        new_mark = _mark(new)
        forget(now, large)
        now, done, mark = new, new_mark == mark, new_mark
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    out = now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
    out.scratch_path = now.scratch_path
    return out


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return row[0], row[1]
