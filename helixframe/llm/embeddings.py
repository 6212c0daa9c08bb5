"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosine, components.

Equal vectors are collapsed first. Each distinct vector gets one signature in
each of several tables; vectors that share a signature meet in a bucket, where
cosines are computed in double precision. A pair that meets in several tables
counts in the first. Tables are worked off one by one, each a job whose shuffle
files go when it ends, so disk never holds the vectors once for each table. A
bucket of many bytes is cut into chunks and every pair of chunks is a unit of
work, so no task holds a whole hot bucket and no pair is lost; units emit sums
and spanning links, never their pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import cleanup, connected_components, forget, scratch, store

#: Bytes of vectors in a chunk of a bucket, and of rows that a task gathers.
CHUNK_BYTES, UNIT_BYTES = 1 << 20, 16 << 20


def plan_tables(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """Bits per table and number of tables: buckets of about 32 by chance; a pair at the bound is found with probability `recall`."""
    bits = min(24, max(4, round(math.log2(max(1, n) / 32))) if n > 32 else 4)
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def signatures(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    planes = np.random.default_rng([7, vectors.shape[1]]).standard_normal((vectors.shape[1], bits * tables))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return (signs @ (1 << np.arange(bits))).astype(np.int32)


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label, by which each member points to the smallest of its group, after the links i, j."""
    while len(i):
        a, b = label[i], label[j]
        far = a != b
        i, j, a, b = i[far], j[far], a[far], b[far]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def verify(x: np.ndarray, sig: np.ndarray, t: int, copies: np.ndarray, split: int, cosine: float):
    """Partner counts and local component labels of one bucket in table t. split: if not 0, only pairs of a row before it and one from it on count."""
    m = len(x)
    norms = np.sqrt((x * x).sum(axis=1))
    counts, label = np.zeros(m, np.int64), np.arange(m)
    end = split or m
    step = max(1, 1_000_000 // (m - split))
    for a in range(0, end, step):
        z = min(end, a + step)
        i, j = np.nonzero((x[a:z] @ x[split:].T) / (norms[a:z, None] * norms[None, split:]) >= cosine)
        i, j = i + a, j + split
        if not split:
            i, j = i[i < j], j[i < j]
        label = merge(label, i, j)
        if t:
            fresh = np.concatenate([~(sig[p, :t] == sig[q, :t]).any(axis=1) for p, q in ((i[b : b + 65_536], j[b : b + 65_536]) for b in range(0, len(i) or 1, 65_536))])
            i, j = i[fresh], j[fresh]
        counts += np.bincount(i, copies[j], m).astype(np.int64) + np.bincount(j, copies[i], m).astype(np.int64)
    return counts, label


def near_duplicates(rows: DataFrame, cosine: float = 0.95, recall: float = 0.999, chunk: int = 1 << 30) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding).

    Vectors that are null, zero, or hold nulls or values that are not finite link with
    nothing; vectors of different length never link. A pair with cosine at least
    `cosine` is found with probability `recall` or more; none below it is ever
    reported. Repeated rows are vectors of their own; component_id is the smallest
    vec_id reachable; a null vec_id names a component only where all its members are null, and such
    rows are not kept. Vectors are equal if 128 bits of hash are. A chunk of a bucket has `chunk` rows at most,
    and CHUNK_BYTES. Other columns are ignored; an empty table gives no rows. The work on different vectors
    that are all near each other grows with the square of their number, as their links do.
    """
    spark = rows.sparkSession
    single = dict(rows.dtypes)["embedding"] == "array<float>"  # such vectors travel as they are, and are widened where they are compared
    kind = np.dtype(np.float32 if single else np.float64)
    usable = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    read = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"))
    read = read.select("vec_id", "v", usable.alias("good"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    own = store(read.drop("v"), "embedding-rows")
    bits, tables = plan_tables(own.where("good").agg(F.approx_count_distinct("h1")).first()[0], cosine, recall)

    def sign(batches):
        for b in batches:
            v, out = b.column("v"), [None] * b.num_rows
            flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))
            lists = np.split(flat, ends[:-1])
            dims = np.array([len(x) for x in lists])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                for i, s in zip(at.tolist(), signatures(np.stack([lists[i] for i in at]).astype(np.float64), bits, tables), strict=True):
                    out[i] = s.tolist()
            same = [b.column(c) for c in ("class_id", "h1", "h2", "least", "copies")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(dims, pa.int32()), pa.array([x.astype(kind).tobytes() for x in lists], pa.binary()), pa.array(out, pa.list_(pa.int32()))], names=["class_id", "h1", "h2", "least", "copies", "dim", "x", "sigs"])

    classes = read.where("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
    signed = classes.withColumn("class_id", F.monotonically_increasing_id()).mapInArrow(sign, "class_id bigint, h1 bigint, h2 bigint, least bigint, copies bigint, dim int, x binary, sigs array<int>")
    signed = store(signed, "embedding-signatures", compression="zstd")

    width = F.col("dim") * kind.itemsize
    sizes = signed.select("dim", F.posexplode("sigs").alias("t", "s")).groupBy("t", "s", "dim").count().where("count > 1")
    chunks = F.greatest(F.ceil(F.col("count") / chunk), F.ceil(F.col("count") * width / CHUNK_BYTES)).cast("int")
    sizes = store(sizes.withColumn("chunks", chunks), "embedding-buckets")
    gathered = {r["t"]: int(r["bytes"]) for r in sizes.groupBy("t").agg(F.sum(F.col("count") * F.col("chunks") * (width + 4 * tables + 64)).alias("bytes")).collect()}
    large = store(sizes.where("chunks > 1").select("t", F.col("s").alias("s_"), F.col("dim").alias("dim_"), "chunks"), "embedding-large")
    path = scratch(spark, "embedding-links")

    def meet(table):
        def run(t: pa.Table) -> pa.Table:
            ids, copies, s, dim, lo, hi, mine = (t.column(c).to_numpy() for c in ("class_id", "copies", "s", "dim", "lo", "hi", "mine"))
            order = np.lexsort((mine, hi, lo, dim, s))
            keys = np.stack([s, dim, lo, hi], 1)[order]
            heads = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
            x = t.column("x").combine_chunks()
            x = pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x
            flat = np.frombuffer(x.buffers()[2], kind)
            begins = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x)] // kind.itemsize
            sig = t.column("sigs").combine_chunks()
            sig = (pa.concat_arrays(sig.chunks) if isinstance(sig, pa.ChunkedArray) else sig).flatten().to_numpy().reshape(len(ids), tables)
            found: list[tuple] = []
            for a, z in zip(heads.tolist(), [*heads[1:].tolist(), len(keys)], strict=True):
                at = order[a:z]
                split = 0 if keys[a, 2] == keys[a, 3] else int((mine[at] == keys[a, 2]).sum())
                if z - a < 2 or keys[a, 2] != keys[a, 3] and split in (0, z - a):
                    continue
                vectors = flat[begins[at][:, None] + np.arange(keys[a, 1])].astype(np.float64)
                counts, label = verify(vectors, sig[at], table, copies[at], split, cosine)
                some = np.flatnonzero((counts > 0) | (label != np.arange(z - a)))
                found.append((ids[at][some], counts[some], ids[at][label[some]]))
            cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
            return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("src", "more", "dst"), cols, strict=True)})

        return run

    for t, size in sorted(gathered.items()):
        full = signed.select("class_id", "copies", "dim", "x", "sigs", F.col("sigs")[t].alias("s"))
        full = full.join(large.where(F.col("t") == t).drop("t"), (F.col("s") == F.col("s_")) & (F.col("dim") == F.col("dim_")), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        full = full.withColumn("mine", F.pmod(F.xxhash64("class_id"), F.col("chunks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        full = full.withColumn("lo", F.least("mine", "with")).withColumn("hi", F.greatest("mine", "with"))
        units = max(spark.sparkContext.defaultParallelism, -(-size // UNIT_BYTES))
        work = full.select("class_id", "copies", "dim", "x", "sigs", "s", "mine", "lo", "hi", F.pmod(F.xxhash64("s", "dim", "lo", "hi"), F.lit(units)).alias("unit"))
        with cleanup(spark):
            work.groupBy("unit").applyInArrow(meet(t), "src bigint, more bigint, dst bigint").write.mode("append").parquet(path)

    met = spark.read.schema("src bigint, more bigint, dst bigint").parquet(path) if gathered else spark.createDataFrame([], "src bigint, more bigint, dst bigint")
    found = connected_components(met.select("src", "dst"))
    links = met.groupBy("src").agg(F.sum("more").alias("more"))
    bare = signed.select("class_id", "h1", "h2", "least", "copies")
    rooted = bare.join(found, bare.class_id == found.node, "left").join(links, bare.class_id == links.src, "left")
    rooted = rooted.select("h1", "h2", "least", "copies", F.coalesce("more", F.lit(0)).alias("more"), F.coalesce("component", "class_id").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = store(rooted.join(names, "root").select(F.col("h1").alias("a"), F.col("h2").alias("b"), (F.col("copies") - 1 + F.col("more")).alias("n"), "component_id"), "embedding-result")
    forget(signed, sizes, large, found)
    out = own.join(known, F.col("good") & (own.h1 == known.a) & (own.h2 == known.b), "left")
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
