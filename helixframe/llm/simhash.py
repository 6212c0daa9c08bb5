"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most 2h bits apart have a common variant at most h bits
from both, so each distinct fingerprint emits all its variants within h bits,
the variants are shuffled, and fingerprints that meet on a variant are linked.
Any two that meet are at most 2h bits apart, so a star from the smallest one of
a meeting carries every link's connectivity without emitting a group's pairs;
the distance of every link is verified, which matters for odd radii.

There are 2081 variants for h = 2. They are packed into sorted binary blocks
of ten bytes a variant and dealt in passes by parities of their bits, each
pass a job whose shuffle files go when it ends; a pass makes its own share of the
variants and needs disk for that.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import cleanup, connected_components, forget, scratch, store, worker_cache

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of variants a task gathers for one bucket, and fingerprints that one task expands.
BUCKET_BYTES, CHUNK = 16 << 20, 2048
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
WHITE = {i: 32 for i in range(9, 14)}


def words_of(text: str) -> list[str]:
    """A-Z lower-cased, cut at space and the characters 9 to 13."""
    return list(filter(None, text.translate(ASCII_LOWER | WHITE).split(" ")))


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash over shingles, repeats included; 0 if there is no word."""
    words = words_of(text) if text else ()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(" ".join(words).encode(), 42)]
    else:
        line = " ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-shingle].tolist()]
        ends = (ends[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts, ends, strict=True)]
    h = np.array(hashes, np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        counts += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(h)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed bigint. Null texts count as empty."""

    def run(batches):
        worker_cache("simhash")
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def flips(half: int) -> np.ndarray:
    """All masks of at most `half` of 64 bits."""
    return np.array([sum(1 << i for i in c) for k in range(half + 1) for c in combinations(range(64), k)], np.uint64)


def parities(values: np.ndarray, bits: int) -> np.ndarray:
    """`bits` parities of fixed halves of the 64 bits, as one number; that of a ^ b is the one of a ^ that of b."""
    halves = np.random.default_rng(11).integers(0, 1 << 63, bits, np.uint64) * np.uint64(2) + np.uint64(1)
    odd = [np.bitwise_count(values & h) & np.uint8(1) for h in halves]
    return sum((o.astype(np.int64) << i for i, o in enumerate(odd)), np.zeros(values.shape, np.int64))


def meetings(v: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """Links (rows of two fingerprints) from the fingerprints `fp` that emitted the variants `v`.

    Of those that meet on a variant, any is within the radius of one that is at most
    radius // 2 bits from the variant; the smallest such is linked with all others,
    and each link's distance is verified.
    """
    half = (radius + 1) // 2
    order = np.argsort(v)
    v, fp = v[order], fp[order]
    del order
    heads = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, len(v)))
    met = np.repeat(sizes > 1, sizes)
    signed = fp.view(np.int64)
    # for an even radius all are near enough to be the middle; for an odd one those half bits off are not
    middle = signed if radius % 2 == 0 else np.where(np.bitwise_count(v ^ fp) < half, signed, np.int64(2**63 - 1))
    least = np.repeat(np.minimum.reduceat(middle, heads) if len(v) else signed, sizes)[met]
    signed = signed[met]
    near = np.bitwise_count((signed ^ least).view(np.uint64)) <= radius
    pairs = np.stack([signed, least], 1)[near & (signed != least)]
    return np.unique(pairs, axis=0) if len(pairs) else np.zeros((0, 2), np.int64)


def ball_edges(points: DataFrame, radius: int = 4, pass_bits: int = 3) -> DataFrame:
    """Links (src, dst) that connect all distinct fingerprints at most `radius` bits apart; points: a stored (fp).

    No link is longer than the radius. There are 2 ** pass_bits passes; a variant's
    parities tell its pass, so each pass makes its own share of the variants only.
    """
    spark, half, passes = points.sparkSession, (radius + 1) // 2, 1 << pass_bits
    masks = flips(half)
    if len(masks) > 65_536:
        raise ValueError("the radius gives more variants than a two-byte code can name")
    kind_of_mask = parities(masks, pass_bits)
    total = points.count()
    buckets = max(1, -(-total * len(masks) * 10 // (passes * BUCKET_BYTES)))
    deal = points.repartition(max(spark.sparkContext.defaultParallelism, -(-total // (4 * CHUNK))), "fp")
    deal = store(deal, "simhash-points")
    path = scratch(spark, "simhash-links")

    def expand(which):
        def run(batches):
            codes = [np.flatnonzero(kind_of_mask == k).astype(np.uint16) for k in range(passes)]
            for b in batches:
                fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                for i in range(0, len(fps), CHUNK):
                    part = fps[i : i + CHUNK]
                    kinds = parities(part, pass_bits)
                    v, code = [], []
                    for k in range(passes):
                        own = part[kinds == k]
                        mine = codes[which ^ k]
                        v.append((own[:, None] ^ masks[mine][None, :]).ravel())
                        code.append(np.tile(mine, len(own)))
                    v, code = np.concatenate(v), np.concatenate(code)
                    if not len(v):
                        continue
                    mixed = (v * MIX) >> np.uint64(40)  # 24 bits
                    slot = ((mixed * np.uint64(buckets)) >> np.uint64(24)).astype(np.uint32)
                    order = np.argsort(slot, kind="stable")
                    v, code, slot = v[order], code[order], slot[order]
                    heads = np.flatnonzero(np.diff(slot, prepend=np.uint32(0xFFFFFFFF)))
                    tails = [*heads[1:].tolist(), len(slot)]
                    cut = list(zip(heads.tolist(), tails, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slot[heads].astype(np.int64), pa.int64()), pa.array([v[a:z].tobytes() for a, z in cut], pa.binary()), pa.array([code[a:z].tobytes() for a, z in cut], pa.binary())],
                        names=["bucket", "variants", "codes"],
                    )

        return run

    def meet(t: pa.Table) -> pa.Table:
        v = np.frombuffer(b"".join(t.column("variants").to_pylist()), np.uint64)
        fp = v ^ masks[np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint16)]
        pairs = meetings(v, fp, radius)
        return pa.table({"src": pa.array(pairs[:, 0], pa.int64()), "dst": pa.array(pairs[:, 1], pa.int64())})

    for which in range(passes):
        found = deal.mapInArrow(expand(which), "bucket bigint, variants binary, codes binary").groupBy("bucket").applyInArrow(meet, "src bigint, dst bigint")
        with cleanup(spark):
            found.distinct().write.mode("append").parquet(path)
    forget(deal)
    out = spark.read.schema("src bigint, dst bigint").parquet(path).distinct()
    out.scratch_path = path
    return out


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, pass_bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable by links of at most `radius` bits.

    Null and empty texts have fingerprint zero and are linked like any other.
    Equal fingerprints are collapsed before any variant is made, so thousands of
    copies cost one point. Repeated rows are kept; a null doc_id never names a
    component unless all of its members are null. Extra columns are ignored;
    an empty table gives an empty result.
    """
    rows = store(fingerprints(docs, shingle), "simhash-rows")
    points = store(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    links = ball_edges(points.select("fp"), radius, pass_bits)
    found = connected_components(links)
    forget(links)
    rooted = points.join(found, points.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = store(rooted.select("fp", "root").join(names, "root").select(F.col("fp").alias("p"), "component_id"), "simhash-names")
    forget(points, found)
    return rows.join(named, rows.fp == named.p, "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """Rows of docs without those whose doc_id does not name their component: one document of each group stays.

    Rows with a null doc_id are kept. Repeated rows with the same doc_id stay together.
    The dropped ids are written first, so their real size decides how they are joined.
    """
    found = near_duplicates(docs, shingle, radius).where("doc_id <> component_id")
    gone = store(found.select(F.col("doc_id").alias("gone_id")).distinct(), "simhash-gone")
    return docs.join(gone, docs.doc_id == gone.gone_id, "left_anti")


def hex_fingerprint(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
