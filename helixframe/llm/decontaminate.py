"""Benchmark decontamination by SimHash of item-sized windows.

Every benchmark item has a 64-bit SimHash of its word shingles. Windows of a
text as long as an item are hashed the same way, looked up in a multi-index
(the fingerprint is cut into blocks; with radius r and b blocks some block
differs in at most r // b bits, and each block's table lists all items that
near), and candidates are verified by the exact weighted Jaccard similarity of
their shingle counts. Windows are hashed only where they can pass that last
test: a similarity of t needs 2t / (1 + t) of the window's shingles in the
benchmark, which prefix sums tell for all windows at once; this test loses no
match. A text shorter than an item is its own only window for that item.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import forget, scratch, store, worker_cache

WORD = re.compile(r"\w+")
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of hashes that one pass's index is made of, beside its number of items.
PASS_BYTES = 64 << 20
MATCHES = "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, similarity double"


class Hashes(dict):
    """Word to 64-bit hash; cleared when it is full. Words of more than 64 characters are not kept."""

    def __missing__(self, word):
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 5)
        if len(word) <= 64:
            if len(self) > 300_000:
                self.clear()
            self[word] = h
        return h


def word_hashes(text: str | None) -> np.ndarray:
    words = WORD.findall(text.lower()) if text else []
    hashes = worker_cache("decontamination").setdefault("hashes", Hashes())
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h ^ words[i : i + n]) * MULTIPLY
        h ^= h >> np.uint64(29)
    return h


def bit_sums(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def to_fingerprints(ones: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(2 * ones > n, axis=-1, bitorder="little").view(np.uint64).ravel()


class Index:
    """Benchmark items by window length, with their multi-index tables. items: (item_id, words, shingle hashes)."""

    def __init__(self, items: list[tuple[int, int, bytes]], shingle: int, similarity: float, radius: int, blocks: int):
        self.shingle, self.similarity, self.radius = shingle, similarity, radius
        self.cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
        self.sizes: dict[int, list] = {}
        known: dict[int, set] = {}
        for item, size, data in items:
            h = np.frombuffer(data, np.uint64)
            known.setdefault(min(shingle, size), set()).update(h.tolist())
            self.sizes.setdefault(size, []).append((item, Counter(h.tolist()), int(to_fingerprints(bit_sums(h).sum(axis=0), len(h))[0])))
        self.known = {k: np.array(sorted(v), np.uint64) for k, v in known.items()}
        near = radius // blocks
        self.tables = {}
        for size, group in self.sizes.items():
            tables = []
            for a, z in zip(self.cuts, self.cuts[1:], strict=False):
                masks = [sum(1 << b for b in c) for j in range(near + 1) for c in combinations(range(z - a), min(j, z - a))]
                t: dict[int, list[int]] = {}
                for i, (_, _, fp) in enumerate(group):
                    part = fp >> a & (1 << z - a) - 1
                    for m in set(masks):
                        t.setdefault(part ^ m, []).append(i)
                tables.append(t)
            self.tables[size] = tables

    def lookup(self, size: int, fp: int) -> list[int]:
        """All items of this size whose fingerprints are within the radius."""
        group, found = self.sizes[size], set()
        for t, a, z in zip(self.tables[size], self.cuts, self.cuts[1:], strict=False):
            found.update(t.get(fp >> a & (1 << z - a) - 1, ()))
        return [i for i in found if (group[i][2] ^ fp).bit_count() <= self.radius]

    def matches(self, words: int, stretches: list[tuple[int, int, bytes]]):
        """Best window for each item: (item_id, start word, words, similarity). stretches: (shingle length, first shingle, hashes) of one text of `words` words."""
        best: dict[int, tuple] = {}
        for k, first, data in stretches:
            if k not in self.known:
                continue
            h = np.frombuffer(data, np.uint64)
            j = np.minimum(np.searchsorted(self.known[k], h), len(self.known[k]) - 1)
            sums = np.concatenate(([0], np.cumsum(self.known[k][j] == h, dtype=np.int32)))
            whole = words - k + 1  # shingles of the text
            for size in self.sizes if sums[-1] else ():
                m = size - k + 1
                n = min(m, whole)  # shingles of a window: those of the whole text where that is shorter than the item
                if k != min(self.shingle, size) or n > len(h) or n < ceil(m * self.similarity - 1e-9):
                    continue
                least = ceil((m + n) * self.similarity / (1 + self.similarity) - 1e-9)
                starts = np.flatnonzero(sums[n:] - sums[:-n] >= least)
                for a in range(0, len(starts), 4096):
                    part = starts[a : a + 4096]
                    lo, hi = int(part[0]), int(part[-1]) + n
                    run = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bit_sums(h[lo:hi]), axis=0, dtype=np.int32)))
                    fps = to_fingerprints(run[part - lo + n] - run[part - lo], n)
                    for s, fp in zip(part.tolist(), fps.tolist(), strict=True):
                        found = self.lookup(size, fp)
                        if found:
                            own = Counter(h[s : s + n].tolist())
                            for i in found:
                                item, counts, _ = self.sizes[size][i]
                                both = (own & counts).total()
                                value = both / (m + n - both)
                                if value >= self.similarity and (item not in best or value > best[item][2]):
                                    best[item] = (first + s, min(size, words), value)
        return [(item, *v) for item, v in best.items()]


def items_of(benchmark: DataFrame, shingle: int, items_per_pass: int) -> DataFrame:
    """The benchmark's items with words as a stored table: pass_, item_id, size (words) and hashes of their shingles."""

    def run(batches):
        for b in batches:
            out = []
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = word_hashes(text)
                if len(words):
                    out.append((item, len(words), shingle_hashes(words, min(shingle, len(words))).tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.binary()], strict=True)], names=["item_id", "size", "hashes"])

    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    items = store(rows.mapInArrow(run, "item_id bigint, size int, hashes binary"), "decontamination-items")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("hashes")), F.lit(0)).alias("bytes")).first()
    passes = max(1, -(-size["n"] // items_per_pass), -(-size["bytes"] // PASS_BYTES))
    return items.withColumn("pass_", F.pmod(F.xxhash64("item_id", "hashes"), F.lit(passes)).cast("int"))


def bitmap_of(items: DataFrame, shingle: int) -> tuple[dict[int, np.ndarray], int]:
    """For each shingle length a bit for each value of the leading bits of the benchmark's hashes, and how many leading bits.

    Sixteen bits a shingle, 2 ** 20 at least and 2 ** 28 (32 MB) at most: beyond that, more stretches pass and all results stay.
    Put together in chunks of 64 KB, so the driver never holds more than the bitmap.
    """
    total = items.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    bits = min(28, max(20, (2 * total).bit_length()))
    chunk = 1 << 19  # bits of 64 KB

    def merged(parts) -> bytes:
        return np.bitwise_or.reduce(np.stack([np.frombuffer(p, np.uint8) for p in parts]), axis=0).tobytes()

    def mark(batches):
        maps: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for size, data in zip(b.column("size").to_pylist(), b.column("hashes").to_pylist(), strict=True):
                at = (np.frombuffer(data, np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
                for c in np.unique(at // chunk).tolist():
                    key = min(shingle, size), c
                    if key not in maps:
                        maps[key] = np.zeros(chunk, bool)
                    maps[key][at[at // chunk == c] % chunk] = True
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in maps], pa.int32()), pa.array([c for _, c in maps], pa.int32()), pa.array([np.packbits(m).tobytes() for m in maps.values()], pa.binary())], names=["k", "chunk", "bits"])

    def join(t: pa.Table) -> pa.Table:
        return pa.table({"k": t.column("k")[:1], "chunk": t.column("chunk")[:1], "bits": pa.array([merged(t.column("bits").to_pylist())], pa.binary())})

    kind = "k int, chunk int, bits binary"
    out: dict[int, np.ndarray] = {}
    for r in items.select("size", "hashes").mapInArrow(mark, kind).groupBy("k", "chunk").applyInArrow(join, kind).collect():
        out.setdefault(r["k"], np.zeros(1 << bits, bool) if bits < 24 else np.zeros(1 << bits - 3, np.uint8))
        if bits < 24:
            out[r["k"]][r["chunk"] * chunk : (r["chunk"] + 1) * chunk] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
        else:
            out[r["k"]][r["chunk"] * chunk // 8 : (r["chunk"] + 1) * chunk // 8] = np.frombuffer(r["bits"], np.uint8)
    return out, bits


def marked(bitmap: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set. Large bitmaps stay packed."""
    at = h >> np.uint64(64 - bits)
    if bitmap.dtype == bool:
        return bitmap[at]
    return (bitmap[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & np.uint8(1) != 0


def stretches_of(words: np.ndarray, bitmaps: dict[int, np.ndarray], bits: int, gaps: dict[int, int], least: dict[int, int]) -> list[tuple[int, int, bytes]]:
    """(shingle length, first shingle, hashes) of the parts of a text that hold every window which can pass.

    Such a window has at most gaps[k] shingles that are not in the benchmark, and at least least[k] that are.
    """
    out = []
    for k, bitmap in bitmaps.items():
        h = shingle_hashes(words, k)
        at = np.flatnonzero(marked(bitmap, bits, h))
        if len(at) < least[k]:
            continue
        breaks = np.flatnonzero(np.diff(at) > gaps[k] + 1) + 1
        for part in np.split(at, breaks):
            if len(part) >= least[k]:
                a, z = max(0, int(part[0]) - gaps[k]), min(len(h), int(part[-1]) + 1 + gaps[k])
                out.append((k, a, h[a:z].tobytes()))
    return out


CANDIDATES = "key bigint, key2 bigint, doc_id bigint, words int, stretches array<struct<k:int,first:int,hashes:binary>>"


def search(docs: DataFrame, benchmark: DataFrame, shingle: int, similarity: float, radius: int, blocks: int, items_per_pass: int) -> DataFrame:
    """(key, key2, doc_id, item_id, start_word, n_words, similarity) of all matches; docs: (key, key2, doc_id, text)."""
    spark = docs.sparkSession
    items = items_of(benchmark, shingle, items_per_pass)
    kind = f"key bigint, key2 bigint, {MATCHES}"
    bitmaps, bits = bitmap_of(items, shingle)
    sizes = [r["size"] for r in items.select("size").distinct().collect()]
    if not sizes:
        return spark.createDataFrame([], kind)
    share = 2 * similarity / (1 + similarity)
    gaps, least = {}, {}
    for size in sizes:
        k = min(shingle, size)
        m = size - k + 1
        gaps[k] = max(gaps.get(k, 0), m - ceil(m * share - 1e-9))
        # the shortest text that can match an item has similarity * m shingles
        least[k] = min(least.get(k, m), ceil((m + ceil(m * similarity - 1e-9)) * share / 2 - 1e-9))
    shared = spark.sparkContext.broadcast((bitmaps, bits, gaps, least))

    def scan(batches):
        own = shared.value
        span = pa.list_(pa.struct([("k", pa.int32()), ("first", pa.int32()), ("hashes", pa.binary())]))
        for b in batches:
            rows = []
            for key, key2, doc, text in zip(*(b.column(c).to_pylist() for c in ("key", "key2", "doc_id", "text")), strict=True):
                words = word_hashes(text)
                found = stretches_of(words, *own) if len(words) else []
                if found:
                    rows.append((key, key2, doc, len(words), [{"k": k, "first": a, "hashes": h} for k, a, h in found]))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.int32(), span], strict=True)], names=["key", "key2", "doc_id", "words", "stretches"])

    parts = store(docs.mapInArrow(scan, CANDIDATES), "decontamination-stretches")
    path = scratch(spark, "decontamination-matches")

    def one_pass(items):
        def run(batches):
            index = index_of(items, shingle, similarity, radius, blocks)
            for b in batches:
                found = [(r["key"], r["key2"], r["doc_id"], *m) for r in b.to_pylist() for m in index.matches(r["words"], [(s["k"], s["first"], s["hashes"]) for s in r["stretches"]])]
                cols = list(zip(*found, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 6 + [pa.float64()], strict=True)], names=["key", "key2", "doc_id", "item_id", "start_word", "n_words", "similarity"])

        return run

    for r in items.select("pass_").distinct().collect():
        part = items.where(F.col("pass_") == r["pass_"]).select("item_id", "size", "hashes").collect()
        parts.mapInArrow(one_pass([tuple(x) for x in part]), kind).write.mode("append").parquet(path)
    forget(parts)
    out = spark.read.schema(kind).parquet(path)
    out.scratch_path = path
    return out


def index_of(items, shingle, similarity, radius, blocks) -> Index:
    """The index of one pass, built once in each worker."""
    key = hash((tuple(items), shingle, similarity, radius, blocks))
    indexes = worker_cache("decontamination").setdefault("indexes", {})
    if key not in indexes:
        indexes.clear()
        indexes[key] = Index(items, shingle, similarity, radius, blocks)
    return indexes[key]


def find_matches(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 20, blocks: int = 7, items_per_pass: int = 20_000) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, its best window's first word, words and similarity.

    Of windows equally similar the first counts. Items of fewer than `shingle` words are one shingle; null or wordless
    ones never match. Texts of any length are read whole. Repeated rows of docs give repeated matches, an item_id that stands for several
    texts may match by each of them; null and empty texts give none, nor does an empty table on either side. Columns but doc_id, item_id and the
    texts are ignored, whatever their names. Indexes hold `items_per_pass` items, or a little more, at a time; only the stretches that
    can match are read again for each.
    """
    zero = F.lit(0).cast("bigint")
    rows = docs.select(zero.alias("key"), zero.alias("key2"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return search(rows, benchmark, shingle, similarity, radius, blocks, items_per_pass).drop("key", "key2")


def clean(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 20, blocks: int = 7, items_per_pass: int = 20_000) -> DataFrame:
    """Rows of docs in whose text no benchmark item is found, with all their columns, whatever their names.

    That depends on a text alone, so rows are told by two hashes of their texts; those of the texts
    with a match are a table whose real size decides how it is joined. Null and empty texts stay, repeated rows are
    decided alike, and an empty benchmark keeps all rows.
    """
    keys = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    rows = docs.select(keys[0].alias("key"), keys[1].alias("key2"), F.lit(0).cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = search(rows, benchmark, shingle, similarity, radius, blocks, items_per_pass)
    dirty = store(found.select(F.col("key").alias("dirty_a"), F.col("key2").alias("dirty_b")).distinct(), "decontamination-dirty")
    return docs.alias("docs").join(dirty.alias("dirty"), (F.xxhash64("docs.text") == F.col("dirty.dirty_a")) & (F.xxhash64(F.lit(1), "docs.text") == F.col("dirty.dirty_b")), "left_anti")
