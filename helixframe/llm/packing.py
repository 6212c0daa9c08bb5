"""Mixture-controlled packing of token streams into fixed windows.

Every source is a queue of tokens. Deficit round-robin serves the queues in
rounds of `round_windows` windows, by default of one: source s is credited
share_s of a round's tokens, whole tokens are served, and the fraction it is
still owed is carried into the next round. As documents may be cut anywhere, the
tokens served to s before round r are exactly floor(r * round_tokens * share_s +
phase_s), so any task can take up the schedule at any round with all deficits of
the rounds before it: deficits pass over windows and partitions without a
sequential pass. The phases, multiples of the golden ratio, spread the whole
tokens of different sources over the rounds, so a round ends within a few tokens
of its window. Within a round the tokens of a source stand together.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import forget, store, worker_cache
from helixframe.llm.tokens import encoder

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_length bigint, source string, round bigint"


#: Fixed values of the published tokenizer whose words are cut here; any other goes to the library word by word.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: Lower-case words without apostrophes in letters that no normalizer changes, and their pre-tokens.
SIMPLE = re.compile("[a-zß-öø-ÿ0-9!-&(-/:-@\\[-`{-~]+")
PART = re.compile("[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")


#: Bytes of the longest word a worker keeps, so that the number of words bounds the memory of its cache.
KEPT_BYTES = 32


def encode_batch(texts: list[str], path: str, cache_size: int = 1_000_000) -> list[bytes]:
    """Little-endian 32-bit ids of each text by a tokenizer that drops white space and case.

    White space always ends a pre-token of such a tokenizer, so a text's ids are
    those of its words in a row; each worker keeps a cache of at most `cache_size` words of at most
    KEPT_BYTES bytes, A-Z lower-cased; longer ones are encoded wherever they stand. Texts that may hold a special token go to the library whole.
    """
    kept = worker_cache("packing")
    known = kept.get(path)
    if known is None:
        known = kept[path] = Words(encoder(path))
    known.begin(cache_size)
    ids_of = known.__getitem__
    return [b"".join(map(ids_of, t.encode("utf-8", "replace").lower().split())) if "<|" not in t else np.array(known.own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


class Words(dict):
    """Ids of words; one that is new is encoded at its first look-up, and kept while there is room, else for its batch."""

    def __init__(self, own):
        self.own, self.room, self.batch, self.parts = own, 0, {}, {}

    def begin(self, room: int) -> None:
        self.room, self.batch, self.parts = room, {}, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.batch.get(word)
        if ids is None:
            ids = encode_word(self.own, word.decode(), self.parts)
            kept = self if len(self) < self.room and len(word) <= KEPT_BYTES else self.batch
            kept[word] = ids
        return ids


_cutters: dict = {}


def _cutter(own):
    """Ids of one pre-token straight from the tokenizer's model, or None if its steps before the model are not the known ones."""
    if id(own) not in _cutters:
        found = None
        normal = json.loads(own.normalizer.__getstate__()) if own.normalizer else {}
        before = json.loads(own.pre_tokenizer.__getstate__()) if own.pre_tokenizer else {}
        if normal == {"type": "Sequence", "normalizers": NORMALIZERS} and before == {"type": "Sequence", "pretokenizers": PRE_TOKENIZERS}:
            model, ids = own.model, [i.to_bytes(4, "little") for i in range(own.get_vocab_size())]
            # byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on
            plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
            moved = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}

            def found(part: str) -> bytes:
                if not part.isascii():
                    part = part.encode().decode("latin-1").translate(moved)
                return b"".join([ids[t.id] for t in model.tokenize(part)])

        _cutters[id(own)] = own, found
    return _cutters[id(own)][1]


def encode_word(own, word: str, made: dict[str, bytes]) -> bytes:
    """Ids of a word without white space, A-Z lower-cased: a simple one by its pre-tokens, of which `made` holds those known, others by the library."""
    cut = _cutter(own)
    if cut is None or not SIMPLE.fullmatch(word):
        return np.array(own.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
    if word.isalpha():
        return cut(word)
    ids = []
    for part in PART.findall(word):
        got = made.get(part)
        if got is None:
            got = made[part] = cut(part)
        ids.append(got)
    return b"".join(ids)


class Schedule:
    """Where the tokens of each source go. totals: tokens of each queue; weights: integer shares."""

    def __init__(self, totals: list[int], weights: list[int], window: int, round_windows: int):
        self.window, self.per_round = window, window * round_windows
        self.weight, self.tokens = sum(weights), sum(totals)
        # 64-bit integers where no product can pass them, Python's own otherwise
        rounds = max((t * self.weight // (self.per_round * w) for t, w in zip(totals, weights, strict=True)), default=0) + 2
        small = max(self.tokens, (rounds + 1) * self.per_round * max(weights, default=1) + self.weight) < 1 << 62
        kind = np.int64 if small else object
        self.totals, self.weights = np.array(totals, kind), np.array(weights, kind)
        self.phases = np.array([(s * 0x9E3779B97F4A7C15 % (1 << 64)) * self.weight >> 64 for s in range(len(weights))], kind)

    def due(self, s: int, r):
        """Tokens of source s that are due before round r, however many it has."""
        return (r * self.per_round * self.weights[s] + self.phases[s]) // self.weight

    def round_of(self, s: int, x: int) -> int:
        """The round that serves token x of source s: the last r with due(s, r) <= x."""
        r = int(x) * self.weight // (self.per_round * int(self.weights[s]))
        while int(self.due(s, r)) > x:
            r -= 1
        while int(self.due(s, r + 1)) <= x:
            r += 1
        return r

    def starts(self, s: int, r0: int, r1: int) -> tuple[np.ndarray, np.ndarray]:
        """For rounds r0 up to r1: tokens of s served before each, and where its part of each starts in the packed stream."""
        first, place = [], []
        step = max(1, (1 << 18) // len(self.totals))
        for a in range(r0, r1, step):
            r = np.arange(a, min(a + step, r1) + 1).astype(self.weights.dtype)
            served = np.minimum(self.totals, (r[:, None] * self.per_round * self.weights + self.phases) // self.weight)
            first.append(served[:-1, s])
            # all sources' tokens of the rounds before, and this round's of the sources before s
            place.append(served[:-1].sum(axis=1) + (served[1:, :s] - served[:-1, :s]).sum(axis=1))
        return np.concatenate(first), np.concatenate(place)

    def pieces(self, s: int, cuts: np.ndarray):
        """(round, queue position, position in the packed stream, length) of the tokens cuts[0] up to cuts[-1] of source s,
        cut at all of `cuts`, at the ends of rounds and at the ends of windows.
        """
        x0, x1 = int(cuts[0]), int(cuts[-1])
        r0, r1 = self.round_of(s, x0), self.round_of(s, x1 - 1)
        served, place = self.starts(s, r0, r1 + 1)
        at = np.unique(np.concatenate((cuts[:-1], served[(served > x0) & (served < x1)])).astype(np.int64))
        r = np.searchsorted(served.astype(np.int64), at, "right") - 1
        g = (place[r] + at - served[r]).astype(np.int64)
        size = np.diff(np.append(at, x1))
        more = (g % self.window + size - 1) // self.window  # window ends inside
        n = np.arange(int(more.sum() + len(more))) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
        skip = np.where(n > 0, n * self.window - np.repeat(g % self.window, more + 1), 0)
        ends = np.minimum((n + 1) * self.window - np.repeat(g % self.window, more + 1), np.repeat(size, more + 1))
        return np.repeat(r, more + 1) + r0, np.repeat(at, more + 1) + skip, np.repeat(g, more + 1) + skip, ends - skip

    def padded(self, sequences: np.ndarray) -> np.ndarray:
        """Lengths of sequences with their padding: the last may end at a power of two."""
        left = self.tokens - sequences * self.window
        tail = min(self.window, 1 << max(0, int(self.tokens % self.window or self.window) - 1).bit_length())
        return np.where(left >= self.window, self.window, tail)


def queues_of(sums: DataFrame, targets: dict[str, int] | None, most: int) -> tuple[dict, list[int], list[int]]:
    """Source -> queue, and the tokens and weight of each queue.

    Sources named in `targets` and the `most` with most tokens have queues of their own.
    Any others share the last one, whose weight is the sum of theirs.
    """
    by_source = sums.groupBy("source").agg(F.sum("n").alias("n"))
    names = [str(k) for k in targets or ()]
    own = {r["source"]: r["n"] for r in by_source.orderBy(F.desc("n"), F.asc_nulls_first("source")).limit(most).collect()}
    for a in range(0, len(names), 1000):
        own |= {r["source"]: r["n"] for r in by_source.where(F.col("source").isin(names[a : a + 1000])).collect()}
    order = sorted(own, key=lambda k: (-own[k], k is not None, k or ""))
    rest = by_source.agg(F.sum("n").alias("n"), F.count("*").alias("k")).first()
    totals = [own[k] for k in order]
    weights = list(totals) if targets is None else [max(1, int(targets.get(k, 1))) for k in order]
    left = (rest["n"] or 0) - sum(totals)
    if left:
        totals.append(left)
        weights.append(left if targets is None else rest["k"] - len(order))
    return {k: i for i, k in enumerate(order)}, totals, weights


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, targets: dict[str, int] | None = None, round_windows: int = 1, max_sources: int = 65_536, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, source, round; ids too if asked for.

    Every document ends with `end_id`; null or empty texts are that id alone.
    targets: integer weight of each source (others: 1); by default each source's
    share of all tokens, so that all queues end together. A queue that ends
    leaves its share of later rounds to the others. With `round_windows` above 1
    the shares hold for so many windows together, not for each. Every source, null
    among them, has a queue of its own, which bounds what the schedule holds by their number;
    beyond `max_sources` of them, those with least tokens and no target share one queue that has the sum of
    their shares. Repeated rows are packed as often as they occur, texts of any length whole, other
    columns are ignored. An empty table gives no pieces.
    """
    spark = docs.sparkSession

    def tokenise(batches):
        part, done = TaskContext.get().partitionId(), {}
        for b in batches:
            sources = b.column("source").to_pylist()
            ids = [x + end_id.to_bytes(4, "little") for x in encode_batch([t or "" for t in b.column("text").to_pylist()], path)]
            at = []
            for s, x in zip(sources, ids, strict=True):
                at.append(done.get(s, 0))
                done[s] = at[-1] + len(x) // 4
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), b.column("doc_id"), b.column("source"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(at, pa.int64()), pa.array(ids, pa.binary())],
                names=["part", "doc_id", "source", "n", "at", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    coded = store(rows.mapInArrow(tokenise, "part int, doc_id bigint, source string, n bigint, at bigint, ids binary"), "packing-ids", compression="zstd")
    sums = store(coded.groupBy("part", "source").agg(F.sum("n").alias("n")), "packing-sums")
    own, totals, weights = queues_of(sums, targets, max_sources)
    kind = PIECES + (", ids binary" if with_ids else "")
    if not own:
        return spark.createDataFrame([], kind)
    plan = Schedule(totals, weights, window, round_windows)
    # at most max_sources rows and those of the targets' names
    queues = spark.createDataFrame([(s, i) for s, i in own.items()], "q_source string, queue int")
    queued = sums.join(F.broadcast(queues), F.col("source").eqNullSafe(F.col("q_source")), "left").withColumn("queue", F.coalesce("queue", F.lit(len(own))))
    bases = store(running(queued.drop("q_source")).select(F.col("part").alias("b_part"), F.col("source").alias("b_source"), "queue", "base"), "packing-bases")

    def cut(batches):
        names_ = [c.split()[0] for c in kind.split(", ")]
        kinds = {"source": pa.string(), "ids": pa.binary()}
        for b in batches:
            if not b.num_rows:
                continue
            n, at, queue, base = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n", "at", "queue", "base"))
            x0 = base + at
            # rows whose tokens follow each other in one queue are cut together
            order = np.lexsort((x0, queue))
            ahead = np.append(True, (queue[order][1:] != queue[order][:-1]) | (x0[order][1:] != (x0 + n)[order][:-1]))
            parts = [[] for _ in range(6)]
            for run in np.split(order, np.flatnonzero(ahead)[1:]):
                cuts = np.append(x0[run], x0[run[-1]] + n[run[-1]])
                r, x, g, size = plan.pieces(int(queue[run[0]]), cuts)
                row = run[np.searchsorted(cuts, x, "right") - 1]
                for column, v in zip(parts, (row, x - x0[row], size, g // window, g % window, r), strict=True):
                    column.append(v)
            row, start, size, sequence, offset, r = (np.concatenate(v).astype(np.int64) for v in parts)
            blobs = b.column("ids")
            views = [memoryview(blobs[i].as_buffer()) for i in range(b.num_rows)]
            crc, where = zlib.crc32, list(zip(row.tolist(), (4 * start).tolist(), (4 * (start + size)).tolist(), strict=True))
            made = {"start": start, "length": size, "ids_crc32": [crc(views[i][a:z]) for i, a, z in where], "doc_tokens": n[row], "sequence_id": sequence, "offset": offset, "sequence_length": plan.padded(sequence), "round": r}
            if with_ids:
                made["ids"] = [bytes(views[i][a:z]) for i, a, z in where]
            for c in ("doc_id", "source"):
                made[c] = b.column(c).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([made[c] if c in ("doc_id", "source") else pa.array(made[c], kinds.get(c, pa.int64())) for c in names_], names=names_)

    placed = coded.join(bases, (F.col("part") == F.col("b_part")) & F.col("source").eqNullSafe(F.col("b_source")))
    out = placed.select("doc_id", "source", "n", "at", "queue", "base", "ids").mapInArrow(cut, kind)
    if with_ids:
        return out
    out = store(out, "packing-pieces", compression="zstd")
    forget(coded, sums, bases)
    return out


def running(sums: DataFrame, block: int = 1000) -> DataFrame:
    """sums (part, source, queue, n) with base, the tokens of the queue before a row, by part and source.

    A hot queue has a row for each partition and source. They are summed by blocks
    of partitions first, so a task orders a block's rows or one row a block.
    """
    cut = sums.withColumn("block", F.floor(F.col("part") / block))
    blocks = cut.groupBy("queue", "block").agg(F.sum("n").alias("s"))
    over = Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("queue").alias("q"), F.col("block").alias("b"), F.coalesce(F.sum("s").over(over), F.lit(0)).alias("s"))
    inner = Window.partitionBy("queue", "block").orderBy("part", F.asc_nulls_first("source")).rowsBetween(Window.unboundedPreceding, -1)
    within = cut.withColumn("base", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    return within.join(blocks, (F.col("queue") == F.col("q")) & (F.col("block") == F.col("b"))).withColumn("base", F.col("base") + F.col("s")).drop("q", "b", "s", "block")
