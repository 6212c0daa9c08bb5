"""Token counts by a two-tier, map-side lookup of pre-token lengths.

A byte-level BPE first cuts a text into pre-tokens and encodes each on its own,
so a text's count is the sum over its pre-tokens. Frequent pre-tokens come from
a broadcast table of bounded size; the others are encoded in batches and kept
in a bounded cache of the Python worker. No pre-token is ever shuffled.
"""

from __future__ import annotations

import os
from collections import Counter
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import worker_cache

#: The published pre-token pattern of byte-level BPE.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Outside these ranges Unicode versions of regex engines may differ: the library then takes the whole text.
UNUSUAL = regex.compile(r"[^\t\n\r\x20-\x7e\xa1-ʯΑ-ΡΣ-ϿЀ-ҁҊ-ԯ‐-‧€ぁ-ゖァ-ヺ一-龥가-힣]")

#: Characters of the longest pre-token that the sample's table and a worker's cache hold.
KEPT = 64

_encoders: dict = {}


def encoder(path: str):
    """The tokenizer of a file, loaded once in each process."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _encoders[path] = Tokenizer.from_file(path)
    return _encoders[path]


def frequent_table(docs: DataFrame, path: str, sample_rows: int = 4000, size: int = 65_536) -> dict[str, int]:
    """Lengths of at most `size` pre-tokens: the most frequent of about `sample_rows` rows, then the vocabulary's own.

    The sample is spread over the table and counted where its rows are; only the counts of pre-tokens of at most KEPT
    characters leave them, at most 4 * `size` a task. The table only saves time; no result depends on what it holds.
    """
    own = encoder(path)
    total = docs.count()

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                if text and not UNUSUAL.search(text):
                    counts.update(w for w in PRE_TOKEN.findall(text) if len(w) <= KEPT)
            if len(counts) > 8 * size:
                counts = Counter(dict(counts.most_common(4 * size)))
        best = counts.most_common(4 * size)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], names=["word", "n"])

    seen = []
    if sample_rows and total:
        rows = docs.select(F.col("text").cast("string").alias("text"))
        rows = rows.sample(sample_rows / total, 1) if total > sample_rows else rows
        most = rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
        seen = [r["word"] for r in most.collect()]
    special = {t.content for t in own.get_added_tokens_decoder().values()}
    plain = {own.decode([i], skip_special_tokens=False): None for i in range(own.get_vocab_size())}
    seen += [w for w in plain if w and w not in special and not UNUSUAL.search(w) and PRE_TOKEN.fullmatch(w)]
    words = list(dict.fromkeys(seen))[:size]
    return dict(zip(words, map(len, own.encode_batch(words, add_special_tokens=False)), strict=True))


def count_batch(texts: list[str | None], path: str, table: dict[str, int], cache_size: int = 400_000) -> list[int]:
    own = encoder(path)
    kept = worker_cache("token counts")
    special = kept.get((path, "special"))
    if special is None:
        special = kept[path, "special"] = [t.content for t in own.get_added_tokens_decoder().values()]
    cache = kept.setdefault(path, {})
    plain = [bool(t) and not UNUSUAL.search(t) and not any(s in t for s in special) for t in texts]
    parts = [PRE_TOKEN.findall(t) if ok else () for t, ok in zip(texts, plain, strict=True)]
    new = set(chain.from_iterable(parts)).difference(table).difference(cache)
    found = dict(zip(new, map(len, own.encode_batch_fast(list(new), add_special_tokens=False)), strict=True)) if new else {}
    short = {w: n for w, n in found.items() if len(w) <= KEPT}
    if len(cache) + len(short) <= cache_size:
        cache.update(short)
        if len(short) == len(found):
            found = {}
    if kept.get("table") is not table:
        kept["table"], kept["known"] = table, _Both(table)
    known = kept["known"]
    known.cache, known.rest = cache, found
    return [sum(map(known.__getitem__, p)) if ok else (len(own.encode(t, add_special_tokens=False)) if t else 0) for t, ok, p in zip(texts, plain, parts, strict=True)]


class _Both(dict):
    """Both tiers as one mapping: the table is copied once per process; on a miss the cache is read, then what a batch has but the cache doesn't keep."""

    cache: dict = {}
    rest: dict = {}

    def __missing__(self, word):
        n = self.cache.get(word)
        return self.rest[word] if n is None else n


def token_counts(docs: DataFrame, path: str, limit: int = 1024, sample_rows: int = 4000, table_size: int = 65_536) -> DataFrame:
    """All columns of docs except its text, with n_bytes, n_tokens and over_limit.

    Null and empty texts have zero bytes and tokens, texts of any length are counted whole. Rows are kept as they are,
    repeated ones included; columns of docs named like a result column are replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_table(docs, path, sample_rows, table_size))
    own = ("n_bytes", "n_tokens", "over_limit")
    rest = [c for c in docs.columns if c not in ("text", *own)]
    schema = docs.select(*rest).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            counts = count_batch(texts, path, table.value)
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in rest), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=[*rest, *own],
            )

    return docs.select(*rest, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
