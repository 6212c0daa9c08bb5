"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text is
built; a text is cut greedily into the longest phrases that occur in the
sample, and the language that needs fewest phrases, each costing log2 of the
sample's length and normalised by the text's length, wins. Whole texts are
parsed, in blocks of `block` symbols that run side by side as numpy lanes; a
phrase ends where its block ends.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import held_out, worker_cache


def samples(docs: DataFrame, rows: int = 60, chars: int = 24_000, low: int = 200, high: int = 6000) -> dict[str, str]:
    """language -> sample text of at most `chars` characters.

    First come the labelled rows of `low` to `high` characters, the `rows` with least text hashes. A language they
    leave short of `chars` goes on with its other texts by least hash, as many as it takes: first longer ones, of
    which the beginning is read, then shorter ones.
    Rows held out by their doc_id, and null languages or texts, are never used.
    """
    learn = docs.where("lang is not null and text is not null").where(~held_out(F.col("doc_id"))).withColumn("size", F.length("text"))
    found = _extend({}, _least(learn.where(F.col("size").between(low, high)), rows, chars), chars)
    for more in (learn.where(F.col("size") > high), learn.where(F.col("size").between(1, low - 1))):
        langs = [r["lang"] for r in more.select("lang").distinct().collect()]
        poor = [x for x in langs if len(found.get(x, "")) < chars]
        if poor:
            found = _extend(found, _least(more.where(F.col("lang").isin(poor)), chars, chars), chars)
    return found


def _extend(found: dict[str, str], texts: list, chars: int) -> dict[str, str]:
    parts: dict[str, list[str]] = {k: [v] for k, v in found.items()}
    for r in texts:
        parts.setdefault(r["lang"], [""]).append(r["text"])
    return {k: " ".join(v)[:chars] if len(v) > 1 else v[0] for k, v in parts.items()}


def _least(learn: DataFrame, rows: int, chars: int) -> list:
    """The texts with least hashes of each language, cut to `chars` characters: at most `rows`, or as many as hold `chars` together."""
    hashes = learn.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("size").alias("size"))
    # a language's least hashes lie among the least of each of its shares, so no task reads more than 16 * rows of one
    for share in ([F.pmod(F.hash("h"), F.lit(16))], []):
        order = Window.partitionBy("lang", *share).orderBy("h")
        hashes = hashes.withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows).drop("k")
        if rows >= chars:
            hashes = hashes.withColumn("sum", F.sum(F.col("size") + 1).over(order)).where(F.col("sum") - F.col("size") - 1 < chars).drop("sum")
    chosen = learn.withColumn("h", F.xxhash64("text")).join(F.broadcast(hashes.select("lang", "h")), ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.substring("text", 1, chars)).alias("text"))
    return sorted(chosen.collect(), key=lambda r: (r["lang"], r["h"]))


class Parser:
    """The automata of all languages as one sparse transition table.

    Symbols: 0 a letter no sample has, 1 all that is no letter, then every letter of the samples; the last one pads.
    The transition of a state by a symbol, if there is one, is at slot[state] + symbol, where `owner` names the state.
    """

    def __init__(self, texts: dict[str, str], block: int = 1024):
        self.langs, self.block = sorted(texts), block
        letters = sorted({c for t in texts.values() for c in t.lower() if c.isalpha()})
        self.pad = 2 + len(letters)
        self.symbol = np.zeros(0x110000, np.min_scalar_type(self.pad))
        everything = np.array([not chr(i).isalpha() for i in range(0x3000)])
        self.symbol[:0x3000][everything] = 1
        for i, c in enumerate(letters):
            self.symbol[ord(c)] = 2 + i
        rows, self.idle, self.cost = [], [], []
        self.first = np.zeros((len(self.langs), self.pad + 1), np.int32)  # state after the first symbol of a phrase
        for i, lang in enumerate(self.langs):
            coded, base = self.code(texts[lang]).tolist(), len(rows)
            nxt = self._automaton(coded)
            self.idle.append(base + len(nxt))  # before the first symbol and after one the sample doesn't have
            self.first[i] = self.idle[-1]
            for c, q in nxt[0].items():
                self.first[i, c] = base + q
            rows += [{c: base + q for c, q in row.items()} for row in nxt]
            rows.append({})
            self.cost.append(math.log2(max(2, len(coded))))
        self._place(rows)

    def _place(self, rows: list[dict[int, int]]) -> None:
        """Slots of the states: drawn until no transition meets another, states with many transitions first."""
        size = 3 * sum(map(len, rows)) + self.pad + 1
        draw = random.Random(1)
        slot, owner, after = [0] * len(rows), [-1] * (size + self.pad + 1), [0] * (size + self.pad + 1)
        for i in sorted((i for i, row in enumerate(rows) if row), key=lambda i: -len(rows[i])):
            at = int(draw.random() * size)
            while any(owner[at + c] >= 0 for c in rows[i]):
                at = int(draw.random() * size)
            slot[i] = at
            for c, q in rows[i].items():
                owner[at + c], after[at + c] = i, q
        self.slot, self.owner, self.after = (np.array(x, np.int32) for x in (slot, owner, after))

    def code(self, text: str) -> np.ndarray:
        """Symbols of a text, with runs of anything but letters as one."""
        s = self.symbol[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 1) | (s[:-1] != 1)
        return s[keep]

    @staticmethod
    def _automaton(coded: list[int]) -> list[dict[int, int]]:
        """The suffix automaton: next state by symbol of each state; the first is the start."""
        nxt, link, size, last = [{}], [-1], [0], 0
        for c in coded:
            cur = len(nxt)
            nxt.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if size[p] + 1 == size[q]:
                    link[cur] = q
                else:
                    copy = len(nxt)
                    nxt.append(dict(nxt[q]))
                    size.append(size[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        return nxt

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text, by language, and each text's number of symbols."""
        coded = [self.code(t) for t in texts]
        sizes = np.array([len(c) for c in coded], np.int64)
        lanes = -(-sizes // self.block)
        owner = np.repeat(np.arange(len(texts)), lanes)
        grid = np.full((len(owner), self.block), self.pad, self.symbol.dtype)
        at = 0
        for c, k in zip(coded, lanes.tolist(), strict=True):
            grid[at : at + k].reshape(-1)[: len(c)] = c
            at += k
        counts = np.zeros((len(self.langs), len(texts)), np.int64)
        for a in range(0, len(owner), 8192):
            part = np.ascontiguousarray(grid[a : a + 8192].T)
            used = int((part != self.pad).any(axis=1).sum())
            state = np.repeat(np.array(self.idle, np.int32)[:, None], part.shape[1], axis=1)
            begun = np.zeros(state.shape, np.int32)
            for step in part[:used]:
                at = self.slot[state] + step
                new = self.owner[at] != state
                state = np.where(new, self.first[:, step], self.after[at])
                begun += new & (step != self.pad)  # a lane that has ended stays so
            for i in range(len(self.langs)):
                counts[i] += np.bincount(owner[a : a + 8192], begun[i], len(texts)).astype(np.int64)
        return counts, sizes

    def identify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not some or not self.langs:
            return langs, scores
        counts, sizes = self.phrases([texts[i] for i in some])
        rates = counts * np.array(self.cost)[:, None] / np.maximum(1, sizes)
        best = rates.argmin(axis=0)
        weight = np.exp(4 * (rates.min(axis=0) - rates))
        for i, b, p in zip(some, best.tolist(), (weight.max(axis=0) / weight.sum(axis=0)).tolist(), strict=True):
            langs[i], scores[i] = self.langs[b], float(p)
        return langs, scores


def predict(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """docs with lang_pred and score; columns of docs with these names are replaced.

    lang_pred is a learned value, `und` with score 0 where the text is null, empty or has no letter,
    or where nothing could be learned. Equal costs go to the first language in
    alphabetical order. Texts of any length are parsed whole. Repeated rows are kept, an empty table gives no rows. The score
    is the winner's share of exp(-4 * bits per symbol).
    """
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*rest).schema.add("lang_pred", "string").add("score", "double")
    key = hash(tuple(sorted(texts.items())))

    def run(batches):
        built = worker_cache("language")
        if key not in built:
            built.clear()
            built[key] = Parser(texts)
        for b in batches:
            langs, scores = built[key].identify(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*rest, "lang_pred", "score"])

    return docs.select(*rest).mapInArrow(run, schema)
