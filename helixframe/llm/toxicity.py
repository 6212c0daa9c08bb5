"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Each word enters as its own embedding beside the mean embedding of its
character trigrams; two gated recurrent units read a window in both directions,
attention pools their states, and a logistic unit scores the window. A text's
score is that of its worst window; windows overlap and cover the whole text.
Runs of more than 40 characters enter as overlapping parts, each a word of its own.
Training is plain numpy: multiple-instance learning, where a toxic document
teaches by its worst window and a clean one by any.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import held_out

WORD = re.compile(r"\w+")
WINDOW, STRIDE, HIDDEN, WIDE, TRIGRAMS = 32, 24, 8, 8, 4096
#: Characters of the longest word, and between the starts of the parts of a longer run.
LONGEST, STEP = 40, 30


def short_words(words: list[str]) -> list[str]:
    """The words, longer ones as overlapping parts that cover them."""
    return [w[a : a + LONGEST] for w in words for a in range(0, max(1, len(w) - LONGEST + STEP), STEP)]


def trigrams(word: str) -> list[int]:
    padded = f"^{word}$"
    return [zlib.crc32(padded[i : i + 3].encode("utf-8", "surrogatepass")) % TRIGRAMS for i in range(len(padded) - 2)]


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters p; words: known word -> row of the word embeddings, 0 for all others."""

    def __init__(self, words: dict[str, int], seed: int = 3):
        self.words = words
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale=0.3: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {"word": draw(len(words) + 1, WIDE), "char": draw(TRIGRAMS, WIDE), "att_w": draw(2 * HIDDEN, HIDDEN), "att_b": np.zeros(HIDDEN, np.float32), "att_v": draw(HIDDEN), "out_w": draw(2 * HIDDEN), "out_b": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"in_{d}": draw(2 * WIDE, 3 * HIDDEN), f"bias_{d}": np.zeros(3 * HIDDEN, np.float32), f"zr_{d}": draw(HIDDEN, 2 * HIDDEN), f"h_{d}": draw(HIDDEN, HIDDEN)}

    def run_direction(self, gates: np.ndarray, d: str, mask: np.ndarray, keep: bool):
        """States of one direction. gates: inputs times in_d plus bias, (time, lanes, 3H); masked steps keep the state."""
        steps, lanes, _ = gates.shape
        h, states, trace = np.zeros((lanes, HIDDEN), np.float32), [None] * steps, [None] * steps
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            zr = sigmoid(gates[t, :, : 2 * HIDDEN] + h @ self.p[f"zr_{d}"])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(gates[t, :, 2 * HIDDEN :] + (r * h) @ self.p[f"h_{d}"])
            m = mask[t][:, None]
            step = z * m
            if keep:
                trace[t] = (h, z, r, new, m)
            h = h + step * (new - h)
            states[t] = h
        return np.stack(states), trace

    def pool(self, states, mask):
        u = np.tanh(states @ self.p["att_w"] + self.p["att_b"])
        e = u @ self.p["att_v"]
        e = np.where(mask > 0, e, -1e9)
        a = np.exp(e - e.max(axis=0, keepdims=True)) * mask
        a /= np.maximum(a.sum(axis=0, keepdims=True), 1e-9)
        c = (a[:, :, None] * states).sum(axis=0)
        return u, a, c

    def logits(self, gf, gb, mask):
        f, _ = self.run_direction(gf, "f", mask, False)
        b, _ = self.run_direction(gb, "b", mask, False)
        return self.pool(np.concatenate((f, b), axis=2), mask)[2] @ self.p["out_w"] + self.p["out_b"][0]

    def gradients(self, word_ids, chars, mask, y):
        """Gradients of the mean cross-entropy; chars: (time, lanes, up to K trigram ids, -1 for none)."""
        p, (steps, lanes) = self.p, word_ids.shape
        have = chars >= 0
        n = np.maximum(have.sum(axis=2, keepdims=True), 1).astype(np.float32)
        x = np.concatenate((p["word"][word_ids], (p["char"][np.maximum(chars, 0)] * have[..., None]).sum(axis=2) / n), axis=2)
        out = {}
        for d in "fb":
            out[d] = self.run_direction(x @ p[f"in_{d}"] + p[f"bias_{d}"], d, mask, True)
        states = np.concatenate((out["f"][0], out["b"][0]), axis=2)
        u, a, c = self.pool(states, mask)
        dl = (sigmoid(c @ p["out_w"] + p["out_b"][0]) - y) / lanes
        g = {"out_w": c.T @ dl, "out_b": dl.sum(keepdims=True)}
        dc = dl[:, None] * p["out_w"]
        ds = a[:, :, None] * dc[None]
        da = (states * dc[None]).sum(axis=2)
        de = a * (da - (a * da).sum(axis=0, keepdims=True))
        g["att_v"] = np.einsum("tl,tlh->h", de, u)
        dpre = de[:, :, None] * p["att_v"] * (1 - u * u)
        g["att_w"], g["att_b"] = np.einsum("tls,tlh->sh", states, dpre), dpre.sum(axis=(0, 1))
        ds = ds + dpre @ p["att_w"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            trace, dstate = out[d][1], ds[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            dh, dgates = np.zeros((lanes, HIDDEN), np.float32), np.zeros((steps, lanes, 3 * HIDDEN), np.float32)
            gzr, gh = np.zeros_like(p[f"zr_{d}"]), np.zeros_like(p[f"h_{d}"])
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                h, z, r, new, m = trace[t]
                dh = dh + dstate[t]
                dnew = dh * z * m * (1 - new * new)
                dz = dh * (new - h) * m * z * (1 - z)
                drh = dnew @ p[f"h_{d}"].T
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate((dz, dr), axis=1)
                gzr += h.T @ dzr
                gh += (r * h).T @ dnew
                dgates[t] = np.concatenate((dzr, dnew), axis=1)
                dh = dh * (1 - z * m) + drh * r + dzr @ p[f"zr_{d}"].T
            g[f"zr_{d}"], g[f"h_{d}"], g[f"bias_{d}"] = gzr, gh, dgates.sum(axis=(0, 1))
            g[f"in_{d}"] = np.einsum("tlx,tlg->xg", x, dgates)
            dx += dgates @ p[f"in_{d}"].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], word_ids, dx[:, :, :WIDE] * mask[:, :, None])
        g["char"] = np.zeros_like(p["char"])
        part = np.broadcast_to((dx[:, :, WIDE:] * mask[:, :, None] / n)[:, :, None, :], (*chars.shape, WIDE))
        np.add.at(g["char"], chars[have], part[have])
        return g


class Scorer:
    """Scores texts: the gates' inputs of each word are computed once and kept in a bounded table."""

    def __init__(self, net: Network, shift: float = 0.0, scale: float = 1.0, cache_words: int = 300_000):
        self.net, self.shift, self.scale, self.cache_words = net, shift, scale, cache_words
        self._reset()

    def _reset(self):
        self.rows: dict[str, int] = {}
        width = 6 * HIDDEN
        self.gates, self.used = np.zeros((1024, width), np.float32), 1

    def __getstate__(self):
        return self.net, self.shift, self.scale, self.cache_words

    def __setstate__(self, state):
        self.__init__(*state)

    def add(self, words: list[str]) -> None:
        p, ids = self.net.p, [trigrams(w) for w in words]
        sizes = np.array([len(i) for i in ids])
        flat = np.fromiter((x for i in ids for x in i), np.int64, int(sizes.sum()))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        char = np.add.reduceat(p["char"][flat], starts, axis=0) / sizes[:, None]
        own = p["word"][[self.net.words.get(w, 0) for w in words]]
        x = np.concatenate((own, char), axis=1)
        new = np.concatenate([x @ p[f"in_{d}"] + p[f"bias_{d}"] for d in "fb"], axis=1).astype(np.float32)
        while self.used + len(new) > len(self.gates):
            self.gates = np.concatenate((self.gates, np.zeros_like(self.gates)))
        self.gates[self.used : self.used + len(new)] = new
        self.rows.update(zip(words, range(self.used, self.used + len(new)), strict=True))
        self.used += len(new)

    def windows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the words of all overlapping windows, (windows, WINDOW), 0 where empty; and whose they are."""
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        if self.used > self.cache_words:
            self._reset()
        new = set().union(*words).difference(self.rows)
        if any(len(w) > LONGEST for w in new):  # no such word is ever in the table
            words = list(map(short_words, words))
            new = set().union(*words).difference(self.rows)
        if new:
            self.add(sorted(new))
        grids, owner = [], []
        for i, w in enumerate(words):
            if w:
                k = 1 + max(0, -(-(len(w) - WINDOW) // STRIDE))
                line = np.zeros((k - 1) * STRIDE + WINDOW, np.int32)
                line[: len(w)] = np.fromiter(map(self.rows.__getitem__, w), np.int32, len(w))
                grids.append(np.lib.stride_tricks.sliding_window_view(line, WINDOW)[::STRIDE])
                owner += [i] * k
        return (np.concatenate(grids) if grids else np.zeros((0, WINDOW), np.int32)), np.array(owner, np.int64)

    def window_logits(self, grid: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grid), np.float32)
        for a in range(0, len(grid), 2048):
            ids = np.ascontiguousarray(grid[a : a + 2048].T)
            g = self.gates[ids]
            out[a : a + 2048] = self.net.logits(g[:, :, : 3 * HIDDEN], g[:, :, 3 * HIDDEN :], (ids > 0).astype(np.float32))
        return out

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Worst window's logit; texts without a word have that of no evidence."""
        grid, owner = self.windows(texts)
        best = np.full(len(texts), -np.inf, np.float32)
        np.maximum.at(best, owner, self.window_logits(grid))
        return best

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(np.clip(self.scale * (self.logits(texts).astype(np.float64) - self.shift), -30, 30))


def fit(texts: list[str], labels: list[int], steps: int = 360, lanes: int = 192, rate: float = 0.02, vocabulary: int = 20_000, seed: int = 3) -> Scorer:
    """Adam on windows; the first third takes any window of a document, then toxic ones their worst."""
    y = np.array(labels, np.float32)
    words = [short_words(WORD.findall(t.lower())) for t in texts]
    spread = Counter(w for ws in words for w in set(ws))
    known = {w: i + 1 for i, (w, n) in enumerate(sorted(spread.items(), key=lambda x: (-x[1], x[0]))[:vocabulary]) if n >= 3}
    net = Network(known, seed)
    scorer = Scorer(net)
    toxic, clean_ = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(toxic) or not len(clean_):
        net.p["out_w"][:] = 0
        net.p["out_b"][:] = -5 if not len(toxic) else 5
        return scorer
    rng = np.random.default_rng(seed)
    cut = [[w[i * STRIDE : i * STRIDE + WINDOW] for i in range(1 + max(0, -(-(len(w) - WINDOW) // STRIDE)))] if w else [] for w in words]
    toxic = np.array([i for i in toxic if cut[i]])
    pool = [(i, j) for i in clean_ for j in range(len(cut[i]))]
    if not len(toxic) or not pool:
        return scorer
    best = {i: None for i in toxic}
    grams: dict[str, list[int]] = {}
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for step in range(steps):
        if step >= steps // 3 and step % 40 == 0:
            scorer._reset()
            grid, owner = scorer.windows([texts[i] for i in toxic])
            found = scorer.window_logits(grid)
            for k, i in enumerate(toxic):
                best[i] = int(found[owner == k].argmax())
        bad = rng.choice(toxic, lanes // 2)
        picked = [(i, best[i] if best[i] is not None else int(rng.integers(len(cut[i])))) for i in bad] + [pool[k] for k in rng.integers(len(pool), size=lanes // 2)]
        rows = [cut[i][j] for i, j in picked]
        ids, mask = np.zeros((WINDOW, lanes), np.int64), np.zeros((WINDOW, lanes), np.float32)
        for w in {w for r in rows for w in r}.difference(grams):
            grams[w] = trigrams(w)
        k = max(len(grams[w]) for r in rows for w in r)
        chars = np.full((WINDOW, lanes, k), -1, np.int64)
        for lane, r in enumerate(rows):
            for t, w in enumerate(r):
                ids[t, lane], mask[t, lane] = known.get(w, 0), 1
                chars[t, lane, : len(grams[w])] = grams[w]
        ids[rng.random(ids.shape) < 0.1] = 0
        g = net.gradients(ids, chars, mask, np.repeat(np.array([1, 0], np.float32), [lanes // 2, lanes // 2]))
        for name, v in g.items():
            m1[name] += 0.1 * (v - m1[name])
            m2[name] += 0.01 * (v * v - m2[name])
            net.p[name] -= (rate * (0.3 if step > 2 * steps // 3 else 1) * (m1[name] / (1 - 0.9 ** (step + 1))) / (np.sqrt(m2[name] / (1 - 0.99 ** (step + 1))) + 1e-7)).astype(np.float32)
    scorer._reset()
    found = scorer.logits(texts)
    usable = np.isfinite(found)
    found, y = found[usable], y[usable]
    order = np.argsort(found)
    errors = np.concatenate(([0], np.cumsum(y[order]))) + np.concatenate((np.cumsum((1 - y[order])[::-1])[::-1], [0]))
    least = np.flatnonzero(errors == errors.min())
    k = int(least[len(least) // 2])
    edge = np.concatenate(([found[order[0]] - 1], found[order], [found[order[-1]] + 1]))
    cut_at = float((edge[k] + edge[k + 1]) / 2)
    scorer.shift = cut_at - np.log(0.7 / 0.3)
    return scorer


def training_rows(docs: DataFrame, labels: DataFrame, toxic_rows: int = 600, clean_rows: int = 1000, chars: int = 8000) -> list[tuple[str, int]]:
    """At most `toxic_rows` and `clean_rows` labelled texts of up to `chars` characters, not held out, by least hash of the text."""
    learn = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.length("text").between(1, chars)).withColumn("h", F.xxhash64("text"))
    both = learn.select("doc_id", "h").join(labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("y")), "doc_id")
    each = both.groupBy("h").agg(F.max("y").alias("y"))
    least = each.where("y = 1").orderBy("h").limit(toxic_rows).unionByName(each.where("y = 0").orderBy("h").limit(clean_rows))
    chosen = learn.select("h", "text").join(F.broadcast(least), "h").groupBy("h", "y").agg(F.min("text").alias("text"))
    return [(r["text"], r["y"]) for r in sorted(chosen.collect(), key=lambda r: r["h"])]


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null, empty and wordless texts score as no evidence of toxicity.

    Texts of any length are read whole, words of any length too; a score that equals the threshold predicts 1.
    Repeated rows are kept, other columns ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        own = shared.value
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                s = own.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
