import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helixframe.llm import packing, tokens
from helixframe.llm.common import worker_cache

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "a", "it's  two\n\n spaces ", "x\x1cy z", "<|endoftext|> a<|endoftext|>b", "é́ é", "中文字 тест", " nbsp em", "9" * 500, "a" * 30000, "😀😀 fin", "don't WE'LL 12.5%", "<|STARTOFTEXT|> ÀÉ İI ΣΑΣ"]
SCHEMA = "doc_id bigint, text string, source string, n_tokens string, length int"


def odd_rows(spark):
    rows = [(i, t, None if i % 4 == 0 else f"s{i % 3}", "x", 1) for i, t in enumerate(ODD)] + [(None, "no id", "s1", "x", 1), (3, "a", "s0", "x", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_counts_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    for docs in (spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), odd_rows(spark)):
        want = sorted((str(r.doc_id), len((r.text or "").encode()), len(own.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
        got = tokens.token_counts(docs, path, sample_rows=20).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_counts_of_nothing(spark):
    assert tokens.token_counts(odd_rows(spark).limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_a_full_cache_changes_nothing():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    texts = ["alpha beta gamma", "beta delta", "alpha epsilon zeta"] * 3
    worker_cache("token counts").clear()
    for size in (0, 3, 1000):
        assert tokens.count_batch(texts, path, {"alpha": 1}, size)[1:] == [len(own.encode(t).ids) for t in texts][1:]


def test_caches_keep_short_words_only():
    texts = [f"short {'long' * 40}{i} {'中文' * 60}{i}" for i in range(4)]
    for name, run, kept, most in (("byte_bpe_50k.json", tokens.count_batch, "token counts", tokens.KEPT), ("word_bpe_49k.json", packing.encode_batch, "packing", packing.KEPT_BYTES)):
        path = public_tokenizers.path(name)
        want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
        worker_cache(kept).clear()
        for _ in range(2):
            got = run(texts, path, {}) if kept == "token counts" else run(texts, path)
            assert got == [len(ids) if kept == "token counts" else np.array(ids, "<u4").tobytes() for ids in want]
        cache = worker_cache(kept)[path]
        assert cache and max(map(len, cache)) <= most


def test_another_table_is_never_taken_for_the_last_one():
    path = public_tokenizers.path("byte_bpe_50k.json")
    for n in range(1, 6):  # each table may stand where the one before it stood
        assert tokens.count_batch(["alpha"], path, {"alpha": n}) == [n]


def test_caches_of_another_operator_are_dropped():
    worker_cache("one")["big"] = 1
    assert worker_cache("one") == {"big": 1}
    assert worker_cache("two") == {} and worker_cache("one") == {}


def test_words_encoded_together_are_those_encoded_alone():
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    words = sorted({w for t in ODD if t and "<|" not in t for w in t.encode().lower().decode().split()} | {"\u200b", "\u3000", "it's2x", "a\u3000b"})
    made = {}
    for part in (made, {}):
        assert [np.frombuffer(packing.encode_word(own, w, part), "<u4").tolist() for w in words] == [own.encode(w, add_special_tokens=False).ids for w in words]


def test_simple_words_are_cut_as_the_library_cuts_them():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, draw = Tokenizer.from_file(path), random.Random(7)
    assert packing._cutter(own) is not None and packing._cutter(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))) is None
    signs = [*map(chr, range(33, 0x180)), *["'"] * 4, *"abcstredmlv0123", "\u0301", " ", "\n"]
    texts = ["".join(draw.choices(signs, k=draw.randint(1, 40))) for _ in range(3000)] + [t or "" for t in ODD]
    want = [own.encode(t, add_special_tokens=False).ids for t in texts]
    worker_cache("packing").clear()
    for size in (0, 100, 10_000):  # a full cache changes nothing
        for i in range(0, len(texts), 500):
            assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode_batch(texts[i : i + 500], path, size)] == want[i : i + 500]


@pytest.mark.parametrize("window", [16, 2048])
def test_pieces_cover_every_document(spark, window):
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_rows(spark)):
        pieces = packing.pack(docs, path, window=window, round_windows=2, with_ids=True).toPandas()
        want = {}
        for r in docs.collect():
            want.setdefault(r.doc_id, []).append([*own.encode(r.text or "", add_special_tokens=False).ids, 1])
        known = pieces[pieces.doc_id.notna()]
        for doc, part in known.groupby("doc_id"):
            if len(want[doc]) == 1:
                part = part.sort_values("start")
                assert np.frombuffer(b"".join(part.ids), "<u4").tolist() == want[doc][0]
                assert (part.start == part.length.cumsum() - part.length).all() and (part.doc_tokens == len(want[doc][0])).all()
        assert set(known.doc_id) == {k for k in want if k is not None}
        assert pieces.length.sum() == sum(len(x) for v in want.values() for x in v)
        assert all(zlib.crc32(i) == c and len(i) == 4 * n for i, c, n in zip(pieces.ids, pieces.ids_crc32, pieces.length))
        filled = pieces.sort_values(["sequence_id", "offset"])
        for s, part in filled.groupby("sequence_id"):
            assert (part.offset == part.length.cumsum() - part.length).all()
            used = part.length.sum()
            assert used == window or s == pieces.sequence_id.max()
            assert part.sequence_length.nunique() == 1 and used <= part.sequence_length.iloc[0] <= max(1, 2 * used - 1)


def test_every_round_has_the_target_shares(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(7)
    got = packing.pack(docs, path, round_windows=8).groupBy("round", "source").sum("length").toPandas()
    total = got["sum(length)"].sum()
    share = got.groupby("source")["sum(length)"].sum() / total
    full = got[got["round"] < got["round"].max()]
    assert len(full) and (abs(full["sum(length)"] - 8 * 2048 * full.source.map(share)) <= 1).all()


def test_targets_are_never_lost(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for most in (3, 65_536):
        got = packing.pack(docs, path, targets={"src0": 8, "src9": 8}, round_windows=4, max_sources=most).groupBy("round", "source").sum("length").toPandas()
        first = got[got["round"] == 0].set_index("source")["sum(length)"]
        n = docs.select("source").distinct().count()
        want = 4 * 2048 * 8 / (n + 14)
        assert abs(first["src0"] - want) <= 1 and abs(first["src9"] - want) <= 1
        # sources that share a queue have the sum of their shares
        assert abs(first.drop(["src0", "src9"]).sum() - (n - 2) * want / 8) <= 3
        assert got["sum(length)"].sum() == packing.pack(docs, path).agg({"length": "sum"}).first()[0]


def test_nothing_to_pack(spark):
    assert packing.pack(odd_rows(spark).limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_every_window_has_the_target_shares(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(7)
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).groupBy("sequence_id", "source").sum("length").toPandas()
    share = got.groupby("source")["sum(length)"].sum() / got["sum(length)"].sum()
    wide = got[got.sequence_id < got.sequence_id.max()].pivot(index="sequence_id", columns="source", values="sum(length)").fillna(0)
    assert len(wide) > 20 and (wide.sum(axis=1) == 2048).all()
    print("largest difference of a source in a window:", abs(wide - 2048 * share).max().max())
    assert (abs(wide - 2048 * share) <= len(share)).all().all()


@pytest.mark.parametrize("by_size", [True, False])
def test_schedules_of_many_sources_are_whole(by_size):
    draw = random.Random(3)
    totals = [draw.choice([0, 1, 5, 300, 300, 4000]) for _ in range(60)] + [50_000]
    weights = [max(1, t) for t in totals] if by_size else [draw.randint(1, 9) for _ in totals]
    plan, places, counts = packing.Schedule(totals, weights, 256, 1), [], {}
    for s, t in enumerate(totals):
        at = 0
        cuts = np.array(sorted({0, t, *(draw.randint(0, t) for _ in range(5))}))
        if t:
            for _, x, g, n in zip(*(v.tolist() for v in plan.pieces(s, cuts)), strict=True):
                assert x == at and n > 0 and g // 256 == (g + n - 1) // 256 and not any(x < c < x + n for c in cuts)
                places += range(g, g + n)
                for p in range(g, g + n):
                    counts[p // 256, s] = counts.get((p // 256, s), 0) + 1
                at += n
        assert at == t
    assert sorted(places) == list(range(sum(totals)))
    large = packing.Schedule(totals, weights, 256, 1)
    large.totals, large.weights, large.phases = (v.astype(object) for v in (large.totals, large.weights, large.phases))
    for s, t in enumerate(totals):
        if t:
            for a, b in zip(plan.pieces(s, np.array([0, t])), large.pieces(s, np.array([0, t])), strict=True):
                assert a.tolist() == b.tolist()
    if by_size:
        assert max(abs(counts.get((r, s), 0) - 256 * t / sum(totals)) for s, t in enumerate(totals) for r in range(sum(totals) // 256)) <= 12


def test_the_table_holds_the_most_frequent(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, "zyxw zyxw qponm " + f"rare{i}xx " + ("x" * 200)) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert set(tokens.frequent_table(docs, path, size=4)) == {"xx", " zyxw", " qponm", " rare"}
    assert len(tokens.frequent_table(docs, path, sample_rows=10, size=20)) == 20 and tokens.frequent_table(docs.limit(0), path, size=20)
