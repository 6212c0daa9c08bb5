import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import simhash
from helixframe.llm.common import connected_components, store


def brute(fps, radius=4):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_shingle_hash_is_xxh64_of_spark(spark):
    text = "One\ttwo  THREE four fïve\x0bsix seven"
    words = ["one", "two", "three", "four", "fïve", "six", "seven"]
    assert simhash.words_of(text) == words
    shingles = [" ".join(words[i : i + 4]) for i in range(4)]
    hashes = [r[0] % 2**64 for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 4)
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("") == simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_components_match_all_pairs_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs, pass_bits=1).collect()}
    assert {k: v[1] for k, v in got.items()} == brute({k: v[0] for k, v in got.items()})


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_every_planted_distance_is_found(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = base + [b ^ sum(1 << i for i in rng.sample(range(64), d)) for b in base for d in (1, 2, 3, 4, 5)]
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    points = store(spark.createDataFrame(signed, "fp bigint").distinct(), "points")
    edges = simhash.ball_edges(points, radius=radius, pass_bits=2)
    assert all(((r.src ^ r.dst) % 2**64).bit_count() <= radius for r in edges.collect())
    got = {r.node % 2**64: r.component for r in connected_components(edges).collect()}
    groups = brute(dict(enumerate(fps)), radius)
    for i, a in enumerate(fps):
        for j, b in enumerate(fps):
            if (a ^ b).bit_count() <= radius and i != j and a != b:
                assert got[a] == got[b]
            if a in got and b in got and got[a] == got[b]:
                assert groups[i] == groups[j]


def test_nulls_copies_and_clashing_columns(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "\n", 9), (4, "a b c d e", 9), (4, "a b c d e", 9), (5, "A  B c D e", 9), (None, "z", 9), (6, "w " * 50000, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(docs, pass_bits=0).collect())
    assert got == [("1", 1), ("2", 1), ("3", 1), ("4", 4), ("4", 4), ("5", 4), ("6", 6), ("None", None)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "4", "6", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1300)}


def test_parities_are_linear_and_even():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 1 << 63, 1000, np.uint64) for _ in range(2))
    assert (simhash.parities(a ^ b, 3) == simhash.parities(a, 3) ^ simhash.parities(b, 3)).all()
    shares = np.bincount(simhash.parities(simhash.flips(2), 3), minlength=8)
    assert shares.sum() == 2081 and shares.min() > 180


def test_an_odd_radius_links_no_further(spark):
    points = store(spark.createDataFrame([(0,), (15,), (7,)], "fp bigint"), "points")
    assert {frozenset((r.src, r.dst)) for r in simhash.ball_edges(points, radius=3).collect()} == {frozenset((0, 7)), frozenset((15, 7))}
