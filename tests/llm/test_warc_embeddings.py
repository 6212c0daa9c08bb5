import base64
import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import embeddings, warc
from helixframe.llm.common import scratch
from helixframe.llm.queries import op1_warc

PAGES = [(1, "http://a/x y", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://c\r\nX: 1", ""), (5, "http://d", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb"), (6, "http://e", "é" * 40000), (7, "http://f", "\r\n\r\n"), (9, "http://b", "same")]


def expected(rows, least=0):
    out = {}
    for i, _, h in rows:
        data = (h or "").encode()
        top = max(j for j, _, g in rows if (g or "") == (h or ""))
        out[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if i != top and len(data) >= least else "response", top if i != top and len(data) >= least else None)
    return out


def write(spark, rows, folder):
    spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).write.parquet(f"{folder}/pages.parquet")


def test_round_trip(spark, tmp_path):
    write(spark, PAGES, tmp_path)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op1_warc(spark, str(tmp_path)).collect()}
    assert got == expected(PAGES)


def test_payloads_and_small_ones(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    path = scratch(spark, "test-warc")
    warc.write(pages, path, least_bytes=5, file_bytes=1)
    records = warc.read(spark, path)
    captures = {int(r.metadata.fields.split()[1]): r for r in warc.assemble(records).collect()}
    assert {k: bytes(r.main.payload) for k, r in captures.items()} == {i: (h or "").encode() for i, _, h in PAGES}
    assert all(r.main.type == "response" and r.request.type == "request" and r.copies == 1 for r in captures.values())


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "u", "t"), (1, "u", "t"), (None, "v", "t"), (None, "w", None)]
    path = scratch(spark, "test-warc")
    warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path)
    got = warc.assemble(warc.read(spark, path)).collect()
    assert len(got) == 4 and sorted(r.copies for r in got) == [1, 1, 2, 2]
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def record(kind, rid, block, **headers):
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", *(f"WARC-{k.replace('_', '-')}: <{v}>" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives_by_two_hops_and_gzip(spark, tmp_path):
    data = [record("warcinfo", "i", b"x"), record("response", "r", b"body", Concurrent_To="q"), record("request", "q", b"get"), record("metadata", "m", b"meta", Concurrent_To="q"), record("metadata", "lost", b"", Concurrent_To="none")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    (row,) = warc.assemble(warc.read(spark, str(tmp_path))).collect()
    assert (row.capture_id, row.request.record_id, row.metadata.record_id, bytes(row.main.payload)) == ("r", "q", "m", b"body")
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse(data[1][:-8]))


def test_pieces_of_any_size_give_the_same_records(monkeypatch):
    data = [record("response", f"r{i}", bytes([65 + i % 26]) * (i * 37 % 5000)) for i in range(60)]
    whole = [(h["warc-record-id"][0], b) for h, b in warc.parse(b"".join(data))]
    plain = warc.inflated
    for archive in (b"".join(data), gzip.compress(b"".join(data)), b"".join(map(gzip.compress, data))):
        for step, most in ((7, 5), (100, 4096), (1 << 18, 4 << 20)):
            monkeypatch.setattr(warc, "inflated", lambda d, s=step, m=most: plain(d, s, m))
            assert [(h["warc-record-id"][0], b) for h, b in warc.parse(archive)] == whole
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse(gzip.compress(b"".join(data))[:-20]))


def test_long_pages_have_files_of_their_own(spark, tmp_path):
    rows = [(i, "u", chr(97 + i) * n) for i, n in enumerate((10, 20, 1 << 17, 1 << 18, 1 << 21, 17 << 20))]
    warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), str(tmp_path / "w"), file_bytes=1 << 20)
    sizes = sorted([len(r.main.payload), r.main.payload_bytes] for r in warc.assemble(warc.read(spark, str(tmp_path / "w"))).collect())
    assert sizes == [[len(h)] * 2 for _, _, h in rows]
    files = [sum(len(b) for _, b in warc.parse(f.read_bytes())) for f in (tmp_path / "w").glob("*.gz")]
    assert len(files) >= 5 and all(n < (1 << 20) + 5000 or n > 1 << 20 for n in files)


def brute(rows, cosine=0.95):
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: {j for j in good if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.sqrt((good[i] @ good[i]) * (good[j] @ good[j])) >= cosine} if i in good else set() for i, _ in rows}
    comp = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i in links:
            low = min([comp[i], *(comp[j] for j in links[i])])
            changed |= low < comp[i]
            comp[i] = low
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in links}


@pytest.mark.parametrize("chunk", [1 << 30, 16])
def test_links_against_all_pairs(spark, chunk):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((25, 16))
    rows = [(k, (base[k % 25] + 0.15 * rng.standard_normal(16)).astype(np.float32).tolist()) for k in range(400)]
    rows += [(1000 + k, rows[3][1]) for k in range(40)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0] * 8), (2004, [2.0] * 8), (2005, [None] * 16), (2006, [float("inf")] + [1.0] * 15), (2007, [])]
    data = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("v", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(data, chunk=chunk, recall=0.99999).collect()}
    want = brute(rows)
    missed = sum(want[i][0] - got[i][0] for i in want)
    assert all(got[i][0] <= want[i][0] for i in want) and missed <= 0.002 * sum(w[0] for w in want.values())
    if not missed:
        assert got == want
    assert embeddings.near_duplicates(data.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == [("1", 2, "1", True), ("1", 2, "1", True), ("None", 0, "None", False), ("None", 2, "1", False)]


def test_thousands_of_different_near_copies_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    near = rng.standard_normal(24) + 0.02 * rng.standard_normal((3000, 24))
    far = rng.standard_normal((300, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((near, far)).astype(np.float32))]
    monkeypatch.setattr(embeddings, "CHUNK_BYTES", 32 << 10)
    monkeypatch.setattr(embeddings, "UNIT_BYTES", 256 << 10)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), recall=0.9).collect()}
    assert all(got[i] == (2999, 0) for i in range(3000)) and all(got[i] == (0, i) for i in range(3000, 3300))


def test_recall_at_the_bound():
    """Planted pairs just above the bound, among 20,000 others: at least 0.9 of them share a signature in some table."""
    rng = np.random.default_rng(9)
    bits, tables = embeddings.plan_tables(20_000, 0.95, 0.999)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * b
    met = (embeddings.signatures(a, bits, tables) == embeddings.signatures(b, bits, tables)).any(axis=1)
    assert met.mean() >= 0.99
