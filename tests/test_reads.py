import bz2
import gzip
import lzma
import random
import re

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe import cli, errors
from helixframe.errors import FormatError, ResourceError, SourceError, UnsupportedFormat, UsageError
from helixframe.functions import sequence as fn
from helixframe.operators import admission, codecs, container, layout, similarity, store
from helixframe.sources import fastq
from helixframe.streaming import ingest


def text_of(n=25, size=20, seed=1):
    rng = random.Random(seed)
    return "".join(f"@r{i} c:{i}\n{''.join(rng.choices('ACGT', k=size + i % 3))}\n+\n{''.join(rng.choices('#@+IJ', k=size + i % 3))}\n" for i in range(n))


@pytest.mark.parametrize("name,pack", [("a.fastq", bytes), ("a.fastq.gz", gzip.compress), ("a.dat", gzip.compress), ("a.bz2", bz2.compress), ("a.xz", lzma.compress), ("a.zst", zstandard.compress)])
def test_files_of_all_compressions(spark, tmp_path, name, pack):
    (tmp_path / name).write_bytes(pack(text_of().encode()))
    rows = fastq.read_fastq(spark, str(tmp_path / name)).orderBy("read_idx").collect()
    assert [(r.read_idx, r.id, r.comment) for r in rows] == [(i, f"r{i}", f"c:{i}") for i in range(25)]
    assert "".join(f"@{r.id} {r.comment}\n{r.sequence}\n+\n{r.quality}\n" for r in rows) == text_of()


@pytest.mark.parametrize("broken,word", [("\n@a\nAC\n+\nII\n", "begin with @"), ("a\nAC\n+\nII\n", "begin with @"), ("@a\nAC\n+\n", "cut short"), ("@a\nAC\nx\nII\n", r"begin with \+"), ("@a\nAC\n+\nI\n", "record 1: 2 bases but 1"), ("@a\nA\n+\nI\n\n", "record 2")])
def test_malformed_records_name_their_place(broken, word):
    with pytest.raises(FormatError, match=word):
        list(fastq.records(broken.splitlines(keepends=True)))


def test_records_keep_tabs_and_windows_line_ends():
    assert list(fastq.records(["@a\tb c d\r\n", "AC \r\n", "+a\r\n", "@+\r\n"])) == [(0, "a\tb", "c d", "AC", "@+")]
    assert list(fastq.records([])) == []


def test_text_scan_equals_the_source(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(text_of(200))
    one = fastq.read_fastq(spark, str(tmp_path / "a.fastq"))
    two = fastq.read_text_fastq(spark, str(tmp_path / "a.fastq"))
    assert sorted(one.collect()) == sorted(two.collect())
    assert layout.in_range(one, "10:12").count() == 3 and fastq.mate_paths("x/a.b.fq") == ("x/a.b_R1.fq", "x/a.b_R2.fq")
    (tmp_path / "b.fastq").write_text("@a\nAC\n+\nI\n")
    with pytest.raises(Exception, match="differ in number"):
        fastq.read_text_fastq(spark, str(tmp_path / "b.fastq")).collect()


def test_mates_must_be_as_many(spark, tmp_path):
    for name, n in (("1", 4), ("2", 3)):
        (tmp_path / name).write_text(text_of(n))
    one, two = (fastq.read_fastq(spark, str(tmp_path / n)) for n in "12")
    with pytest.raises(Exception, match="one mate only"):
        layout.zip_mates(one, two).collect()
    assert layout.zip_mates(one, two, strict=False).count() == 4


@pytest.mark.parametrize("text,want", [("", (None, None)), ("0", (None, None)), ("0:", (None, None)), ("3", (3, 3)), ("2:5", (2, 5)), (":5", (None, 5)), ("5:", (5, None)), ("10:5", (10, 5))])
def test_ranges(text, want):
    assert layout.parse_range(text) == want


def test_class_and_block_size():
    assert [layout.length_class(*x) for x in ((100, 511), (100, 512), (1024, 400), (9, 10_239), (9, 10_240))] == ["short", "medium", "medium", "medium", "long"]
    assert layout.block_size(0, "medium", 2000, 4000) == 2 and layout.block_size(7, "long", 9, 1) == 7 and layout.block_size(0, "medium", 511) == 50_000


@given(st.lists(st.integers(-(2**62), 2**62), max_size=60))
@settings(max_examples=60, deadline=None)
def test_integers_come_back(values):
    assert codecs.unzigzags(codecs.from_varints(codecs.varints(codecs.zigzags(values)))) == values
    if all(abs(v) < 2**60 for v in values):
        assert codecs.decode_deltas(codecs.encode_deltas(values)) == values if values else True


@given(st.lists(st.text("ab0159:_/| \t", max_size=12), min_size=1, max_size=30))
@settings(max_examples=80, deadline=None)
def test_identifiers_come_back(values):
    codec, data = codecs.encode_ids(values)
    assert codecs.decode_ids(codec, data, len(values)) == values


def test_odd_identifiers_fall_back_to_exact():
    for values in (["a:1", "b"], ["a:01", "a:2"], ["a:+5", "a:-0"], ["a:1:2", "a:1_2"]):
        codec, data = codecs.encode_ids(values)
        assert codecs.decode_ids(codec, data, len(values)) == values
    codec, data = codecs.encode_ids([f"HWUSI:1:{i}" for i in range(500)])
    assert codecs.family_of(codec, "ids") == "id_tokens" and len(data) < 500


@given(st.lists(st.text("!#5I~", max_size=30), max_size=12), st.sampled_from([1, 2]))
@settings(max_examples=40, deadline=None)
def test_qualities_come_back(values, order):
    assert codecs.decode_qualities(codecs.encode_qualities(values, order), [len(v) for v in values], order) == values


def test_contigs_group_shifted_and_reversed_reads():
    rng = random.Random(3)
    genome = "".join(rng.choices("ACGT", k=120))
    rc = str.maketrans("ACGT", "TGCA")
    reads = [genome[i : i + 60] for i in range(0, 24, 4)] + [genome[5:65].translate(rc)[::-1], "N" * 60, genome[2:40] + "N" + genome[41:62]] + ["".join(rng.choices("ACGT", k=60)) for _ in range(5)]
    groups = similarity.contigs(reads)
    assert similarity.from_contigs(groups) == reads and len(groups[0]["deltas"]) == 7  # the last shift leaves too much over
    assert sum(len(d["mm_pos"]) for d in groups[0]["deltas"]) == 1
    many = ["".join(rng.choices("ACGT", k=511)) for _ in range(200)]
    codec, data = codecs.encode_sequences(many, "short")
    assert codecs.family_of(codec, "seq") == "consensus" and codecs.decode_sequences(codec, data, [511] * 200) == many
    for odd in (["acgt"], ["ACGR"], ["A"] * 4097):
        codec, data = codecs.encode_sequences(odd, "short")
        assert codecs.family_of(codec, "seq") == "zstd" and codecs.decode_sequences(codec, data, [len(s) for s in odd]) == odd


def test_codec_bytes_are_checked():
    for value, stream in ((0x20, "ids"), (0x40, "seq"), (0xF1, "seq"), (0x10, "aux")):
        with pytest.raises(FormatError):
            codecs.family_of(value, stream)
    with pytest.raises(ResourceError):
        codecs.expand(codecs.squeeze(b"x" * 1000), 999)


def test_quantisers():
    assert [fn.illumina(q) for q in (0, 1, 2, 9, 10, 39, 40, 93)] == [2, 2, 6, 6, 15, 37, 40, 40]
    assert [fn.nearest(q, (7, 15, 20)) for q in (0, 11, 12, 17, 18, 93)] == [7, 7, 15, 15, 20, 20]


def test_minimizer_forms_agree_with_n(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("ACGTN", [9, 9, 9, 9, 1], k=k))) for i, k in enumerate((0, 14, 15, 16, 24, 25, 80, 200))] + [(9, "N" * 40)]
    df = spark.createDataFrame(rows, "read_idx bigint, sequence string")
    assert sorted(similarity.minimizers(df).collect()) == sorted(similarity.minimizers_arrow(df).collect())


def test_archive_from_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "1.fq").write_text(text_of(30))
    out = str(tmp_path / "a")
    cli.run(spark, ["compress", "-i", str(tmp_path / "1.fq"), "-o", out, "--reorder"])
    cli.run(spark, ["verify", "-i", out])
    cli.run(spark, ["info", "-i", out, "--json", "--detailed", "--show-codecs"])
    said = capsys.readouterr().out
    assert '"total_reads":30' in said and "block 0: first 0, reads 30" in said and "ids " in said
    cli.run(spark, ["decompress", "-i", out, "-o", str(tmp_path / "o"), "--original-order"])
    assert "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*"))) == text_of(30)
    cli.run(spark, ["d", "-i", out, "-o", str(tmp_path / "h"), "--header-only", "--range", "2:3"])
    assert sum(p.read_text().count("@") for p in (tmp_path / "h").glob("part-*")) == 2
    for mode in ("illumina8", "qvz", "discard"):
        lossy = str(tmp_path / mode)
        cli.run(spark, ["c", "-i", str(tmp_path / "1.fq"), "-o", lossy, "--lossy-quality", mode, "--id-mode", "discard"])
        cli.run(spark, ["v", "-i", lossy])
        ids = [r.id for r in store.read_archive(spark, lossy).orderBy("read_idx").collect()]
        assert ids == [f"read{i + 1}" for i in range(30)]
    with pytest.raises(UnsupportedFormat):
        store.info(spark, str(tmp_path / "none"))
    with pytest.raises(ResourceError):
        store.write_archive(fastq.read_fastq(spark, str(tmp_path / "1.fq")), str(tmp_path / "big"), limit_bytes=100)
    assert not (tmp_path / "big").exists()


def test_a_changed_block_is_found(spark, tmp_path):
    (tmp_path / "1.fq").write_text(text_of(30))
    blocks = store.encode_blocks(fastq.read_fastq(spark, str(tmp_path / "1.fq")), 10, "medium")
    assert [r.ok for r in store.verify(blocks.selectExpr("* except (checksum)", "if(block_id = 1, 1L, checksum) checksum").select(*blocks.columns)).orderBy("block_id").collect()] == [True, False, True]
    with pytest.raises(Exception, match="not allowed"):
        store.decode_blocks(blocks.selectExpr("* except (codec_seq)", "cast(64 as smallint) codec_seq").select(*blocks.columns)).collect()


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "1.fq").write_text(text_of(25))
    stream = ingest.read_stream(spark, str(tmp_path / "1.fq"), rows_per_slice=10, slices_per_batch=1)
    query = ingest.append_blocks(stream, str(tmp_path / "b"), str(tmp_path / "c"), 10, kind="medium")
    for _ in range(120):
        query.processAllAvailable()
        if len(list((tmp_path / "b").glob("batch=*"))) >= 3:
            break
    query.stop()
    blocks = ingest.finish(spark, str(tmp_path / "b"))
    assert sorted(store.decode_blocks(blocks).collect()) == sorted(fastq.read_fastq(spark, str(tmp_path / "1.fq")).collect())
    assert store.structure_errors(blocks, 25).count() == 0


def test_sniff_falls_back_to_the_extension():
    assert [fastq.sniff(h, p) for h, p in ((b"\x1f\x8b", "x.fq"), (b"@r1 AC", "x.gz"), (b"", "x.ZST"), (b"@r1", "x.fq"), (b"@r1", "xz"), (b"BZh9", "x.gz"))] == ["gzip", "gzip", "zstd", "plain", "xz", "bzip2"]


def numbered(first, n, size=20):
    return "".join(f"@r{i} c{i}\n{'ACGT' * (size // 4 + i % 3)}\n+\n{'IIII' * (size // 4 + i % 3)}\n" for i in range(first, first + n))


def check_numbers(df, n):
    rows = sorted(df.collect())
    assert [(r.read_idx, r.id, r.comment) for r in rows] == [(i, f"r{i}", f"c{i}") for i in range(n)]
    assert all(len(r.sequence) == 20 + 4 * (i % 3) for i, r in enumerate(rows))


@pytest.mark.parametrize("split", [40, 100, 333, 5000, 1 << 20])
def test_many_files_and_splits_are_numbered_in_order(spark, tmp_path, split):
    at = 0
    for name, n in (("a", 1), ("b", 3), ("c", 200), ("d", 50)):
        (tmp_path / name).write_text(numbered(at, n))
        at += n
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    session.conf.set("spark.sql.files.openCostInBytes", "1")
    check_numbers(fastq.read_text_fastq(session, str(tmp_path)), 254)


def test_compressed_files_beside_plain_ones(spark, tmp_path):
    import gzip
    import lzma

    (tmp_path / "a.fq.gz").write_bytes(gzip.compress(numbered(0, 30).encode()))
    (tmp_path / "b.fq").write_text(numbered(30, 20))
    (tmp_path / "c.fq.xz").write_bytes(lzma.compress(numbered(50, 7).encode()))
    check_numbers(fastq.read_fastq(spark, str(tmp_path)), 57)
    check_numbers(fastq.read_fastq(spark, f"{tmp_path}/a.fq.gz,{tmp_path}/b.fq"), 50)


def test_a_file_of_three_lines_is_cut_short(spark, tmp_path):
    (tmp_path / "a").write_text("@a\nAC\n+\n")
    with pytest.raises(FormatError, match="record 1 is cut short"):
        fastq.read_text_fastq(spark, str(tmp_path / "a"))
    (tmp_path / "e").write_text("")
    assert fastq.read_text_fastq(spark, str(tmp_path / "e")).count() == 0


def test_slices_cover_every_record_once(tmp_path):
    (tmp_path / "a").write_text(numbered(0, 103)[:-1])
    for rows, piece in ((1, 64), (10, 50), (10, 1 << 20), (1000, 1 << 20), (1000, 64)):
        stream = fastq.SliceStream({"path": str(tmp_path / "a"), "rowsPerSlice": rows, "slicesPerBatch": 3})
        at, seen, ends = stream.initialOffset(), [], []
        while True:
            found, end = stream.read(at)
            found = list(found)
            if not found:
                break
            assert list(stream.readBetweenOffsets(at, end)) == found
            for s in found:
                seen += [r[0] for r in fastq.reads_of(s)]
            at = end
        assert seen == list(range(103)), rows
        at, n = 0, 0
        while part := fastq.cut_plain(str(tmp_path / "a"), at, n, rows, piece):
            at, n = part[-1][3], fastq.lines_of(part[-1])
        assert n == 103


def test_pairs_of_unequal_files_are_an_error(tmp_path):
    (tmp_path / "1").write_text(numbered(0, 25))
    (tmp_path / "2").write_text(numbered(0, 24))
    stream = fastq.PairStream({"path": str(tmp_path / "1"), "path2": str(tmp_path / "2"), "rowsPerSlice": 10})
    with pytest.raises(FormatError, match="mates"):
        stream.read(stream.initialOffset())


def test_command_line_streaming_pairs_and_ranges(spark, tmp_path, capsys):
    for m in "12":
        (tmp_path / m).write_text(numbered(0, 25))
    for layout_, extra in (("interleaved", []), ("consecutive", []), ("consecutive", ["--streaming"]), ("interleaved", ["--streaming", "--pipeline"])):
        out = str(tmp_path / f"a{layout_}{len(extra)}")
        cli.run(spark, ["-q", "c", "-i", str(tmp_path / "1"), "-2", str(tmp_path / "2"), "-o", out, "--pe-layout", layout_, *extra])
        cli.run(spark, ["v", "-i", out, "--verbose", "--fail-fast"])
        cli.run(spark, ["x", "-i", out, "-o", f"{out}.fq", "--split-pe"])
        for m in (1, 2):
            assert "".join(p.read_text() for p in sorted(tmp_path.glob(f"a{layout_}{len(extra)}_R{m}.fq/part-*"))) == numbered(0, 25)
        with pytest.raises(SourceError):
            cli.run(spark, ["x", "-i", out, "-o", f"{out}.fq", "--split-pe"])
    capsys.readouterr()
    cli.run(spark, ["d", "-i", out, "-o", "-", "--range", "1:2"])
    assert capsys.readouterr().out == numbered(0, 1) * 2
    with pytest.raises(UsageError):
        cli.run(spark, ["c", "-i", "-", "-2", "x", "-o", "y"])


def test_overwriting_never_mixes_archives(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "a")
    for n in (10, 20):
        (tmp_path / f"{n}").write_text(numbered(0, n))
    one, two = (fastq.read_fastq(spark, str(tmp_path / n)) for n in ("10", "20"))
    store.write_archive(one, out, requested_block=5, kind="medium")
    with pytest.raises(SourceError):
        store.write_archive(two, out)
    monkeypatch.setattr(store, "finish_archive", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        store.write_archive(two, out, "overwrite", requested_block=5)
    assert store.read_archive(spark, out).count() == 10 and sorted(p.name for p in tmp_path.iterdir()) == ["10", "20", "a"]
    monkeypatch.undo()
    store.write_archive(two, out, "overwrite", requested_block=5, kind="medium")
    assert store.read_archive(spark, out).count() == 20 and store.check_archive(spark, out).count() == 0
    with pytest.raises(ResourceError):
        store.read_archive(spark, out, budget=admission.DecodeBudget(100))


def test_long_archives_with_coded_qualities_verify(spark, tmp_path):
    (tmp_path / "1").write_text(numbered(0, 10))
    store.write_archive(fastq.read_fastq(spark, str(tmp_path / "1")), str(tmp_path / "a"), kind="long", quality_codec="context")
    cli.run(spark, ["v", "-i", str(tmp_path / "a")])
    check_numbers(store.read_archive(spark, str(tmp_path / "a")), 10)


def test_container_comes_back_and_refuses_damage(spark, tmp_path):
    (tmp_path / "1").write_text(numbered(0, 30))
    blocks = store.encode_blocks(fastq.read_fastq(spark, str(tmp_path / "1")), 8, "medium").persist()
    file = tmp_path / "x.bin"
    order = list(range(29, -1, -1))
    assert container.export(blocks, str(file), 1 << 10, "né.fq", 7, order) == 30
    opened = container.open_container(str(file))
    assert (opened["header"]["original_filename"], opened["header"]["timestamp"], opened["header"]["total_read_count"], len(opened["index"])) == ("né.fq", 7, 30, 4)
    assert container.read_map(str(file), opened) == (order, order)
    check_numbers(store.decode_blocks(container.load_blocks(spark, str(file))), 30)
    assert container.contains_read(opened["index"][1], 15) and not container.contains_read(opened["index"][1], 16)
    data = file.read_bytes()
    first = opened["index"][0]["offset"]
    damaged = {"unknown": b"x" + data[1:], "sequential": container.MAGIC_SEQUENTIAL + data[8:], "version": data[:8] + b"\x30" + data[9:], "short": data[:20], "footer": data[:-1] + b"x", "index": data[:-32] + (1 << 60).to_bytes(8, "little") + data[-24:], "header": data[: first + 4] + b"\x09" + data[first + 5 :], "reserved": data[: first + 13] + b"\x01" + data[first + 14 :]}
    for what, bad in damaged.items():
        file.write_bytes(bad)
        with pytest.raises(UnsupportedFormat if what in ("sequential", "version") else FormatError):
            container.open_container(str(file))
    with pytest.raises(UnsupportedFormat):
        fastq.refuse_foreign("x", data[:8])


def test_larger_sections_are_passed_over():
    head = container.write_global(5, 3, "a", 9)
    grown = (len(head) + 4).to_bytes(4, "little") + head[4:] + b"more"
    import io

    f = io.BytesIO(grown + b"next")
    assert container.read_global(f)["flags"] == 5 and f.read() == b"next"
    entry = container.put(container.ENTRY, offset=1, read_count=2)
    f = io.BytesIO(container.put(container.INDEX, header_size=20, entry_size=30, num_blocks=2) + b"xxxx" + (entry + b"yy") * 2)
    assert [e["read_count"] for e in container.read_index(f, 1000, admission.DecodeBudget(1 << 30))] == [2, 2]
    assert [container.size_of(x) for x in (container.GLOBAL, container.BLOCK, container.INDEX, container.ENTRY, container.MAP, container.FOOTER)] == [26, 104, 16, 28, 32, 32]


def test_admission_numbers(tmp_path):
    (tmp_path / "m").write_text("MemTotal: 9 kB\nMemAvailable:  2048000 kB\n")
    assert admission.available_mb(str(tmp_path / "m")) == 2000 and admission.available_mb(str(tmp_path / "none")) == 8192
    b = admission.DecodeBudget.resolve(1)
    assert (b.limit, b.allocation, b.blocks, b.reads, b.automatic) == (16 << 20, 8 << 20, 262_144, 524_288, False)
    assert admission.DecodeBudget.resolve(0).automatic and b.original_order_peak(10, 100) == 160 + 6400 + 200
    assert (b.batch(4, 1), admission.DecodeBudget(1 << 40).batch(100, 1), b.batch(0, 1 << 20)) == (8, 64, 2)
    for call in (lambda: b.check_allocation(9 << 20), lambda: b.check_index(1 << 30, 1 << 40, 28), lambda: b.check_index(10, 100, 28), lambda: b.check_reads(1 << 30), lambda: b.check_original_order(1 << 20, 0), lambda: b.check_block(6 << 20), lambda: b.batch(1, 6 << 20)):
        with pytest.raises(ResourceError):
            call()
    m = admission.MemoryBudget.of(8192)
    assert (m.buffer_mb, m.second_pass_bytes, m.block_reads(8), admission.MemoryBudget.of(1).total_mb) == (512, (8192 - 576) << 20, 500_000, 256)
    c = admission.Chunking.of(100_000_000, 150, 100_000, 8, 1024)
    assert c.chunks == -(-(100_000_000 * 554 // (1 << 20)) // 1024) and "chunks" in str(c) and admission.Chunking.of(10, 150, 100, 1, 1024).chunks == 1


def test_errors_have_their_exit_codes():
    assert [getattr(errors, n).exit_code for n in ("SourceError", "FormatError", "EncodeError", "DecodeError", "UsageError", "ChecksumError", "CorruptBlock", "UnsupportedVersion", "ParseError", "UnsupportedFormat", "ResourceError")] == [2, 3, 2, 3, 1, 4, 4, 5, 3, 5, 1]
    assert cli.main(["info", "-i", "/none/there"]) == 5


def test_path_of_nearest_reads():
    sizes, hashes = [10, 30, 12, 11, 50], [[1], [1, 2], [1], [2], []]
    assert similarity.path(sizes, hashes, 64) == [0, 2, 1, 3, 4]
    assert similarity.path(sizes, hashes, 1) == [0, 1, 2, 3, 4] and similarity.path([], [], 64) == []
    draw = random.Random(4)
    sizes, hashes = [draw.randrange(20) for _ in range(60)], [[draw.randrange(8) for _ in range(draw.randrange(4))] for _ in range(60)]
    for limit in (1, 3, 64):
        left, now, want = set(range(60)), 0, []
        while now is not None:
            left.discard(now)
            want.append(now)
            seen = [i for h in hashes[now] for i in sorted(left) if h in hashes[i]][:limit]
            now = min(seen, key=lambda i: (abs(sizes[i] - sizes[now]), seen.index(i))) if seen else min(left, default=None)
        assert similarity.path(sizes, hashes, limit) == want


def test_alignment_by_brute_force():
    draw = random.Random(9)
    rc = str.maketrans("ACGT", "TGCA")
    reference = "".join(draw.choices("ACGT", k=40))
    texts = [reference[a : a + 30] for a in (0, 5, 10)] + [reference[3:33].translate(rc)[::-1], "".join(draw.choices("ACGTN", k=25)), "A"]
    width = max(map(len, texts))
    forms = [np.array([list(f(t).ljust(width, "\0").encode()) for t in texts], np.uint8) for f in (str, lambda t: t.translate(rc)[::-1])]
    cost, shift, strand = similarity.align(*forms, np.array([len(t) for t in texts]), np.frombuffer(reference.encode(), np.uint8), 32)
    for i, t in enumerate(texts):
        best = None
        for turned in (False, True):
            x = t.translate(rc)[::-1] if turned else t
            for s in range(-32, 33):
                pairs = [(x[p], reference[p + s]) for p in range(len(x)) if 0 <= p + s < len(reference)]
                if pairs and (best is None or sum(a != b for a, b in pairs) + len(x) - len(pairs) < best[0]):
                    best = (sum(a != b for a, b in pairs) + len(x) - len(pairs), s, turned)
        assert (cost[i], shift[i], strand[i]) == best


def test_for_each_sees_every_read(spark, tmp_path):
    (tmp_path / "1").write_text(numbered(0, 12))
    assert fastq.for_each(fastq.read_fastq(spark, str(tmp_path / "1")), lambda r: None) == 12


def test_reordering_is_for_single_short_reads_only():
    assert [layout.reorder_allowed(*x) for x in ((True, "short", False), (True, "medium", False), (True, "short", True), (False, "short", False))] == [True, False, False, False]
    assert layout.default_stats("streaming") == ("medium", 1024) and layout.default_stats("pipeline") == ("short", 150)


def test_only_reads_that_can_fit_are_aligned(monkeypatch):
    draw, tried, align = random.Random(12), [], similarity.align
    monkeypatch.setattr(similarity, "align", lambda reads, *a: tried.append(len(reads)) or align(reads, *a))
    apart = ["".join(draw.choices("ACGT", k=64)) for _ in range(120)]
    assert len(similarity.contigs(apart)) == 120 and not tried
    codes = np.full(256, 4, np.uint8)
    codes[np.frombuffer(b"ACGTN", np.uint8)] = np.arange(5)
    rc, seen = str.maketrans("ACGT", "TGCA"), 0
    for size in (5, 40, 64, 70, 150):
        genome = "".join(draw.choices("ACGT", k=2 * size))
        texts = [genome[(a := draw.randrange(size // 2)) : a + draw.randrange(size // 2, size)] for _ in range(30)] + ["N" * size, "", "A"]
        texts = ["".join(c if draw.random() > 0.1 else draw.choice("ACGTN") for c in t) for t in texts]
        sizes = np.array([len(t) for t in texts])
        forms = np.array([[list(f(t).ljust(192, "\0").encode()) for t in texts] for f in (str, lambda t: t.translate(rc)[::-1])], np.uint8)
        for r in (0, 7, 30):
            reference = np.frombuffer(texts[r].encode(), np.uint8)
            maybe, shifts = similarity.within(similarity.planes(forms, codes, sizes), 192, 0, reference, codes, 32, 16)
            cost, shift, strand = align(*forms, sizes, reference, 32)
            for i in np.flatnonzero(cost <= 16):
                assert maybe[int(strand[i]), i, shifts.index(int(shift[i]))]
                seen += 1
    assert seen > 50


def test_coded_qualities_keep_their_bytes_in_few_steps(monkeypatch):
    """Checksums of what the bit-by-bit coder wrote; each symbol narrows the range once, however many bits that settles."""
    import hashlib

    draw, steps, narrowed = random.Random(21), [], codecs.narrowed
    monkeypatch.setattr(codecs, "narrowed", lambda *a: steps.append(1) or narrowed(*a))
    for alphabet, n, size, order, want in QUALITIES:
        values = ["".join(draw.choices(alphabet, k=size)) for _ in range(n)]
        data = codecs.encode_qualities(values, order)
        assert hashlib.md5(codecs.expand(data)).hexdigest() == want
        assert codecs.decode_qualities(data, [size] * n, order) == values
    assert len(steps) == 2 * sum(n * size for _, n, size, _, _ in QUALITIES)


QUALITIES = [
    ("#(-27;=?ACEFGHIJ", 50, 48, 2, "1573c50ff1c5667add267889a6fa0192"),
    ("I", 3, 2500, 2, "1fd33154e5a028ef5046678b832b3109"),
    ("III#", 4, 2500, 1, "ab6633590376aee8f7d62086b7221e2e"),
    ("".join(map(chr, range(33, 127))), 9, 70, 1, "b6fe2e24338ecb8ea02f4b790935d4d7"),
    ("!~", 3, 1, 2, "bb6fe7c974f00a7b6305870eb5250c4f"),
]


def test_a_stream_read_once_is_read_whole(spark, tmp_path):
    """More slices than a batch has, of files that end within a slice and within a pair."""
    for name, first, n in (("a", 0, 33), ("b", 33, 24), ("c", 57, 53)):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(numbered(first, n))
    for m in "12":
        (tmp_path / m).write_text(numbered(0, 57))
    for name, stream, laid, n in (
        ("plain", ingest.read_stream(spark, str(tmp_path / "in"), 10, 2), "", 110),
        ("interleaved", ingest.read_stream(spark, str(tmp_path / "in"), 10, 2), "consecutive", 110),
        ("pairs", ingest.read_pair_stream(spark, str(tmp_path / "1"), str(tmp_path / "2"), 5, 3), "interleaved", 114),
    ):
        ingest.append_blocks(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-c", 10, once=True, pe_layout=laid, kind="long").awaitTermination()
        blocks = ingest.finish(spark, f"{tmp_path}/{name}")
        assert store.structure_errors(blocks, n).count() == 0
        rows = store.decode_blocks(blocks, mates=True).orderBy("read_idx").collect()
        ids = [int(r.id[1:]) for r in rows]
        assert [r.read_idx for r in rows] == list(range(n))
        if laid == "consecutive":
            assert sorted(ids) == list(range(n)) and all(r.mate == 1 + int(r.id[1:]) % 2 for r in rows)
        else:
            assert ids == [i // 2 for i in range(n)] if laid else ids == list(range(n))
        assert len(list((tmp_path / name).glob("batch=*"))) > 3


def test_slices_end_at_multiples_of_their_rows_over_files(tmp_path):
    for name, first, n in (("a", 0, 33), ("b", 33, 4), ("c", 37, 53)):
        (tmp_path / name).write_text(numbered(first, n))
    for slices in (1, 2, 3, 64):
        stream = fastq.SliceStream({"path": str(tmp_path), "rowsPerSlice": 10, "slicesPerBatch": slices})
        at, seen = stream.initialOffset(), []
        while found := list((got := stream.read(at))[0]):
            assert list(stream.readBetweenOffsets(at, got[1])) == found
            seen += [r[0] for s in found for r in fastq.reads_of(s)]
            at = got[1]
            assert at["next"] % 10 == 0 or at["next"] == 90
        assert seen == list(range(90))


def plain_minimizers(s, k=15, w=10):
    code = {c: i for i, c in enumerate(b"ACGT")}
    h = []
    for i in range(len(s) - k + 1):
        part = [code.get(c) for c in s[i : i + k]]
        both = None if None in part else (sum(v << 2 * (k - 1 - j) for j, v in enumerate(part)), sum((3 - v) << 2 * j for j, v in enumerate(part)))
        h.append(min(both) if both else 1 << 62)
    size, found, before = min(w, len(h)), [], None
    for a in range(len(h) - size + 1 if h else 0):
        at = min(range(a, a + size), key=h.__getitem__)
        if h[at] == 1 << 62:
            at = None
        elif at != before:
            found.append((at, h[at]))
        before = at
    return found


def test_minimizers_of_many_reads_at_once_are_those_of_each():
    """Reads of all lengths side by side, over several stretches of one call; none reaches into the next."""
    draw = random.Random(31)
    texts = ["".join(draw.choices("ACGTNg", [9, 9, 9, 9, 1, 0.3], k=draw.choice((0, 3, 14, 15, 16, 23, 24, 25, 26, 80, 200)))).encode() for _ in range(2500)] + [b"N" * 40, "é".encode() + b"ACGTTTGA" * 4, b"A" * 99, b"ACGT" * 9000]
    found = list(similarity.minimizer_rows(texts))
    assert len(found) > 1
    rows = [r for part in found for r in zip(*(x.tolist() for x in part), strict=True)]
    assert rows == [(i, *m) for i, t in enumerate(texts) for m in plain_minimizers(t)]
    assert not list(similarity.minimizer_rows([]))


def test_shuffles_of_minimizers_grow_with_the_input(spark, tmp_path):
    from helixframe.operators import shared

    for name, n in (("a", 1000), ("b", 40_000)):
        spark.range(n).selectExpr("id as read_idx", "concat(md5(string(id)), md5(string(-id))) as sequence").write.parquet(str(tmp_path / name))
    few, many = (shared.parts(similarity.minimizers_arrow(spark.read.parquet(str(tmp_path / n))), 100_000) for n in "ab")
    assert few == 8 and 15 < many < 80 and shared.parts(similarity.minimizers_arrow(spark.createDataFrame([(1, "A")], "read_idx bigint, sequence string")), 1) >= 8
    mins = similarity.minimizers_arrow(spark.createDataFrame([(i, "ACGTACGGTCA" * 4) for i in range(5)], "read_idx bigint, sequence string"))
    assert {(r.reads, r.places) for r in similarity.buckets(mins).collect()} == {(5, n) for n in {r.n for r in mins.where("read_idx = 0").groupBy("hash").count().toDF("hash", "n").collect()}}
    assert similarity.candidates(mins).count() == 10


def test_small_splits_share_tasks(spark, tmp_path):
    (tmp_path / "a").write_text(numbered(0, 3000))
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "300")
    session.conf.set("spark.sql.files.openCostInBytes", "1")
    rows = fastq.read_text_fastq(session, str(tmp_path / "a"))
    assert rows.rdd.getNumPartitions() < 200 < session.read.text(str(tmp_path / "a")).rdd.getNumPartitions()
    check_numbers(rows, 3000)


def test_no_stream_of_an_exported_archive_passes_through_spark_to_the_driver(spark, tmp_path, monkeypatch):
    import struct

    import xxhash
    from pyspark.sql.classic.dataframe import DataFrame

    (tmp_path / "1").write_text(numbered(0, 300))
    blocks = store.encode_blocks(fastq.read_fastq(spark, str(tmp_path / "1")), 8, "medium").persist()
    want = xxhash.xxh64(struct.pack("<Q", 3), seed=0)
    for r in blocks.orderBy("block_id").collect():
        for s in container.STREAMS:
            want.update(bytes(r[f"{s}_data"]))
    collect = DataFrame.collect

    def bare(df):
        assert not any(c.endswith("_data") for c in df.columns)
        return collect(df)

    monkeypatch.setattr(DataFrame, "collect", bare)
    monkeypatch.setattr(DataFrame, "toLocalIterator", bare)
    assert container.export(blocks.repartition(5), str(tmp_path / "x"), 3) == 300
    monkeypatch.undo()
    assert container.open_container(str(tmp_path / "x"))["footer"]["global_checksum"] == want.intdigest()
    check_numbers(store.decode_blocks(container.load_blocks(spark, str(tmp_path / "x"))), 300)
    assert container.export(blocks.where("false"), str(tmp_path / "y"), 3) == 0 and not container.open_container(str(tmp_path / "y"))["index"]


def test_order_keys_are_the_least_minimizers_of_all_reads(spark):
    draw = random.Random(10)
    texts = ["".join(draw.choices("ACGTNg", [9, 9, 9, 9, 1, 0.3], k=draw.choice((0, 14, 15, 40, 90)))) for _ in range(400)] + ["N" * 40, "", "é" + "ACGTTTGA" * 4]
    found = similarity.order_keys(spark.createDataFrame([*enumerate(texts)], "read_idx bigint, sequence string")).collect()
    want = [(i, min((h for _, h in plain_minimizers(t.encode())), default=-1), len(t)) for i, t in enumerate(texts)]
    assert sorted(map(tuple, found)) == want


def test_ranges_of_an_order_grow_with_the_reads(spark, monkeypatch):
    """As many reads again, as many range partitions again, and so tasks of the same size; ranks stay whole and in order."""
    monkeypatch.setattr(layout, "RANK_BYTES", 20_000, raising=False)
    ranges = []
    for n in (4000, 40_000):
        reads = spark.range(n).selectExpr("id as read_idx", "translate(concat(md5(string(id % 999)), md5(string(id % 77))), '0123456789abcdef', 'ACGTACGTACGTACGT') as sequence")
        order = layout.similarity_order(similarity.order_keys(reads))
        ranges.append(len(order.inputFiles()))
        keys = {r.orig_idx: (r.h, r.len, r.orig_idx) for r in similarity.order_keys(reads).collect()}
        assert [(r.orig_idx, r.archive_idx) for r in order.orderBy("archive_idx").collect()] == [(i, k) for k, i in enumerate(sorted(keys, key=keys.__getitem__))]
    assert ranges[0] <= 8 < ranges[1]


def test_scans_of_large_files_are_dealt_finer(spark, tmp_path, monkeypatch):
    from helixframe.plans import views

    spark.range(20_000).selectExpr("id as o_orderkey", "id as o_custkey", "'O' as o_orderstatus").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    few = views.reads(spark, str(tmp_path)).rdd.getNumPartitions()
    monkeypatch.setattr(views, "SPREAD_BYTES", 1000, raising=False)
    assert views.reads(spark, str(tmp_path)).rdd.getNumPartitions() > 2 * few


@pytest.mark.parametrize("name", ["minimizer_candidates", "minimizer_buckets"])
def test_minimizers_of_a_small_file_are_dealt_by_their_bases(spark, tmp_path, monkeypatch, name):
    """The driver's table holds a read in eight bytes, so its size says little about the minimizers; the rows stay the same."""
    from helixframe.plans import catalogue

    spark.range(3000).selectExpr("id as o_orderkey", "id div 10 as o_custkey", "'O' as o_orderstatus").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    few = catalogue.queries()[name](spark, str(tmp_path))
    monkeypatch.setattr(similarity, "BUCKET_BASES", 3000 * 40 // 30, raising=False)
    many = catalogue.queries()[name](spark, str(tmp_path))
    parts = [max(int(n) for n in re.findall(r"hashpartitioning\(hash#\d+L?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())) for df in (few, many)]
    assert parts[0] == 8 and 30 <= parts[1] <= 60
    assert sorted(few.collect()) == sorted(many.collect())


def test_groups_of_a_path_are_dealt_to_more_tasks_as_reads_grow(spark, tmp_path, monkeypatch):
    """Few bytes of many groups would go to one task for each core, whatever a path costs; the paths stay the same."""
    spark.range(6000).selectExpr("id as read_idx", "substr(translate(md5(string(id div 7)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 20 + id % 13) as sequence").write.parquet(str(tmp_path / "reads"))
    reads = spark.read.parquet(str(tmp_path / "reads"))
    group = fn.F.floor(fn.F.col("read_idx") / 50)
    few = similarity.greedy_order(reads, group)
    monkeypatch.setattr(similarity, "PATH_BYTES", 2000, raising=False)
    many = similarity.greedy_order(reads, group)
    assert many.rdd.getNumPartitions() >= 40 > few.rdd.getNumPartitions()
    assert sorted(few.collect()) == sorted(many.collect()) and many.count() == 6000
