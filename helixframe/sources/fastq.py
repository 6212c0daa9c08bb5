"""FASTQ files as a data source, batch and streaming, plain or compressed."""

from __future__ import annotations

import bz2
import glob
import gzip
import io
import lzma
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThanOrEqual, InputPartition, LessThanOrEqual, SimpleDataSourceStreamReader

from helixframe import schema
from helixframe.errors import FormatError, UnsupportedFormat
from helixframe.functions import sequence as fn
from helixframe.operators import container, shared

# First bytes and extensions of compressed files
MAGIC = {b"\x1f\x8b": "gzip", b"BZh": "bzip2", b"\x28\xb5\x2f\xfd": "zstd", b"\xfd7zXZ\x00": "xz"}
EXTENSIONS = {"gz": "gzip", "gzip": "gzip", "bz2": "bzip2", "xz": "xz", "zst": "zstd", "zstd": "zstd"}


def sniff(head: bytes, path: str = "") -> str:
    """Compression by the first bytes, else by the extension, else plain."""
    for magic, name in MAGIC.items():
        if head.startswith(magic):
            return name
    return EXTENSIONS.get(path.rpartition(".")[2].lower(), "plain")


def supported() -> list[str]:
    return ["plain", *MAGIC.values()]


def open_text(data: io.BufferedIOBase, path: str = "") -> io.TextIOBase:
    head = data.peek(6)[:6] if hasattr(data, "peek") else b""
    kind = sniff(head, path)
    if kind == "zstd":
        import zstandard

        raw = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
    else:
        raw = {"gzip": gzip.open, "bzip2": bz2.open, "xz": lzma.open}.get(kind, lambda f: f)(data)
    return io.TextIOWrapper(raw if hasattr(raw, "readable") else io.BufferedReader(raw), encoding="utf-8", newline="\n")


def records(lines: Iterator[str], first: int = 0) -> Iterator[tuple]:
    """(read_idx, id, comment, sequence, quality); errors name the line and the record."""
    lines, idx, at = iter(lines), first, 0
    for head in lines:
        at += 1
        head = head.rstrip()
        if not head.startswith("@"):
            raise FormatError(f"line {at}, record {idx + 1}: a header must begin with @, not {head[:20]!r}")
        rest = [next(lines, None) for _ in range(3)]
        if rest[2] is None:
            raise FormatError(f"line {at}, record {idx + 1}: the record is cut short")
        seq, plus, qual = (x.rstrip() for x in rest)
        if not plus.startswith("+"):
            raise FormatError(f"line {at + 2}, record {idx + 1}: the separator must begin with +")
        if len(seq) != len(qual):
            raise FormatError(f"line {at + 3}, record {idx + 1}: {len(seq)} bases but {len(qual)} qualities")
        read_id, _, comment = head[1:].partition(" ")
        yield idx, read_id, comment, seq, qual
        idx, at = idx + 1, at + 3


@dataclass
class Range(InputPartition):
    path: str
    low: int
    high: int


class FastqReader(DataSourceReader):
    """One file in one partition, for compressed files; pushed ranges of read_idx stop the scan early."""

    def __init__(self, options):
        self.path, self.low, self.high = options["path"], 0, 1 << 62

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("read_idx",):
                self.low = max(self.low, f.value)
            elif isinstance(f, LessThanOrEqual) and f.attribute == ("read_idx",):
                self.high = min(self.high, f.value)
            else:
                yield f

    def partitions(self):
        return [Range(self.path, self.low, self.high)]

    def read(self, part):
        with open(part.path, "rb") as f:
            for row in records(open_text(f, part.path)):
                if row[0] > part.high:
                    return
                if row[0] >= part.low:
                    yield row


def refuse_foreign(path: str, head: bytes) -> None:
    """Parquet files and archives are no reads."""
    if head[:4] == b"PAR1":
        raise UnsupportedFormat(f"{path} is a Parquet file")
    if head[:4] == container.MAGIC[:4]:
        raise UnsupportedFormat(f"{path} is an archive")


class FastqSource(DataSource):
    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        path = self.options.get("path", "")
        if os.path.isfile(path):
            with open(path, "rb") as f:
                refuse_foreign(path, f.read(8))
        return schema.READ

    def reader(self, schema):
        return FastqReader(self.options)


SLICE = "path string, first bigint, start bigint, stop bigint"


def local_files(path: str) -> list[str]:
    """The files of a path, comma-separated paths, globs or a folder, in the order of their names."""
    found = []
    for p in path.removeprefix("file://").split(","):
        found += sorted(f for f in glob.glob(f"{p}/*") if not os.path.basename(f).startswith(("_", "."))) if os.path.isdir(p) else sorted(glob.glob(p))
    return found


def cut_plain(path: str, start: int, first: int, rows: int, piece: int = 1 << 20) -> list[tuple]:
    """Slices (path, first read, first byte, end) of up to `rows` whole records each, of as many as end within a `piece` of the next batch's reach.

    They end at multiples of `rows`, so after a file's last slice, which may be shorter, the next file's first one makes up for it. Only line ends are looked at. A last record without a line end is whole once its fourth line has begun.
    """
    out, at, lines, kept = [], start, 0, 0
    with open(path, "rb") as f:
        f.seek(start)
        while data := f.read(piece):
            ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
            for k in range(4 * (rows - first % rows) - lines - 1, len(ends), 4 * rows):
                stop = start + kept + int(ends[k]) + 1
                out.append((path, first, at, stop))
                first, at = first + rows - first % rows, stop
            lines, kept = (lines + len(ends)) % (4 * rows) if out else lines + len(ends), kept + len(data)
            if out:
                return out
            last = data
        if lines // 4 or lines % 4 == 3 and not last.endswith(b"\n"):
            f.seek(at)
            tail = f.read()
            if not tail.endswith(b"\n") and lines % 4 == 3:
                out.append((path, first, at, at + len(tail)))
            elif lines // 4:
                ends = np.flatnonzero(np.frombuffer(tail, np.uint8) == 10)
                out.append((path, first, at, at + int(ends[lines // 4 * 4 - 1]) + 1))
    return out


def lines_of(s) -> int:
    """The read after a plain slice."""
    path, first, a, z = s[:4]
    with open(path, "rb") as f:
        f.seek(a)
        data = f.read(z - a)
    return first + -(-data.count(b"\n") // 4)


def reads_of(s) -> Iterator[tuple]:
    """The records of one slice; an end of -1 is the file's."""
    path, first, start, stop = s
    with open(path, "rb") as f:
        if stop < 0:
            yield from records(open_text(f, path), first)
        else:
            f.seek(start)
            yield from records(io.StringIO(f.read(stop - start).decode(), newline="\n"), first)


class SliceStream(SimpleDataSourceStreamReader):
    """Micro-batches of slices. The offset is a file, a byte and a read, so every byte is looked at once and a restart goes on where it stopped.

    A batch ends at a multiple of `rowsPerSlice` or with the data, so that it cuts no pair. Plain files may grow; a compressed one is one slice.
    """

    def __init__(self, options):
        self.path, self.rows, self.slices = options["path"], int(options.get("rowsPerSlice", "10000")), int(options.get("slicesPerBatch", "64"))

    def initialOffset(self):
        return {"file": "", "byte": 0, "next": 0}

    def plan(self, start, stop=None):
        out, at = [], dict(start)
        for path in (f for f in local_files(self.path) if f >= start["file"]):
            if path != at["file"]:
                at = {"file": path, "byte": 0, "next": at["next"]}
            with open(path, "rb") as f:
                packed = sniff(f.read(6), path) != "plain"
            while (len(out) < self.slices or at["next"] % self.rows) and (stop is None or (path, at["byte"]) < (stop["file"], stop["byte"])):
                if packed and at["byte"] == 0:
                    with open(path, "rb") as f:
                        n = sum(1 for _ in open_text(f, path)) // 4
                    found = [(path, at["next"], 0, -1)]
                    at = {"file": path, "byte": 1, "next": at["next"] + n}
                else:
                    found = [] if packed else cut_plain(path, at["byte"], at["next"], self.rows)
                    found = found[: max(1, self.slices - len(out))]
                    if found:
                        at = {"file": path, "byte": found[-1][3], "next": lines_of(found[-1])}
                if not found:
                    break
                out += found
            if len(out) >= self.slices and not at["next"] % self.rows:
                break
        return out, at

    def read(self, start):
        out, end = self.plan(start)
        return iter(out), end

    def readBetweenOffsets(self, start, end):
        return iter(self.plan(start, end)[0])


PAIR_SLICE = "path string, first bigint, start bigint, stop bigint, path2 string, start2 bigint, stop2 bigint"


class PairStream(SimpleDataSourceStreamReader):
    """Micro-batches of slices of two plain files with as many records each; the offset is a byte of either and a pair."""

    def __init__(self, options):
        self.one, self.two = options["path"], options["path2"]
        self.rows, self.slices = int(options.get("rowsPerSlice", "10000")), int(options.get("slicesPerBatch", "64"))

    def initialOffset(self):
        return {"byte": 0, "byte2": 0, "next": 0}

    def plan(self, start, stop=None):
        out, at = [], dict(start)
        while len(out) < self.slices and (stop is None or at["byte"] < stop["byte"]):
            ones, twos = (cut_plain(p, at[k], at["next"], self.rows) for p, k in ((self.one, "byte"), (self.two, "byte2")))
            if not ones and not twos:
                break
            for a, b in list(zip(ones or [None], twos or [None], strict=False))[: self.slices - len(out)]:
                n = [0 if s is None else lines_of(s) - s[1] for s in (a, b)]
                if n[0] != n[1]:
                    raise FormatError(f"mates: after pair {at['next']} the files have {n[0]} and {n[1]} records")
                if stop is not None and a[2] >= stop["byte"]:
                    break
                out.append((*a, self.two, b[2], b[3]))
                at = {"byte": a[3], "byte2": b[3], "next": at["next"] + n[0]}
        return out, at

    def read(self, start):
        out, end = self.plan(start)
        return iter(out), end

    def readBetweenOffsets(self, start, end):
        return iter(self.plan(start, end)[0])


class PairSource(DataSource):
    @classmethod
    def name(cls):
        return "fastq_pairs"

    def schema(self):
        return PAIR_SLICE

    def simpleStreamReader(self, schema):
        return PairStream(self.options)


class SliceSource(DataSource):
    @classmethod
    def name(cls):
        return "fastq_slices"

    def schema(self):
        return SLICE

    def simpleStreamReader(self, schema):
        return SliceStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the formats known; ranges of read_idx need filter pushdown for Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FastqSource)
    spark.dataSource.register(SliceSource)
    spark.dataSource.register(PairSource)


def parse_slices(slices: DataFrame) -> DataFrame:
    """The reads of slices, parsed where the slices are."""
    names = [c.split()[0] for c in schema.READ.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 4]

    def run(batches):
        for b in batches:
            for s in zip(*(b.column(c).to_pylist() for c in ("path", "first", "start", "stop")), strict=True):
                rows = reads_of(s)
                while part := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)

    return slices.mapInArrow(run, schema.READ)


def parse_pairs(slices: DataFrame) -> DataFrame:
    """pair_idx and both mates' columns of pair slices."""
    names = [f"{c}_{m}" for m in (1, 2) for c in ("id", "comment", "sequence", "quality")]

    def run(batches):
        for b in batches:
            for path, first, a, z, path2, a2, z2 in zip(*(b.column(c.split()[0]).to_pylist() for c in PAIR_SLICE.split(", ")), strict=True):
                rows = zip(reads_of((path, first, a, z)), reads_of((path2, first, a2, z2)), strict=True)
                while part := [(*r1, *r2[1:]) for r1, r2 in islice(rows, 10_000)]:
                    cols = list(zip(*part, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=["pair_idx", *names])

    return slices.mapInArrow(run, ", ".join(["pair_idx bigint", *(f"{n} string" for n in names)]))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Records of one file, of comma-separated ones, of a glob or of a folder; read_idx in the order of the files' names.

    Plain files, which any store may hold, are read in splits; a compressed one, which all machines must see, by one task.
    """
    files = local_files(path)
    packed = []
    for p in files:
        with open(p, "rb") as f:
            head = f.read(8)
        refuse_foreign(p, head)
        packed.append(sniff(head, p) != "plain")
    if not any(packed):
        return read_text_fastq(spark, files or path.split(","))
    register(spark)
    if len(files) == 1:
        return spark.read.format("fastq").load(files[0])
    listed = spark.createDataFrame([(p, 0, 0, -1) for p in files], SLICE).repartition(len(files), "path")

    def count(batches):
        for b in batches:
            for p in b.column("path").to_pylist():
                with open(p, "rb") as f:
                    yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([sum(1 for _ in open_text(f, p))], pa.int64())], names=["path", "lines"])

    lines = {r["path"]: r["lines"] for r in listed.mapInArrow(count, "path string, lines bigint").collect()}
    bases = accumulate((lines[p] // 4 for p in files), initial=0)
    return parse_slices(spark.createDataFrame([(p, n, 0, -1) for p, n in zip(files, bases, strict=False)], SLICE).repartition(len(files), "path"))


class Runs:
    """Folds lines, which come in order within each split, to records; what a split's ends cut off is left to others."""

    def __init__(self, keys: np.ndarray, bases: np.ndarray):
        self.keys, self.bases, self.split, self.n, self.held = keys, bases, None, 0, None

    def feed(self, split: int, lines: pa.Array):
        if split != self.split:
            self.split, self.held = split, None
            at = int(np.searchsorted(self.keys, split))
            if at == len(self.keys) or self.keys[at] != split:
                raise FormatError("the files or their splits have changed since their lines were counted")
            self.n = int(self.bases[at])
            skip = min(-self.n % 4, len(lines))  # lines of a record that began in the split before
            self.n, lines = self.n + skip, lines[skip:]
        if self.held is not None and len(self.held):
            lines = pa.concat_arrays([self.held, lines])
        if self.n % 4:  # still within the first record, of a split of few lines
            skip = min(-self.n % 4, len(lines))
            self.n, lines = self.n + skip, lines[skip:]
        whole = len(lines) // 4
        self.held = lines[4 * whole :]
        at = np.arange(whole) * 4
        first, self.n = self.n // 4, self.n + 4 * whole
        return pa.RecordBatch.from_arrays([pa.array(first + np.arange(whole), pa.int64()), *(lines.take(pa.array(at + k)) for k in range(4))], names=["read_idx", "h", "sequence", "plus", "quality"])


def read_text_fastq(spark: SparkSession, path) -> DataFrame:
    """The same for plain files of any size, and those that Spark's text reader decodes, in any store it reads.

    Files are cut into splits by bytes. A first scan counts the lines of each split and keeps the three at either end; sums
    over the splits in the order of files and offsets give the number of each split's first line. The second scan
    folds lines to records where they are; records that lie across splits are put together from the kept lines.
    No line is shuffled. The driver holds 16 bytes a split. A file whose lines are no multiple of four is an error.
    Small splits share tasks, and the tables of them files, so that neither is as many as the splits.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    text = together(text.select("value", "path", "start", F.xxhash64("path", "start").alias("split")))
    ends = "split bigint, path string, start bigint, lines bigint, head array<string>, tail array<string>"

    def count(batches):
        now, path, start, n, head, tail = None, None, None, 0, [], []
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
        row = lambda: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((now, path, start, n, head, tail), kinds, strict=True)], names=[c.split()[0] for c in ends.split(", ")])
        for b in batches:
            split = b.column("split").to_numpy()
            for a, z in stretches(split):
                if split[a] != now:
                    if now is not None:
                        yield row()
                    now, path, start, n, head, tail = int(split[a]), b.column("path")[a].as_py(), b.column("start")[a].as_py(), 0, [], []
                if len(head) < 3:
                    head = head + b.column("value").slice(a, min(z - a, 3 - len(head))).to_pylist()
                tail = (tail + b.column("value").slice(max(a, z - 3), z - max(a, z - 3)).to_pylist())[-3:]
                n += z - a
        if now is not None:
            yield row()

    stored = shared.folder(spark, "splits")
    text.mapInArrow(count, ends).write.parquet(stored)
    splits = together(spark.read.schema(ends).parquet(stored))
    order = Window.orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    based = splits.withColumn("base", F.coalesce(F.sum("lines").over(order), F.lit(0)))
    known = based.select("split", "base").collect()
    keys, bases = (np.array([r[i] for r in known], np.int64) for i in range(2))
    if len(np.unique(keys)) < len(keys):
        raise FormatError("two splits have one hash")
    bad = splits.groupBy("path").agg(F.sum("lines").alias("n")).where("n % 4 <> 0").first()
    if bad:
        raise FormatError(f"{bad['path']}: record {bad['n'] // 4 + 1} is cut short")
    by_key = np.argsort(keys)
    where = spark.sparkContext.broadcast((keys[by_key], bases[by_key]))

    def fold(batches):
        runs = Runs(*where.value)
        for b in batches:
            split, value = b.column("split").to_numpy(), b.column("value")
            for a, z in stretches(split):
                out = runs.feed(int(split[a]), value.slice(a, z - a))
                if out.num_rows:
                    yield out

    kind = "read_idx bigint, h string, sequence string, plus string, quality string"
    inner = text.select("split", "value").mapInArrow(fold, kind)
    # lines of records that lie across splits: the first up to the next record's, and those after the last whole record
    first, last = F.least(F.pmod(-F.col("base"), F.lit(4)), F.col("lines")), F.pmod(F.col("base") + F.col("lines"), F.lit(4))
    ahead = F.transform(F.slice("head", 1, first.cast("int")), lambda v, i: F.struct((F.col("base") + i).alias("n"), v.alias("v")))
    rest = F.greatest(F.lit(0).cast("bigint"), F.least(last, F.col("lines") - first)).cast("int")
    after = F.transform(F.slice("tail", F.size("tail") - rest + 1, rest), lambda v, i: F.struct((F.col("base") + F.col("lines") - rest + i).alias("n"), v.alias("v")))
    cut = based.select(F.explode(F.concat(ahead, after)).alias("l")).select("l.n", "l.v")
    part = lambda k: F.max(F.when(F.col("n") % 4 == k, F.col("v")))
    across = cut.groupBy(F.floor(F.col("n") / 4).alias("read_idx")).agg(part(0).alias("h"), part(1).alias("sequence"), part(2).alias("plus"), part(3).alias("quality"))
    rows = inner.unionByName(across)
    trim = lambda c: F.regexp_replace(c, r"\s+$", "")
    rows = rows.select("read_idx", trim("h").alias("h"), trim("sequence").alias("sequence"), "plus", trim("quality").alias("quality"))
    bad = F.when(~F.coalesce(F.col("h").startswith("@"), F.lit(False)), "a header must begin with @").when(~F.coalesce(F.col("plus").startswith("+"), F.lit(False)), "the separator must begin with +").when(F.coalesce(F.length("sequence") != F.length("quality"), F.lit(True)), "bases and qualities differ in number")
    checked = rows.withColumn("h", F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("line "), (F.col("read_idx") * 4 + 1).cast("string"), F.lit(", record "), (F.col("read_idx") + 1).cast("string"), F.lit(": "), bad))).otherwise(F.col("h")))
    read_id, comment = fn.split_header(F.substr("h", F.lit(2)))
    return checked.select("read_idx", read_id.alias("id"), comment.alias("comment"), "sequence", "quality")


TASK_BYTES = 32 << 20


def together(scan: DataFrame) -> DataFrame:
    """A scan of splits that the session wants small, with enough neighbours to a task for about 32 MB; each core keeps tasks, and splits of that size stay alone."""
    spark = scan.sparkSession
    largest = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    n = scan.rdd.getNumPartitions()
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-n // max(1, TASK_BYTES // largest)))
    return scan.coalesce(tasks) if tasks < n else scan


def stretches(split: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of each run of equal values."""
    if not len(split):
        return []
    cuts = (np.flatnonzero(split[1:] != split[:-1]) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(split)], strict=True))


def for_each(reads: DataFrame, f) -> int:
    """Calls f with every read, as a row, where it is; the number of reads."""
    seen = reads.sparkSession.sparkContext.accumulator(0)

    def run(rows):
        for r in rows:
            f(r)
            seen.add(1)

    reads.foreachPartition(run)
    return seen.value


def read_stdin(spark: SparkSession, stream: io.BufferedIOBase) -> DataFrame:
    """Plain records from a stream, spooled to the shared folder first."""
    path = shared.folder(spark, "stdin")
    where, files = shared.hadoop(spark, path)
    out = files.create(where)
    while data := stream.read(1 << 20):
        out.write(bytearray(data))
    out.close()
    return read_text_fastq(spark, path)


def write_fastq(reads: DataFrame, path: str, header_only: bool = False, files: int = 0) -> None:
    """One record per row of text, in the order of read_idx over the files; `files` of them, or as many as Spark finds good."""
    head = F.concat(F.lit("@"), fn.header("id", "comment"))
    line = head if header_only else F.concat(head, F.lit("\n"), "sequence", F.lit("\n+\n"), "quality")
    dealt = reads.repartitionByRange(files, "read_idx") if files else reads.repartitionByRange("read_idx")
    dealt.sortWithinPartitions("read_idx").select(line.alias("value")).write.text(path)


def mate_paths(path: str) -> tuple[str, str]:
    stem, dot, extension = path.rpartition(".")
    return (f"{stem}_R1.{extension}", f"{stem}_R2.{extension}") if dot else (f"{path}_R1", f"{path}_R2")
