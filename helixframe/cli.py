"""compress, decompress, info and verify on the command line."""

from __future__ import annotations

import argparse
import sys
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe import schema
from helixframe.errors import ChecksumError, ReadEngineError, SourceError, UsageError
from helixframe.operators import admission, container, layout, shared, similarity, store
from helixframe.sources import fastq
from helixframe.streaming import ingest


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="helixframe")
    p.add_argument("-t", "--threads", type=int, default=0)
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--memory-limit", type=int, default=0, help="MB; 0: from the machine's memory")
    p.add_argument("--no-progress", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compress", aliases=["c"])
    c.add_argument("-i", "--input", required=True, help="- is standard input")
    c.add_argument("-2", "--input2")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("-l", "--level", type=int, default=5, choices=range(1, 10))
    c.add_argument("--reorder", nargs="?", const="true", default="false", choices=("true", "false"))
    c.add_argument("--streaming", action="store_true")
    c.add_argument("--pipeline", action="store_true")
    c.add_argument("--interleaved", action="store_true")
    c.add_argument("--pe-layout", default="interleaved", choices=schema.PE_LAYOUTS)
    c.add_argument("--lossy-quality", default="none", choices=schema.QUALITY_MODES)
    c.add_argument("--quality-codec", default="zstd", choices=("zstd", "context"))
    c.add_argument("--id-mode", default="tokenize", choices=schema.ID_MODES)
    c.add_argument("--long-read-mode", default="auto", choices=("auto", *schema.LENGTH_CLASSES))
    c.add_argument("--scan-all-lengths", action="store_true")
    c.add_argument("--max-block-bases", type=int, default=0)
    c.add_argument("-f", "--force", action="store_true")
    d = sub.add_parser("decompress", aliases=["d", "x"])
    d.add_argument("-i", "--input", required=True)
    d.add_argument("-o", "--output", required=True, help="- is standard output")
    d.add_argument("--range", default="")
    d.add_argument("--header-only", action="store_true")
    d.add_argument("--original-order", action="store_true")
    d.add_argument("--skip-corrupted", action="store_true")
    d.add_argument("--corrupted-placeholder", default="")
    d.add_argument("--split-pe", action="store_true")
    d.add_argument("--pipeline", action="store_true")
    d.add_argument("-f", "--force", action="store_true")
    i = sub.add_parser("info", aliases=["i"])
    i.add_argument("-i", "--input", required=True)
    for flag in ("--json", "--detailed", "--show-codecs"):
        i.add_argument(flag, action="store_true")
    v = sub.add_parser("verify", aliases=["v"])
    v.add_argument("-i", "--input", required=True)
    for flag in ("--fail-fast", "--verbose", "--quick"):
        v.add_argument(flag, action="store_true", dest=f"verify_{flag[2:].replace('-', '_')}")
    return p


@dataclass(frozen=True)
class Request:
    """What compress is asked for, made consistent: streaming goes before pipeline before archive, standard input before pairs before interleaved."""

    mode: str
    topology: str
    reorder: bool
    kind: str

    @classmethod
    def of(cls, a: argparse.Namespace) -> Request:
        stdin = a.input == "-"
        if stdin and a.input2:
            raise UsageError("standard input has no second file")
        if a.input2 and a.interleaved:
            raise UsageError("two files are not interleaved")
        mode = "streaming" if a.streaming or stdin else "pipeline" if a.pipeline else "archive"
        topology = "stdin" if stdin else "paired" if a.input2 else "interleaved" if a.interleaved else "single"
        kind = a.long_read_mode if a.long_read_mode != "auto" else layout.default_stats("streaming")[0] if mode == "streaming" else ""
        return cls(mode, topology, a.reorder == "true" and mode != "streaming", kind)

    @property
    def paired(self) -> bool:
        return self.topology in ("paired", "interleaved")


def length_profile(reads: DataFrame, everything: bool) -> tuple[str, int]:
    """Length class and longest read of all reads, or of evenly spaced ones."""
    rows = reads.select("read_idx", F.length("sequence").alias("len"))
    if not everything:
        n = rows.count()
        step = max(1, n // schema.LENGTH_SAMPLE)
        rows = rows.where(F.col("read_idx") % step == 0)
    stats = layout.length_stats(rows.select("len")).first()
    return (stats["length_class"], stats["max_length"]) if stats["n"] else ("short", 0)


def compress(spark: SparkSession, a: argparse.Namespace) -> None:
    request, began = Request.of(a), time.time()
    if not a.force and shared.exists(spark, a.output):
        raise SourceError(f"{a.output} is already there")
    if request.mode == "streaming" and request.topology != "stdin":
        stream(spark, a, request)
    else:
        reads = fastq.read_stdin(spark, sys.stdin.buffer) if request.topology == "stdin" else fastq.read_fastq(spark, a.input)
        if request.topology == "paired":
            reads = layout.arrange(layout.zip_mates(reads, fastq.read_fastq(spark, a.input2)), a.pe_layout).drop("mate", "pair_idx")
        elif request.topology == "interleaved":
            if reads.count() % 2:
                raise UsageError("an interleaved file needs an even number of reads")
            if a.pe_layout == "consecutive":
                reads = layout.arrange(ingest.as_pairs(reads), "consecutive").drop("mate", "pair_idx")
        kind, longest = (request.kind, 0) if request.kind and not a.max_block_bases else length_profile(reads, a.scan_all_lengths)
        kind = request.kind or kind
        order = None
        if layout.reorder_allowed(request.reorder, kind, request.paired):
            order = layout.similarity_order(similarity.order_keys(reads))
        store.write_archive(reads, a.output, "overwrite" if a.force else "errorifexists", a.memory_limit * admission.MB or None, order, a.input, request.paired, a.pe_layout, request.mode == "streaming", layout.block_size(0, kind, longest, a.max_block_bases), 0, a.lossy_quality, a.id_mode, a.level, a.quality_codec, kind)
    if not a.quiet:
        report(spark, a.output, time.time() - began, a.verbose)


def stream(spark: SparkSession, a: argparse.Namespace, request: Request) -> None:
    """Blocks by micro-batches, without a look at the input first."""
    work = shared.folder(spark, "ingest")
    size = layout.block_size(0, request.kind, layout.default_stats("streaming")[1], a.max_block_bases)
    reads = ingest.read_pair_stream(spark, a.input, a.input2, size) if request.topology == "paired" else ingest.read_stream(spark, a.input, size)
    ingest.append_blocks(reads, f"{work}/blocks", f"{work}/progress", size, True, a.pe_layout if request.paired else "", kind=request.kind, id_mode=a.id_mode, quality_mode=a.lossy_quality, level=a.level, quality_codec=a.quality_codec).awaitTermination()
    ingest.finish_archive(spark, f"{work}/blocks", a.output, request.paired, a.pe_layout, request.kind, a.lossy_quality, a.id_mode, a.input, a.force)


def report(spark: SparkSession, path: str, seconds: float, verbose: int) -> None:
    blocks = spark.read.schema(schema.BLOCK).parquet(f"{path}/blocks")
    stats = store.archive_stats(blocks, store.decode_blocks(blocks) if verbose else None).first().asDict()
    if verbose:
        stats |= store.throughput(stats, seconds)
    print("\n".join(f"{k}: {v}" for k, v in stats.items()), file=sys.stderr)


def lines_of(reads: DataFrame, header_only: bool):
    for r in reads.orderBy("read_idx").toLocalIterator():
        head = f"@{r['id']} {r['comment']}" if r["comment"] else f"@{r['id']}"
        yield head if header_only else f"{head}\n{r['sequence']}\n+\n{r['quality']}"


def decompress(spark: SparkSession, a: argparse.Namespace) -> None:
    budget = admission.DecodeBudget.resolve(a.memory_limit)
    if a.split_pe and a.output == "-":
        raise UsageError("standard output can't be split")
    head = store.info(spark, a.input).first()
    if a.split_pe and not head["is_paired"]:
        raise UsageError("the archive holds no pairs")
    paths = fastq.mate_paths(a.output) if a.split_pe else (a.output,)
    if a.output != "-":
        for path in paths:
            if not a.force and shared.exists(spark, path):
                raise SourceError(f"{path} is already there")
    reads = store.read_archive(spark, a.input, a.range, a.original_order, a.skip_corrupted, a.corrupted_placeholder, budget)
    if a.output == "-":
        for line in lines_of(reads, a.header_only):
            print(line)
        return
    parts = store.split_mates(spark, a.input, reads) if a.split_pe else (reads,)
    staged = [f"{path}.part" for path in paths]
    for part, path in zip(parts, staged, strict=True):
        fastq.write_fastq(part, path, a.header_only)
    for part, path in zip(staged, paths, strict=True):
        store.commit(spark, part, path)


def show(spark: SparkSession, a: argparse.Namespace) -> None:
    manifest = store.info(spark, a.input)
    if a.json:
        print(manifest.toJSON().first())
    else:
        print("\n".join(f"{k}: {v}" for k, v in manifest.first().asDict().items()))
    blocks = spark.read.schema(schema.BLOCK).parquet(f"{a.input}/blocks")
    if a.detailed:
        for r in store.stream_sizes(blocks).join(store.headers(blocks).select("block_id", "archive_id_start", "uniform_read_length"), "block_id").orderBy("block_id").toLocalIterator():
            print(f"block {r['block_id']}: first {r['archive_id_start']}, reads {r['read_count']}, length {r['uniform_read_length']}, bytes {r['compressed_size']}")
    if a.show_codecs:
        names = {v: k for k, v in store.codecs.FAMILIES.items()}
        for r in store.headers(blocks).orderBy("block_id").toLocalIterator():
            print(f"block {r['block_id']}: " + ", ".join(f"{s} {names.get(r[f'codec_{s}'] >> 4, '?')}" for s in container.STREAMS))


def verify(spark: SparkSession, a: argparse.Namespace) -> None:
    errors = [f"block {r['block_id']}: {r['error']}" for r in store.check_archive(spark, a.input, admission.DecodeBudget.resolve(a.memory_limit)).limit(1000).collect()]
    if not a.verify_quick and not (errors and a.verify_fail_fast):
        checked = store.verify(spark.read.schema(schema.BLOCK).parquet(f"{a.input}/blocks"))
        bad = checked.where("not ok")
        errors += [f"block {r['block_id']}: {r['error']}" for r in bad.limit(1 if a.verify_fail_fast else 1000).collect()]
        if a.verify_verbose:
            print(store.verify_totals(checked).toJSON().first())
    if errors:
        raise ChecksumError("\n".join(errors[: 1 if a.verify_fail_fast else None]))


def run(spark: SparkSession, argv: list[str]) -> None:
    a = parser().parse_args(argv)
    act = {"c": compress, "d": decompress, "x": decompress, "i": show, "v": verify}
    act[a.command[0]](spark, a)


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    a = parser().parse_args(argv)
    builder = SparkSession.builder
    if a.threads:
        builder = builder.master(f"local[{a.threads}]")
    try:
        run(builder.config("spark.ui.showConsoleProgress", str(not (a.no_progress or a.quiet)).lower()).getOrCreate(), argv)
    except ReadEngineError as e:
        print(e, file=sys.stderr)
        return e.exit_code
    except OSError as e:
        print(e, file=sys.stderr)
        return SourceError.exit_code
    return 0


if __name__ == "__main__":
    sys.exit(main())
