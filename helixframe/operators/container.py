"""The single-file container: header, blocks, reorder map, index and footer, little-endian.

An archive of tables is the working form; this one carries it as one file. Every
section names its own size, so that readers skip what later versions add.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe import schema
from helixframe.errors import FormatError, UnsupportedFormat, UnsupportedVersion
from helixframe.operators import admission, codecs

# Fixed values of the format: first and last bytes, version, sizes
MAGIC, MAGIC_SEQUENTIAL, MAGIC_END = b"\x89FQC\r\n\x1a\n", b"FQCV2\r\n\x1a", b"FQC_EOF\x00"
MAJOR, MINOR = 2, 0
PADDING = 1 << 20
GLOBAL = {"header_size": "I", "flags": "Q", "compression_algo": "B", "checksum_type": "B", "reserved": "H", "total_read_count": "Q", "name_size": "H"}
BLOCK = {"header_size": "I", "block_id": "I", "checksum_type": "B", "codec_ids": "B", "codec_seq": "B", "codec_qual": "B", "codec_aux": "B", "reserved1": "B", "reserved2": "H", "checksum": "Q", "read_count": "I", "uniform_read_length": "I", "compressed_size": "Q", "offset_ids": "Q", "offset_seq": "Q", "offset_qual": "Q", "offset_aux": "Q", "size_ids": "Q", "size_seq": "Q", "size_qual": "Q", "size_aux": "Q"}
INDEX = {"header_size": "I", "entry_size": "I", "num_blocks": "Q"}
ENTRY = {"offset": "Q", "compressed_size": "Q", "archive_id_start": "Q", "read_count": "I"}
MAP = {"header_size": "I", "version": "I", "total_reads": "Q", "forward_size": "Q", "reverse_size": "Q"}
FOOTER = {"index_offset": "Q", "map_offset": "Q", "global_checksum": "Q", "magic": "8s"}
STREAMS = ("ids", "seq", "qual", "aux")


def size_of(fields: dict) -> int:
    return struct.calcsize("<" + "".join(fields.values()))


def put(fields: dict, **values) -> bytes:
    """One section's fields; those not named are 0, and its own size is filled in."""
    known = {"header_size": size_of(fields)} | values
    return struct.pack("<" + "".join(fields.values()), *(known.get(k, 0) for k in fields))


def take(f, fields: dict) -> dict:
    data = f.read(size_of(fields))
    if len(data) < size_of(fields):
        raise FormatError("the file ends within a section")
    return dict(zip(fields, struct.unpack("<" + "".join(fields.values()), data), strict=True))


def skip(f, section: str, declared: int, least: int) -> None:
    """Checks a declared size and passes over what lies beyond the known fields."""
    if not least <= declared <= least + PADDING:
        raise FormatError(f"{section}: a size of {declared} is not in {least} to {least + PADDING}")
    f.seek(declared - least, 1)


def family(magic: bytes) -> str:
    return {MAGIC: "indexed", MAGIC_SEQUENTIAL: "sequential"}.get(bytes(magic[:8]), "unknown")


def check_magic(head: bytes) -> None:
    """The first nine bytes: eight of the family, and the version whose major part must be ours."""
    if len(head) < 9:
        raise FormatError("the file is too short for an archive")
    if family(head) == "sequential":
        raise UnsupportedFormat("a sequential archive, which this engine does not read")
    if family(head) == "unknown":
        raise FormatError("no archive: unknown first bytes")
    if head[8] >> 4 != MAJOR:
        raise UnsupportedVersion(f"version {head[8] >> 4}.{head[8] & 15} is not {MAJOR}.x")


def write_global(flags: int, reads: int, name: str, timestamp: int) -> bytes:
    raw = name.encode()
    size = size_of(GLOBAL) + len(raw) + 8
    return put(GLOBAL, header_size=size, flags=flags, checksum_type=1, total_read_count=reads, name_size=len(raw)) + raw + struct.pack("<Q", timestamp)


def read_global(f) -> dict:
    head = take(f, GLOBAL)
    least = size_of(GLOBAL) + 8
    if not least <= head["header_size"] <= least + PADDING or head["header_size"] < least + head["name_size"]:
        raise FormatError(f"global header: a size of {head['header_size']} for a name of {head['name_size']} bytes")
    try:
        name = f.read(head["name_size"]).decode()
    except UnicodeDecodeError as e:
        raise FormatError("global header: the name is no text") from e
    (stamp,) = struct.unpack("<Q", f.read(8))
    f.seek(head["header_size"] - least - head["name_size"], 1)
    if head["reserved"]:
        raise FormatError("global header: reserved bits are set")
    return head | {"original_filename": name, "timestamp": stamp}


def read_block_header(f) -> dict:
    head = take(f, BLOCK)
    skip(f, "block header", head["header_size"], size_of(BLOCK))
    if head["reserved1"] or head["reserved2"]:
        raise FormatError("block header: reserved bits are set")
    return head


def uniform(head: dict) -> bool:
    return head["uniform_read_length"] > 0 and head["size_aux"] == 0


def quality_discarded(head: dict) -> bool:
    return head["size_qual"] == 0 and head["codec_qual"] >> 4 == codecs.FAMILIES["raw"]


def read_index(f, region: int, budget: admission.DecodeBudget) -> list[dict]:
    """The entries; larger headers and entries than ours are passed over, more than the budget or the file allows are refused."""
    head = take(f, INDEX)
    skip(f, "index", head["header_size"], size_of(INDEX))
    if not size_of(ENTRY) <= head["entry_size"] <= size_of(ENTRY) + PADDING:
        raise FormatError(f"index: an entry of {head['entry_size']} bytes")
    budget.check_index(head["num_blocks"], region, head["entry_size"])
    out = []
    for _ in range(head["num_blocks"]):
        out.append(take(f, ENTRY))
        f.seek(head["entry_size"] - size_of(ENTRY), 1)
    return out


def export(blocks: DataFrame, path: str, flags: int, name: str = "", timestamp: int = 0, order_map: list[int] | None = None) -> int:
    """Writes an archive's blocks as one file; its checksum over the flags and all streams in block order.

    The driver gets the blocks' sizes, which settle their places; tasks write the blocks there, so all machines must see the file. A task that
    runs again writes the same bytes again. The checksum is of one run through the streams, which the driver reads from the file.
    """
    sizes = [F.octet_length(f"{s}_data").cast("bigint") for s in STREAMS]
    rows = blocks.select("block_id", "archive_id_start", "read_count", sum(sizes[1:], sizes[0]).alias("size")).orderBy("block_id").collect()
    header = write_global(flags, sum(r["read_count"] for r in rows), name, timestamp)
    data = np.array([r["size"] for r in rows], np.int64)
    ids = np.array([r["block_id"] for r in rows], np.int64)
    if len(np.unique(ids)) < len(ids):
        raise FormatError("two blocks have one number")
    ends = 9 + len(header) + np.cumsum(data + size_of(BLOCK))
    starts = ends - data - size_of(BLOCK)
    with open(path, "wb") as f:
        f.write(MAGIC + bytes([MAJOR << 4 | MINOR]) + header)
    places = blocks.sparkSession.sparkContext.broadcast((ids, starts))

    def write(batches) -> Iterator[pa.RecordBatch]:
        ids, starts = places.value
        for b in batches:
            with open(path, "r+b") as f:
                for r in b.to_pylist():
                    parts = [r[f"{s}_data"] for s in STREAMS]
                    lengths = [len(d) for d in parts]
                    head = {"block_id": r["block_id"], "checksum_type": 1, "checksum": r["checksum"] % (1 << 64), "read_count": r["read_count"], "uniform_read_length": r["uniform_read_length"], "compressed_size": sum(lengths)}
                    head |= {f"codec_{s}": r[f"codec_{s}"] for s in STREAMS} | {f"offset_{s}": sum(lengths[:i]) for i, s in enumerate(STREAMS)} | {f"size_{s}": n for s, n in zip(STREAMS, lengths, strict=True)}
                    f.seek(int(starts[np.searchsorted(ids, r["block_id"])]))
                    f.write(put(BLOCK, **head) + b"".join(parts))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    done = blocks.mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if done != len(rows):
        raise FormatError(f"{done} of {len(rows)} blocks were written")
    sum_ = xxhash.xxh64(struct.pack("<Q", flags), seed=0)
    with open(path, "r+b") as f:
        for start, n in zip(starts.tolist(), data.tolist(), strict=True):
            f.seek(start + size_of(BLOCK))
            while n:
                part = f.read(min(n, PADDING))
                if not part:
                    raise FormatError("the file ends within a block")
                sum_.update(part)
                n -= len(part)
        map_at = 0
        f.seek(0, 2)
        if order_map is not None:
            map_at = f.tell()
            reverse = [0] * len(order_map)
            for i, v in enumerate(order_map):
                reverse[v] = i
            parts = [codecs.encode_deltas(order_map), codecs.encode_deltas(reverse)]
            f.write(put(MAP, version=1, total_reads=len(order_map), forward_size=len(parts[0]), reverse_size=len(parts[1])) + b"".join(parts))
        index_at = f.tell()
        f.write(put(INDEX, entry_size=size_of(ENTRY), num_blocks=len(rows)))
        for r, start, n in zip(rows, starts.tolist(), data.tolist(), strict=True):
            f.write(put(ENTRY, offset=start, compressed_size=n, archive_id_start=r["archive_id_start"], read_count=r["read_count"]))
        f.write(put(FOOTER, index_offset=index_at, map_offset=map_at, global_checksum=sum_.intdigest(), magic=MAGIC_END))
    return sum(r["read_count"] for r in rows)


def open_container(path: str, memory_mb: int = 0) -> dict:
    """header, footer and index of a file, all checked: magic, version, footer, offsets, index and every block's header."""
    budget = admission.DecodeBudget.resolve(memory_mb)
    with open(path, "rb") as f:
        check_magic(f.read(9))
        end = f.seek(0, 2)
        if end < 9 + size_of(GLOBAL) + 8 + size_of(INDEX) + size_of(FOOTER):
            raise FormatError("the file is too short for an archive")
        f.seek(end - size_of(FOOTER))
        footer = take(f, FOOTER)
        if footer["magic"] != MAGIC_END:
            raise FormatError("the footer's last bytes are wrong")
        f.seek(9)
        header = read_global(f)
        first = f.tell()
        last = footer["map_offset"] or footer["index_offset"]
        if not first <= last <= footer["index_offset"] <= end - size_of(FOOTER):
            raise FormatError("the footer's offsets are out of order")
        f.seek(footer["index_offset"])
        index = read_index(f, end - size_of(FOOTER) - footer["index_offset"], budget)
        errors = index_errors(index, header["total_read_count"], first, last)
        if errors:
            raise FormatError(errors[0])
        for i, e in enumerate(index):
            f.seek(e["offset"])
            head = read_block_header(f)
            if (head["block_id"], head["read_count"], head["compressed_size"]) != (i, e["read_count"], e["compressed_size"]):
                raise FormatError(f"block {i}: header and index differ")
            e |= {"block_id": i, "data": f.tell()}
    return {"header": header, "footer": footer, "index": index}


def index_errors(index: list[dict], total: int, first: int, last: int) -> list[str]:
    """What is wrong with the order, the regions and the counts of the entries."""
    out, at, reads = [], first, 0
    for i, e in enumerate(index):
        if e["offset"] < at or e["offset"] + size_of(BLOCK) + e["compressed_size"] > last:
            out.append(f"block {i}: its region leaves its place")
        if e["archive_id_start"] != reads or not e["read_count"]:
            out.append(f"block {i}: gap, overlap or empty block")
        at, reads = e["offset"] + size_of(BLOCK) + e["compressed_size"], e["archive_id_start"] + e["read_count"]
    if reads != total:
        out.append("read counts do not add up")
    return out


def contains_read(entry: dict, archive_id: int) -> bool:
    return entry["archive_id_start"] <= archive_id < archive_id_end(entry)


def archive_id_end(entry: dict) -> int:
    return entry["archive_id_start"] + entry["read_count"]


def read_map(path: str, opened: dict, memory_mb: int = 0) -> tuple[list[int], list[int]]:
    """Forward and reverse order of the reads."""
    if not opened["footer"]["map_offset"]:
        raise FormatError("the archive has no reorder map")
    with open(path, "rb") as f:
        f.seek(opened["footer"]["map_offset"])
        head = take(f, MAP)
        skip(f, "reorder map", head["header_size"], size_of(MAP))
        admission.DecodeBudget.resolve(memory_mb).check_reads(head["total_reads"])
        out = tuple(codecs.decode_deltas(f.read(head[k])) for k in ("forward_size", "reverse_size"))
    if any(len(m) != head["total_reads"] or head["total_reads"] != opened["header"]["total_read_count"] for m in out):
        raise FormatError("the reorder map has another number of reads")
    return out


def load_blocks(spark: SparkSession, path: str, opened: dict | None = None) -> DataFrame:
    """The blocks as an archive's rows, each read by the task that has its index entry."""
    opened = opened or open_container(path)
    order = 1 if opened["header"]["flags"] >> 10 & 3 == schema.LENGTH_CLASSES.index("long") else 2
    rows = [(e["block_id"], e["archive_id_start"], e["data"], e["offset"]) for e in opened["index"]]
    kind = pa.schema([(n, t) for n, t in zip(BLOCK_COLUMNS, BLOCK_TYPES, strict=True)])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with open(path, "rb") as f:
                for r in b.to_pylist():
                    f.seek(r["offset"])
                    head = read_block_header(f)
                    row = {c: head[c] for c in ("block_id", "read_count", "uniform_read_length", *(f"codec_{s}" for s in STREAMS))}
                    row |= {"archive_id_start": r["start"], "qual_order": order, "checksum": head["checksum"] - (1 << 64) * (head["checksum"] >> 63)}
                    for s in STREAMS:
                        f.seek(r["data"] + head[f"offset_{s}"])
                        row[f"{s}_data"] = f.read(head[f"size_{s}"])
                    yield pa.RecordBatch.from_pylist([row], schema=kind)

    index = spark.createDataFrame(rows, "block_id int, start bigint, data bigint, offset bigint")
    return index.repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism)), "block_id").mapInArrow(run, schema.BLOCK)


BLOCK_COLUMNS = [c.split()[0] for c in schema.BLOCK.split(", ")]
BLOCK_TYPES = [{"int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16(), "binary": pa.binary()}[c.split()[1]] for c in schema.BLOCK.split(", ")]
