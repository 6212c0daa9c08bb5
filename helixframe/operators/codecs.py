"""Column codecs of one block: identifiers, sequences, qualities, lengths."""

from __future__ import annotations

import json
import re
import struct
from bisect import bisect_left

import numpy as np
import xxhash
import zstandard

from helixframe import schema
from helixframe.errors import FormatError, ResourceError
from helixframe.operators.similarity import contigs, from_contigs

# Codec families, the high half of a codec byte
FAMILIES = {"raw": 0, "consensus": 1, "quality_context": 2, "delta_varint": 3, "id_tokens": 4, "zstd": 15}
ALLOWED = {"ids": {"zstd", "id_tokens", "raw"}, "seq": {"consensus", "zstd"}, "qual": {"quality_context", "zstd", "raw"}, "aux": {"delta_varint"}}


def codec_byte(family: str, version: int = 0) -> int:
    return FAMILIES[family] << 4 | version


def family_of(value: int, stream: str) -> str:
    """Family of a codec byte, if the stream may have it in version 0."""
    name = {v: k for k, v in FAMILIES.items()}.get(value >> 4)
    if name is None or name not in ALLOWED[stream] or value & 15:
        raise FormatError(f"codec {value:#x} is not allowed for {stream}")
    return name


def squeeze(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def expand(data: bytes, limit: int = 1 << 31) -> bytes:
    """Never more than limit bytes, whatever the frame says."""
    out = zstandard.ZstdDecompressor().stream_reader(data).read(limit + 1)
    if len(out) > limit:
        raise ResourceError(f"a stream has more than {limit} bytes")
    return out


def varints(values) -> bytes:
    out = bytearray()
    for v in values:
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def from_varints(data: bytes) -> list[int]:
    out, v, shift = [], 0, 0
    for b in data:
        v |= (b & 127) << shift
        shift += 7
        if shift > 70:
            raise FormatError("a varint has more than ten bytes")
        if b < 128:
            out.append(v)
            v = shift = 0
    if shift:
        raise FormatError("a varint is cut short")
    return out


def zigzags(values: list[int]) -> list[int]:
    return [v << 1 if v >= 0 else (-v << 1) - 1 for v in values]


def unzigzags(values: list[int]) -> list[int]:
    return [v >> 1 if v & 1 == 0 else -(v + 1 >> 1) for v in values]


def encode_deltas(values: list[int]) -> bytes:
    return squeeze(varints(zigzags([b - a for a, b in zip([0, *values], values, strict=False)])))


def decode_deltas(data: bytes) -> list[int]:
    return np.cumsum(unzigzags(from_varints(expand(data)))).tolist()


def encode_lengths(lengths: list[int]) -> tuple[int, bytes]:
    """(uniform length, nothing) or (0, deltas)."""
    if lengths and min(lengths) == max(lengths) > 0:
        return lengths[0], b""
    return 0, encode_deltas(lengths)


def decode_lengths(uniform: int, data: bytes, count: int) -> list[int]:
    out = [uniform] * count if uniform else decode_deltas(data) if count else []
    if len(out) != count:
        raise FormatError(f"{len(out)} lengths for {count} reads")
    return out


def encode_strings(values: list[str], level: int = 3) -> bytes:
    raw = [v.encode() for v in values]
    sizes = varints(map(len, raw))
    return squeeze(struct.pack("<I", len(sizes)) + sizes + b"".join(raw), level)


def decode_strings(data: bytes) -> list[str]:
    raw = expand(data)
    (n,) = struct.unpack_from("<I", raw)
    out, at = [], 4 + n
    for size in from_varints(raw[4:at]):
        out.append(raw[at : at + size].decode())
        at += size
    if at != len(raw):
        raise FormatError("strings and sizes do not agree")
    return out


TOKEN = re.compile(r"[:_/| \t]|[^:_/| \t]+")
INTEGER = re.compile(r"0|[1-9][0-9]{0,17}")


def encode_ids(values: list[str], level: int = 3) -> tuple[int, bytes]:
    """Token columns if all identifiers share a pattern and can be rebuilt exactly; plain strings otherwise."""
    split = [TOKEN.findall(v) for v in values]
    shape = [t if TOKEN.fullmatch(t) and t in ":_/| \t" else None for t in split[0]] if split else []
    same = split and shape and all(len(s) == len(shape) and all((f is None and t not in ":_/| \t") or f == t for f, t in zip(shape, s, strict=True)) for s in split)
    columns = [[s[i] for s in split] for i, f in enumerate(shape) if f is None] if same else []
    whole = [all(INTEGER.fullmatch(t) for t in c) for c in columns]
    if not any(whole):
        return codec_byte("zstd"), encode_strings(values, level)
    parts = [encode_deltas([int(t) for t in c]) if w else encode_strings(c, level) for c, w in zip(columns, whole, strict=True)]
    head = json.dumps({"shape": shape, "whole": whole, "sizes": [len(p) for p in parts], "n": len(values)}).encode()
    return codec_byte("id_tokens"), struct.pack("<I", len(head)) + head + b"".join(parts)


def decode_ids(codec: int, data: bytes, count: int) -> list[str]:
    family = family_of(codec, "ids")
    if family == "raw":
        return [f"read{i + 1}" for i in range(count)]
    if family == "zstd":
        return decode_strings(data)
    (n,) = struct.unpack_from("<I", data)
    head, at, columns = json.loads(data[4 : 4 + n]), 4 + n, []
    for size, whole in zip(head["sizes"], head["whole"], strict=True):
        part = data[at : at + size]
        columns.append([str(v) for v in decode_deltas(part)] if whole else decode_strings(part))
        at += size
    order = iter(columns)
    filled = [next(order) if f is None else [f] * head["n"] for f in head["shape"]]
    return ["".join(t) for t in zip(*filled, strict=True)]


def encode_sequences(values: list[str], kind: str, level: int = 3) -> tuple[int, bytes]:
    """Consensus groups for small blocks of short upper-case ACGTN reads, else zstd over all bases."""
    if kind == "short" and 0 < len(values) <= schema.CONSENSUS_READS and all(v and not v.strip("ACGTN") for v in values):
        groups = contigs(values)
        head = json.dumps([[len(g["consensus"]), len(g["deltas"])] for g in groups]).encode()
        ints, chars = [], b""
        for g in groups:
            for d in g["deltas"]:
                ints += [d["orig_order"], d["shift"], int(d["is_rc"]), d["read_len"], len(d["mm_pos"]), *d["mm_pos"]]
                chars += d["mm_chr"]
        parts = [head, "".join(g["consensus"] for g in groups).encode(), varints(ints), chars]
        return codec_byte("consensus"), squeeze(struct.pack("<4I", *map(len, parts)) + b"".join(parts), level)
    return codec_byte("zstd"), squeeze("".join(values).encode(), level)


def decode_sequences(codec: int, data: bytes, lengths: list[int]) -> list[str]:
    family, raw = family_of(codec, "seq"), expand(data)
    if family == "zstd":
        text, ends = raw.decode(), np.cumsum([0, *lengths]).tolist()
        if ends[-1] != len(text):
            raise FormatError("bases and lengths do not agree")
        return [text[a:z] for a, z in zip(ends, ends[1:], strict=False)]
    sizes = struct.unpack_from("<4I", raw)
    ends = np.cumsum([16, *sizes]).tolist()
    head, consensus, ints, chars = (raw[a:z] for a, z in zip(ends, ends[1:], strict=False))
    ints, groups, i, c, at = from_varints(ints), [], 0, 0, 0
    for size, members in json.loads(head):
        deltas = []
        for _ in range(members):
            order, shift, rc, n, k = ints[i : i + 5]
            deltas.append({"orig_order": order, "shift": shift, "is_rc": bool(rc), "read_len": n, "mm_pos": ints[i + 5 : i + 5 + k], "mm_chr": chars[c : c + k]})
            i, c = i + 5 + k, c + k
        groups.append({"consensus": consensus[at : at + size].decode(), "deltas": deltas})
        at += size
    return from_contigs(groups)


class Model:
    """Adaptive counts of 94 symbols for one context: 1 each, and what the symbols seen so far have beyond that."""

    __slots__ = ("total", "symbols", "more")

    def __init__(self):
        self.total, self.symbols, self.more = 94, [], []

    def take(self, s: int) -> tuple[int, int, int]:
        """The bounds of a symbol and the total, as they were before it is counted here."""
        symbols, more, total = self.symbols, self.more, self.total
        at = bisect_left(symbols, s)
        low = s + sum(more[:at]) if at else s
        if at < len(symbols) and symbols[at] == s:
            high = low + more[at] + 1
            more[at] += 8
        else:
            high = low + 1
            symbols.insert(at, s)
            more.insert(at, 8)
        self.total = total + 8
        if total > 16_375:
            self.halve()
        return low, high, total

    def find(self, v: int) -> tuple[int, int, int]:
        """The symbol whose bounds hold v, and those, as they were before it is counted here."""
        symbols, more, before, at = self.symbols, self.more, 0, 0
        for k in symbols:
            low, n = k + before, more[at]
            if v < low:
                break
            if v <= low + n:
                more[at] = n + 8
                self.total += 8
                if self.total > 16_383:
                    self.halve()
                return k, low, low + n + 1
            before += n
            at += 1
        symbols.insert(at, v - before)
        more.insert(at, 8)
        self.total += 8
        if self.total > 16_383:
            self.halve()
        return v - before, v, v + 1

    def halve(self) -> None:
        self.more = [((n + 2) >> 1) - 1 for n in self.more]
        self.total = 94 + sum(self.more)


HALF, WORD = (1 << 31) - 1, (1 << 32) - 1


def narrowed(low: int, high: int) -> tuple[int, int, int, int]:
    """The range with its settled bits shifted out: how many leading bits both ends shared, how many after the first differed for being near the middle, and both ends."""
    same = 32 - (low ^ high).bit_length()
    if same:
        low, high = low << same & WORD, high << same & WORD | (1 << same) - 1
    near = 31 - ((~low | high) & HALF).bit_length()
    if near:
        low, high = low << near & HALF, high << near & HALF | 1 << 31 | (1 << near) - 1
    return same, near, low, high


def encode_qualities(values: list[str], order: int = 2) -> bytes:
    """Arithmetic coding under the two symbols before and the place in the read. Symbol by symbol: for small blocks."""
    models, low, high, pending, held, size, out = {}, 0, WORD, 0, 0, 0, bytearray()
    for v in values:
        a = b = 0
        n = len(v)
        for pos, ch in enumerate(v):
            s = ord(ch) - 33
            if not 0 <= s < 94:
                raise FormatError(f"{ch!r} is no quality")
            key = (a * 94 + (b if order > 1 else 0)) * 8 + pos * 8 // n
            m = models.get(key)
            if m is None:
                m = models[key] = Model()
            lo, hi, total = m.take(s)
            span = high - low + 1
            first = low + span * lo // total
            same, near, low, high = narrowed(first, low + span * hi // total - 1)
            if same:
                settled = first >> 32 - same
                if pending:  # the bits that were left open are the opposite of the first one
                    top = settled >> same - 1
                    held = (held << 1 | top) << pending | (0 if top else (1 << pending) - 1)
                    held, size = held << same - 1 | settled & (1 << same - 1) - 1, size + pending
                    pending = 0
                else:
                    held = held << same | settled
                size += same
                if size > 1024:
                    rest = size & 7
                    out += (held >> rest).to_bytes(size >> 3, "big")
                    held, size = held & (1 << rest) - 1, rest
            pending += near
            a, b = s, a
    pending += 1
    top = 0 if low < 1 << 30 else 1
    held, size = (held << 1 | top) << pending | (0 if top else (1 << pending) - 1), size + 1 + pending
    out += (held << (-size & 7)).to_bytes(size + 7 >> 3, "big")
    return squeeze(bytes(out))


def decode_qualities(data: bytes, lengths: list[int], order: int = 2) -> list[str]:
    data = expand(data)
    models, low, high, value, out = {}, 0, WORD, int.from_bytes(data[:4].ljust(4, b"\0"), "big"), []
    held, size, at = 0, 0, 4
    for n in lengths:
        a = b = 0
        line = []
        for pos in range(n):
            key = (a * 94 + (b if order > 1 else 0)) * 8 + pos * 8 // n
            m = models.get(key)
            if m is None:
                m = models[key] = Model()
            span = high - low + 1
            total = m.total
            s, lo, hi = m.find(((value - low + 1) * total - 1) // span)
            same, near, low, high = narrowed(low + span * lo // total, low + span * hi // total - 1)
            k = same + near
            if k:
                if size < k:
                    held = (held & (1 << size) - 1) << 512 | int.from_bytes(data[at : at + 64].ljust(64, b"\0"), "big")
                    size, at = size + 512, at + 64
                size -= k
                bits = held >> size & (1 << k) - 1
                value = value << same & WORD | bits >> near
                if near:
                    value = value & 1 << 31 | value << near & HALF | bits & (1 << near) - 1
            line.append(chr(33 + s))
            a, b = s, a
        out.append("".join(line))
    return out


def checksum(headers: list[str], sequences: list[str], qualities: list[str]) -> int:
    """XXH64, seed 0, over all headers, bases, qualities and lengths; signed."""
    h = xxhash.xxh64(seed=0)
    for part in (headers, sequences, qualities):
        for v in part:
            h.update(v.encode())
    h.update(np.array([len(s) for s in sequences], "<u4").tobytes())
    v = h.intdigest()
    return v - (1 << 64) if v >> 63 else v
