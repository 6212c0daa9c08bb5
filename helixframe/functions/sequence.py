"""Column builders over bases, qualities and identifiers; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from helixframe import schema

QUALITIES = "".join(chr(33 + q) for q in range(94))


def reverse_complement(s) -> Column:
    """Case is kept; whatever is no base becomes N."""
    return F.reverse(F.translate(F.regexp_replace(s, "[^ACGTNacgtn]", "N"), "ACGTacgt", "TGCAtgca"))


def base_index(s) -> Column:
    return F.translate(s, "ACGTN", "01234")


def canonical_hash(kmer) -> Column:
    """Smaller of a k-mer's two-bit value and that of its reverse complement; null unless all bases are ACGT."""
    forward = F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("bigint")
    backward = F.conv(F.translate(F.reverse(kmer), "ACGT", "3210"), 4, 10).cast("bigint")
    return F.when(F.col(kmer).rlike("^[ACGT]+$") if isinstance(kmer, str) else kmer.rlike("^[ACGT]+$"), F.least(forward, backward))


def valid_sequence(s) -> Column:
    return F.col(s).rlike("^[ACGTNacgtn]*$")


def valid_base(c) -> Column:
    """One of ACGT in either case; N is none."""
    return F.coalesce(F.col(c).rlike("^[ACGTacgt]$"), F.lit(False))


def noise_encode(reference, base) -> Column:
    """A digit that tells a base against another: its place among the others of that one, 3 for all else."""
    up = F.upper(base)
    row = F.create_map(*(F.lit(x) for k, v in schema.NOISE.items() for x in (k, v[:3])))[F.upper(reference)]
    return F.when(row.isNull(), "0").otherwise(F.when(F.contains(row, up) & (up != ""), F.position(up, row) - 1).otherwise(3).cast("string"))


def noise_decode(reference, digit) -> Column:
    """The base a digit tells; of references other than ACGT as of N, of digits past 3 as of 3."""
    row = F.coalesce(F.create_map(*(F.lit(x) for k, v in schema.NOISE.items() for x in (k, v)))[F.upper(reference)], F.lit(schema.NOISE["N"]))
    return F.substr(row, F.when(digit.between("0", "3"), digit.cast("int")).otherwise(3) + 1, F.lit(1))


def valid_quality(q) -> Column:
    return F.col(q).rlike("^[!-~]*$")


def first_invalid(s) -> Column:
    """0-based position of the first invalid base, -1 if there is none."""
    ok = F.length(F.regexp_extract(s, "^[ACGTNacgtn]*", 0))
    return F.when(ok < F.length(s), ok).otherwise(-1)


def count_matching(s, pattern: str) -> Column:
    return F.length(s) - F.length(F.regexp_replace(s, pattern, ""))


def nearest(q: int, levels) -> int:
    return min(levels, key=lambda v: (abs(v - q), v))


def illumina(q: int) -> int:
    return next(v for b, v in zip(schema.ILLUMINA_BOUNDS, schema.ILLUMINA_VALUES, strict=True) if q < b)


def quantized(quality, mode: str) -> Column:
    """Qualities after a lossy mode; each is one translate over the 94 characters."""
    if mode == "none":
        return F.col(quality)
    if mode == "discard":
        return F.repeat(F.lit("!"), F.length(quality))
    to = illumina if mode == "illumina8" else lambda q: nearest(q, schema.CODEBOOK)
    return F.translate(quality, QUALITIES, "".join(chr(33 + to(q)) for q in range(94)))


def phred(quality) -> Column:
    """Array of values, clamped to 0..93."""
    chars = F.filter(F.split(quality, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.greatest(F.lit(0), F.least(F.lit(93), F.ascii(c) - 33)))


def position_bin(pos, length) -> Column:
    return F.least(F.floor(pos * 8 / length), F.lit(7))


def hamming(a, b) -> Column:
    """Differing positions of the common part plus the difference in length."""
    pairs = F.zip_with(F.split(F.substr(a, F.lit(1), F.least(F.length(a), F.length(b))), ""), F.split(F.substr(b, F.lit(1), F.least(F.length(a), F.length(b))), ""), lambda x, y: x != y)
    return F.size(F.filter(pairs, lambda x: x)) + F.abs(F.length(a) - F.length(b))


def id_tokens(read_id) -> Column:
    return F.regexp_extract_all(read_id, F.lit(r"([:_/| \t]|[^:_/| \t]+)"), F.lit(1))


def token_kind(token) -> Column:
    """d: delimiter, i: integer that its text can be rebuilt from, s: string."""
    return F.when(token.rlike(r"^[:_/| \t]$"), "d").when(token.rlike("^(0|[1-9][0-9]{0,17})$"), "i").otherwise("s")


def id_pattern(read_id) -> Column:
    return F.array_join(F.transform(id_tokens(read_id), lambda t: F.when(t.rlike(r"^[:_/| \t]$"), t).otherwise("v")), "")


def zigzag(v) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(v) -> Column:
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-(v.bitwiseAND(1)))


def header(read_id, comment) -> Column:
    return F.when(F.col(comment) == "", F.col(read_id)).otherwise(F.concat(read_id, F.lit(" "), comment))


def split_header(h) -> tuple[Column, Column]:
    return F.substring_index(h, " ", 1), F.when(F.locate(" ", h) > 0, F.substr(h, F.locate(" ", h) + 1)).otherwise("")


def pair_ids_match(a, b) -> Column:
    """Equal ids; /1 and /2; or the same id with comments 1: and 2:."""
    a, b = F.col(a), F.col(b)
    mates = a.endswith("/1") & b.endswith("/2") & (F.substr(a, F.lit(1), F.length(a) - 2) == F.substr(b, F.lit(1), F.length(b) - 2))
    spaced = a.contains(" ") & b.contains(" ") & (F.substring_index(a, " ", 1) == F.substring_index(b, " ", 1)) & F.substr(a, F.locate(" ", a) + 1).startswith("1:") & F.substr(b, F.locate(" ", b) + 1).startswith("2:")
    return (a == b) | F.when(a.endswith("/1") & b.endswith("/2"), mates).otherwise(spaced)


def flags(paired, preserve, quality: int, ids: int, has_map, layout: int, length_class: int, streaming) -> Column:
    """One integer: paired 0, preserve 1, quality 3-4, ids 5-6, map 7, layout 8-9, class 10-11, streaming 12."""
    bit = lambda v, n: F.shiftleft(F.lit(v).cast("bigint") if not isinstance(v, Column) else v.cast("bigint"), n)
    return bit(paired, 0) + bit(preserve, 1) + bit(quality, 3) + bit(ids, 5) + bit(has_map, 7) + bit(layout, 8) + bit(length_class, 10) + bit(streaming, 12)


def flag(value, low: int, width: int = 1) -> Column:
    return F.shiftright(value, low).bitwiseAND((1 << width) - 1)


def register(spark: SparkSession) -> None:
    """The scalar functions as SQL functions of the session."""
    for name, body in {
        "revcomp": "s string) returns string return reverse(translate(regexp_replace(s, '[^ACGTNacgtn]', 'N'), 'ACGTacgt', 'TGCAtgca'))",
        "zigzag": "v bigint) returns bigint return shiftleft(v, 1) ^ shiftright(v, 63)",
        "valid_bases": "s string) returns boolean return s rlike '^[ACGTNacgtn]*$'",
    }.items():
        spark.sql(f"create or replace temporary function {name}({body}")
