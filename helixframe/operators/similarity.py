"""Minimizers, candidate pairs and consensus groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe import schema
from helixframe.functions import sequence as fn
from helixframe.operators import shared


def kmers(reads: DataFrame, k: int = schema.KMER) -> DataFrame:
    pos = F.explode(F.sequence(F.lit(0), F.length("sequence") - k)).alias("pos")
    return reads.where(F.length("sequence") >= k).select("read_idx", "sequence", pos).select("read_idx", "pos", F.substr("sequence", F.col("pos") + 1, F.lit(k)).alias("kmer"))


def minimizers(reads: DataFrame, k: int = schema.KMER, w: int = schema.MINIMIZER_WINDOW) -> DataFrame:
    """(read_idx, pos, hash): leftmost least hash of each window of k-mers, once for each change of place.

    k-mers with other bases than ACGT take no part; a read with none has no minimizer.
    """
    hashed = kmers(reads, k).withColumn("hash", fn.canonical_hash(F.col("kmer")))
    each = Window.partitionBy("read_idx")
    n = F.count("*").over(each)
    least = F.min(F.when(F.col("hash").isNotNull(), F.struct("hash", "pos"))).over(each.orderBy("pos").rowsBetween(0, w - 1))
    windows = hashed.select("read_idx", "pos", n.alias("n"), least.alias("m")).where(F.col("pos") <= F.col("n") - F.least(F.lit(w), F.col("n")))
    changed = windows.withColumn("before", F.lag("m.pos").over(Window.partitionBy("read_idx").orderBy("pos"))).where(F.col("m").isNotNull() & ~F.col("m.pos").eqNullSafe(F.col("before")))
    return changed.select("read_idx", F.col("m.pos").alias("pos"), F.col("m.hash").alias("hash"))


def minimizer_rows(sequences: list[bytes], k: int = schema.KMER, w: int = schema.MINIMIZER_WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the sequence, pos, hash), in order, of all sequences' minimizers, a stretch of the sequences at a time."""
    code = np.full(256, 4, np.uint8)
    code[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
    none, apart, lengths = 1 << 62, b"\0" * w, np.fromiter(map(len, sequences), np.int64, len(sequences))
    cuts = [*np.flatnonzero(np.diff(np.cumsum(lengths + w) >> 17, prepend=-1)).tolist(), len(sequences)]  # of about 128 KB, or one sequence
    for low, high in zip(cuts, cuts[1:], strict=False):
        c = code[np.frombuffer(apart.join([*sequences[low:high], b"\0" * (w + k)]), np.uint8)]  # what lies between is no base
        size = lengths[low:high]
        starts = np.cumsum(size + w) - size - w
        m = len(c) - k + 1
        bad = np.concatenate(([0], np.cumsum(c > 3)))
        forward, backward, two = np.zeros(m, np.int64), np.zeros(m, np.int64), (c & 3).astype(np.int64)
        for i in range(k):
            forward <<= 2
            forward |= two[i : i + m]
            backward |= (3 - two[i : i + m]) << (2 * i)
        h = np.minimum(forward, backward)
        h[bad[k:] != bad[:-k]] = none
        m -= w - 1
        best, at = h[:m].copy(), np.arange(m)
        for i in range(1, w):
            less = h[i : i + m] < best
            np.copyto(best, h[i : i + m], where=less)
            np.copyto(at, np.arange(i, i + m), where=less)
        windows = np.where(size >= k, np.maximum(1, size - k - w + 2), 0)
        which = np.repeat(np.arange(len(size)), windows)
        begun = np.cumsum(windows) - windows
        first = np.arange(len(which)) - begun[which] + starts[which]
        at, best = at[first], best[first]
        ok = best < none
        new = ok.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~ok[:-1] | (which[1:] != which[:-1])
        yield low + which[new], at[new] - starts[which[new]], best[new]


def bases_of(column) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def minimizers_arrow(reads: DataFrame, k: int = schema.KMER, w: int = schema.MINIMIZER_WINDOW) -> DataFrame:
    """The same rows from one numpy kernel over many reads at once, without a shuffle: the form for full tables."""

    def run(batches):
        for b in batches:
            idx = b.column("read_idx").to_numpy()
            for which, pos, h in minimizer_rows(bases_of(b.column("sequence")), k, w):
                yield pa.RecordBatch.from_arrays([pa.array(idx[which], pa.int64()), pa.array(pos, pa.int32()), pa.array(h)], names=["read_idx", "pos", "hash"])

    return reads.select("read_idx", "sequence").mapInArrow(run, "read_idx bigint, pos int, hash bigint")


def order_keys(reads: DataFrame, k: int = schema.KMER, w: int = schema.MINIMIZER_WINDOW) -> DataFrame:
    """(orig_idx, h, len) of all reads: least minimizer, -1 where there is none, and length. One pass without a shuffle or a join."""

    def run(batches):
        for b in batches:
            h = np.full(b.num_rows, -1, np.int64)
            for which, _, found in minimizer_rows(bases_of(b.column("sequence")), k, w):
                first = np.flatnonzero(np.diff(which, prepend=-1))
                if len(first):
                    h[which[first]] = np.minimum.reduceat(found, first)
            yield pa.RecordBatch.from_arrays([b.column("orig_idx"), pa.array(h), b.column("len")], names=["orig_idx", "h", "len"])

    return reads.select(F.col("read_idx").alias("orig_idx"), "sequence", F.length("sequence").alias("len")).mapInArrow(run, "orig_idx bigint, h bigint, len int")


BUCKET_BASES, PART_BYTES = 4 << 20, 4 << 20


def bucket_parts(reads: DataFrame) -> int:
    """Shuffle partitions for the minimizers of reads, by their bases: a table may hold a read in few bytes, so its size says little. The session's number at least."""
    bases = reads.agg(F.sum(F.length("sequence"))).first()[0] or 0
    return max(int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-bases // BUCKET_BASES))


def by_hash(mins: DataFrame, parts: int | None = None) -> DataFrame:
    """Minimizers dealt by hash to partitions whose number grows with the input, so that none does.

    `parts` is from `bucket_parts`; else it is the optimizer's estimate, which counts a read once, at about 100 bytes, and
    less where the reads come from a table of a few bytes a row. A read has about eight minimizers.
    """
    return mins.repartition(parts or shared.parts(mins, PART_BYTES), "hash")


def buckets(mins: DataFrame, parts: int | None = None) -> DataFrame:
    """Reads and places of each hash, counted."""
    each = by_hash(mins.select("hash", "read_idx"), parts).groupBy("hash", "read_idx").agg(F.count("*").alias("places"))
    return each.groupBy("hash").agg(F.count("*").alias("reads"), F.sum("places").alias("places"))


def candidates(mins: DataFrame, limit: int = schema.MAX_CANDIDATES, parts: int | None = None) -> DataFrame:
    """(a, b, shared): pairs a < b that share minimizers. Within a bucket a read meets its next `limit` reads, as a search of bounded depth does."""
    unique = by_hash(mins.select("hash", "read_idx"), parts).distinct()
    ahead = Window.partitionBy("hash").orderBy("read_idx").rowsBetween(1, limit)
    near = unique.withColumn("next", F.collect_list("read_idx").over(ahead))
    pairs = near.select(F.col("read_idx").alias("a"), F.explode("next").alias("b"))
    return pairs.repartition(2 * (parts or shared.parts(mins, PART_BYTES)), "a").groupBy("a", "b").agg(F.count("*").alias("shared"))


def consensus_vote(reads: DataFrame, key) -> DataFrame:
    """(key, pos, base, votes): most frequent base of each column, ties to the later of ACGT; N does not vote."""
    bases = reads.select(key.alias("key"), F.posexplode(F.split("sequence", "")).alias("pos", "base")).where(F.col("base").isin("A", "C", "G", "T"))
    votes = bases.groupBy("key", "pos", "base").agg(F.count("*").alias("votes"))
    best = F.max(F.struct("votes", "base")).alias("best")
    return votes.groupBy("key", "pos").agg(best).select("key", "pos", "best.base", "best.votes")


def align(reads: np.ndarray, turned: np.ndarray, sizes: np.ndarray, reference: np.ndarray, max_shift: int, places: list[tuple[bool, int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least cost of each read against the reference, and the shift and strand of the first alignment that has it.

    The cost is the differing bases of the overlap and the bases of the read outside it;
    forward strands come first, then smaller shifts. `places`, in that order, are the (strand, shift) to try if not all.
    """
    best = np.full(len(reads), np.iinfo(np.int64).max)
    where, strand = np.zeros(len(reads), np.int64), np.zeros(len(reads), bool)
    for rc, shift in places if places is not None else [(rc, shift) for rc in (False, True) for shift in range(-max_shift, max_shift + 1)]:
        x, a, b = turned if rc else reads, max(0, shift), max(0, -shift)
        overlap = np.minimum(len(reference) - a, sizes - b)
        w = min(len(reference) - a, x.shape[1] - b)
        if w <= 0:
            continue
        differ = ((x[:, b : b + w] != reference[a : a + w]) & (np.arange(w) < overlap[:, None])).sum(axis=1)
        cost = np.where(overlap > 0, differ + sizes - overlap, np.iinfo(np.int64).max)
        less = cost < best
        best, where, strand = np.where(less, cost, best), np.where(less, shift, where), np.where(less, rc, strand)
    return best, where, strand


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits, a multiple of 64, as rows of 64-bit words."""
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def planes(forms: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Both bits of each base, where N counts as A, and which places hold one, as words; forms are (2, reads, width)."""
    c = codes[forms] & 3
    return words(c & 1), words(c >> 1), words(np.broadcast_to(np.arange(forms.shape[2]) < sizes[:, None], forms.shape))


def within(bits: tuple[np.ndarray, ...], width: int, least: int, reference: np.ndarray, codes: np.ndarray, max_shift: int, limit: int) -> tuple[np.ndarray, range]:
    """(strand, read, shift): where the cost may be within the limit, and the range of shifts; nowhere else is it.

    The differing bases, and those outside the reference, of all reads at all shifts are counted in words of 64 places. N equals A here, so
    a count is never above the cost. Shifts that leave more than the limit of even the shortest read (of `least` bases) outside are left out.
    """
    n = len(reference)
    shifts = range(-min(max_shift, limit), min(max_shift, limit + n - least) + 1)
    if not len(shifts):
        return np.zeros((2, bits[0].shape[1], 0), bool), shifts
    spread = np.full(n + len(shifts) + width, 4, np.uint8)
    spread[-shifts[0] : n - shifts[0]] = codes[reference] & 3
    views = spread[np.arange(len(shifts))[:, None] + np.arange(width)]
    one, two, outside = words(views & 1), words(views >> 1 & 1), words(views >> 2)
    out = np.empty((2, bits[0].shape[1], len(shifts)), bool)
    for low in range(0, out.shape[1], 512):
        count = 0
        for w in range(one.shape[1]):
            first, second, real = (p[:, low : low + 512, w, None] for p in bits)
            differ = first ^ one[:, w]
            differ |= second ^ two[:, w]
            differ |= outside[:, w]
            differ &= real
            count = np.bitwise_count(differ) if one.shape[1] == 1 else count + np.bitwise_count(differ).astype(np.int32)
        out[:, low : low + 512] = count <= limit
    return out, shifts




def contigs(sequences: list[str], max_shift: int = schema.MAX_SHIFT, limit: int = schema.HAMMING_LIMIT) -> list[dict]:
    """Greedy consensus groups of ACGTN reads, each a consensus with shift, strand and differences of its members.

    The first read that is left founds a group; those after it join in order if they align
    within the limit to the consensus as it stands, over the founder's span, and vote in it. Members are stored
    as their differences from the final consensus.
    """
    table = str.maketrans("ACGT", "TGCA")
    codes = np.full(256, 4, np.uint8)
    codes[np.frombuffer(b"ACGTN", np.uint8)] = np.arange(5)
    sizes = np.array([len(s) for s in sequences], np.int64)
    forms = np.zeros((2, len(sequences), max(64, -int(-sizes.max(initial=0) // 64) * 64)), np.uint8)
    for i, s in enumerate(sequences):
        forms[0, i, : len(s)] = np.frombuffer(s.encode(), np.uint8)
        forms[1, i, : len(s)] = np.frombuffer(s.translate(table)[::-1].encode(), np.uint8)
    bits, least = planes(forms, codes, sizes), int(sizes.min()) if len(sizes) else 0
    left, groups = np.arange(len(sequences)), []
    while len(left):
        founder, rest = int(left[0]), left[1:]
        n = int(sizes[founder])
        reference, votes = forms[0, founder, :n].copy(), None
        members, joined, at = [(founder, 0, False, forms[0, founder, :n])], np.zeros(len(rest), bool), 0
        while at < len(rest):
            begun, at = at, len(rest)
            maybe, shifts = within(tuple(p[:, rest[begun:]] for p in bits), forms.shape[2], least, reference, codes, max_shift, limit)
            some = np.flatnonzero(maybe.any(axis=(0, 2)))
            if not len(some):
                break
            places = [(bool(rc), shifts[k]) for rc, k in np.argwhere(maybe.any(axis=1)).tolist()]
            tried = rest[begun:][some]
            cost, shift, strand = align(forms[0, tried], forms[1, tried], sizes[tried], reference, max_shift, places)
            if votes is None:
                votes = np.zeros((n, 5), np.int32)
                votes[np.arange(n), codes[reference]] += 1
            for k in np.flatnonzero(cost <= limit).tolist():
                j, sh = int(tried[k]), int(shift[k])
                x = forms[int(strand[k]), j, : sizes[j]]
                members.append((j, sh, bool(strand[k]), x))
                joined[begun + some[k]] = True
                a, z = max(0, sh), min(n, sh + len(x))
                votes[np.arange(a, z), codes[x[a - sh : z - sh]]] += 1
                plain = votes[:, :4]
                new = np.where(plain.sum(axis=1) > 0, np.frombuffer(b"ACGT", np.uint8)[3 - plain[:, ::-1].argmax(axis=1)], reference)
                if (new != reference).any():
                    reference, at = new, begun + int(some[k]) + 1
                    break
        groups.append({"members": members})
        left = rest[~joined]
    out = []
    for g in groups:
        if len(g["members"]) == 1:  # a read alone is its own consensus
            order = g["members"][0][0]
            out.append({"consensus": sequences[order], "deltas": [{"orig_order": order, "shift": 0, "is_rc": False, "read_len": int(sizes[order]), "mm_pos": [], "mm_chr": b""}]})
            continue
        low = min(m[1] for m in g["members"])
        size = max(m[1] + len(m[3]) for m in g["members"]) - low
        votes = np.zeros((size, 5), np.int32)
        for _, shift, _, x in g["members"]:
            votes[np.arange(shift - low, shift - low + len(x)), codes[x]] += 1
        votes[:, 4] = 0
        pick = 3 - votes[:, 3::-1].argmax(axis=1)
        consensus = np.where(votes.sum(axis=1) > 0, np.frombuffer(b"ACGT", np.uint8)[pick], ord("N")).astype(np.uint8)
        deltas = []
        for order, shift, rc, x in g["members"]:
            part = consensus[shift - low : shift - low + len(x)]
            at = np.flatnonzero(part != x)
            deltas.append({"orig_order": order, "shift": int(shift - low), "is_rc": rc, "read_len": len(x), "mm_pos": at.tolist(), "mm_chr": x[at].tobytes()})
        out.append({"consensus": consensus.tobytes().decode(), "deltas": deltas})
    return out


def from_contigs(groups: list[dict]) -> list[str]:
    table = str.maketrans("ACGT", "TGCA")
    out: dict[int, str] = {}
    for g in groups:
        base = np.frombuffer(g["consensus"].encode(), np.uint8)
        for d in g["deltas"]:
            x = base[d["shift"] : d["shift"] + d["read_len"]].copy()
            x[d["mm_pos"]] = np.frombuffer(d["mm_chr"], np.uint8)
            s = x.tobytes().decode()
            out[d["orig_order"]] = s.translate(table)[::-1] if d["is_rc"] else s
    return [out[i] for i in range(len(out))]


PATH_BYTES = 512 << 10


def greedy_order(reads: DataFrame, group, limit: int = schema.MAX_CANDIDATES) -> DataFrame:
    """(group, orig_idx, archive_idx): the nearest-neighbour path through each group's reads, from its first.

    The next read is, of the first `limit` unused ones that share a minimizer with the last read, in the order of its minimizers
    and of the reads, the one nearest in length; else the first unused one. One step needs the step before, so a group is
    one task's work: groups are blocks of bounded size, and `layout.similarity_order` serves whole tables. Groups are dealt
    to partitions whose number grows with the reads, as a path costs far more than its few bytes.
    """
    rows = reads.select("read_idx", group.alias("group"), F.length("sequence").alias("size"), "sequence")

    def walk(t: pa.Table) -> pa.Table:
        t = t.sort_by("read_idx")
        hashes: list[list[int]] = [[] for _ in range(t.num_rows)]
        for which, _, h in minimizer_rows(bases_of(t.column("sequence"))):
            for i, v in zip(which.tolist(), h.tolist(), strict=True):
                hashes[i].append(v)
        order = path(t.column("size").to_pylist(), hashes, limit)
        idx = t.column("read_idx").to_numpy()
        return pa.table({"group": t.column("group"), "orig_idx": pa.array(idx[order], pa.int64()), "archive_idx": pa.array(np.arange(len(order)), pa.int64())})

    dealt = rows.repartition(shared.parts(rows, PATH_BYTES, 2 * reads.sparkSession.sparkContext.defaultParallelism), "group")
    return dealt.groupBy("group").applyInArrow(walk, "group bigint, orig_idx bigint, archive_idx bigint")


def path(sizes: list[int], hashes: list[list[int]], limit: int) -> list[int]:
    places: dict[int, list[int]] = {}
    for i, own in enumerate(hashes):
        for h in dict.fromkeys(own):
            places.setdefault(h, []).append(i)
    used, order, first = [False] * len(sizes), [], 0
    now = 0 if sizes else None
    while now is not None:
        used[now] = True
        order.append(now)
        best, seen = None, 0
        for h in hashes[now]:
            bucket = places[h] = [i for i in places[h] if not used[i]]
            for i in bucket[: limit - seen]:
                if best is None or abs(sizes[i] - sizes[now]) < abs(sizes[best] - sizes[now]):
                    best = i
            seen += min(len(bucket), limit - seen)
            if seen >= limit:
                break
        while first < len(sizes) and used[first]:
            first += 1
        now = best if best is not None else first if first < len(sizes) else None
    return order
