"""Personal data: base recognisers, then bootstrapped contextual extraction.

What the recognisers find are seeds. The words around every seed and around
every other identifier-like string become lexical patterns; Spark scores the
pattern-instance graph in rounds (a pattern by the share of its distinct
instances that are trusted, an instance by its patterns), and patterns of high
confidence mark the unseen identifiers that stand in them.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import forget, store, worker_cache

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
MARK = re.compile(r"[0-9@]")
TAIL = re.compile(r"\S*")
#: Characters that a run of digit groups may have before it is cut into several candidates; a surface of more
#: characters stands in the graph by its digest; characters of context read on either side.
LONGEST, REACH = 64, 48


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost matches of each kind that do not overlap; a match that fails its check is dropped, not retried."""
    found = {k: [] for k in KINDS}
    found["email"] = emails(text)
    if DIGIT.search(text):
        if "." in text:
            found["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return found


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Identifier-like strings that no base span touches: words with a digit or @, whatever their length, and digit groups after them.

    Digit groups in a row are taken together up to LONGEST characters; a longer row gives several candidates.
    """
    found, free = [], 0
    taken = sorted(taken)
    k = 0
    for m in MARK.finditer(text):
        if m.start() < free:
            continue
        start = m.start()
        while start > free and not text[start - 1].isspace():
            start -= 1
        end = TAIL.match(text, m.start()).end()
        while end + 1 < len(text) and text[end] == " " and "0" <= text[end + 1] <= "9":
            more = TAIL.match(text, end + 1).end()
            if more - start > LONGEST:
                break
            end = more
        free = end
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k < len(taken) and taken[k][0] < end:
            continue
        while start < end and not (text[start].isalnum() or text[start] == "+"):
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        if end - start >= 4:
            found.append((start, end))
    return found


def could_be(surface: str) -> list[str]:
    """The kinds that a string outside the base recognisers may be of at all."""
    digits = sum("0" <= c <= "9" for c in surface)
    fits = {"email": "@" in surface, "ip": digits >= 4 and ("." in surface or ":" in surface), "card": digits >= 8, "phone": digits >= 5}
    return [k for k in KINDS if fits[k]]


def surface_of(text: str) -> str:
    return text if len(text) <= LONGEST else "#" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span: two words to its left; one on either side."""
    left = re.sub("[0-9]", "0", text[max(0, start - REACH) : start].lower()).split()
    right = re.sub("[0-9]", "0", text[end : end + REACH].lower()).split()
    two = " ".join(left[-2:])
    both = f"{left[-1] if left else ''} _ {right[0] if right else ''}"
    return [p for p in (f"L {two}", f"B {both}") if sum(map(str.isalpha, p)) >= 5]


SCAN = "key bigint, key2 bigint, doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base array<struct<kind:string,start:int,end:int>>, seen array<struct<kind:string,start:int,end:int,surface:string,may:array<string>,patterns:array<string>>>"


def joined(spans) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def scan(docs: DataFrame, keys) -> DataFrame:
    """Per row its base spans and all graph occurrences: seeds with their kind, candidates with null. keys: two columns that tell the rows apart."""

    def run(batches):
        worker_cache("pii")
        for b in batches:
            rows = []
            for key, key2, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("key", "key2", "doc_id", "text")), strict=True):
                text = text or ""
                spans = base_spans(text)
                base = [(k, a, z) for k in KINDS for a, z in spans[k]]
                seen = [{"kind": k, "start": a, "end": z, "may": None} for k, a, z in base]
                if base or MARK.search(text):
                    seen += [{"kind": None, "start": a, "end": z, "may": could_be(text[a:z])} for a, z in candidates(text, [s[1:] for s in base])]
                for s in seen:
                    s |= {"surface": surface_of(text[s["start"] : s["end"]]), "patterns": contexts(text, s["start"], s["end"])}
                rows.append({"key": key, "key2": key2, "doc_id": doc_id, **{f"n_{k}": len(spans[k]) for k in KINDS}, "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "base": [{"kind": k, "start": a, "end": z} for k, a, z in base], "seen": seen})
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    span = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
    ARROW = pa.schema(
        [("key", pa.int64()), ("key2", pa.int64()), ("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("base", pa.list_(pa.struct(span))), ("seen", pa.list_(pa.struct([*span, ("surface", pa.string()), ("may", pa.list_(pa.string())), ("patterns", pa.list_(pa.string()))])))]
    )
    key, key2 = keys
    return docs.select(key.alias("key"), key2.alias("key2"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCAN)


def trusted_patterns(scanned: DataFrame, rounds: int = 3, least_score: float = 0.6, least_support: int = 3) -> DataFrame:
    """(pattern, kind, score): score = trusted share of a pattern's distinct instances, smoothed by one unknown instance.

    Only patterns that some seed stands in are scored, whatever their number;
    a pattern needs `least_support` distinct instances that are seeds. An instance that is no seed has
    the mean score of its patterns; equal scores go to the first kind.
    """
    seen = scanned.select(F.explode("seen").alias("s")).select("s.kind", "s.surface", F.explode("s.patterns").alias("pattern"))
    seeds = seen.where("kind is not null").select("pattern").distinct()
    nodes = store(
        seen.join(seeds, "pattern", "left_semi").groupBy("pattern", "surface").agg(*(F.max(F.when(F.col("kind") == k, 1.0).otherwise(0.0)).alias(k) for k in KINDS), F.max(F.col("kind").isNotNull()).alias("seed")),
        "pii-graph",
    )
    graph = nodes
    for i in range(rounds):
        scored = graph.groupBy("pattern").agg(F.sum(F.col("seed").cast("int")).alias("support"), *((F.sum(k) / (F.count("*") + 1)).alias(f"p_{k}") for k in KINDS))
        if i == rounds - 1:
            break
        back = graph.select("pattern", "surface").join(scored, "pattern").groupBy("surface").agg(*(F.avg(f"p_{k}").alias(f"i_{k}") for k in KINDS))
        graph = store(nodes.join(back, "surface").select("pattern", "surface", "seed", *(F.when(F.col("seed"), F.col(k)).otherwise(F.col(f"i_{k}")).alias(k) for k in KINDS)), "pii-graph")
    best = F.greatest(*(F.col(f"p_{k}") for k in KINDS))
    kind = F.coalesce(*(F.when(F.col(f"p_{k}") == best, F.lit(k)) for k in KINDS))
    return scored.where((F.col("support") >= least_support) & (best >= least_score)).select("pattern", kind.alias("kind"), best.alias("score"))


def added_spans(scanned: DataFrame, patterns: DataFrame) -> DataFrame:
    """(key, key2, added): the identifiers that trusted patterns find in each row."""
    seen = scanned.select("key", "key2", F.explode("seen").alias("s")).where("s.kind is null").select("key", "key2", "s.start", "s.end", "s.may", F.explode("s.patterns").alias("pattern"))
    order = F.array(*map(F.lit, KINDS))
    hits = seen.join(patterns, "pattern").where(F.expr("array_contains(may, kind)")).groupBy("key", "key2", "start", "end").agg(F.max(F.struct("score", (-F.array_position(order, F.col("kind"))).alias("o"), "kind")).alias("b"))
    return hits.groupBy("key", "key2").agg(F.collect_list(F.struct(F.col("b.kind").alias("kind"), "start", "end", F.col("b.score").alias("score"))).alias("added"))


def find(docs: DataFrame, rounds: int = 3, least_score: float = 0.6, least_support: int = 3) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (text) and found (array of kind, start, end, score); one row per row of docs.

    Base spans have score 1. Offsets are code points, ends exclusive. Null and empty texts
    have no span; long ones are read whole. An identifier that stands in several patterns takes the best, then the first kind.
    Repeated rows are kept, columns but doc_id and text are ignored whatever their names; an empty table gives no rows.
    """
    scanned = store(scan(docs, (F.monotonically_increasing_id(), F.lit(0).cast("bigint"))), "pii-scan")
    patterns = store(trusted_patterns(scanned, rounds, least_score, least_support), "pii-patterns")
    added = added_spans(scanned, patterns)
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(1.0).alias("score")))
    full = scanned.join(added, ["key", "key2"], "left").withColumn("found", F.when(F.col("added").isNull(), base).otherwise(F.concat(base, F.col("added"))))
    order = F.array(*map(F.lit, KINDS))
    ranked = F.array_sort(F.transform("found", lambda s: F.struct(F.array_position(order, s["kind"]).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return full.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", text.alias("spans"), "found")


def mask(docs: DataFrame, rounds: int = 3, least_score: float = 0.6, least_support: int = 3) -> DataFrame:
    """docs with every found span of text replaced by its kind in angle brackets, and n_chars, if there is one, that of the new text.

    What is found depends on a text alone, so rows meet their added spans by two hashes of the text and nothing is
    numbered or copied. Overlapping spans are replaced as one, under the kind that starts first. Null texts stay null, empty
    ones empty; repeated rows are kept. Other columns come back as they were, whatever their names; an empty table gives no rows.
    """
    keys = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    scanned = store(scan(docs, keys), "pii-scan")
    patterns = store(trusted_patterns(scanned, rounds, least_score, least_support), "pii-patterns")
    taken = {c.lower() for c in docs.columns}
    a, b, c = (next(n for n in (f"{x}{'_' * i}" for i in range(1, len(taken) + 2)) if n not in taken) for x in ("key_a", "key_b", "added"))
    added = store(added_spans(scanned, patterns).select(F.col("key").alias(f"{a}x"), F.col("key2").alias(f"{b}x"), F.col("added").alias(c)), "pii-added")
    forget(scanned, patterns)
    names, schema = docs.columns, docs.schema
    keyed = docs.select("*", keys[0].alias(a), keys[1].alias(b))
    both = keyed.join(added, (F.col(a) == F.col(f"{a}x")) & (F.col(b) == F.col(f"{b}x")), "left").select(*(F.col(f"`{n}`") for n in names), c)

    def run(batches):
        for batch in batches:
            texts = []
            for t, more in zip(batch.column(names.index("text")).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                spans = [(i, j, k) for k, found in base_spans(t).items() for i, j in found] if t else []
                texts.append(cover(t, spans + [(s["start"], s["end"], s["kind"]) for s in more or ()]))
            made = {"text": texts, "n_chars": [None if t is None else len(t) for t in texts]}
            yield pa.RecordBatch.from_arrays([pa.array(made[n], batch.column(i).type) if n in made else batch.column(i) for i, n in enumerate(names)], names=names)

    return both.mapInArrow(run, schema)


def cover(text: str | None, spans) -> str | None:
    if not text or not spans:
        return text
    out, at = [], 0
    for a, z, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, z)
    return "".join(out) + text[at:]
