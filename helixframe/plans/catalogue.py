"""Named queries over the driver's tables, each with its SQL where there is one."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe import schema
from helixframe.functions import sequence as fn
from helixframe.operators import codecs, container, layout, shared, similarity, store
from helixframe.plans.views import SQL, as_reads, reads, varied
from helixframe.sources import fastq
from helixframe.streaming import ingest

BLOCK = 1000
_queries: dict = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        _queries[key] = f
        if sql is not None:
            _sql[key] = SQL + sql
        return f

    return add


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# --- profiles

CLASS = "case when max_length >= 10240 then 'long' when max_length > 511 or median_length >= 1024 then 'medium' else 'short' end"
LENGTHS = "select count(*) as n, cast(sum(len) // count(*) as bigint) as mean_length, list_sort(list(len))[count(*) // 2 + 1] as median_length, max(len) as max_length from {src}"
PROFILE = "select cast(n as bigint) as n, mean_length, cast(median_length as int) as median_length, cast(max_length as int) as max_length, " + CLASS + " as length_class from (" + LENGTHS + ")"


@query("""select count(*) as records, cast(sum(length(sequence)) as bigint) as bases, min(length(sequence))::int as min_length, max(length(sequence))::int as max_length,
cast(sum(length(sequence)) // count(*) as bigint) as mean_length, cast(list_sort(list(length(sequence)))[count(*) // 2 + 1] as int) as median_length,
cast(sum(length(regexp_replace(sequence, '[^Nn]', '', 'g'))) as bigint) as n_bases, cast(sum(length(id) + length(comment) + length(sequence) + length(quality) + 7) as bigint) as raw_bytes,
'short' as length_class, 100000 as block_size from varied""")
def read_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = varied(spark, sf)
    n = F.length("sequence")
    each = rows.groupBy(n.alias("len")).agg(F.count("*").alias("c"), F.sum(fn.count_matching("sequence", "[Nn]")).alias("nn"), F.sum(F.length("id") + F.length("comment") + 2 * n + 7).alias("raw"))
    upto = each.withColumn("upto", F.sum("c").over(Window.orderBy("len").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    stats = upto.agg(
        F.max("n").alias("records"), F.sum(F.col("len") * F.col("c")).alias("bases"), F.min("len").alias("min_length"), F.max("len").alias("max_length"),
        F.expr("sum(len * c) div max(n)").alias("mean_length"), F.min(F.when(F.col("upto") >= F.expr("n div 2 + 1"), F.col("len"))).alias("median_length"),
        F.sum("nn").alias("n_bases"), F.sum("raw").alias("raw_bytes"),
    )
    kind = layout.class_column(F.col("median_length"), F.col("max_length"))
    sizes = schema.BLOCK_READS
    return stats.withColumn("length_class", kind).withColumn("block_size", F.when((F.col("max_length") < schema.SHORT_MAX_LENGTH) | (F.col("length_class") == "short"), sizes["short"]).when(F.col("length_class") == "medium", sizes["medium"]).otherwise(sizes["long"]))


@query(PROFILE.format(src="(select length(sequence) as len from varied)"))
def length_profile(spark, sf):
    return layout.length_stats(varied(spark, sf).select(F.length("sequence").alias("len")))


@query(PROFILE.format(src="(select length(sequence) as len from varied join (select unnest(generate_series(0, least(4096, (select count(*) from reads)) - 1)) as i) on read_idx = i * (select count(*) from reads) // least(4096, (select count(*) from reads)))"))
def length_profile_strided(spark, sf):
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    k = min(schema.LENGTH_SAMPLE, n)
    places = spark.range(k).select(F.expr(f"(id * {n}) div {max(1, k)}").alias("read_idx"))
    return layout.length_stats(varied(spark, sf).join(F.broadcast(places), "read_idx").select(F.length("sequence").alias("len")))


@query(PROFILE.format(src="(select length(sequence) as len from varied where read_idx < 4096)"))
def length_profile_prefix(spark, sf):
    return layout.length_stats(varied(spark, sf).where(F.col("read_idx") < schema.LENGTH_SAMPLE).select(F.length("sequence").alias("len")))


@query("""select cast(read_idx % 7 as bigint) as grp, max(300 * (read_idx % 7) * length(sequence) // 32)::bigint as max_length,
case when max(300 * (read_idx % 7) * length(sequence) // 32) >= 10240 then 'long' when max(300 * (read_idx % 7) * length(sequence) // 32) > 511 then 'medium' else 'short' end as length_class,
case when max(300 * (read_idx % 7) * length(sequence) // 32) >= 10240 then 10000 when max(300 * (read_idx % 7) * length(sequence) // 32) > 511 then 50000 else 100000 end as block_size from varied group by 1""")
def length_class_by_group(spark, sf):
    rows = varied(spark, sf).select((F.col("read_idx") % 7).alias("grp"), F.expr("(300 * (read_idx % 7) * length(sequence)) div 32").alias("len"))
    kind = layout.class_column(F.lit(0), F.col("max_length"))
    out = rows.groupBy("grp").agg(F.max("len").alias("max_length")).withColumn("length_class", kind)
    return out.withColumn("block_size", F.create_map(*(F.lit(x) for k, v in schema.BLOCK_READS.items() for x in (k, v)))[F.col("length_class")])


@query("""select kind, longest, cap, case when cap > 0 and kind <> 'short' then least(base, greatest(1, cap // longest)) else base end as block_size from
(select *, case when longest < 511 or kind = 'short' then 100000 when kind = 'medium' then 50000 else 10000 end as base from
(values ('short', 150, 0), ('short', 150, 4000), ('medium', 2000, 4000), ('medium', 511, 0), ('medium', 400, 0), ('long', 20000, 1000000), ('long', 20000, 10)) t(kind, longest, cap))""")
def block_sizes(spark, sf):
    cases = [("short", 150, 0), ("short", 150, 4000), ("medium", 2000, 4000), ("medium", 511, 0), ("medium", 400, 0), ("long", 20000, 1_000_000), ("long", 20000, 10)]
    return spark.createDataFrame([(k, n, c, layout.block_size(0, k, n, c)) for k, n, c in cases], "kind string, longest int, cap int, block_size int")


@query("select cast(sum(2 * (length(id) + length(comment) + length(sequence) + length(quality) + 128)) as bigint) as peak_bytes from varied")
def ingest_estimate(spark, sf):
    return store.ingest_estimate(varied(spark, sf))


# --- headers, predicates, ranges


@query("select read_idx, split_part(h, ' ', 1) as id, case when instr(h, ' ') > 0 then substr(h, instr(h, ' ') + 1) else '' end as comment from (select read_idx, case when read_idx % 3 = 0 then id else concat(id, ' ', comment) end as h from reads)")
def header_split(spark, sf):
    h = reads(spark, sf).select("read_idx", F.when(F.col("read_idx") % 3 == 0, F.col("id")).otherwise(F.concat("id", F.lit(" "), "comment")).alias("h"))
    read_id, comment = fn.split_header("h")
    return h.select("read_idx", read_id.alias("id"), comment.alias("comment"))


@query("select read_idx, case when read_idx % 3 = 0 then id else concat(id, ' ', comment) end as header from reads")
def header_full(spark, sf):
    rows = reads(spark, sf).withColumn("comment", F.when(F.col("read_idx") % 3 == 0, "").otherwise(F.col("comment")))
    return rows.select("read_idx", fn.header("id", "comment").alias("header"))


@query("select concat('@', id, ' ', comment) as line from reads")
def header_only(spark, sf):
    return reads(spark, sf).select(F.concat(F.lit("@"), fn.header("id", "comment")).alias("line"))


@query("select read_idx, regexp_matches(sequence, '^[ACGTNacgtn]*$') as ok, case when regexp_matches(sequence, '^[ACGTNacgtn]*$') then -1 else length(regexp_extract(sequence, '^[ACGTNacgtn]*'))::int end as first_invalid from varied")
def validate_sequence(spark, sf):
    return varied(spark, sf).select("read_idx", fn.valid_sequence("sequence").alias("ok"), fn.first_invalid("sequence").alias("first_invalid"))


@query("select read_idx, regexp_matches(q, '^[!-~]*$') as ok from (select read_idx, case when read_idx % 9 = 0 then concat(quality, ' ') else quality end as q from varied)")
def validate_quality(spark, sf):
    return varied(spark, sf).withColumn("q", F.when(F.col("read_idx") % 9 == 0, F.concat("quality", F.lit(" "))).otherwise(F.col("quality"))).select("read_idx", fn.valid_quality("q").alias("ok"))


@query("select doc_id, length(text) > 0 and length(text) = n_chars as equal_lengths, regexp_matches(text, '^[ACGTNacgtn]*$') as is_sequence from documents")
def valid_reads(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", ((F.length("text") > 0) & (F.length("text") == F.col("n_chars"))).alias("equal_lengths"), F.col("text").rlike(r"\A[ACGTNacgtn]*\z").alias("is_sequence"))


@query("select read_idx, length(regexp_replace(sequence, '[ACGTNacgtn]', '', 'g'))::int as invalid from varied")
def invalid_base_count(spark, sf):
    return varied(spark, sf).select("read_idx", F.length(F.regexp_replace("sequence", "[ACGTNacgtn]", "")).alias("invalid"))


for _name, _text, _where in (("range_closed", "100:200", "read_idx between 99 and 199"), ("range_open_end", "500:", "read_idx >= 499"), ("range_open_start", ":50", "read_idx <= 49"), ("range_single", "7", "read_idx = 6"), ("range_all", "0", "true"), ("range_reversed", "10:5", "false")):
    query(f"select * from reads where {_where}", _name)(lambda spark, sf, t=_text: layout.in_range(reads(spark, sf), t))


@query(f"select * from (select cast(read_idx // {BLOCK} as int) as block_id, min(read_idx) as archive_id_start, count(*) as read_count, 64 as uniform_read_length from reads group by 1) where archive_id_start + read_count >= 1500 and archive_id_start <= 2499")
def range_blocks(spark, sf):
    return layout.touching(layout.block_index(reads(spark, sf), BLOCK), "1500:2500")


@query("select a.read_idx, a.id = b.id or (a.id[-2:] = '/1' and b.id[-2:] = '/2' and a.id[:-3] = b.id[:-3]) as ok from ids a join ids b on b.read_idx = a.read_idx + 1 where a.read_idx % 2 = 0".replace("ids a", "(select read_idx, concat('p', cast(read_idx // 2 as varchar), case when read_idx % 10 < 6 then concat('/', cast(read_idx % 2 + 1 as varchar)) else '' end) as id from reads) a").replace("ids b", "(select read_idx, concat('p', cast(read_idx // 2 as varchar), case when read_idx % 10 < 6 then concat('/', cast(read_idx % 2 + 1 as varchar)) else '' end) as id from reads) b"))
def pe_id_valid(spark, sf):
    suffix = F.when(F.col("read_idx") % 10 < 6, F.concat(F.lit("/"), (F.col("read_idx") % 2 + 1).cast("string"))).otherwise("")
    ids = reads(spark, sf).select("read_idx", F.concat(F.lit("p"), F.expr("read_idx div 2").cast("string"), suffix).alias("id"))
    mates = ids.where("read_idx % 2 = 1").select((F.col("read_idx") - 1).alias("read_idx"), F.col("id").alias("id2"))
    return ids.join(mates, "read_idx").select("read_idx", fn.pair_ids_match("id", "id2").alias("ok"))


# --- scalar functions

RC = "reverse(translate(regexp_replace({s}, '[^ACGTNacgtn]', 'N', 'g'), 'ACGTacgt', 'TGCAtgca'))"
CHARS = fn.QUALITIES.replace("'", "''")
BINS = "".join(chr(33 + fn.illumina(q)) for q in range(94)).replace("'", "''")
LEVELS = "".join(chr(33 + fn.nearest(q, schema.CODEBOOK)) for q in range(94)).replace("'", "''")


@query(f"select read_idx, {RC.format(s='sequence')} as rc from varied")
def revcomp(spark, sf):
    return varied(spark, sf).select("read_idx", fn.reverse_complement("sequence").alias("rc"))


@query("select read_idx, translate(sequence, 'ACGTN', '01234') as digits from varied")
def base_index(spark, sf):
    return varied(spark, sf).select("read_idx", fn.base_index("sequence").alias("digits"))


NOISE = {k: "case upper(a) " + " ".join(f"when '{b}' then '{r[:k]}'" for b, r in schema.NOISE.items()) for k in (3, 4)}


@query(f"select read_idx, code, substr(coalesce({NOISE[4]} end, '{schema.NOISE['N']}'), code::int + 1, 1) as back, strict from (select read_idx, a, case when {NOISE[3]} end is null then '0' when instr({NOISE[3]} end, upper(b)) > 0 then (instr({NOISE[3]} end, upper(b)) - 1)::varchar else '3' end as code, regexp_matches(b, '^[ACGTacgt]$') as strict from (select read_idx, sequence[1] as a, sequence[2] as b from varied))")
def noise_codes(spark, sf):
    rows = varied(spark, sf).select("read_idx", F.substring("sequence", 1, 1).alias("a"), F.substring("sequence", 2, 1).alias("b"))
    rows = rows.withColumn("code", fn.noise_encode(F.col("a"), F.col("b")))
    return rows.select("read_idx", "code", fn.noise_decode(F.col("a"), F.col("code")).alias("back"), fn.valid_base("b").alias("strict"))


@query("select read_idx, list_sum(list_transform(string_split(quality, ''), lambda c: ascii(c) - 33))::bigint as total, list_min(list_transform(string_split(quality, ''), lambda c: ascii(c) - 33))::int as least from varied")
def phred_values(spark, sf):
    v = fn.phred("quality")
    return varied(spark, sf).select("read_idx", F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.array_min(v).alias("least"))


@query(f"select read_idx, translate(quality, '{CHARS}', '{BINS}') as quality from varied")
def quality_illumina8(spark, sf):
    return varied(spark, sf).select("read_idx", fn.quantized("quality", "illumina8").alias("quality"))


@query(f"select read_idx, translate(quality, '{CHARS}', '{LEVELS}') as quality from varied")
def quality_qvz(spark, sf):
    return varied(spark, sf).select("read_idx", fn.quantized("quality", "qvz").alias("quality"))


@query("select read_idx, repeat('!', length(sequence)) as quality from varied")
def quality_discard(spark, sf):
    return varied(spark, sf).select("read_idx", fn.quantized("quality", "discard").alias("quality"))


@query("select least(pos * 8 // len, 7)::bigint as bin, count(*) as places, cast(sum(ascii(substr(quality, pos::int + 1, 1)) - 33) as bigint) as total from (select quality, length(quality) as len, unnest(generate_series(0, length(quality) - 1)) as pos from varied) group by 1")
def quality_position_bins(spark, sf):
    rows = varied(spark, sf).select(F.length("quality").alias("len"), F.posexplode(fn.phred("quality")).alias("pos", "q"))
    return rows.groupBy(fn.position_bin(F.col("pos"), F.col("len")).alias("bin")).agg(F.count("*").alias("places"), F.sum("q").alias("total"))


@query("""select a, b, c, count(*) as n from (select ascii(q) - 33 as a, coalesce(lag(ascii(q) - 33, 1) over w, 0) as b, coalesce(lag(ascii(q) - 33, 2) over w, 0) as c
from (select read_idx, pos, substr(quality, pos::int, 1) as q from (select read_idx, quality, unnest(generate_series(1, length(quality))) as pos from varied)) window w as (partition by read_idx order by pos)) group by all""")
def quality_contexts(spark, sf):
    rows = varied(spark, sf).select("read_idx", F.posexplode(fn.phred("quality")).alias("pos", "a"))
    w = Window.partitionBy("read_idx").orderBy("pos")
    return rows.select("a", F.lag("a", 1, 0).over(w).alias("b"), F.lag("a", 2, 0).over(w).alias("c")).groupBy("a", "b", "c").agg(F.count("*").alias("n"))


@query("""select a.read_idx, (list_sum(list_transform(generate_series(1, least(length(a.sequence), length(b.sequence))), lambda i: (a.sequence[i] <> b.sequence[i])::int)) + abs(length(a.sequence) - length(b.sequence)))::int as distance
from varied a join varied b on b.read_idx = a.read_idx + 1""")
def hamming_to_neighbor(spark, sf):
    rows = varied(spark, sf)
    ahead = rows.select((F.col("read_idx") - 1).alias("read_idx"), F.col("sequence").alias("other"))
    return rows.join(ahead, "read_idx").select("read_idx", fn.hamming(F.col("sequence"), F.col("other")).alias("distance"))


KMERS = "select read_idx, pos::int as pos, substr(sequence, pos::int + 1, 15) as kmer from (select read_idx, sequence, unnest(generate_series(0, length(sequence) - 15)) as pos from varied)"
NUMBER = "list_reduce(list_transform(string_split(translate({k}, 'ACGT', '{d}'), ''), lambda c: c::bigint), lambda a, b: a * 4 + b)"
MIN_SQL = f"""hashed as (select read_idx, pos, (case when regexp_matches(kmer, '^[ACGT]+$') then least({NUMBER.format(k='kmer_a', d='0123')}, {NUMBER.format(k='reverse(kmer_a)', d='3210')}) end)::bigint as hash
 from (select *, case when regexp_matches(kmer, '^[ACGT]+$') then kmer else 'A' end as kmer_a from ({KMERS}))),
win as (select read_idx, pos, n, m from (select read_idx, pos, count(*) over (partition by read_idx) as n,
 min(case when hash is not null then {{'hash': hash, 'pos': pos}} end) over (partition by read_idx order by pos rows between current row and 9 following) as m from hashed) where pos <= n - least(10, n)),
mins as (select read_idx, m['pos'] as pos, m['hash'] as hash from (select *, lag(m['pos']) over (partition by read_idx order by pos) as before from win) where m is not null and m['pos'] is distinct from before)
"""


@query(f"select * from ({KMERS})")
def kmers(spark, sf):
    return similarity.kmers(varied(spark, sf))


@query(", " + MIN_SQL + "select read_idx, pos, coalesce(hash, -1) as hash from hashed")
def kmer_canonical_hash(spark, sf):
    return similarity.kmers(varied(spark, sf)).select("read_idx", "pos", F.coalesce(fn.canonical_hash(F.col("kmer")), F.lit(-1)).alias("hash"))


@query(", " + MIN_SQL + "select * from mins")
def minimizers(spark, sf):
    return similarity.minimizers_arrow(varied(spark, sf))


@query(", " + MIN_SQL + "select * from mins")
def minimizers_native(spark, sf):
    return similarity.minimizers(varied(spark, sf))


@query(", " + MIN_SQL + "select hash, count(distinct read_idx) as reads, count(*) as places from mins group by hash")
def minimizer_buckets(spark, sf):
    rows = varied(spark, sf)
    return similarity.buckets(similarity.minimizers_arrow(rows), similarity.bucket_parts(rows))


@query(", " + MIN_SQL + """, u as (select distinct hash, read_idx from mins), r as (select *, row_number() over (partition by hash order by read_idx) as k from u)
select a.read_idx as a, b.read_idx as b, count(*) as shared from r a join r b on a.hash = b.hash and b.k > a.k and b.k <= a.k + 64 group by 1, 2""")
def minimizer_candidates(spark, sf):
    rows = varied(spark, sf)
    return similarity.candidates(similarity.minimizers_arrow(rows), parts=similarity.bucket_parts(rows))


@query("select read_idx, array_to_string(regexp_extract_all(id, '[:_/| \t]|[^:_/| \t]+'), '~') as tokens, array_to_string(list_transform(regexp_extract_all(id, '[:_/| \t]|[^:_/| \t]+'), lambda t: case when regexp_matches(t, '^[:_/| \t]$') then 'd' when regexp_matches(t, '^(0|[1-9][0-9]{0,17})$') then 'i' else 's' end), '') as kinds from reads")
def id_tokens(spark, sf):
    t = fn.id_tokens("id")
    return reads(spark, sf).select("read_idx", F.array_join(t, "~").alias("tokens"), F.array_join(F.transform(t, fn.token_kind), "").alias("kinds"))


_SHAPE = "array_to_string(list_transform(regexp_extract_all(id, '[:_/| \t]|[^:_/| \t]+'), lambda t: case when regexp_matches(t, '^[:_/| \t]$') then t else 'v' end), '')"
_IDS = "(select read_idx, case when read_idx % 40 = 5 then concat('odd_', id) else id end as id from reads)"


@query(f"select cast(a.read_idx // {BLOCK} as int) as block_id, avg(({_SHAPE.replace('(id', '(a.id')} = p.shape)::int) as ratio, avg(({_SHAPE.replace('(id', '(a.id')} = p.shape)::int) >= 0.95 as tokenizable from {_IDS} a join (select cast(read_idx // {BLOCK} as int) as block_id, arg_min({_SHAPE}, read_idx) as shape from {_IDS} group by 1) p on cast(a.read_idx // {BLOCK} as int) = p.block_id group by 1")
def id_pattern_match_ratio(spark, sf):
    odd = F.when(F.col("read_idx") % 40 == 5, F.concat(F.lit("odd_"), "id")).otherwise(F.col("id"))
    rows = layout.with_blocks(reads(spark, sf).select("read_idx", odd.alias("id")), BLOCK).withColumn("shape", fn.id_pattern("id"))
    first = rows.groupBy("block_id").agg(F.min_by("shape", "read_idx").alias("first"))
    return rows.join(first, "block_id").groupBy("block_id").agg(F.avg((F.col("shape") == F.col("first")).cast("int")).alias("ratio")).withColumn("tokenizable", F.col("ratio") >= 0.95)


@query(f"select read_idx, (v - coalesce(lag(v) over (partition by read_idx // {BLOCK} order by read_idx), 0))::bigint as delta from (select read_idx, split_part(id, ':', 5)::bigint as v from reads)")
def id_int_deltas(spark, sf):
    rows = layout.with_blocks(reads(spark, sf), BLOCK).select("read_idx", "block_id", F.split_part("id", F.lit(":"), F.lit(5)).cast("bigint").alias("v"))
    return rows.select("read_idx", (F.col("v") - F.lag("v", 1, 0).over(Window.partitionBy("block_id").orderBy("read_idx"))).alias("delta"))


@query("select read_idx, concat('read', cast(read_idx + 1 as varchar)) as id from reads")
def id_discard(spark, sf):
    return reads(spark, sf).select("read_idx", F.concat(F.lit("read"), (F.col("read_idx") + 1).cast("string")).alias("id"))


@query(f"select read_idx, (n - coalesce(lag(n) over (partition by read_idx // {BLOCK} order by read_idx), 0))::bigint as delta from (select read_idx, length(sequence) as n from varied)")
def length_deltas(spark, sf):
    rows = layout.with_blocks(varied(spark, sf), BLOCK)
    n = F.length("sequence").cast("bigint")
    return rows.select("read_idx", (n - F.lag(n, 1, 0).over(Window.partitionBy("block_id").orderBy("read_idx"))).alias("delta"))


@query("select read_idx, xor((v * 2)::bigint, (v >> 63)::bigint)::bigint as z, v as back from (select read_idx, (read_idx - 700)::bigint as v from reads)")
def zigzag(spark, sf):
    v = F.col("read_idx") - 700
    return reads(spark, sf).select("read_idx", fn.zigzag(v).alias("z"), fn.unzigzag(fn.zigzag(v)).alias("back"))


# --- blocks


@query(f"select read_idx, (read_idx // {BLOCK})::int as block_id, read_idx % {BLOCK} as pos_in_block from reads")
def block_assign(spark, sf):
    return layout.with_blocks(reads(spark, sf).select("read_idx"), BLOCK)


@query(f"select (read_idx // {BLOCK})::int as block_id, min(read_idx) as first_read, max(read_idx) + 1 as end_read from reads group by 1")
def block_boundaries(spark, sf):
    return layout.with_blocks(reads(spark, sf).select("read_idx"), BLOCK).groupBy("block_id").agg(F.min("read_idx").alias("first_read"), (F.max("read_idx") + 1).alias("end_read"))


@query(f"select block_id, read_count, (sum(read_count) over (order by block_id) - read_count)::bigint as archive_id_start from (select (read_idx // {BLOCK})::int as block_id, count(*) as read_count from reads group by 1)")
def block_index(spark, sf):
    return layout.starts(layout.with_blocks(reads(spark, sf).select("read_idx"), BLOCK).groupBy("block_id").agg(F.count("*").alias("read_count")))


@query("select (read_idx // 20)::int as block_id, min(read_idx) as archive_id_start, count(*) as read_count, case when min(n) = max(n) then min(n) else 0 end::int as uniform_read_length from (select read_idx, 32 + (read_idx // 30) % 33 as n from reads) group by 1")
def block_uniform_length(spark, sf):
    rows = reads(spark, sf).withColumn("sequence", F.substring("sequence", F.lit(1), F.expr("cast(32 + (read_idx div 30) % 33 as int)")))
    return layout.block_index(rows, 20)


@query(f"select read_idx, (read_idx // {BLOCK})::int as block_id, concat('corrupted_block', cast(read_idx // {BLOCK} as varchar), '_read', cast(read_idx % {BLOCK} as varchar)) as id from reads")
def corrupted_placeholders(spark, sf):
    rows = layout.block_index(reads(spark, sf), BLOCK).select("block_id", "archive_id_start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("read_count") - 1)).alias("i"))
    return rows.select((F.col("archive_id_start") + F.col("i")).alias("read_idx"), "block_id", F.concat(F.lit("corrupted_block"), F.col("block_id").cast("string"), F.lit("_read"), F.col("i").cast("string")).alias("id"))


# --- pairs


def mates(spark, sf):
    rows = reads(spark, sf)
    one, two = (rows.where(F.col("read_idx") % 2 == m).withColumn("read_idx", F.expr("read_idx div 2")) for m in (0, 1))
    return one, two


PAIRS = "(select a.read_idx // 2 as pair_idx, a.id as id_1, b.id as id_2, a.sequence as sequence_1, b.sequence as sequence_2 from reads a join reads b on b.read_idx = a.read_idx + 1 where a.read_idx % 2 = 0)"


@query(f"select pair_idx, id_1, id_2, sequence_1, sequence_2 from {PAIRS}")
def pe_zip(spark, sf):
    return layout.zip_mates(*mates(spark, sf)).select("pair_idx", "id_1", "id_2", "sequence_1", "sequence_2")


@query("select read_idx, (read_idx % 2 + 1)::int as mate, id, sequence from reads")
def pe_interleave(spark, sf):
    return layout.arrange(layout.zip_mates(*mates(spark, sf)), "interleaved").select("read_idx", "mate", "id", "sequence")


@query("select (read_idx // 2 + (read_idx % 2) * ((select count(*) from reads) // 2))::bigint as read_idx, (read_idx % 2 + 1)::int as mate, id from reads")
def pe_consecutive(spark, sf):
    return layout.arrange(layout.zip_mates(*mates(spark, sf)), "consecutive").select("read_idx", "mate", "id")


@query("select read_idx, id, sequence, quality from reads where read_idx % 2 = 0")
def pe_split_r1(spark, sf):
    return reads(spark, sf).where(layout.mate_of("interleaved", 0) == 1).select("read_idx", "id", "sequence", "quality")


@query("select read_idx, id from reads where read_idx >= (select count(*) from reads) // 2")
def pe_split_consecutive_r2(spark, sf):
    total = spark.read.parquet(f"{sf}/orders.parquet").count()
    return reads(spark, sf).where(layout.mate_of("consecutive", total) == 2).select("read_idx", "id")


# --- order


def order_map(spark, sf):
    rows = varied(spark, sf)
    return rows, layout.similarity_order(similarity.order_keys(rows))


ORDER = MIN_SQL + ", ord as (select v.read_idx as orig_idx, row_number() over (order by coalesce(h, -1), length(sequence), v.read_idx) - 1 as archive_idx from varied v left join (select read_idx, min(hash) as h from mins group by 1) m on v.read_idx = m.read_idx)"


@query(", " + ORDER + " select orig_idx, archive_idx::bigint as archive_idx from ord")
def reorder_map(spark, sf):
    return order_map(spark, sf)[1]


@query(", " + ORDER + " select archive_idx::bigint as archive_idx, id, sequence from varied join ord on read_idx = orig_idx")
def reorder_scalable(spark, sf):
    rows, order = order_map(spark, sf)
    return layout.reorder(rows, order).select("archive_idx", "id", "sequence")


@query("select read_idx, id, comment, sequence, quality from varied")
def original_order(spark, sf):
    rows, order = order_map(spark, sf)
    moved = layout.reorder(rows, order).drop("read_idx")
    return moved.join(order, "archive_idx").select(F.col("orig_idx").alias("read_idx"), "id", "comment", "sequence", "quality")


@query(", " + ORDER + " select archive_idx::bigint as archive_idx, orig_idx from ord where archive_idx between 100 and 119")
def lookup_original(spark, sf):
    return order_map(spark, sf)[1].where("archive_idx between 100 and 119").select("archive_idx", "orig_idx")


@query(", " + ORDER + " select archive_idx::bigint as archive_idx, (orig_idx - coalesce(lag(orig_idx) over (partition by archive_idx // 1000 order by archive_idx), 0))::bigint as delta from ord")
def reorder_map_delta(spark, sf):
    w = Window.partitionBy(F.floor(F.col("archive_idx") / 1000)).orderBy("archive_idx")
    return order_map(spark, sf)[1].select("archive_idx", (F.col("orig_idx") - F.lag("orig_idx", 1, 0).over(w)).alias("delta"))


@query("""select key, pos::int as pos, arg_max(base, {'v': votes, 'b': base}) as base, max(votes) as votes from (select key, pos, base, count(*) as votes from
(select read_idx % 97 as key, pos - 1 as pos, substr(sequence, pos::int, 1) as base from (select read_idx, sequence, unnest(generate_series(1, length(sequence))) as pos from varied)) where base in ('A', 'C', 'G', 'T') group by all) group by 1, 2""")
def consensus_vote(spark, sf):
    return similarity.consensus_vote(varied(spark, sf), F.col("read_idx") % 97)


def greedy_path(spark, sf):
    """The nearest-neighbour path through each thousand reads; one step needs the one before, so it has no SQL."""
    return similarity.greedy_order(varied(spark, sf), F.floor(F.col("read_idx") / BLOCK))


query(None, "greedy_path")(greedy_path)


@query("select (read_idx // 200)::int as block_id, count(*) as members, true as whole, true as near from reads group by 1")
def consensus_groups(spark, sf):
    """Consensus groups of each 200 reads: all are members of one, within the limit of its consensus over the first one's span."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("read_idx")
        texts = t.column("sequence").to_pylist()
        groups = similarity.contigs(texts)
        near = all(d["read_len"] == len(texts[d["orig_order"]]) for g in groups for d in g["deltas"])
        return pa.table({"block_id": t.column("block_id")[:1], "members": pa.array([sum(len(g["deltas"]) for g in groups)], pa.int64()), "whole": [similarity.from_contigs(groups) == texts], "near": [near]})

    rows = reads(spark, sf).select("read_idx", F.expr("cast(read_idx div 200 as int)").alias("block_id"), "sequence")
    return rows.groupBy("block_id").applyInArrow(run, "block_id int, members bigint, whole boolean, near boolean")


# --- round trips: what comes back is what went in

IDENTITY = "select read_idx, id, comment, sequence, quality from {v}"


@query(IDENTITY.format(v="varied"))
def roundtrip_exact(spark, sf):
    return store.decode_blocks(store.encode_blocks(varied(spark, sf), BLOCK, "short", id_mode="exact"))


@query(IDENTITY.format(v="reads"))
def roundtrip_tokenize(spark, sf):
    return store.decode_blocks(store.encode_blocks(reads(spark, sf), BLOCK, "long", id_mode="tokenize"))


@query(IDENTITY.format(v="reads"))
def roundtrip_consensus(spark, sf):
    return store.decode_blocks(store.encode_blocks(reads(spark, sf), 250, "short"))


@query(IDENTITY.format(v="varied"))
def roundtrip_quality_context(spark, sf):
    return store.decode_blocks(store.encode_blocks(varied(spark, sf), 50, "short", quality_codec="context"))


@query(f"select read_idx, id, comment, sequence, translate(quality, '{CHARS}', '{BINS}') as quality from varied")
def roundtrip_illumina8(spark, sf):
    return store.decode_blocks(store.encode_blocks(varied(spark, sf), BLOCK, "medium", quality_mode="illumina8"))


@query("select read_idx, concat('read', cast(read_idx + 1 as varchar)) as id, '' as comment, sequence, repeat('!', length(sequence)) as quality from varied")
def roundtrip_discard(spark, sf):
    return store.decode_blocks(store.encode_blocks(varied(spark, sf), BLOCK, "medium", id_mode="discard", quality_mode="discard"))


@query("select read_idx, length(sequence)::bigint as length from varied")
def roundtrip_aux(spark, sf):
    blocks = store.encode_blocks(varied(spark, sf), BLOCK, "medium").select("archive_id_start", "read_count", "uniform_read_length", "aux_data")
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                sizes = codecs.decode_lengths(r["uniform_read_length"], r["aux_data"], r["read_count"])
                yield pa.RecordBatch.from_arrays([pa.array(range(r["archive_id_start"], r["archive_id_start"] + len(sizes)), pa.int64()), pa.array(sizes, pa.int64())], names=["read_idx", "length"])

    return blocks.mapInArrow(run, "read_idx bigint, length bigint")


# --- archive


@query(f"select (read_idx // {BLOCK})::int as block_id, true as ok, cast(null as varchar) as error, count(*) as reads from varied group by 1")
def verify_blocks(spark, sf):
    return store.verify(store.encode_blocks(varied(spark, sf), BLOCK, "medium", quality_mode="qvz"))


@query(f"select read_idx, case when read_idx // {BLOCK} = 1 then concat('corrupted_block1_read', cast(read_idx % {BLOCK} as varchar)) else id end as id from reads")
def skip_corrupted(spark, sf):
    blocks = store.encode_blocks(reads(spark, sf), BLOCK, "long")
    broken = blocks.withColumn("seq_data", F.when(F.col("block_id") == 1, F.lit(b"broken")).otherwise(F.col("seq_data")))
    return store.decode_blocks(broken, skip_corrupted=True).select("read_idx", "id")


def written(spark, sf, **settings) -> str:
    path = shared.folder(spark, "archive")
    store.write_archive(varied(spark, sf), path, requested_block=BLOCK, **settings)
    return path


@query(f"select count(*) as total_reads, (count(*) + {BLOCK - 1}) // {BLOCK} as num_blocks, false as is_paired, true as preserve_order, 'illumina8' as quality_mode, 'tokenize' as id_mode, false as has_reorder_map, 'interleaved' as pe_layout, 'short' as read_length_class, false as streaming_mode from varied")
def archive_info(spark, sf):
    """What the flags of a written archive say."""
    return store.info_from_flags(store.info(spark, written(spark, sf, quality_mode="illumina8")))


@query(f"select (read_idx // {BLOCK})::int as block_id, min(read_idx) as archive_id_start, count(*)::int as read_count, 0 as uniform_read_length, 'id_tokens' as ids, 'zstd' as seq, 'zstd' as qual, 'delta_varint' as aux from varied group by 1")
def block_codecs(spark, sf):
    """Index and codecs of a written archive, without its streams."""
    names = F.create_map(*(F.lit(x) for k, v in codecs.FAMILIES.items() for x in (v, k)))
    rows = store.headers(spark.read.schema(schema.BLOCK).parquet(f"{written(spark, sf, id_mode='tokenize')}/blocks"))
    return rows.select("block_id", "archive_id_start", "read_count", "uniform_read_length", *(names[F.shiftright(F.col(f"codec_{c}").cast("int"), 4)].alias(c) for c in ("ids", "seq", "qual", "aux")))


@query(f"select (count(*) + {BLOCK - 1}) // {BLOCK} as checked, (count(*) + {BLOCK - 1}) // {BLOCK} - 1 as ok, 1::bigint as failed, count(*) - least({BLOCK}, count(*) - {BLOCK}) as reads from varied")
def verify_totals(spark, sf):
    blocks = store.encode_blocks(varied(spark, sf), BLOCK, "medium")
    return store.verify_totals(store.verify(blocks.withColumn("seq_data", F.when(F.col("block_id") == 1, F.lit(b"broken")).otherwise(F.col("seq_data")))))


@query(f"select (read_idx // {BLOCK})::int as block_id, m as error from reads, (values ('the codec of ids contradicts the mode tokenize'), ('the codec of qual contradicts the mode none')) t(m) group by all")
def codec_contradictions(spark, sf):
    blocks = store.encode_blocks(reads(spark, sf), BLOCK, "long", id_mode="discard", quality_mode="discard")
    return store.contradictions(blocks, "none", "tokenize")


@query(f"select (read_idx // {BLOCK})::int as block_id, case when min(read_idx) = 0 then 'not in the index' else 'another first read' end as error from reads group by 1")
def index_mismatches(spark, sf):
    blocks = store.encode_blocks(reads(spark, sf), BLOCK, "long")
    index = blocks.select("block_id", (F.col("archive_id_start") + 1).alias("archive_id_start"), "read_count").where("block_id > 0")
    return store.index_mismatches(index, blocks)


@query("select count(*) as reads, sum(length(sequence))::bigint as bases, sum(length(id) + length(comment) + 2 * length(sequence) + 7)::bigint as raw_bytes, true as smaller, true as consistent from varied")
def archive_stats(spark, sf):
    blocks = spark.read.schema(schema.BLOCK).parquet(f"{written(spark, sf)}/blocks")
    stats = store.archive_stats(blocks, store.decode_blocks(blocks))
    bits = F.abs(F.col("bits_per_base") * F.col("bases") - 8 * F.col("compressed_bytes")) < 1
    return stats.select("reads", "bases", "raw_bytes", (F.col("ratio") > 1).alias("smaller"), (bits & (F.col("largest_block") <= F.col("compressed_bytes"))).alias("consistent"))


@query("select block, sum(own) over (order by block)::bigint as peak_bytes from (select (read_idx // 10000)::bigint as block, 2 * sum(length(id) + length(comment) + length(sequence) + length(quality) + 128) as own from varied group by 1)")
def running_estimate(spark, sf):
    return store.running_estimate(varied(spark, sf))


@query(IDENTITY.format(v="varied"))
def container_roundtrip(spark, sf):
    """The archive as a single file and back."""
    path = shared.folder(spark, "container")
    blocks = spark.read.schema(schema.BLOCK).parquet(f"{written(spark, sf)}/blocks")
    file = f"{path.removeprefix('file://')}.bin"
    container.export(blocks, file, 2)
    return store.decode_blocks(container.load_blocks(spark, file))


@query("select read_idx, flags, (flags & 1)::bigint as paired, ((flags >> 3) & 3)::bigint as quality_mode, ((flags >> 5) & 3)::bigint as id_mode, ((flags >> 8) & 3)::bigint as layout, ((flags >> 10) & 3)::bigint as length_class, ((flags >> 12) & 1)::bigint as streaming from (select read_idx, ((read_idx % 2) + ((read_idx % 4) << 3) + ((read_idx % 3) << 5) + ((read_idx % 2) << 8) + ((read_idx % 3) << 10) + ((read_idx % 2) << 12) + 2)::bigint as flags from reads)")
def flags_decode(spark, sf):
    i = F.col("read_idx")
    rows = reads(spark, sf).select("read_idx", fn.flags(i % 2, 1, i % 4, i % 3, 0, i % 2, i % 3, i % 2).alias("flags"))
    return rows.select("read_idx", "flags", *(fn.flag(F.col("flags"), low, width).alias(n) for n, low, width in (("paired", 0, 1), ("quality_mode", 3, 2), ("id_mode", 5, 2), ("layout", 8, 2), ("length_class", 10, 2), ("streaming", 12, 1))))


@query(f"select (read_idx // {BLOCK})::int as block_id, 'gap, overlap or empty block' as error from reads where read_idx // {BLOCK} > 1 group by 1 union all select -1, 'read counts do not add up'")
def structure_check(spark, sf):
    """An archive whose second block has lost ten reads: all blocks after it start too late, and the sum is wrong."""
    blocks = store.encode_blocks(reads(spark, sf), BLOCK, "long")
    short = blocks.withColumn("read_count", F.when(F.col("block_id") == 1, F.col("read_count") - 10).otherwise(F.col("read_count")))
    return store.structure_errors(short, spark.read.parquet(f"{sf}/orders.parquet").count())


@query(IDENTITY.format(v="varied"))
def fastq_files(spark, sf):
    path = shared.folder(spark, "fastq")
    fastq.write_fastq(varied(spark, sf), path)
    return fastq.read_text_fastq(spark, path)


@query(IDENTITY.format(v="varied"))
def fastq_many_files(spark, sf):
    """Twelve files of two folders, the first ones small."""
    path = shared.folder(spark, "fastq")
    fastq.write_fastq(varied(spark, sf).where("read_idx < 300"), f"{path}/0", files=5)
    fastq.write_fastq(varied(spark, sf).where("read_idx >= 300"), f"{path}/1", files=7)
    return fastq.read_text_fastq(spark, [f"{path}/0", f"{path}/1"])


@query(IDENTITY.format(v="varied"))
def fastq_many_splits(spark, sf):
    """Three files cut every 50,000 bytes, wherever that is in a record."""
    path = shared.folder(spark, "fastq")
    fastq.write_fastq(varied(spark, sf), path, files=3)
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    return fastq.read_text_fastq(session, path)


@query(IDENTITY.format(v="varied"))
def stream_files(spark, sf):
    """Several files as a stream of slices, in blocks, and back."""
    path = shared.folder(spark, "fastq")
    fastq.write_fastq(varied(spark, sf), path, files=3)
    work = shared.folder(spark, "stream")
    ingest.append_blocks(ingest.read_stream(spark, path, BLOCK), f"{work}/blocks", f"{work}/progress", BLOCK, kind="long", once=True).awaitTermination()
    return store.decode_blocks(ingest.finish(spark, f"{work}/blocks"))


def pair_files(spark, sf) -> tuple[str, str]:
    paths = []
    for m in (0, 1):
        path = shared.folder(spark, f"mate{m}")
        fastq.write_fastq(reads(spark, sf).where(F.col("read_idx") % 2 == m), path, files=1)
        paths.append(fastq.local_files(path)[0])
    return tuple(paths)


@query("select read_idx, id, comment, sequence, quality from reads")
def stream_pairs(spark, sf):
    """Two files as a stream of pairs, interleaved."""
    work = shared.folder(spark, "stream")
    ingest.append_blocks(ingest.read_pair_stream(spark, *pair_files(spark, sf), BLOCK), f"{work}/blocks", f"{work}/progress", 2 * BLOCK, once=True, pe_layout="interleaved", kind="long").awaitTermination()
    return store.decode_blocks(ingest.finish(spark, f"{work}/blocks"))


@query("select read_idx // 2 as pair_idx, id, sequence from reads where read_idx % 2 = 1")
def stream_consecutive_r2(spark, sf):
    """An interleaved file as a stream, first mates before second ones in each block; its second mates."""
    path, work = shared.folder(spark, "fastq"), shared.folder(spark, "stream")
    fastq.write_fastq(reads(spark, sf), path, files=2)
    ingest.append_blocks(ingest.read_stream(spark, path, 2 * BLOCK), f"{work}/blocks", f"{work}/progress", 2 * BLOCK, once=True, pe_layout="consecutive", kind="long").awaitTermination()
    ingest.finish_archive(spark, f"{work}/blocks", f"{work}/archive", True, "consecutive", "long")
    two = store.split_mates(spark, f"{work}/archive")[1]
    return two.select(F.floor(F.split_part("id", F.lit(":"), F.lit(6)).cast("bigint") / 2).alias("pair_idx"), "id", "sequence")


@query(f"select (2 * (p // 500) * 500 + p % 500 + m * least(500, n - (p // 500) * 500))::bigint as read_idx, (p // 500)::int as block_id, (m + 1)::int as mate, id from (select read_idx // 2 as p, read_idx % 2 as m, id, (select count(*) // 2 from reads) as n from reads)")
def pe_blocked_consecutive(spark, sf):
    return layout.blocked_consecutive(layout.zip_mates(*mates(spark, sf)), BLOCK).select("read_idx", "block_id", "mate", "id")


@query(IDENTITY.format(v="varied") + " where read_idx between 499 and 1199")
def archive_range(spark, sf):
    path = shared.folder(spark, "archive")
    store.write_archive(varied(spark, sf), path, requested_block=BLOCK)
    return store.read_archive(spark, path, "500:1200")


@query(IDENTITY.format(v="varied"))
def archive_original_order(spark, sf):
    path = shared.folder(spark, "archive")
    rows, order = order_map(spark, sf)
    store.write_archive(rows, path, requested_block=2 * schema.CONSENSUS_READS, reorder_map=order)
    return store.read_archive(spark, path, original_order=True)


@query(IDENTITY.format(v="reads"))
def stream_ingest(spark, sf):
    path = shared.folder(spark, "stream")
    table = spark.read.parquet(f"{sf}/orders.parquet")
    source = spark.readStream.schema(table.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/orders*")
    ingest.append_blocks(as_reads(source), f"{path}/blocks", f"{path}/progress", BLOCK, kind="long", once=True).awaitTermination()
    return store.decode_blocks(ingest.finish(spark, f"{path}/blocks"))
