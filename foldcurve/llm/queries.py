"""The registered queries of this subpackage, with SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcurve.llm import clusters, dialogue, jaccard, language, mixing, pieces, quality, secrets, suffixes, tokenfiles, topk, toxicity, warc
from foldcurve.llm.common import crc_mod

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Base 32: 160 bits are 8 groups of 5 hexadecimal digits, each 4 letters of 5 bits.
WARC_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages
), d as (
  select page_id, octet_length(encode(html)) as payload_bytes, hex,
    list_aggregate(list_transform(range(32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::bigint) >> (15 - 5 * (i % 4))) & 31)::int, 1)), 'string_agg', '') as payload_digest
  from p
), m as (select hex, max(page_id) as top from d group by hex)
select page_id, payload_bytes, payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id = top then null else top end as refers_to
from d join m using (hex)
"""


@query("op1_warc", WARC_SQL)
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    part = crc_mod("doc_id", 4)
    model = toxicity.fit(toxicity.labelled(docs.where(part != 2), table(spark, folder, "labels")))
    return toxicity.tag(docs, model).select("doc_id", (part == 2).alias("held_out"), "score", "predicted", F.size("spans").cast("long").alias("n_toxic_tokens"))


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_documents(table(spark, folder, "documents"))


SUFFIX_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as (select doc_id, s, substr(x, 2 * s + 1, 100) as g from (select doc_id, x, unnest(range(len(x) // 2 - 49)) as s from d where len(x) >= 100)),
f as (select g, min(doc_id) as first from w group by g),
hit as (select doc_id, s, s + 50 as e from w join f using (g) where first < doc_id),
runs as (select *, case when s <= max(e) over (partition by doc_id order by s rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from hit),
numbered as (select *, sum(new) over (partition by doc_id order by s) as k from runs),
spans as (select doc_id, k, min(s) as s, max(e) as e from numbered group by doc_id, k),
gaps as (select doc_id, e as a, lead(s) over (partition by doc_id order by s) as b from spans
  union all select doc_id, 0, min(s) from spans group by doc_id),
kept as (select doc_id, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, len(x) // 2) - a)), '' order by a) as x from gaps join d using (doc_id) group by doc_id),
n as (select doc_id, sum(e - s)::bigint as n_removed, count(*) as n_spans from spans group by doc_id)
select doc_id, len(d.x) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(kept.x, d.x))) as kept_sha256
from d left join kept using (doc_id) left join n using (doc_id)
"""


@query("op4_suffix_dedup", SUFFIX_SQL)
def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.dedup(table(spark, folder, "documents"))


def quality_sql() -> str:
    stops = ", ".join("'" + w + "'" for w in quality.STOP_FORMS)
    tests = [f"{r.measure} >= {r.low}" for r in quality.RULES if r.low is not None] + [f"{r.measure} <= {r.high}" for r in quality.RULES if r.high is not None]
    return rf"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select doc_id, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
t as (select doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] as g from (select doc_id, w, unnest(range(len(w) - 2)) as i from d where len(w) > 2)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from t) where n > 1),
c as (select doc_id, count(distinct i + j) as n_repeat_words from r, (select unnest(range(3)) as j) group by doc_id),
m as (select doc_id, len(w) as n_words, len(array_to_string(w, '')) as word_chars,
  len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  len(list_filter(w, lambda x: x in ({stops}))) as n_stop_words
  from d left join l using (doc_id) left join c using (doc_id)),
q as (select *, word_chars::double / greatest(n_words, 1) as mean_word_length, n_symbols::double / greatest(word_chars, 1) as symbol_ratio,
  n_dup_lines::double / greatest(n_lines, 1) as dup_line_ratio, n_repeat_words::double / greatest(n_words, 1) as repeat_ratio,
  n_stop_words::double / greatest(n_words, 1) as stop_word_ratio, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {" and ".join(tests)} as kept from q
"""


@query("op5_quality_rules", quality_sql())
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.judge(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


TOPK_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id,
  list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""


@query("op6_exact_topk", TOPK_SQL)
def op6_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(topk.scaled(table(spark, folder, "embeddings")), F.col("vec_id") % 50 == 0)


@query("op7_language_id")
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    part = crc_mod("doc_id", 5)
    learned = language.prototypes(docs.where(part != 0))
    return language.identify(docs, learned).select("doc_id", (part == 0).alias("held_out"), "lang_pred", "score")


@query("op8_mixing")
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


JACCARD_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i + 1 : i + 5], ' ') as g from (select doc_id, w, unnest(range(greatest(len(w) - 4, 1))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (g) where a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
reach as (select distinct a as doc_id, a as c from e union select e.b, reach.c from reach join e on reach.doc_id = e.a),
m as (select doc_id, min(c) as c from reach group by doc_id)
select w.doc_id, coalesce(n, 0) as n_shingles, coalesce(m.c, w.doc_id) as component_id
from w left join n using (doc_id) left join m using (doc_id)
"""


@query("op9_jaccard_join", JACCARD_SQL)
def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(table(spark, folder, "documents"))


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(table(spark, folder, "documents"))


def centroid_sql(rounds: int = clusters.ROUNDS) -> str:
    """A step for each round: distances of all rows to all centroids, the nearest, and the floors of the means."""
    steps = []
    for r in range(rounds + 1):
        old = f"c{r}"
        steps += [
            f"d{r} as materialized (select n, c, sum((x - y) * (x - y)) as d from u join {old} using (i) group by n, c)",
            f"a{r} as materialized (select n, c, d from (select *, row_number() over (partition by n order by d, c) as k from d{r}) where k = 1)",
            f"m{r} as (select c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as y from u join a{r} using (n) group by c, i)",
            f"c{r + 1} as materialized (select c, i, coalesce(m{r}.y, {old}.y) as y from {old} left join m{r} using (c, i))",
        ]
    return f"""
with v as (select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor({clusters.SCALE} * x::double)::hugeint) as v from embeddings
  where len(embedding) = {clusters.DIM} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
u as materialized (select n, unnest(v) as x, unnest(range({clusters.DIM})) as i from v),
s as (select n, row_number() over (order by sha256('3:' || vec_id)) - 1 as c from v),
c0 as materialized (select c, i, x as y from s join u using (n) where c < {clusters.K}),
{", ".join(steps)},
h as (select c, sha256(string_agg(y::varchar, ',' order by i)) as centroid_sha256 from c{rounds} group by c)
select vec_id, c::int as cluster, d::bigint as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, centroid_sha256
from a{rounds} join v using (n) join h using (c)
"""


@query("op11_centroids", centroid_sql())
def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.digest(clusters.fit(clusters.scaled(table(spark, folder, "embeddings"))))


def repair_sql() -> str:
    """Rows in order, then the best edits to each state, row by row. Up to two inserts go ahead of a row."""
    arcs = []
    for q in range(4):
        state, inserts, cost = q, "", 0
        for _ in range(3):
            for symbol in dialogue.ARCS:
                arcs += [f"({q}, '{symbol}', '{inserts}', {cost}, '{letter}', {c}, {behind})" for c, ahead, behind, letter in dialogue.ARCS[symbol][state] if ahead]
            state, inserts, cost = dialogue.NEXT[state], inserts + "I", cost + dialogue.INSERT
    names = "case {0} when 2 then 'user' when 3 then 'assistant' end"
    first, second = (names.format(f"case when {q} in (0, 1, 3) then 2 else 3 end") for q in ("q", "(case when q in (0, 1, 3) then 2 else 3 end)"))
    return rf"""
with recursive arcs(q, symbol, inserts, paid, letter, c, q2) as (values {", ".join(arcs)}),
b as (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, xor(4294967295, list_reduce(list_transform(range(len(name)), lambda p: ascii(substr(name, p::int + 1, 1))::bigint),
    lambda c, x: list_reduce(range(8), lambda y, z: xor(y >> 1, (y & 1) * 3988292384), xor(c, x)), 4294967295::bigint)) % 20 as kind from b),
d as (select conv_id, turn, case kind when 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case kind when 3 then 2 else 1 end)) as copy from k where kind <> 0),
o as (select *, row_number() over w as i, lag(left(role, 1)) over w as before,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth from d window w as (partition by conv_id order by turn nulls first, role, text, copy)),
f as (select *, case when not regexp_matches(text, '[^ 	-
]') then 'blank' when nth > 1 then 'duplicate' when not regexp_matches(text, '[.!?][ 	-
]*\z') then 'truncated' else '' end as fault,
    case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else 'x' end as initial from o),
g as (select *, case when fault in ('blank', 'duplicate') then '-' when fault = 'truncated' then upper(initial) else initial end as symbol from f),
best as (
  select conv_id, 0::bigint as i, 0 as q, 0::bigint as cost, '' as audit, [''][:0] as repaired from (select distinct conv_id from g)
  union all
  select conv_id, i, q2, best.cost, best.audit, best.repaired from (
    select b.conv_id, g.i, a.q2, min({{cost: b.cost + a.paid + a.c, audit: b.audit || a.inserts || a.letter, repaired: b.repaired
      || case when a.inserts = '' then [] when a.inserts = 'I' then [{first.replace("q ", "b.q ")} || ':'] else [{first.replace("q ", "b.q ")} || ':', {second.replace("q ", "b.q ")} || ':'] end
      || case a.letter when 'D' then [] when 'K' then [g.role || ':' || g.text] else [{names.format("a.q2")} || ':' || g.text] end}}) as best
    from best b join g on b.conv_id is not distinct from g.conv_id and g.i = b.i + 1 join arcs a on a.q = b.q and a.symbol = g.symbol
    group by b.conv_id, g.i, a.q2)
),
ended as (select conv_id, i, min({{cost: cost + case q when 1 then 10 when 2 then 5 else 0 end, audit: audit || case q when 1 then 'II' when 2 then 'I' else '' end,
    repaired: repaired || case q when 1 then ['user:', 'assistant:'] when 2 then ['assistant:'] else [] end}}) as best from best group by conv_id, i),
n as (select conv_id, max(i) as i, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (before || left(role, 1) not in ('su', 'ua', 'au')) as illegal from f group by conv_id)
select p.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(e.best.cost, 0)::bigint as cost, coalesce(e.best.audit, '') as audit, sha256(coalesce(array_to_string(e.best.repaired, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) p left join n on p.conv_id is not distinct from n.conv_id
left join ended e on p.conv_id is not distinct from e.conv_id and e.i = n.i
"""


@query("op12_dialogue_repair", repair_sql())
def op12_dialogue_repair(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.digest(table(spark, folder, "conversations"))


@query("op13_token_files")
def op13_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return tokenfiles.round_trip(table(spark, folder, "documents"), tokenfiles.default_tokenizer())
