"""The operators' registered queries: each over its whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom_lm, centroids, chat, decontaminate, exact_dedup, html_text, langid, line_dedup, near_vectors, packing, simhash, tokencount, vector_codes
from .common import Maker, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.lm_scores(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.language_id(docs).select("doc_id", "held_out", "lang_pred", "score")


#: The conversation added to the table's own.
EXTRA_CHAT = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA_CHAT, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(turns.union(extra)))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))
    return found.withColumn("codebooks_sha256", F.lit(vector_codes.digest(books)))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))[0]


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OPERATORS = (op1_token_counts, op2_html_extraction, op3_line_dedup, op4_near_vectors, op5_decontamination, op6_lm_scores, op7_packing, op8_language_id, op9_chat_formatting, op10_simhash, op11_vector_codes, op12_centroids, op13_exact_dedup)


def queries() -> dict[str, Maker]:
    return {f.__name__: f for f in OPERATORS}


_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
with lines as (
  select doc_id, generate_subscripts(parts, 1) as pos, unnest(parts) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents)),
keyed as (select *, {_AZ.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from lines),
owners as (select key, min(doc_id) as owner from keyed where length(key) >= 10 group by key having count(distinct doc_id) > 1),
marked as (select k.*, o.owner is not null and o.owner <> k.doc_id as gone from keyed k left join owners o on k.key = o.key)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id"""

OP5_SQL = f"""
with dw as (select doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from documents),
bw as (select item_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from benchmark),
bwin as (select distinct item_id, w[i:i + 12] as win from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) as i from bw where len(w) > 0)),
sizes as (select distinct len(win) as k from bwin),
dwin as (select doc_id, i, k, w[i:i + k - 1] as win from (
  select doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from dw, sizes where len(w) >= k)),
hits as (select d.doc_id, d.i, d.k, b.item_id from dwin d join bwin b on d.win = b.win),
n_hit as (select doc_id, count(distinct p) as n from (select doc_id, unnest(generate_series(i, i + k - 1)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from hits where item_id is not null) group by doc_id)
select dw.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(h.n, 0) as bigint) as n_hit, cast(coalesce(i.n, 0) as bigint) as n_items,
  sha256(coalesce(i.ids, '')) as items_sha256, coalesce(h.n, 0) > 0 and 20 * coalesce(h.n, 0) >= len(w) as contaminated
from dw left join n_hit h on dw.doc_id = h.doc_id left join items i on dw.doc_id = i.doc_id"""


_ESCAPED = "replace(replace({}, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')"

OP9_SQL = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, n, r, chr(92) || '### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(n, r))
select conv_id, cast(count(*) as bigint) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + 23) as bigint) as formatted_chars
from t group by conv_id"""

OP4_SQL = """
with unit as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as x from embeddings
  where label is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (
  select a.vec_id as a, b.vec_id as b from unit a join unit b
  on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x) and list_cosine_similarity(a.x, b.x) >= 0.98),
reach as (
  with recursive r(a, b) as (select vec_id, vec_id from embeddings union select r.a, link.b from r join link on r.b = link.a) select * from r)
select e.vec_id, cast(coalesce(l.n, 0) as bigint) as n_links, m.c as component_id, e.vec_id = m.c as kept
from embeddings e left join (select a, count(*) as n from link group by a) l on e.vec_id = l.a
join (select a, min(b) as c from reach group by a) m on e.vec_id = m.a"""


_FINITE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"


def _op11_sql(rounds: int = 6) -> str:
    """Every part against every entry, round by round; entries without members stay."""
    assigned = """
a{i} as materialized (
  select vec_id, label, part, x, arg_min(e, struct_pack(d, e)) as e, min(d) as d
  from (select p.*, b.e, list_sum(list_transform(generate_series(1, 8), lambda j: (p.x[j] - b.c[j]) * (p.x[j] - b.c[j]))) as d from parts p join b{i} b using (part))
  group by all)"""
    updated = """
b{n} as materialized (
  select b.part, b.e, coalesce(m.c, b.c) as c
  from b{i} b left join (
    select part, e, list(c order by j) as c from (
      select part, e, j, cast(floor(sum(x[j]) / count(*)) as bigint) as c from a{i}, generate_series(1, 8) s(j) group by part, e, j) group by part, e) m
  on b.part = m.part and b.e = m.e)"""
    steps = ",".join(assigned.format(i=i) + "," + updated.format(i=i, n=i + 1) for i in range(rounds)) + "," + assigned.format(i=rounds)
    return f"""
with ints as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as v from embeddings where {_FINITE}),
parts as materialized (select vec_id, label, part, v[8 * part + 1:8 * part + 8] as x from ints, generate_series(0, 7) s(part)),
b0 as materialized (
  select part, e, v[8 * part + 1:8 * part + 8] as c
  from (select v, row_number() over (order by vec_id) - 1 as e from ints) f, generate_series(0, 7) s(part) where e < 16),
{steps},
total as materialized (select vec_id, any_value(label) as label, string_agg(printf('%02x', e), '' order by part) as code, cast(sum(d) as bigint) as error from a{rounds} group by vec_id),
book as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, e)) as h from b{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256 from total, book"""


def _op12_sql(rounds: int = 5) -> str:
    """Every vector against every centroid, round by round; centroids without members stay."""
    assigned = """
a{i} as materialized (
  select vec_id, v, arg_min(k, struct_pack(d, k)) as k, min(d) as d
  from (select p.*, b.k, list_sum(list_transform(generate_series(1, 64), lambda j: (p.v[j] - b.c[j]) * (p.v[j] - b.c[j]))) as d from ints p, b{i} b)
  group by all)"""
    updated = """
b{n} as materialized (
  select b.k, coalesce(m.c, b.c) as c
  from b{i} b left join (
    select k, list(c order by j) as c from (
      select k, j, cast(floor(sum(v[j]) / count(*)) as bigint) as c from a{i}, generate_series(1, 64) s(j) group by k, j) group by k) m on b.k = m.k)"""
    steps = ",".join(assigned.format(i=i) + "," + updated.format(i=i, n=i + 1) for i in range(rounds)) + "," + assigned.format(i=rounds)
    return f"""
with ints as materialized (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings where {_FINITE} and len(embedding) = 64),
b0 as materialized (select k, v as c from (select v, row_number() over (order by sha256('2:' || cast(vec_id as varchar))) - 1 as k from ints) where k < 40),
{steps}
select vec_id, cast(a.k as integer) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by a.k) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} a join b{rounds} b on a.k = b.k"""


OP13_SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from n"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": OP3_SQL, "op4_near_vectors": OP4_SQL, "op5_decontamination": OP5_SQL, "op9_chat_formatting": OP9_SQL,
        "op11_vector_codes": _op11_sql(), "op12_centroids": _op12_sql(), "op13_exact_dedup": OP13_SQL,
    }
