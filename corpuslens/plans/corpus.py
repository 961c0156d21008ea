"""Transcripts, search, facets, differences, exports and the journal over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diff, exports, search, transcripts
from ..sources.shared import shared_dir
from ..streaming import journal
from .base import Registry, Tables

R = Registry()


def _segments(t: Tables) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("rec"), F.col("turn").alias("ord"), F.col("role").alias("speaker"), "text")


@R.add("""
with c as (select conv_id as rec, turn as ord, role, lag(role) over w as b, row_number() over w as n from conversations window w as (partition by conv_id order by turn))
select rec, ord, cast(sum(case when n = 1 or role is distinct from b then 1 else 0 end) over (partition by rec order by ord) as bigint) as turn from c""")
def turns(t: Tables) -> DataFrame:
    return transcripts.turns(_segments(t)).select("rec", "ord", "turn")


@R.add("""
with c as (select conv_id as rec, turn as ord, role, text, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as question from conversations)
select rec, question, min(ord) as first, max(ord) as last, cast(sum(length(text)) as bigint) as chars from c where role = 'assistant' and question is not null group by 1, 2""")
def answers(t: Tables) -> DataFrame:
    kind = F.when(F.col("speaker") == "user", "question").when(F.col("speaker") == "assistant", "answer").otherwise("other")
    return transcripts.answers(_segments(t).withColumn("kind", kind))


@R.add("""
select conv_id as rec, turn as ord, cast(coalesce(sum(length(text) + 1) over w, 0) as bigint) as c0, cast(coalesce(sum(length(text) + 1) over w, 0) + length(text) as bigint) as c1
from conversations window w as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)""")
def running_offsets(t: Tables) -> DataFrame:
    return transcripts.offsets(_segments(t), "rec", "ord", "text").select("rec", "ord", "c0", "c1")


@R.add("""
with p as (select conv_id as rec, role as speaker, sum(length(text) - length(replace(text, '?', ''))) as asked from conversations group by 1, 2)
select rec, arg_max(speaker, (asked, speaker)) as interviewer from p group by rec""")
def interviewer(t: Tables) -> DataFrame:
    return transcripts.interviewer(_segments(t))


@R.add("""
with e as (select user_id, event_id * 10 as lo, event_id * 10 + 900 as hi, event_id * 10 + 450 as s, event_id * 10 + 1300 as e from events)
select a.user_id, count(*) as pairs from e a join e b on a.user_id = b.user_id and a.lo < b.e and b.s < a.hi group by 1""")
def time_overlap(t: Tables) -> DataFrame:
    at = F.col("event_id") * 10
    left, right = t.events.select("user_id", at.alias("lo"), (at + 900).alias("hi")), t.events.select("user_id", (at + 450).alias("s"), (at + 1300).alias("e"))
    return transcripts.overlapping(left, right, "user_id", 1024).groupBy("user_id").agg(F.count("*").alias("pairs"))


@R.add("""
with o as (select o_custkey, o_orderkey as lo, o_orderkey + 2000 as hi, o_orderkey as s, o_orderkey + 10 as e from orders)
select a.o_custkey, count(*) as pairs from o a join o b on a.o_custkey = b.o_custkey and b.s >= a.lo and b.e <= a.hi group by 1""")
def answers_contain(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    outer, inner = t.orders.select("o_custkey", k.alias("lo"), (k + 2000).alias("hi")), t.orders.select("o_custkey", k.alias("s"), (k + 10).alias("e"))
    return transcripts.contained(outer, inner, "o_custkey", 1024).groupBy("o_custkey").agg(F.count("*").alias("pairs"))


@R.add("""
with e as (select user_id, event_id, event_type, last_value(case when event_id % 4 = 0 then event_type end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as mark from events)
select user_id, event_id, mark from e where event_id % 4 <> 0""")
def page_asof(t: Tables) -> DataFrame:
    marks = t.events.where("event_id % 4 = 0").select("user_id", "event_id", F.col("event_type").alias("mark"))
    return transcripts.as_of(t.events.where("event_id % 4 <> 0").select("user_id", "event_id"), marks, "user_id", "event_id", "mark")


@R.add("""
with e as (select user_id, event_id, case when event_id % 3 = 0 then event_id end as x, case when event_id % 3 = 0 then value end as y from events),
k as (select *, last_value(x ignore nulls) over b as lx, last_value(y ignore nulls) over b as ly, first_value(x ignore nulls) over f as hx, first_value(y ignore nulls) over f as hy from e
  window b as (partition by user_id order by event_id rows between unbounded preceding and current row), f as (partition by user_id order by event_id rows between current row and unbounded following))
select user_id, event_id, round(coalesce(y, ly + (hy - ly) * (event_id - lx) / nullif(hx - lx, 0)), 6) as filled from k""")
def time_interpolation(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"))
    return transcripts.interpolated(rows, "user_id", "event_id", "value").select("user_id", "event_id", F.round("filled", 6).alias("filled"))


@R.add("""
select doc_id, score from (select doc_id, contains(lower(text), 'the')::int + contains(lower(text), 'and of')::int + contains(lower(text), 'ße')::int as score from documents) where score > 0""")
def keyword_search(t: Tables) -> DataFrame:
    return search.keyword_search(t.documents.select("doc_id", "text"), ["the", "AND of", "ße"]).select("doc_id", "score")


@R.add("""
with m as (select i, avg(x) as m from (select generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings) group by i),
c as (select list(m order by i) as m from m),
v as (select vec_id, list_transform(list_zip(embedding, c.m), lambda p: p[1]::double - p[2]) as x from embeddings, c),
s as (select q.vec_id as query_id, list_cosine_similarity(q.x, v.x) as score from v q join v on q.vec_id % 100 = 0)
select query_id, rank, round(score, 5) as score from (select *, cast(row_number() over (partition by query_id order by score desc) as integer) as rank from s) where rank <= 5""")
def semantic_topk(t: Tables) -> DataFrame:
    """The rows whose id is divisible by 100 as queries against all rows; the cut at 5 is the feature."""
    v = t.embeddings
    found = search.semantic_topk(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5)
    return found.select("query_id", "rank", F.round("score", 5).alias("score"))


_FACETS = "select d.doc_id, d.lang, d.source, l.quality, l.toxic from documents d join labels l on d.doc_id = l.doc_id"


@R.add(f"""
with r as ({_FACETS}) select 'lang' as scheme, lang as value, count(*) as n from r where quality = 1 group by 2 union all select 'source', source, count(*) from r where lang in ('en', 'de') and quality = 1 group by 2
union all select 'quality', cast(quality as varchar), count(*) from r where lang in ('en', 'de') group by 2 union all select 'toxic', cast(toxic as varchar), count(*) from r where lang in ('en', 'de') and quality = 1 group by 2""")
def facet_counts(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id")
    return search.facet_counts(rows, {"lang": ["en", "de"], "quality": [1]}, ["lang", "source", "quality", "toxic"])


@R.add("select d.doc_id from documents d join labels l on d.doc_id = l.doc_id where lang in ('en', 'de') and quality = 1 and contains(lower(text), 'the')")
def facet_filter(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id")
    return rows.where(search.facet_filter(rows, {"lang": ["en", "de"], "quality": [1], "toxic": []}, ("The",))).select("doc_id")


@R.add("""
with a as (select o_orderkey as k, o_orderstatus as s, o_totalprice as p from orders where o_orderkey % 7 <> 0), b as (select o_orderkey as k, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end as s, o_totalprice + (o_orderkey % 3 = 0)::int as p from orders where o_orderkey % 11 <> 0)
select coalesce(a.k, b.k) as k, case when b.k is null then 'gone' when a.k is null then 'new' when a.s = b.s and a.p = b.p then 'same' else 'changed' end as state,
  case when a.k is null or b.k is null then '' else concat_ws(';', case when a.s <> b.s then 's' end, case when a.p <> b.p then 'p' end) end as changed from a full join b on a.k = b.k""")
def diff_keyed(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    before = t.orders.where(k % 7 != 0).select(k.alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    after = t.orders.where(k % 11 != 0).select(k.alias("k"), F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"), (F.col("o_totalprice") + (k % 3 == 0).cast("int")).alias("p"))
    return diff.keyed(before, after, "k", ["s", "p"])


@R.add("""
with a as (select distinct l_partkey from lineitem where l_linenumber = 1), b as (select distinct l_partkey from lineitem where l_linenumber = 2)
select case when b.l_partkey is null then 'only before' when a.l_partkey is null then 'only after' else 'both' end as side, count(*) as n from a full join b on a.l_partkey = b.l_partkey group by 1""")
def set_diff(t: Tables) -> DataFrame:
    return diff.sets(t.lineitem.where("l_linenumber = 1").select("l_partkey"), t.lineitem.where("l_linenumber = 2").select("l_partkey"))


@R.add("select doc_id, case when doc_id % 10 = 0 then 'missing' else 'changed' end as state from documents where doc_id % 10 = 0 or doc_id % 10 = 1")
def input_drift(t: Tables) -> DataFrame:
    recorded = t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"))
    now = t.documents.where("doc_id % 10 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return diff.drift(recorded, now, "doc_id")


@R.add("""
with c as (select o_orderkey as id, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as supersedes, o_custkey from orders)
select o_custkey as cust, min(id) as first, max(id) as current, count(*) as revisions from c group by o_custkey""")
def supersession_chain(t: Tables) -> DataFrame:
    """Each customer's orders as revisions of one object."""
    from pyspark.sql import Window

    links = t.orders.select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("supersedes"))
    found = diff.chains(links).select("first", "current", "revisions").distinct()
    return found.join(t.orders.select(F.col("o_orderkey").alias("first"), F.col("o_custkey").alias("cust")), "first").select("cust", "first", "current", "revisions")


@R.add("""
select d.doc_id, 'no document' as problem from labels d anti join documents x on d.doc_id = x.doc_id union all select l_orderkey, 'no part' from (select distinct l_orderkey, l_partkey from lineitem where l_partkey % 50 = 0 or true) l anti join (select * from part where p_partkey % 97 <> 0) p on l.l_partkey = p.p_partkey""")
def dangling_refs(t: Tables) -> DataFrame:
    """References without their object; for parts, each 97th counts as missing."""
    labels = t.labels.join(t.documents.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("no document").alias("problem"))
    lines = t.lineitem.select("l_orderkey", "l_partkey").distinct()
    parts = lines.join(t.part.where("p_partkey % 97 <> 0"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("l_orderkey", F.lit("no part"))
    return labels.union(parts)


@R.add("""
select p_partkey, '@misc{' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) || p_size || left(sha256(cast(p_partkey as varchar)), 4) || ',' || chr(10) || '  title = {' || p_name || '},' || chr(10) || '  year = {' || p_size || '}' || chr(10) || '}' as entry from part""")
def export_bibtex(t: Tables) -> DataFrame:
    key = exports.cite_key(F.col("p_brand"), F.col("p_size"), F.concat(F.lit("src-"), F.sha2(F.col("p_partkey").cast("string"), 256)))
    return t.part.select("p_partkey", exports.bibtex(F.lit("misc"), key, {"title": F.col("p_name"), "doi": F.lit(None).cast("string"), "year": F.col("p_size")}).alias("entry"))


@R.add("select p_partkey, 'TY  - GEN' || chr(10) || 'TI  - ' || p_name || chr(10) || 'PB  - ' || p_brand || chr(10) || 'ER  - ' as entry from part")
def export_ris(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", exports.ris(F.lit("GEN"), [("TI", F.col("p_name")), ("DO", F.lit("")), ("PB", F.col("p_brand"))]).alias("entry"))


@R.add("""select p_partkey, '{"id":"' || p_partkey || '","title":"' || p_name || '","size":' || p_size || '}' as entry from part""")
def export_csl(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", exports.csl(F.col("p_partkey").cast("string"), {"title": F.col("p_name"), "size": F.col("p_size")}).alias("entry"))


@R.add("""
select conv_id, turn, conv_id || ',' || turn || ',' || coalesce(role, '') || ',' || case when regexp_matches(coalesce(text, ''), '[",\r\n]') then '"' || replace(text, '"', '""') || '"' else coalesce(text, '') end as line from conversations""")
def csv_mirror(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", exports.csv_line(F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")).alias("line"))


@R.add("""
with e as (select 'o' || o_custkey as id, min('v' || event_id) as by_ from orders join events on o_custkey = user_id group by 1),
q as (select distinct 'o' || o_custkey as id from orders)
select q.id, 'Entity' as type, e.by_ as was_generated_by, case when q.id like 'o%1' then 'src-' || q.id end as was_quoted_from from q left join e on q.id = e.id
union all select 'v' || event_id, 'Activity', null, null from events""")
def prov_nodes(t: Tables) -> DataFrame:
    ids = t.orders.select(F.concat(F.lit("o"), "o_custkey").alias("id")).distinct()
    events = t.events.select(F.concat(F.lit("v"), "event_id").alias("event_id"), F.array(F.concat(F.lit("o"), "user_id")).alias("outputs"))
    quotes = ids.where("id like 'o%1'").select(F.col("id").alias("extraction_id"), F.concat(F.lit("src-"), "id").alias("source_id"), F.lit(None).cast("string").alias("status"))
    return exports.prov_nodes(ids, events, quotes)


_JOURNAL = "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@R.add(_JOURNAL)
def journal_windows(t: Tables) -> DataFrame:
    return _shown(journal.windows(t.events))


@R.add(_JOURNAL)
def journal_stream(t: Tables) -> DataFrame:
    """The same windows from a stream over the table's files."""
    source = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/event[s].parquet")
    at = f"{shared_dir(t.spark)}/journal/{uuid.uuid4().hex}"
    return _shown(journal.run(t.spark, source, lambda s: journal.windows(s), f"{at}/out", f"{at}/progress"))


@R.add("select event_id, event_type from events")
def journal_dedupe(t: Tables) -> DataFrame:
    return journal.once(t.events.union(t.events.where("event_id % 2 = 0"))).select("event_id", "event_type")


@R.add("select user_id, count(*) as events, arg_max(event_type, (ts, event_id)) as event_type, arg_max(event_id, (ts, event_id)) as event_id from events group by user_id")
def journal_state(t: Tables) -> DataFrame:
    return journal.newest(t.events, "user_id", ["ts", "event_id"], "event_type", "event_id")
