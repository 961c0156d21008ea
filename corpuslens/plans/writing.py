"""Additions to a corpus over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ident
from ..functions import text as tx
from ..operators import exports, search, writing
from .base import Registry, Tables

R = Registry()


@R.add("""
with r as (select doc_id, 'src-' || left(sha256('src' || chr(10) || 'sha256:' || sha256(text)), 12) as id, sha256(text) as h, text is null as none, 'doc ' || source as title from documents),
e as (select distinct id from r where doc_id % 5 = 0 and not none), n as (select *, row_number() over (partition by case when none then null else id end order by doc_id) as n from r),
s as (select doc_id, id, title, case when none then 'refused' when id in (select id from e) then 'exists' when n > 1 then 'repeated' else 'added' end as status from n),
b as (select *, case when status = 'added' then coalesce(nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'untitled') end as base from s),
c as (select *, row_number() over (partition by base order by doc_id) - 1 as before from b)
select doc_id as record, case when status <> 'refused' then id end as source_id, status, case when base is not null then base || case when before = 0 then '' else '--' || substr(id, 5, 6) end end as slug from c""")
def add_sources(t: Tables) -> DataFrame:
    """Documents as new sources by their bytes; every fifth is there already, under a slug of its own."""
    rows = t.documents.select(F.col("doc_id").alias("record"), F.lit(None).cast("string").alias("url"), F.concat(F.lit("doc "), "source").alias("title"), F.sha2("text", 256).alias("sha256"))
    there = rows.where("record % 5 = 0 and sha256 is not null").select(ident.mint_src_id(F.lit(None).cast("string"), F.col("sha256")).alias("source_id"), F.concat(F.lit("old-"), "record").alias("slug")).dropDuplicates(["source_id"])
    return writing.add_sources(rows, there, ascii_only=True)


@R.add("""
with r as (select o_orderkey as record, o_orderkey % 4 as book, case when o_orderkey % 7 = 0 then null else o_orderstatus end as code, case when o_orderkey % 11 = 0 then 'free' end as value, o_custkey as target from orders),
c as (select c_custkey as target, case when c_custkey % 2 = 0 then 'F' else 'O' end as old from customer where c_custkey % 3 = 0)
select record, case when book = 3 then 'unknown codebook' when (code is null) = (value is null) then 'both or neither' when book < 2 and value is not null then 'closed' when book = 2 and code is not null then 'open'
  when book < 2 and code not in ('F', 'O') then 'unknown code' when r.target % 13 = 0 then 'unknown target' when book = 0 and old = coalesce(code, value) then 'unchanged' when book = 0 and old is not null then 'replaced' else 'added' end as result
from r left join c on c.target = r.target""")
def code_records(t: Tables) -> DataFrame:
    """Orders as proposals for two closed codebooks, an open one, and one that nobody has."""
    k = F.col("o_orderkey")
    book = F.concat(F.lit("b"), k % 4)
    rows = t.orders.select(k.alias("record"), book.alias("codebook"), F.when(k % 7 != 0, F.col("o_orderstatus")).alias("code"), F.when(k % 11 == 0, "free").alias("value"), F.col("o_custkey").alias("target"), F.lit("a").alias("coder"))
    codes = t.spark.createDataFrame([("b0", True, "F"), ("b0", True, "O"), ("b1", True, "F"), ("b1", None, "O"), ("b2", False, None)], "codebook string, closed boolean, code string")
    current = t.customer.where("c_custkey % 3 = 0").select(F.lit("b0").alias("codebook"), F.col("c_custkey").alias("target"), F.lit("a").alias("coder"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("O").alias("label"))
    targets = t.orders.where("o_custkey % 13 <> 0").select(F.col("o_custkey").alias("target"))
    return writing.code(rows, current, codes, targets)


@R.add("select o_orderkey, 'evt-' || lpad((41 + row_number() over (order by o_orderdate, o_orderkey))::varchar, cast(greatest(6, length((41 + row_number() over (order by o_orderdate, o_orderkey))::varchar)) as integer), '0') as event_id from orders")
def journal_ids(t: Tables) -> DataFrame:
    return writing.journal_ids(t.orders.select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], 41).select("o_orderkey", "event_id")


@R.add("select o_orderkey as unit from orders where o_orderkey % 4 = 0 or o_orderkey % 6 = 1")
def pending_units(t: Tables) -> DataFrame:
    """Orders of which three quarters are done, a sixth of all from an older state."""
    k = F.col("o_orderkey")
    units = t.orders.select(k.alias("unit"), F.sha2(F.concat_ws("|", k, "o_orderstatus"), 256).alias("digest"))
    done = t.orders.where("o_orderkey % 4 <> 0").select(k.alias("unit"), F.sha2(F.concat_ws("|", k, F.when(k % 6 == 1, "?").otherwise(F.col("o_orderstatus"))), 256).alias("digest"))
    return writing.pending(units, done).select("unit")


@R.add("""
select item_id, 'ext-' || item_id || ',s,r,quote,"{""representation_ref"":""r"",""type"":""char_range"",""value"":{""end"":' || length(text) || ',""start"":0}}",' ||
  case when regexp_matches(text, '[",\r\n]') then '"' || replace(text, '"', '""') || '"' else text end || ',active' as line from benchmark""")
def extraction_mirror(t: Tables) -> DataFrame:
    rows = t.benchmark.select(F.concat(F.lit("ext-"), "item_id").alias("extraction_id"), F.lit("s").alias("source_id"), F.lit("r").alias("representation_ref"), F.lit("quote").alias("type"), F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text").alias("direct_quote"), F.lit(None).cast("string").alias("status"))
    return exports.extraction_lines(rows).select(F.substring_index("extraction_id", "-", -1).cast("long").alias("item_id"), "line")


@R.add("select p_partkey, '- ' || p_brand || case when p_size % 2 = 0 then ' (' || p_size || ')' else '' end || '. *' || p_name || '*.' || case when p_size % 3 = 0 then ' ' || p_type || '.' else '' end as entry from part")
def export_markdown(t: Tables) -> DataFrame:
    size = F.col("p_size")
    return t.part.select("p_partkey", exports.markdown_entry(F.col("p_brand"), F.when(size % 2 == 0, size), F.col("p_name"), F.when(size % 3 == 0, F.col("p_type")), F.lit(None).cast("string")).alias("entry"))


@R.add("""
select p_partkey from part where case when p_size < 10 then 'well' when p_size < 30 then 'some' else 'weak' end in ('well', 'some') and p_partkey % 3 in (0, 1) and contains(lower(p_name), 'a')""")
def findings_filter(t: Tables) -> DataFrame:
    size = F.col("p_size")
    rows = t.part.select("p_partkey", F.when(size < 10, "well").when(size < 30, "some").otherwise("weak").alias("support"), F.lit("finding").alias("kind"), F.array(F.concat(F.lit("k"), F.col("p_partkey") % 3), F.lit("world")).alias("places"), F.col("p_name").alias("text"))
    return rows.where(search.findings_filter(["well", "some"], [], ["k0", "k1"], ("A",))).select("p_partkey")


@R.add("select p_partkey, row_number() over (partition by p_brand order by p_size % 4 desc, p_size desc, p_partkey) as place from part")
def findings_by_strength(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.col("p_brand").alias("overview"), F.col("p_partkey").alias("ord"), (F.col("p_size") % 4).alias("support_rank"), F.col("p_size").alias("studies"))
    return search.by_strength(rows, "overview").select("p_partkey", F.col("place").cast("long").alias("place"))


@R.add("""
with c as (select event_type as scheme, count(distinct user_id) as sources from events group by 1) select scheme, sources, row_number() over (order by (scheme = 'click')::int, sources desc, scheme) as place from c""")
def facets_by_coverage(t: Tables) -> DataFrame:
    return search.by_coverage(t.events.select(F.col("event_type").alias("scheme"), F.col("user_id").alias("source")), ("click",)).withColumn("place", F.col("place").cast("long"))


@R.add("""select event_id, case when event_id % 3 = 0 then '{"id":' || event_id || ',"in":{"s":"a } b"}}' end as object from events""")
def loose_objects(t: Tables) -> DataFrame:
    """Answers with words around an object, with a broken one, and with none."""
    k = F.col("event_id")
    whole = F.concat(F.lit('Here it is: {"id":'), k, F.lit(',"in":{"s":"a } b"}} and {"x":1}'))
    answer = F.when(k % 3 == 0, whole).when(k % 3 == 1, F.lit('{"id": broken')).otherwise("no object")
    return t.events.select("event_id", tx.first_object(answer).alias("object"))
