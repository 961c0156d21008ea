"""Joins of records over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import glossary, linking
from .base import Registry, Tables

R = Registry()


@R.add("select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id from events group by 1, 2")
def last_wins(t: Tables) -> DataFrame:
    return linking.last_wins(t.events.select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@R.add("""
with a as (select l_orderkey as k, min(l_suppkey) as v from lineitem where l_linenumber = 2 group by 1), b as (select o_orderkey as k, o_custkey as v from orders)
select coalesce(a.k, b.k) as k, coalesce(a.v, b.v) as v from a full join b using (k)""")
def first_wins(t: Tables) -> DataFrame:
    a = t.lineitem.where("l_linenumber = 2").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_suppkey").alias("v"))
    return linking.first_wins([a, t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"))], ["k"])


@R.add("""
with c as (select p_brand as codebook, p_partkey as code, case when p_partkey % 2 = 0 then upper(p_name) else lower(p_name) end as label from part)
select lower(label) as label, min(codebook) as codebook, min(code) as code from c group by 1 having count(*) = 1""")
def label_owners(t: Tables) -> DataFrame:
    label = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.lower("p_name"))
    return linking.label_owners(t.part.select(F.col("p_brand").alias("codebook"), F.col("p_partkey").alias("code"), label.alias("label")))


@R.add("""
with b as (select user_id, event_id * 10 as c0, event_id * 10 + 400 as c1, event_id as block from events where event_id % 50 = 0), p as (select user_id, event_id * 10 + 5 as place from events where event_id % 50 <> 0),
i as (select p.user_id, p.place, max(b.block) as block from p join b on b.user_id = p.user_id and b.c0 <= p.place and p.place < b.c1 group by 1, 2), n as (select p.user_id, p.place, min(b.block) as block from p join b on b.user_id = p.user_id and b.c0 >= p.place group by 1, 2)
select p.user_id, p.place, coalesce(i.block, n.block) as block from p left join i using (user_id, place) left join n using (user_id, place)""")
def block_at(t: Tables) -> DataFrame:
    """Some events as blocks, 400 wide unless the next one begins; the others as places."""
    from pyspark.sql import Window

    at = F.col("event_id") * 10
    blocks = t.events.where("event_id % 50 = 0").select("user_id", at.alias("c0"), (at + 400).alias("c1"), F.col("event_id").alias("block"))
    after = F.lead("c0").over(Window.partitionBy("user_id").orderBy("c0"))
    blocks = blocks.withColumn("c1", F.least("c1", F.coalesce(after, F.col("c1"))))
    return linking.block_at(t.events.where("event_id % 50 <> 0").select("user_id", (at + 5).alias("place")), blocks, "user_id")


@R.add("""
select l_suppkey, string_agg(distinct l_linenumber::varchar, ';' order by l_linenumber::varchar) filter (l_returnflag = 'A') as "A", string_agg(distinct l_linenumber::varchar, ';' order by l_linenumber::varchar) filter (l_returnflag = 'N') as "N" from lineitem group by 1""")
def source_columns(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", F.col("l_returnflag").alias("scheme"), F.col("l_linenumber").cast("string").alias("label"))
    out = linking.columns_by(rows, "l_suppkey", ["A", "N"])
    return out.select("l_suppkey", *[F.nullif(c, F.lit("")).alias(c) for c in ("A", "N")])


@R.add("""
with c as (select l_orderkey, l_linenumber as ord, l_partkey % 7 as code from lineitem), k as (select *, case when code < 5 then 'label ' || code else code::varchar end as label from c),
f as (select l_orderkey, label, min(ord) as ord from k group by 1, 2) select l_orderkey, string_agg(label, ';' order by ord, label) as labels from f group by 1""")
def labelled(t: Tables) -> DataFrame:
    codings = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("ord"), (F.col("l_partkey") % 7).cast("string").alias("code"))
    codes = t.spark.range(5).select(F.col("id").cast("string").alias("code"), F.concat(F.lit("label "), "id").alias("label"))
    return linking.labelled(codings, codes, "l_orderkey").select("l_orderkey", F.array_join("labels", ";").alias("labels"))


@R.add("""
with a as (select o_orderkey as k, o_orderstatus as s, o_custkey::varchar as c from orders), b as (select o_orderkey as k, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end as s, case when o_orderkey % 3 = 0 then null else o_custkey::varchar end as c from orders)
select k, 's' as field, a.s as old, b.s as "new" from a join b using (k) where a.s <> b.s and k % 10 <> 0 union all select k, 'c', a.c, b.c from a join b using (k) where b.c is null""")
def field_changes(t: Tables) -> DataFrame:
    """Changed fields of orders; changes of every tenth order's status are approved."""
    k = F.col("o_orderkey")
    a = t.orders.select(k.alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("c"))
    b = t.orders.select(k.alias("k"), F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"), F.when(k % 3 != 0, F.col("o_custkey")).alias("c"))
    return linking.field_changes(a, b, "k", ["s", "c"], t.orders.where("o_orderkey % 10 = 0").select(k.alias("k"), F.lit("s").alias("field"), F.lit("X").alias("new")))


@R.add("select p_partkey as source_id, '10.1/x' || p_partkey as doi, case when p_partkey % 4 <> 0 then p_name end as work from part")
def by_doi(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    spelled = F.when(k % 2 == 0, F.concat(F.lit("https://doi.org/10.1/X"), k)).otherwise(F.concat(F.lit(" 10.1/x"), k))
    works = t.part.where("p_partkey % 4 <> 0").select(F.concat(F.lit("http://dx.doi.org/10.1/x"), k).alias("doi"), F.col("p_name").alias("work"))
    return linking.by_doi(t.part.select(k.alias("source_id"), spelled.alias("doi")), works)


@R.add("""
with a as (select o_orderkey as k, o_orderstatus as s, o_custkey % 3 as c from orders where o_orderkey % 2 = 0), b as (select o_orderkey as k, case when o_orderkey % 8 = 0 then 'F' else o_orderstatus end as s, case when o_orderkey % 6 = 0 then null else o_custkey % 4 end as c from orders where o_orderkey % 3 <> 1)
select 's' as field, a.s as a, b.s as b, count(*) as n from a join b using (k) group by 2, 3 union all select 'c', a.c::varchar, b.c::varchar, count(*) from a join b using (k) where b.c is not null group by 2, 3""")
def rating_pairs(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a = t.orders.where("o_orderkey % 2 = 0").select(k.alias("k"), F.col("o_orderstatus").alias("s"), (c % 3).alias("c"))
    b = t.orders.where("o_orderkey % 3 <> 1").select(k.alias("k"), F.when(k % 8 == 0, "F").otherwise(F.col("o_orderstatus")).alias("s"), F.when(k % 6 != 0, c % 4).alias("c"))
    return linking.rating_pairs(a, b, "k", ["s", "c"])


@R.add("""
select s_suppkey as id, case when s_suppkey % 10 < 4 then min(s_suppkey) over (partition by s_suppkey // 10, s_suppkey % 10 < 4) else s_suppkey end as entity from supplier""")
def merged_entities(t: Tables) -> DataFrame:
    """Suppliers under several names: of ten neighbours the first four share keys in a chain: a name, its acronym, the acronym alone, and a
    name with a title."""
    k, ten = F.col("s_suppkey"), F.floor(F.col("s_suppkey") / 10)
    letters = lambda n: F.translate(n.cast("string"), "0123456789", "abcdefghij")
    person = F.concat(F.lit("Ada X"), letters(ten))
    form = k % 10
    name = F.when(form == 0, person).when(form == 1, F.concat(person, F.lit(", Chair"))).when(form == 2, F.concat(person, F.lit(" (AX"), ten, F.lit(")"))).when(form == 3, F.concat(F.lit("ax"), ten, F.lit("."))).otherwise(F.concat(F.lit("firm "), k))
    return linking.merged_entities(t.supplier.select(k.alias("id"), name.alias("name")))


_TERMS = ("the", "and the", "and", "of the", "der", "et", "les")
_END = r"[^\p{L}\p{N}_]"


@R.add(rf"""
with d as (select doc_id, regexp_replace(text, '({_END})', '\1\1', 'g') as t from documents where text is not null),
h as (select doc_id, list_transform(regexp_extract_all(t, '(?i)(?:^|{_END})({"|".join(sorted((x.replace(" ", "  ") for x in _TERMS), key=lambda x: -len(x)))})(?:$|{_END})', 1), lambda x: replace(lower(x), '  ', ' ')) as h from d)
select doc_id, cast(len(h) as bigint) as n, sha256(array_to_string(h, '|')) as hits_sha256 from h""")
def glossary_hits(t: Tables) -> DataFrame:
    """Every place of some terms in every document. The SQL doubles what lies between words, so that neighbours don't share it."""
    terms = t.spark.createDataFrame([(x,) for x in _TERMS], "term string")
    texts = t.documents.where("text is not null").select("doc_id", "text")
    found = glossary.term_places(texts, terms, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "term"))).alias("p"))
    hits = F.transform(F.coalesce("p", F.array().cast("array<struct<start:bigint,term:string>>")), lambda x: x["term"])
    return texts.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.size(hits).cast("long").alias("n"), F.sha2(F.array_join(hits, "|"), 256).alias("hits_sha256"))


@R.add()
def pseudonymised(t: Tables) -> DataFrame:
    """Documents with every longer word of the benchmark replaced by its pseudonym; tests hold replacing against a plain version."""
    names = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}{7,}"), F.lit(0))).alias("name")).distinct()
    found = glossary.pseudonymised(t.documents.select("doc_id", "text"), names, "doc_id", "a key of the corpus")
    return found.select("doc_id", "n", F.sha2("text", 256).alias("text_sha256"))


@R.add("""
with u as (select o_orderkey as unit, strftime(o_orderdate, '%Y-%m-%d') as day, o_custkey % 9 as a, (o_custkey + 4) % 9 as b from orders)
select unit, concat_ws(';', case when day < (1992 + a) || '-06-01' then 'k' || a end, case when day < (1992 + b) || '-06-01' then 'k' || b end) as early from u""")
def too_early(t: Tables) -> DataFrame:
    a, b = F.col("o_custkey") % 9, (F.col("o_custkey") + 4) % 9
    units = t.orders.select(F.col("o_orderkey").alias("unit"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.concat(F.lit("k"), a, F.lit(";k"), b).alias("codes"))
    return linking.too_early(units, t.spark.range(9).select(F.concat(F.lit("k"), "id").alias("code"), F.concat(F.col("id") + 1992, F.lit("-06-01")).alias("since")))
