"""Passages and texts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import passages
from .base import Registry, Tables

R = Registry()


@R.add("""
with a as (select o_custkey, o_orderstatus as code, case o_orderkey % 5 when 0 then 2 when 1 then 1 else 0 end as r, strftime(o_orderdate, '%Y-%m-%d') as day from orders)
select o_custkey, arg_max(code, (r, day, code)) as code, count(distinct code) > 1 as disagree from a group by 1""")
def resolved_codes(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 5
    rows = t.orders.select("o_custkey", F.col("o_orderstatus").alias("code"), F.when(k == 0, "adjudicator").when(k == 1, "human").when(k == 2, "model").alias("kind"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"))
    return passages.resolve(rows, ["o_custkey"])


@R.add("""
with r as (select l_orderkey * 10 + l_linenumber as id, l_suppkey as paper, l_quantity as strength, row_number() over (partition by l_suppkey order by l_quantity desc, l_orderkey * 10 + l_linenumber) as n from lineitem where l_returnflag <> 'R')
select id, paper from r where n <= 3 order by strength desc, id limit 100""")
def claim_pool(t: Tables) -> DataFrame:
    """A pool of a hundred passages, three of a paper (both limits are the pool's)."""
    rows = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("paper"), F.col("l_quantity").alias("strength"), F.when(F.col("l_returnflag") == "R", "reported").otherwise("own").alias("origin"))
    return passages.pool(rows, 3, 100).select("id", "paper")


@R.add("""
with r as (select o_orderkey, o_orderpriority, o_orderstatus, row_number() over (partition by o_orderpriority, o_orderstatus order by md5('7-' || o_orderkey), o_orderkey) as draw from orders)
select o_orderkey, o_orderpriority, o_orderstatus, draw from r where draw <= 20""")
def spot_check(t: Tables) -> DataFrame:
    """Twenty of each code (the sample is the feature)."""
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return passages.spot_check(rows, ["o_orderpriority", "o_orderstatus"], "o_orderkey", 20).withColumn("draw", F.col("draw").cast("long"))


@R.add("""
with p as (select p_partkey as paper, p_brand || ' ' || (p_partkey // 9) as who from part), n as (select *, count(*) over (partition by who) as m, row_number() over (partition by who order by paper) as i from p)
select paper, case when m > 1 then who || case when i > 26 then chr(cast(96 + (i - 1) // 26 as integer)) else '' end || chr(cast(97 + (i - 1) % 26 as integer)) else who end as name from n""")
def names_told_apart(t: Tables) -> DataFrame:
    return passages.told_apart(t.part.select(F.col("p_partkey").alias("paper"), F.concat_ws(" ", "p_brand", F.floor(F.col("p_partkey") / 9)).alias("author_year")))


@R.add("select p_partkey, row_number() over (partition by p_brand order by p_size desc, p_retailprice, p_partkey) as place from part")
def document_order(t: Tables) -> DataFrame:
    rows = passages.sections_ordered(t.part, "p_brand", [F.desc("p_size"), F.col("p_retailprice"), F.col("p_partkey")])
    return rows.select("p_partkey", F.col("place").cast("long").alias("place"))


@R.add("""
with b as (select p_partkey, p_brand, p_size, case when p_partkey % 5 = 0 then 'relayed' when p_size % 10 <= 1 then 'one study' when p_type like '%A%' then 'strong' end as bucket from part),
r as (select *, row_number() over (partition by p_brand, bucket order by p_size % 10 desc, p_partkey) as place from b where bucket is not null)
select p_partkey, bucket, place from r where bucket = 'one study' or place <= case bucket when 'strong' then 8 else 4 end""")
def key_findings(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("theme"), (F.col("p_partkey") % 5 == 0).alias("relayed"), (F.col("p_size") % 10).alias("studies"), F.when(F.col("p_type").contains("A"), "well").otherwise("weak").alias("support"))
    return passages.key_findings(rows, "theme").select(F.col("id").alias("p_partkey"), "bucket", F.col("place").cast("long").alias("place"))


@R.add("""
with q as (select conv_id, turn, trim(case when turn % 4 = 3 then 'the same quotation of some length' else coalesce(text, '') end) as q from conversations),
f as (select *, case when length(q) < 20 then 'too_short' when length(q) > 800 then 'too_long' when contains(q, '...') or contains(q, '…') then 'ellipsis' end as fault from q),
n as (select *, row_number() over (partition by conv_id, q, fault is null order by turn) as n from f) select conv_id, turn, coalesce(fault, case when n > 1 then 'duplicate' end) as problem from n""")
def clean_passages(t: Tables) -> DataFrame:
    quote = F.when(F.col("turn") % 4 == 3, "the same quotation of some length").otherwise(F.col("text"))
    return passages.clean_passages(t.conversations.select("conv_id", F.col("turn").alias("ord"), quote.alias("quote")), "conv_id", 20, 400).withColumnRenamed("ord", "turn")


@R.add("""
select o_orderkey, case when o_orderkey % 3 < 2 then '1-URGENT' else '' end as kept, case when o_orderkey % 3 = 0 then '' else 'x' || (o_orderkey % 3) end as unknown from orders""")
def checked_answers(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 3
    given = F.filter(F.array(F.when(k < 2, "1-URGENT"), F.when(k < 2, "1-URGENT"), F.when(k > 0, F.concat(F.lit("x"), k))), lambda x: x.isNotNull())
    found = passages.checked_answer(given, F.array(F.lit("1-URGENT"), F.lit("2-HIGH")))
    return t.orders.select("o_orderkey", F.array_join(found["kept"], ";").alias("kept"), F.array_join(found["unknown"], ";").alias("unknown"))


@R.add("""
select doc_id, case when doc_id % 3 = 2 then 0 else 30 end as removed, sha256(case when doc_id % 3 = 2 then array_to_string(list_transform(range(1, 31), lambda i: (case when i % 2 = 0 then 900 - i else i end)::varchar), chr(10)) || chr(10) || t else t end) as text
from (select doc_id, regexp_replace(coalesce(text, ''), '(?m)^[ \\t]*[0-9]{1,4}[ \\t]*$', 'number', 'g') as t from documents)""")
def margin_numbers(t: Tables) -> DataFrame:
    """Thirty lines of numbers before a text, rising in two thirds of the documents."""
    n = F.sequence(F.lit(1), F.lit(30))
    up = F.array_join(F.transform(n, lambda i: i.cast("string")), "\n")
    mixed = F.array_join(F.transform(n, lambda i: F.when(i % 2 == 0, 900 - i).otherwise(i).cast("string")), "\n")
    own = F.regexp_replace(F.coalesce("text", F.lit("")), "(?m)^[ \\t]*[0-9]{1,4}[ \\t]*$", "number")
    rows = t.documents.select("doc_id", F.concat_ws("\n", F.when(F.col("doc_id") % 3 == 2, mixed).otherwise(up), own).alias("text"))
    found = rows.select("doc_id", passages.margin_numbers(F.col("text")).alias("x"))
    return found.select("doc_id", F.col("x.removed").alias("removed"), F.sha2("x.text", 256).alias("text"))


@R.add("select conv_id, turn, value_ok and turn % 2 = 0 as found from (select conv_id, turn, trim(left(text, 12)) <> '' as value_ok from conversations where text is not null)")
def values_in_quotes(t: Tables) -> DataFrame:
    value = F.when(F.col("turn") % 2 == 0, F.replace(F.substring("text", 1, 12), F.lit(" "), F.lit("  "))).otherwise(F.concat(F.substring("text", 1, 12), F.lit("\a")))
    return t.conversations.where("text is not null").select("conv_id", "turn", passages.value_in(value, F.lower("text")).alias("found"))


@R.add("""
select doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*'), lambda x: x not in ('1', '2', '3', '10')))), ' ') as loose from documents where text is not null""")
def unregistered_numbers(t: Tables) -> DataFrame:
    known = F.array(*[F.lit(x) for x in ("1", "2", "3", "10")])
    return t.documents.where("text is not null").select("doc_id", F.array_join(F.array_sort(passages.unregistered_numbers(F.col("text"), known)), " ").alias("loose"))


@R.add("select doc_id, cast(p + 2 * (p // 3) + least(2, p % 3) as bigint) as units from (select doc_id, least(20, length(text)) as p from documents where text is not null)")
def utf16_offsets(t: Tables) -> DataFrame:
    """A place in a text of which two of every three characters take two units."""
    wide = F.repeat(F.lit("\U0001f600\U0001f600a"), 20)
    place = F.least(F.lit(20), F.length("text"))
    return t.documents.where("text is not null").select("doc_id", passages.utf16_offset(wide, place).cast("long").alias("units"))


@R.add("select event_id, hour(ts) * 60 + minute(ts) >= 1320 or hour(ts) * 60 + minute(ts) < 390 as open from events")
def overnight(t: Tables) -> DataFrame:
    return t.events.select("event_id", passages.in_hours(F.hour("ts") * 60 + F.minute("ts"), 22 * 60, 6 * 60 + 30).alias("open"))


@R.add("select l_orderkey, l_linenumber, abs(l_extendedprice - x) <= 0.02 * greatest(l_extendedprice, x) as agree from (select *, l_extendedprice * (1 + (l_partkey % 5 - 2) / 80.0) as x from lineitem)")
def readings_agree(t: Tables) -> DataFrame:
    again = F.col("l_extendedprice") * (1 + (F.col("l_partkey") % 5 - 2) / 80)
    return t.lineitem.select("l_orderkey", "l_linenumber", passages.readings_agree(F.col("l_extendedprice"), again).alias("agree"))


@R.add()
def text_chunks(t: Tables) -> DataFrame:
    """Python inside tasks; tests hold the spans against known ones."""
    return passages.chunks(t.documents.select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text")), "doc_id")


@R.add()
def model_parts(t: Tables) -> DataFrame:
    """Python inside tasks; tests put the parts together again."""
    return passages.model_parts(t.documents.select("doc_id", "text"), "doc_id", 3000)
