"""Queries over tables: profiles, keys, links, paths, neighbours, windows, samples, appraisal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import appraise, profile, units
from .base import Registry, Tables

R = Registry()


#: Every table of the driver with its columns of plain values.
FACT_COLUMNS = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "supplier": ("s_suppkey", "s_name", "s_nationkey"), "customer": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"),
    "events": ("event_id", "user_id", "event_type"), "documents": ("doc_id", "text", "lang", "source"), "pages": ("page_id", "url"), "benchmark": ("item_id", "text"), "labels": ("doc_id", "quality", "toxic"), "conversations": ("conv_id", "turn", "role", "text"),
}
CELLS = " union all ".join(f"select '{t}' as tbl, '{c}' as col, coalesce(cast({c} as varchar), '') as v from {t}" for t, cols in FACT_COLUMNS.items() for c in cols)
_TRIM = "trim(v, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"
FACTS = f"""
cells as ({CELLS}), trimmed as (select *, {_TRIM} as s from cells),
facts as (select tbl, col, count(*) as rows, count(*) filter (s <> '') as filled, count(distinct v) filter (s <> '') as distinct_, coalesce(max(length(v)) filter (s <> ''), 0) as len_max,
  coalesce(round(avg(regexp_matches(s, '^-?[0-9]+$')::int) filter (s <> ''), 3), 0) as share_int, coalesce(round(avg(regexp_matches(s, '^-?[0-9]+([.][0-9]+)?([eE]-?[0-9]+)?$')::int) filter (s <> ''), 3), 0) as share_number,
  coalesce(round(avg((lower(s) in ('true', 'false', 'yes', 'no', '0', '1', 'y', 'n', 't', 'f'))::int) filter (s <> ''), 3), 0) as share_bool, coalesce(round(avg(regexp_matches(s, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')::int) filter (s <> ''), 3), 0) as share_date,
  coalesce(round(avg(contains(v, chr(10))::int) filter (s <> ''), 3), 0) as share_newline from trimmed group by tbl, col),
keys as (select tbl, col from facts where filled > 0 and distinct_ = filled and filled = rows and len_max <= 80 and share_newline = 0 and share_date < 0.9 and rows >= 3)"""


def _plain(t: Tables) -> dict[str, DataFrame]:
    return {name: getattr(t, name).select(*cols) for name, cols in FACT_COLUMNS.items()}


@R.add(f"""
with {FACTS} select tbl, col as column, cast(rows as bigint) as rows, cast(filled as bigint) as filled, round(filled::double / rows, 3) as fill, cast(distinct_ as bigint) as distinct_,
  filled > 0 and distinct_ = filled and filled = rows as unique_, cast(len_max as integer) as len_max, share_int, share_number, share_bool, share_date, share_newline from facts""")
def column_facts(t: Tables) -> DataFrame:
    shares = [f"share_{k}" for k in ("int", "number", "bool", "date", "newline")]
    return profile.column_facts(_plain(t)).select(F.col("t").alias("tbl"), "column", "rows", "filled", "fill", F.col("distinct").alias("distinct_"), F.col("unique").alias("unique_"), "len_max", *shares)


@R.add("""
with c as (select 'o_totalprice' as col, cast(round(o_totalprice) as bigint)::varchar as v from orders union all select 'o_orderpriority', o_orderpriority from orders),
r as (select col, length(v) as n, row_number() over (partition by col order by length(v)) - 1 as i, count(*) over (partition by col) as m from c)
select col as column, cast(max(n) filter (i = round_even(0.5 * (m - 1), 0)) as integer) as p50, cast(max(n) filter (i = round_even(0.9 * (m - 1), 0)) as integer) as p90 from r group by col""")
def percentile(t: Tables) -> DataFrame:
    df = t.orders.select(F.round("o_totalprice").cast("bigint").cast("string").alias("o_totalprice"), "o_orderpriority")
    return profile.column_facts({"orders": df}).select("column", F.col("len_p50").alias("p50"), F.col("len_p90").alias("p90"))


@R.add(f"with {FACTS} select tbl, col as column from keys")
def keys(t: Tables) -> DataFrame:
    return profile.column_facts(_plain(t)).where(profile.is_key()).select(F.col("t").alias("tbl"), "column")


@R.add(f"""
with {FACTS.replace("cells as (", "all_cells as (").replace("from cells)", "from cells)").replace("trimmed as", "cells as (select * from all_cells where tbl in ('region', 'nation', 'supplier', 'customer', 'part', 'orders', 'lineitem', 'events')), trimmed as", 1)},
toks as (select distinct t.tbl, t.col, trim(t.v) as v from cells t join facts f using (tbl, col) where f.filled > 0 and f.len_max <= 400 and trim(t.v) <> ''),
sizes as (select tbl, col, count(*) as n from toks join facts using (tbl, col) group by tbl, col having bool_and(regexp_full_match(v, '[A-Za-z]{{0,3}}[0-9A-Za-z_.-]{{1,40}}')) and count(*) >= least(5, max(rows))),
hits as (select a.tbl as from_table, a.col as from_column, b.tbl as to_table, b.col as to_column, count(*) as m from toks a join sizes using (tbl, col) join toks b on a.v = b.v and (a.tbl <> b.tbl or a.col <> b.col) join keys k on b.tbl = k.tbl and b.col = k.col group by 1, 2, 3, 4),
bare as (select distinct b.tbl, b.col, regexp_replace(b.v, '^[A-Za-z]{{1,3}}([0-9])', '\\1') as v from toks b join keys k on b.tbl = k.tbl and b.col = k.col),
loose as (select a.tbl as from_table, a.col as from_column, b.tbl as to_table, b.col as to_column, count(*) as l from toks a join sizes using (tbl, col) join bare b on regexp_replace(a.v, '^[A-Za-z]{{1,3}}([0-9])', '\\1') = b.v and (a.tbl <> b.tbl or a.col <> b.col) group by 1, 2, 3, 4),
both_ as (select from_table, from_column, to_table, to_column, coalesce(m, 0) as m, coalesce(l, 0) as l, n from hits full join loose using (from_table, from_column, to_table, to_column) join sizes s on s.tbl = from_table and s.col = from_column),
share as (select *, (case when m < 0.9 * n and l > m then l else m end)::double / n as c from both_)
select from_table, from_column, to_table, to_column, round(c, 3) as containment, c < 0.9 as partial from share where c >= 0.5""")
def find_links(t: Tables) -> DataFrame:
    """Over all tables of keys; their cells hold no lists."""
    names = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events")
    return profile.find_links({k: v for k, v in _plain(t).items() if k in names}).select("from_table", "from_column", "to_table", "to_column", "containment", "partial")


@R.add("select distinct cast(c_custkey as varchar) as start, cast(p_brand as varchar) as target from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey")
def resolve_path(t: Tables) -> DataFrame:
    """Customers to the brands of what they ordered, over three links."""
    hops = [("c_custkey", t.orders, "o_custkey", "o_orderkey"), ("o_orderkey", t.lineitem, "l_orderkey", "l_partkey"), ("l_partkey", t.part, "p_partkey", "p_brand")]
    return units.resolve_path(t.customer, "c_custkey", hops).select("start", "target")


@R.add("""
with l as (select o_custkey, min(o_orderkey::varchar) as linked, string_agg(o_orderkey::varchar, ';' order by o_orderkey::varchar) as ids from orders group by 1)
select c_custkey, linked, ids as linked_ids, o_orderstatus from customer left join l on o_custkey = c_custkey left join orders o on o.o_orderkey::varchar = linked""")
def joined_export(t: Tables) -> DataFrame:
    """Customers with the status of their first order and all their orders' ids."""
    links = t.orders.select(F.col("o_custkey").cast("string").alias("start"), F.col("o_orderkey").cast("string").alias("target"), F.col("o_orderkey").cast("string").alias("first"))
    return units.joined_export(t.customer.select("c_custkey"), "c_custkey", links, t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey")


@R.add("select c_custkey, c_mktsegment from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def where_not_in(t: Tables) -> DataFrame:
    return units.where_in(t.customer, "c_custkey", t.orders.where("o_orderpriority = '1-URGENT'"), "o_custkey", negate=True).select("c_custkey", "c_mktsegment")


@R.add("select p_partkey, p_brand from part where p_partkey in (select l_partkey from lineitem where l_quantity >= 49)")
def where_in(t: Tables) -> DataFrame:
    return units.where_in(t.part, "p_partkey", t.lineitem.where("l_quantity >= 49"), "l_partkey").select("p_partkey", "p_brand")


@R.add("""
select coalesce(s.s_suppkey, c.c_custkey) as id, coalesce(s.s_name, c.c_name) as name, case when c.c_custkey is not null then 0 else 1 end as first_table
from customer c full join supplier s on c.c_custkey = s.s_suppkey""")
def unit_rows_union(t: Tables) -> DataFrame:
    """Customers, then suppliers over them under equal ids."""
    parts = [t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))]
    return units.unit_rows(parts, "id").select("id", "name", "first_table")


@R.add("""
select event_id, coalesce(array_to_string(list_value(lag(event_id, 2) over w, lag(event_id) over w), ';'), '') as before, coalesce(array_to_string(list_value(lead(event_id) over w), ';'), '') as after
from events window w as (partition by user_id order by ts, event_id)""")
def neighbors(t: Tables) -> DataFrame:
    rows = units.neighbours(t.events.select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], 2, 1)
    return rows.select("event_id", F.array_join("before", ";").alias("before"), F.array_join("after", ";").alias("after"))


@R.add("""
with k as (select *, sum(case when event_type = 'click' then 1 else 0 end) over (partition by user_id order by ts, event_id) as p from events),
c as (select user_id, p, event_id as cid from k where event_type = 'click')
select k.event_id, b.cid as before, a.cid as after from k
left join c b on b.user_id = k.user_id and b.p = k.p - case when k.event_type = 'click' then 1 else 0 end left join c a on a.user_id = k.user_id and a.p = k.p + 1""")
def neighbors_filtered(t: Tables) -> DataFrame:
    """The click before and the click after each event: the filter holds before neighbours are counted off."""
    rows = units.neighbours(t.events.select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], 1, 1, F.col("event_type") == "click")
    return rows.select("event_id", F.get("before", 0).alias("before"), F.get("after", 0).alias("after"))


@R.add("""
with recursive s as (select conv_id, turn, length(text) as n, row_number() over (partition by conv_id order by turn) as i from conversations),
w as (select conv_id, turn, n, i, 0 as win, n as used from s where i = 1
  union all select s.conv_id, s.turn, s.n, s.i, case when w.used > 0 and w.used + s.n > 4000 then w.win + 1 else w.win end, case when w.used > 0 and w.used + s.n > 4000 then s.n else w.used + s.n end from w join s on s.conv_id = w.conv_id and s.i = w.i + 1)
select conv_id, turn, cast(win as bigint) as window from w""")
def screen_windows(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.length("text").alias("n"))
    return units.screen_windows(rows, "conv_id", ["turn"], "n", 4000, overlap=0)


@R.add()
def screen_windows_overlap(t: Tables) -> DataFrame:
    """As above with a row of overlap; tests hold it against a plain loop."""
    rows = t.conversations.select("conv_id", "turn", F.length("text").alias("n"))
    return units.screen_windows(rows, "conv_id", ["turn"], "n", 4000, overlap=1)


@R.add()
def stratified_sample(t: Tables) -> DataFrame:
    """200 orders in turn over the priorities, by a hash that SQL lacks; tests count the strata."""
    return units.stratified(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 200)


@R.add("select doc_id, source, row_number() over (partition by source order by doc_id) as turn from documents")
def spread(t: Tables) -> DataFrame:
    return units.spread(t.documents.select("doc_id", "source"), "source", "doc_id").withColumn("turn", F.col("turn").cast("long"))


@R.add("""
with r as (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank, min((-o_totalprice, o_orderkey)) over (partition by o_custkey) as top from orders)
select o_orderkey, o_custkey, rank from r where rank <= 3 order by rank, top, o_custkey limit 500""")
def rank_cap(t: Tables) -> DataFrame:
    """The 500 first of the customers' three largest orders (the cap is the feature)."""
    rows = units.rank_cap(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", [-F.col("o_totalprice"), F.col("o_orderkey")], 3, 500)
    return rows.select("o_orderkey", "o_custkey", F.col("rank").cast("long").alias("rank"))


ANSWERS = """
ans as (select l_orderkey as paper, l_returnflag as profile, 'q' || l_linenumber as question, 'd' || (l_linenumber % 4) as dim, l_linenumber % 4 < 2 as critical, case when l_orderkey % 3 = 0 then 'systematic-review' else 'cohort' end as design,
  case (l_partkey + l_suppkey) % 5 when 0 then 'yes' when 1 then 'partly' when 2 then 'not found' when 3 then 'can''t tell' else 'yes' end as answer, case when l_returnflag = 'A' or l_orderkey % 3 = 0 then 'High' when l_returnflag = 'N' then 'Moderate' else 'Low' end as start from lineitem),
dims as (select paper, profile, dim, bool_or(critical) as critical, count(*) as n, count(*) filter (answer = 'can''t tell') as open, count(*) filter (answer in ('yes', 'partly')) as met, count(*) filter (answer = 'not found') as lost from ans group by 1, 2, 3),
cnt as (select paper, profile, sum(n) as n, sum(open) as open, count(*) filter (critical and met = 0 and lost > 0) as unmet, count(*) filter (critical and open = n) as unclear, coalesce(sum(lost) filter (not critical), 0) as missing from dims group by 1, 2),
st as (select paper, profile, case max(start) when 'High' then 3 when 'Moderate' then 2 else 1 end as s, max(design) = 'systematic-review' and not (bool_or(question = 'q6' and answer = 'yes') and bool_or(question = 'q7' and answer in ('yes', 'partly'))) as unshown from ans group by 1, 2),
lvl as (select *, least(s, case when unshown then 2 else 3 end, case when unmet >= 2 then 0 when unmet = 1 then 1 else 3 end) - unclear - case when missing >= 2 then 1 else 0 end as i from cnt join st using (paper, profile)),
grades as (select paper, profile, case when 2 * open > n then 'Not appraisable' else list_extract(['Very low', 'Low', 'Moderate', 'High'], cast(greatest(0, i) + 1 as integer)) end as grade from lvl)"""


def _answers(t: Tables) -> DataFrame:
    """Order lines as answers: the order is the paper, the return flag the profile, the line's number the question and its dimension."""
    answer = F.element_at(F.array(*[F.lit(x) for x in ("yes", "partly", "not found", None, "yes")]), ((F.col("l_partkey") + F.col("l_suppkey")) % 5 + 1).cast("int"))
    review, number = F.col("l_orderkey") % 3 == 0, F.col("l_linenumber")
    start = F.when((F.col("l_returnflag") == "A") | review, "High").when(F.col("l_returnflag") == "N", "Moderate").otherwise("Low")
    design = F.when(review, "systematic-review").otherwise("cohort")
    return t.lineitem.select(F.col("l_orderkey").alias("paper"), F.col("l_returnflag").alias("profile"), F.concat(F.lit("q"), number).alias("question"), F.concat(F.lit("d"), number % 4).alias("dim"), (number % 4 < 2).alias("critical"), design.alias("design"), answer.alias("answer"), start.alias("start"))


@R.add(f"with {ANSWERS} select * from grades")
def grade(t: Tables) -> DataFrame:
    return appraise.grade(_answers(t))


@R.add(f"""
with {ANSWERS} select paper, coalesce(list_extract(['Very low', 'Low', 'Moderate', 'High'], cast(min(list_position(['Very low', 'Low', 'Moderate', 'High'], grade)) filter (grade <> 'Not appraisable') as integer)), 'Not appraisable') as grade from grades group by paper""")
def weaker_strand(t: Tables) -> DataFrame:
    return appraise.weaker(appraise.grade(_answers(t)))


EVIDENCE = """
ev as (select l_orderkey // 8 as statement, l_orderkey as paper, case when l_suppkey % 7 = 0 then null else l_suppkey % 5 end as lead, case l_linenumber % 4 when 0 then 'High' when 1 then 'Moderate' when 2 then 'Low' else 'Not appraisable' end as grade, l_returnflag = 'R' as relayed,
  case when l_returnflag = 'R' then 'reported' else 'own' end as origin, case when l_orderkey // 8 % 11 = 0 then null when l_quantity < 40 then 'supports' when l_quantity < 46 then 'partly' else 'does not support' end as verdict,
  case when l_partkey % 9 = 0 then 'place' else 'none' end as gap, l_orderkey // 8 % 22 = 0 as split, p_type as country from lineitem join part on p_partkey = l_partkey)"""


def _evidence(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    kind, statement, quantity = F.col("l_linenumber") % 4, F.floor(F.col("l_orderkey") / 8), F.col("l_quantity")
    level = F.when(kind == 0, "High").when(kind == 1, "Moderate").when(kind == 2, "Low").otherwise("Not appraisable")
    verdict = F.when(statement % 11 == 0, None).when(quantity < 40, "supports").when(quantity < 46, "partly").otherwise("does not support")
    lead = F.when(F.col("l_suppkey") % 7 != 0, (F.col("l_suppkey") % 5).cast("string"))
    runs = F.when(statement % 22 == 0, F.array(F.lit("supports"), F.lit("partly"), F.lit(None)))
    relayed = F.col("l_returnflag") == "R"
    return rows.select(statement.alias("statement"), F.col("l_orderkey").alias("paper"), lead.alias("lead"), level.alias("grade"), relayed.alias("relayed"), F.when(relayed, "reported").otherwise("own").alias("origin"), verdict.alias("verdict"), F.when(F.col("l_partkey") % 9 == 0, "place").otherwise("none").alias("gap"), runs.alias("runs"), F.col("p_type").alias("country"))


@R.add(f"""
with {EVIDENCE}, backs as (select statement, paper, coalesce('l' || lead, 'p' || paper) as who, list_position(['Very low', 'Low', 'Moderate', 'High'], grade) as g from ev where verdict in ('supports', 'partly') and origin <> 'reported'),
l as (select statement, who, max(g) as best from backs group by 1, 2), p as (select statement, count(distinct paper) as papers from backs group by 1),
s as (select statement, count(*) as studies, count(*) filter (best >= 3) as good, count(*) filter (best = 4) as high from l group by 1),
v as (select statement, count(verdict) as checked, count(*) filter (verdict = 'partly') as partly, count(*) filter (verdict = 'does not support') as against, count(*) filter (gap <> 'none') as gaps, bool_or(split) as split from ev group by 1),
c as (select v.*, coalesce(studies, 0) as n, coalesce(good, 0) as good, coalesce(high, 0) as high, coalesce(papers, 0) as np, checked > 0 and against < checked as real from v left join s using (statement) left join p using (statement)),
d as (select *, case when not real then null when n >= 3 and good >= 2 then 'robust' when n >= 2 or n = 1 and high = 1 then 'medium' else 'limited' end as evidence,
  case when not real then null when against > 0 or 2 * partly > checked then 'low' when partly > 0 or gaps > 0 or n < 2 then 'medium' else 'high' end as agreement from c)
select statement, case when real then n else 0 end as studies, case when real then np else 0 end as papers, evidence, agreement,
  case when checked = 0 then case when split then 'runs disagreed' else 'not checked' end when not real then 'not supported by its passages'
    else list_extract(['very low', 'low', 'medium', 'high', 'very high'], cast(list_position(['limited', 'medium', 'robust'], evidence) + list_position(['low', 'medium', 'high'], agreement) - 1 as integer)) end as confidence from d""")
def confidence(t: Tables) -> DataFrame:
    return appraise.confidence(_evidence(t))


@R.add(f"""
with {EVIDENCE} select statement, count(distinct paper) as papers, count(distinct lead) as studies, count(distinct lead) < count(distinct paper) as same_lead, bool_and(relayed) as relayed_only, string_agg(distinct country, ';' order by country) as countries from ev group by statement""")
def plain_fields(t: Tables) -> DataFrame:
    return appraise.plain(_evidence(t))


@R.add("""
with c as (select o_custkey, count(*) as cited from orders group by 1), r as (select c_custkey, cited, row_number() over (order by cited desc nulls last, c_custkey) as rank, count(*) over () as n from customer left join c on o_custkey = c_custkey)
select tier, count(*) as n from (select case when c_custkey % 9 = 0 then 'too recent' when cited is null then 'unknown' when rank = 1 then 'top 1' when rank <= 10 then 'top 10' when 2 * rank <= n then 'upper half' else 'lower half' end as tier from r) group by tier""")
def citation_tier(t: Tables) -> DataFrame:
    """Customers by orders; ranks come from counts of counts, so that no window sees all rows."""
    from pyspark.sql import Window

    cited = t.customer.join(t.orders.groupBy("o_custkey").agg(F.count("*").alias("cited")), F.col("o_custkey") == F.col("c_custkey"), "left")
    sizes = cited.groupBy("cited").agg(F.count("*").alias("m"))
    # a row for each different count of orders, far fewer than customers
    above = sizes.withColumn("above", F.coalesce(F.sum("m").over(Window.orderBy(F.desc_nulls_last("cited")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("cited").orderBy("c_custkey")
    total = cited.count()
    ranked = cited.join(above.withColumnRenamed("cited", "k"), F.col("cited").eqNullSafe(F.col("k"))).withColumn("rank", F.col("above") + F.row_number().over(inside))
    return ranked.groupBy(appraise.citation_tier(F.col("cited"), F.col("rank"), F.lit(total), F.col("c_custkey") % 9 == 0).alias("tier")).agg(F.count("*").alias("n"))
