"""Report queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reports
from .base import Registry, Tables

R = Registry()


@R.add("""
select c_custkey as cust, coalesce(n, 0) as orders, coalesce(m, 0) as visits from customer left join (select o_custkey, count(*) as n from orders group by 1) o on o_custkey = c_custkey
left join (select user_id, count(*) as m from events group by 1) e on user_id = c_custkey""")
def corpus_counts(t: Tables) -> DataFrame:
    return reports.counts(t.customer.select(F.col("c_custkey").alias("cust")), "cust", orders=t.orders.select(F.col("o_custkey").alias("cust")), visits=t.events.select(F.col("user_id").alias("cust")))


def _codings(t: Tables) -> DataFrame:
    return t.lineitem.select(F.concat("l_returnflag", F.lit("-"), F.col("l_quantity").cast("int").cast("string")).alias("code"), F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("coder"))


@R.add("""
with c as (select l_returnflag || '-' || cast(l_quantity as integer) as code, l_suppkey as source, l_linenumber as coder from lineitem), k as (select 'N-' || i as code from range(0, 61) r(i)),
a as (select code, count(*) as codings, count(distinct source) as sources, count(distinct coder) as coders from c group by 1)
select code, coalesce(codings, 0) as codings, coalesce(sources, 0) as sources, coalesce(coders, 0) as coders, round(case when sources > 0 then codings::double / sources else 0 end, 3) as per_source from k left join a using (code)""")
def coding_report(t: Tables) -> DataFrame:
    """Codes of one flag, sixty of them, some of which nobody uses."""
    codes = t.spark.range(61).select(F.concat(F.lit("N-"), "id").alias("code"))
    return reports.coding_report(_codings(t), codes, t.supplier.select(F.col("s_suppkey").alias("source")))[0]


@R.add("select s_suppkey as source from supplier where s_suppkey not in (select l_suppkey from lineitem where l_quantity > 49)")
def quiet_sources(t: Tables) -> DataFrame:
    some = _codings(t).where("split_part(code, '-', 2) = '50'")
    return reports.coding_report(some, some, t.supplier.select(F.col("s_suppkey").alias("source")))[1]


@R.add("select event_type, lower(props) as props, count(*) as n from events group by 1, 2 order by n desc, event_type, props limit 30")
def top_labels(t: Tables) -> DataFrame:
    """The thirty commonest pairs (the cut is the report's)."""
    return reports.tally(t.events.select("event_type", F.lower("props").alias("props")), "event_type", "props", most=30)


@R.add("""
select year(o_orderdate) as year, count(*) filter (o_orderkey % 4 >= 2) as relevant, count(*) as screened, round(count(*) filter (o_orderkey % 4 >= 2)::double / count(*), 4) as share from orders group by 1""")
def relevance_by_year(t: Tables) -> DataFrame:
    return reports.relevance_by_year(t.orders.select(F.year("o_orderdate").alias("year"), (F.col("o_orderkey") % 4).alias("r")))


@R.add("""
with z as (select o_orderkey, o_custkey % 7 as row_r, row_number() over (order by o_totalprice, o_orderkey) - 1 as i, count(*) over () as n from orders where o_orderkey % 4 = 0),
s as (select o_orderkey, row_r, least(4, i * 5 // n) as stratum from z), b as (select stratum, count(*) as size from s group by 1),
p as (select stratum, count(*) as n, count(*) filter (row_r >= 5) as m, max(size) as size from s join b using (stratum) where o_orderkey % 3 = 0 group by 1),
a as (select sum(n) as n, sum(m) as m, sum(m::double / n * size) / sum(size) as w from p)
select cast(n as bigint) as rescreened, cast(m as bigint) as missed, round(greatest(0, (m / n + 1.9208 / n - 1.96 * sqrt(m / n * (1 - m / n) / n + 0.9604 / n / n)) / (1 + 3.8416 / n)), 6) as low,
  round(least(1, (m / n + 1.9208 / n + 1.96 * sqrt(m / n * (1 - m / n) / n + 0.9604 / n / n)) / (1 + 3.8416 / n)), 6) as high, round(w, 6) as weighted from (select n::double as n, m::double as m, w from a)""")
def calibration(t: Tables) -> DataFrame:
    """Orders left out, in fifths by price; a third of each is rated again."""
    zeros = t.orders.where("o_orderkey % 4 = 0").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 7).alias("row_r"))
    placed = reports.strata(zeros, "o_totalprice", "o_orderkey")
    sizes = placed.groupBy("stratum").agg(F.count("*").alias("stratum_size"))
    return reports.calibration(placed.join(sizes, "stratum").where("o_orderkey % 3 = 0"), 5)


@R.add("""
with r as (select event_type, event_id % 4 as t, (event_id // 3) % 4 as f from events), n as (select event_type, count(*) filter (t >= 2 and f >= 2)::double as b, count(*) filter (f >= 2)::double as f, count(*) filter (t >= 2)::double as t from r group by 1)
select event_type, round(b / f, 6) as precision, round(greatest(0, (b / f + 1.9208 / f - 1.96 * sqrt(b / f * (1 - b / f) / f + 0.9604 / f / f)) / (1 + 3.8416 / f)), 6) as precision_low,
  round(least(1, (b / f + 1.9208 / f + 1.96 * sqrt(b / f * (1 - b / f) / f + 0.9604 / f / f)) / (1 + 3.8416 / f)), 6) as precision_high, round(b / t, 6) as recall,
  round(greatest(0, (b / t + 1.9208 / t - 1.96 * sqrt(b / t * (1 - b / t) / t + 0.9604 / t / t)) / (1 + 3.8416 / t)), 6) as recall_low,
  round(least(1, (b / t + 1.9208 / t + 1.96 * sqrt(b / t * (1 - b / t) / t + 0.9604 / t / t)) / (1 + 3.8416 / t)), 6) as recall_high from n""")
def precision_recall(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", (F.col("event_id") % 4).alias("truth"), (F.floor(F.col("event_id") / 3) % 4).alias("found"))
    return reports.precision_recall(rows, ["event_type"])


@R.add("""
with a as (select l_returnflag as field, l_orderkey as unit, case when l_linenumber % 2 = 0 then 'b; a' else 'a;b' end as v, l_quantity > 45 as odd from lineitem),
k as (select field, unit, count(*) as n, count(distinct case when odd then 'c' else 'a;b' end) as kinds from a group by 1, 2 having count(*) > 1)
select field, count(*) as units, count(*) filter (kinds = 1) as same, round(count(*) filter (kinds = 1)::double / count(*), 6) as rate from k group by 1""")
def same_answers(t: Tables) -> DataFrame:
    """Order lines as runs; two spellings of one list are one answer."""
    value = F.when(F.col("l_quantity") > 45, "c").when(F.col("l_linenumber") % 2 == 0, "b; a").otherwise("a;b")
    return reports.same_answers(t.lineitem.select(F.col("l_returnflag").alias("field"), F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("run"), value.alias("value")))


@R.add("""
with v as (select l_orderkey as unit, 'flag' as field, l_returnflag as label from lineitem union all select l_orderkey, 'status', l_linestatus from lineitem), c as (select unit, field, label, count(*) as n from v group by 1, 2, 3)
select unit, field, cast(sum(n) as bigint) as votes, max(label) filter (2 * n > total) as majority from (select *, sum(n) over (partition by unit, field) as total from c) group by 1, 2""")
def field_votes(t: Tables) -> DataFrame:
    return reports.votes(t.lineitem.select(F.col("l_orderkey").alias("unit"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")), "unit", ["flag", "status"])


@R.add("""
with s as (select p_brand as theme, case p_size % 6 when 0 then 'well' when 1 then 'well' when 2 then 'some' when 3 then 'limited' when 4 then 'weak' end as w from part)
select theme, count(*) filter (w = 'well') as well, count(*) filter (w = 'some') as some, count(*) filter (w = 'limited') as "limited", count(*) filter (w = 'weak') as weak, count(*) as statements,
  round(count(*) filter (w in ('well', 'some'))::double / count(*), 4) as good_share, count(*) < 8 as thin from s group by 1""")
def evidence_map(t: Tables) -> DataFrame:
    labels = ("very high", "high", "medium", "low", "very low", "not checked")
    level = F.element_at(F.array(*[F.lit(x) for x in labels]), (F.col("p_size") % 6 + 1).cast("int"))
    return reports.evidence_map(t.part.select(F.col("p_brand").alias("theme"), level.alias("confidence")), 8)


@R.add("""
with c as (select l_orderkey, count(distinct l_suppkey % 3) as n from lineitem group by 1) select count(*) as claims, count(*) filter (n = 1) as single, round(count(*) filter (n = 1)::double / count(*), 6) as share from c""")
def single_source(t: Tables) -> DataFrame:
    return reports.single_source(t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.col("l_suppkey") % 3).alias("source_ids")))


@R.add("""
select year(o_orderdate) as year, count(*) filter (o_orderpriority = '1-URGENT') as "1-URGENT", count(*) filter (o_orderpriority = '2-HIGH') as "2-HIGH", count(*) as total from orders group by 1""")
def timeline(t: Tables) -> DataFrame:
    return reports.timeline(t.orders.select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("thread")), ["1-URGENT", "2-HIGH"])


@R.add("""
with d as (select date_diff('day', date '1970-01-01', o_orderdate::date) as year, count(*) as total from orders group by 1), m as (select *, total < 5 and lag(total < 5) over w and lag(year) over w = year - 1 as same from d window w as (order by year)),
r as (select *, sum(case when same then 0 else 1 end) over (order by year) as run from m) select min(year) as first, max(year) as last, cast(sum(total) as bigint) as total from r group by run""")
def sparse_merged(t: Tables) -> DataFrame:
    """Days in the place of years: neighbouring ones of under five orders are one row."""
    days = t.orders.groupBy(F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("long").alias("year")).agg(F.count("*").alias("total"))
    return reports.sparse_merged(days, 5)


@R.add("""
with p as (select conv_id as doc, turn, list_filter(string_split('Report ' || conv_id || ' page ' || turn || chr(10) || coalesce(text, '') || chr(10) || case when turn % 3 = 0 then 'Draft' else 'Own' || turn end, chr(10)), lambda x: trim(x) <> '') as l from conversations),
e as (select doc, turn, unnest(list_distinct(list_transform(list_filter(list_concat(l[1:3], l[-3:]), lambda x: length(trim(x)) > 3), lambda x: lower(regexp_replace(trim(regexp_replace(x, '\\s+', ' ', 'g')), '[0-9]+', '#', 'g'))))) as key from p),
n as (select doc, count(*) as a from p group by 1 having count(*) >= 3) select e.doc, key, count(*) as pages from e join n using (doc) group by e.doc, key, a having count(*) >= greatest(3, cast(floor(a * 0.34) as bigint))""")
def running_lines(t: Tables) -> DataFrame:
    """Turns as pages with a head line, and a foot line on some of them."""
    head = F.concat(F.lit("Report "), "conv_id", F.lit(" page "), "turn", F.lit("\n"))
    foot = F.when(F.col("turn") % 3 == 0, "Draft").otherwise(F.concat(F.lit("Own"), "turn"))
    pages = t.conversations.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.concat(head, F.coalesce("text", F.lit("")), F.lit("\n"), foot).alias("text"))
    return reports.running_lines(pages)


@R.add("select o_custkey as cust, count(*) as n, sha256(string_agg(o_orderkey::varchar || ' ' || o_orderstatus, chr(10) order by o_orderkey::varchar || ' ' || o_orderstatus)) as sha256 from orders group by 1")
def export_fingerprint(t: Tables) -> DataFrame:
    return reports.fingerprint(t.orders.select(F.col("o_custkey").alias("cust"), "o_orderkey", "o_orderstatus"), ["cust"], F.concat_ws(" ", "o_orderkey", "o_orderstatus"))


_NAMED = lambda names: ", ".join(f"'{x}'" for x in names)


@R.add(f"""
with c as (select c_custkey, c_mktsegment, lower(n.n_name) as a, case when c_custkey % 3 = 0 then lower(m.n_name) end as b
  from customer join nation n on c_nationkey = n.n_nationkey join nation m on (c_nationkey + 7) % 25 = m.n_nationkey),
r as (select *, case when a in ({_NAMED(reports.US_NAMES)}) or coalesce(b in ({_NAMED(reports.US_NAMES)}), false) then 'us'
  when a in ({_NAMED(reports.EUROPE_NAMES)}) or coalesce(b in ({_NAMED(reports.EUROPE_NAMES)}), false) then 'europe' else 'elsewhere' end as region from c)
select c_custkey, region, case when region = 'europe' and c_mktsegment = 'BUILDING' then 'target' when region = 'europe' or c_mktsegment = 'BUILDING' then 'near' else 'other' end as setting from r""")
def regions_and_settings(t: Tables) -> DataFrame:
    """Customers' nations; every third customer names a second one. The nations' table is 25 rows."""
    n = t.nation.select("n_nationkey", "n_name")
    other = n.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("second"))
    rows = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(other, (F.col("c_nationkey") + 7) % 25 == F.col("k2"))
    place = F.concat_ws(" / ", "n_name", F.when(F.col("c_custkey") % 3 == 0, F.col("second")))
    region = reports.region_of(place).alias("region")
    return rows.select("c_custkey", region, reports.setting_of(F.col("c_mktsegment"), F.array(place), ["BUILDING"], ["europe"]).alias("setting"))


@R.add("""
with w as (select o_orderkey, o_orderdate::date as d, date '1998-06-15' as a, case when o_orderkey % 5 = 0 then null else (o_orderkey % 100) / 100.0 end as p from orders)
select o_orderkey, case when (year(a) - year(d)) * 12 + month(a) - month(d) - (day(a) < day(d))::int < 24 then 'too-recent' when p is null then 'not-indexed' when p >= 0.99 then 'top-1' when p >= 0.9 then 'top-10' when p >= 0.5 then 'above-median' else 'below-median' end as tier from w""")
def work_tiers(t: Tables) -> DataFrame:
    p = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 100 / 100)
    return t.orders.select("o_orderkey", reports.citation_tier(F.to_date("o_orderdate"), F.lit("1998-06-15").cast("date"), p, p >= 0.99, p >= 0.9).alias("tier"))
