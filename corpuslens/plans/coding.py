"""Coding and agreement queries. Order lines count as codings: the order is the target, the supplier the coder, the return flag the code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coding, stats
from .base import Registry, Tables

R = Registry()


def _codings(t: Tables) -> DataFrame:
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", F.date_format("l_shipdate", "yyyyMMdd"))
    return t.lineitem.select(F.lit("flags").alias("codebook"), F.col("l_orderkey").alias("target"), F.col("l_suppkey").alias("coder"), F.col("l_partkey").alias("source"), F.col("l_returnflag").alias("code"), F.when(F.col("l_linestatus") == "O", "active").otherwise("retracted").alias("status"), F.col("l_linenumber").alias("seq"), key.alias("coding_id"))




def _codes(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("flags", c) for c in "ANRX"], "codebook string, code string")


@R.add("select 'flags' as codebook, c.code, count(l_orderkey) as applied from (values ('A'), ('N'), ('R'), ('X')) c(code) left join lineitem on l_returnflag = c.code and l_linestatus = 'O' group by c.code")
def code_usage(t: Tables) -> DataFrame:
    return coding.usage(_codings(t), _codes(t))


@R.add("select 'flags' as codebook, l_returnflag as code, count(distinct l_orderkey) as passages, count(distinct l_partkey) as sources, count(distinct l_suppkey) as coders from lineitem where l_linestatus = 'O' group by l_returnflag")
def code_index(t: Tables) -> DataFrame:
    return coding.index(_codings(t))


@R.add("""
with s as (select distinct l_orderkey, l_returnflag from lineitem where l_linestatus = 'O')
select x.l_returnflag as a, y.l_returnflag as b, count(*) as passages from s x join s y on x.l_orderkey = y.l_orderkey and x.l_returnflag < y.l_returnflag group by 1, 2""")
def matrix(t: Tables) -> DataFrame:
    return coding.matrix(_codings(t))


@R.add("""
select 'flags' as codebook, l_orderkey as target, count(distinct l_returnflag) as labels, count(distinct l_suppkey) as coders from lineitem where l_linestatus = 'O'
group by l_orderkey having count(distinct l_returnflag) > 1 and count(distinct l_suppkey) > 1""")
def disagreement(t: Tables) -> DataFrame:
    return coding.disagreement(_codings(t))


@R.add("""
with e as (select user_id, event_type, ts, event_id, lead(event_id) over w as nxt, lag(event_type) over w as before from events window w as (partition by user_id order by ts, event_id))
select user_id as target, event_id as coding_id, case when nxt is null then 'active' else 'superseded' end as status, nxt as superseded_by, coalesce(event_type = before, false) as unchanged from e""")
def code_supersede(t: Tables) -> DataFrame:
    """Each user's events as one coder's answers in time."""
    rows = t.events.select(F.lit("b").alias("codebook"), F.col("user_id").alias("target"), F.lit("c").alias("coder"), F.col("event_type").alias("code"), F.col("event_id").alias("coding_id"), "ts")
    return coding.superseded(rows, "ts", "coding_id").select("target", "coding_id", "status", "superseded_by", "unchanged")


@R.add("""
with e as (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before, min((ts, event_id)) over (partition by user_id, event_type) as first from events)
select user_id as target, arg_max(event_type, (ts, event_id)) as code, count(*) filter (before is null or before <> event_type) as answers,
  count(*) filter ((before is null or before <> event_type) and (ts, event_id) <> first) as revivals from e group by user_id""")
def code_revive(t: Tables) -> DataFrame:
    rows = t.events.select(F.lit("b").alias("codebook"), F.col("user_id").alias("target"), F.lit("c").alias("coder"), F.col("event_type").alias("code"), "ts", "event_id")
    return coding.revived(rows, "ts", "event_id").select("target", "code", "answers", "revivals")


@R.add("""
select o_orderkey as coding_id, case when o_orderstatus = 'P' then 'refused' when o_orderkey % 10 = 0 then 'missing' when o_orderstatus = 'F' then 'retracted' when o_orderpriority = '1-URGENT' then 'unchanged' else 'recoded' end as result,
  case when o_orderstatus <> 'P' and o_orderkey % 10 <> 0 and o_orderstatus <> 'F' and o_orderpriority <> '1-URGENT' then '1-URGENT' when o_orderkey % 10 = 0 then null else o_orderpriority end as code from orders""")
def recode(t: Tables) -> DataFrame:
    """A correction for every order: priority 1-URGENT, or retraction for those finished; no reason is given for those in progress, and the tenth orders have no coding."""
    o = t.orders
    codings = o.where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("coding_id"), F.col("o_orderpriority").alias("code"))
    changes = o.select(F.col("o_orderkey").alias("coding_id"), F.when(F.col("o_orderstatus") != "F", "1-URGENT").alias("to"), (F.col("o_orderstatus") == "F").alias("retract"), F.when(F.col("o_orderstatus") != "P", "checked").alias("why"))
    return coding.recode(codings, changes)


def _tree(t: Tables) -> DataFrame:
    """Nations under their regions' numbers shifted, regions under the world."""
    n = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("code"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    r = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("code"), F.lit("world").alias("parent"))
    return n.union(r).union(t.spark.createDataFrame([("world", None)], "code string, parent string"))


@R.add("""
with a as (select 'n' || n_nationkey as code, 'n' || n_nationkey as up, n_nationkey from nation union all select 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey from nation union all select 'n' || n_nationkey, 'world', n_nationkey from nation),
c as (select 'n' || c_nationkey as code, c_custkey from customer)
select a.up as code, count(distinct case when a.up = c.code then c_custkey end) as own, count(distinct c_custkey) as total from c join a on c.code = a.code group by a.up""")
def rollup_codes(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_custkey").alias("target"), F.concat(F.lit("n"), "c_nationkey").alias("code"))
    return coding.rollup(rows, _tree(t))


@R.add("select 'n' || n_nationkey as code, 2 as depth from nation union all select 'r' || r_regionkey, 1 from region union all select 'world', 0")
def code_depth(t: Tables) -> DataFrame:
    return coding.ancestors(_tree(t)).groupBy("code").agg(F.max("depth").alias("depth"))


@R.add("select 'c' || (n_nationkey % 5) as code from nation where n_nationkey < 5")
def codebook_cycle(t: Tables) -> DataFrame:
    """Five codes in a ring, the other nations hanging from it."""
    ring = t.nation.select(F.concat(F.lit("c"), "n_nationkey").alias("code"), F.concat(F.lit("c"), F.when(F.col("n_nationkey") < 5, (F.col("n_nationkey") + 1) % 5).otherwise(F.lit(0))).alias("parent"))
    return coding.cycles(ring)


@R.add("""
with p as (select quality as a, toxic as b from labels where quality is not null and toxic is not null), n as (select count(*) as n, avg(case when a = b then 1.0 else 0 end) as po from p),
e as (select sum(x.c * y.c) as pe from (select a, count(*)::double / (select n from n) as c from p group by a) x join (select b, count(*)::double / (select n from n) as c from p group by b) y on x.a = y.b)
select n, round(po, 9) as agreement, round((po - pe) / (1 - pe), 9) as kappa from n, e""")
def kappa(t: Tables) -> DataFrame:
    found = stats.kappa(t.labels.select(F.col("quality").alias("a"), F.col("toxic").alias("b")))
    return found.select("n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


def _pairs(t: Tables) -> DataFrame:
    """The first two lines of an order: their discounts in hundredths."""
    return t.lineitem.groupBy("l_orderkey").agg(F.max(F.when(F.col("l_linenumber") == 1, F.round(F.col("l_discount") * 100))).alias("a"), F.max(F.when(F.col("l_linenumber") == 2, F.round(F.col("l_discount") * 100))).alias("b"), F.max(F.when(F.col("l_linenumber") == 3, F.round(F.col("l_discount") * 100))).alias("c"))


PAIRS = "with p as (select l_orderkey, max(round(l_discount * 100)) filter (l_linenumber = 1) as a, max(round(l_discount * 100)) filter (l_linenumber = 2) as b, max(round(l_discount * 100)) filter (l_linenumber = 3) as c from lineitem group by 1)"


@R.add(f"""
{PAIRS}, q as (select a, b from p where a is not null and b is not null), ca as (select a, count(*) as n from q group by a), cb as (select b, count(*) as n from q group by b),
s as (select sum(abs(a - b)) / 10 as seen, count(*) as n from q), e as (select sum(abs(a - b) * ca.n * cb.n) / 10.0 as far from ca, cb)
select n, round(1 - (seen / n) / (far / n / n), 9) as kappa from s, e""")
def weighted_kappa(t: Tables) -> DataFrame:
    return stats.weighted_kappa(_pairs(t), 0, 10).select("n", F.round("kappa", 9).alias("kappa"))


@R.add(f"""
{PAIRS}, q as (select a, b from p where a is not null and b is not null), v as (select x, count(*) as n from (select a as x from q union all select b from q) group by x),
m as (select sum(n) as m, sum(n * n)::double as sq from v), s as (select count(*) as n, sum(case when a <> b then 2 else 0 end) as off from q)
select n, round(1 - off::double / m / ((m * m - sq) / (m * (m - 1.0))), 9) as alpha from s, m""")
def alpha_nominal(t: Tables) -> DataFrame:
    return stats.alpha_nominal(_pairs(t)).select("n", F.round("alpha", 9).alias("alpha"))


@R.add(f"""
{PAIRS}, r as (select l_orderkey as item, unnest([a, b, c]) as label from p), k as (select item, label, count(*) as n from r where label is not null group by 1, 2),
i as (select item, sum(n) as r, sum(n * (n - 1)) as agree, max(n) as top from k group by item having sum(n) > 1),
w as (select label, sum(k.n::double / i.r) / (select count(*) from i) as p from k join i on k.item = i.item group by label),
x as (select count(*) as items, avg(agree::double / (r * (r - 1))) as pa, avg(case when top = r then 1.0 else 0 end) as al from i), e as (select sum(p * p) as pe, sum(p * (1 - p)) / (greatest(2, count(*)) - 1) as pg from w)
select items, round(al, 9) as all_agree, round((pa - pe) / (1 - pe), 9) as fleiss, round((pa - pg) / (1 - pg), 9) as ac1 from x, e""")
def fleiss_ac1(t: Tables) -> DataFrame:
    ratings = _pairs(t).select(F.col("l_orderkey").alias("item"), F.explode(F.array("a", "b", "c")).alias("label"))
    return stats.fleiss_ac1(ratings).select("items", *[F.round(c, 9).alias(c) for c in ("all_agree", "fleiss", "ac1")])


@R.add("""
with k as (select l_orderkey, l_returnflag, count(*) as n from lineitem group by 1, 2)
select l_orderkey, cast(sum(n) as bigint) as votes, case when 2 * max(n) > sum(n) then arg_max(l_returnflag, n) end as majority from k group by l_orderkey""")
def majority(t: Tables) -> DataFrame:
    return stats.majority(t.lineitem.select("l_orderkey", F.col("l_returnflag").alias("label")), ["l_orderkey"])


@R.add("""
with s as (select l_orderkey, list_distinct(list(l_returnflag) filter (l_linenumber % 2 = 1)) as a, list_distinct(list(l_returnflag) filter (l_linenumber % 2 = 0)) as b from lineitem group by 1),
t as (select l_orderkey, coalesce(a, []) as a, coalesce(b, []) as b from s)
select l_orderkey, round(case when len(list_distinct(list_concat(a, b))) = 0 then 1.0 else len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) end, 9) as jaccard from t""")
def jaccard(t: Tables) -> DataFrame:
    side = lambda odd: F.collect_set(F.when(F.col("l_linenumber") % 2 == odd, F.col("l_returnflag")))
    sets = t.lineitem.groupBy("l_orderkey").agg(side(1).alias("a"), side(0).alias("b"))
    return sets.select("l_orderkey", F.round(stats.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"))


@R.add("""
with g as (select l_suppkey, count(*)::double as n, count(*) filter (l_returnflag = 'R')::double as h from lineitem group by 1)
select l_suppkey, round(greatest(0, (h / n + 1.9208 / n - 1.96 * sqrt(h / n * (1 - h / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)), 9) as low,
  round(least(1, (h / n + 1.9208 / n + 1.96 * sqrt(h / n * (1 - h / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)), 9) as high from g""")
def wilson(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("h"))
    w = stats.wilson(F.col("h"), F.col("n"))
    return g.select("l_suppkey", F.round(w["low"], 9).alias("low"), F.round(w["high"], 9).alias("high"))


@R.add()
def bootstrap_kappa(t: Tables) -> DataFrame:
    """Resampled by hash, so tests hold it against the point value."""
    return stats.bootstrap(t.labels.select(F.col("quality").alias("a"), F.col("toxic").alias("b")))
