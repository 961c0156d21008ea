"""Tables of strings: column facts, keys, links between tables."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

#: Shapes of trimmed cells. A list is a cell with a semicolon whose parts are all tokens.
SHAPES = {
    "int": r"^-?\d+$",
    "number": r"^-?\d+(\.\d+)?([eE]-?\d+)?$",
    "bool": r"(?i)^(true|false|yes|no|0|1|y|n|t|f)$",
    "date": r"^\d{4}-\d{2}-\d{2}",
    "url": r"(?i)^https?://",
    "newline": r"\n",
}
TOKEN = r"^[A-Za-z]{0,3}[\w.-]{1,40}$"
#: Types of whole numbers, whose text tells them apart as they are.
INTEGERS = ("tinyint", "smallint", "int", "bigint")
#: Columns whose set is one long.
BITS = 63
#: How quotations of others are marked.
QUOTE_STYLES = {"xenforo": r"(?m)^.{1,80} said:\s*$|Click to expand\.\.\.", "markdown": r"(?m)^\s*>", "email": r"(?m)^On .{5,120} wrote:\s*$"}


def cell(c: Column, kind: str) -> Column:
    """A cell as text: null as empty, booleans by name, lists joined, nested values as JSON."""
    if kind == "boolean":
        text = F.when(c, "True").otherwise("False")
    elif kind.startswith("array<") and kind[6:-1] in ("string", "int", "bigint", "double", "float", "boolean"):
        text = F.array_join(F.transform(c, lambda x: x.cast("string")), ";")
    elif kind.startswith(("array<", "struct<", "map<")):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(F.when(c.isNotNull(), text), F.lit(""))


def as_strings(df: DataFrame) -> DataFrame:
    return df.select(*[cell(F.col(f"`{n}`"), k).alias(n) for n, k in df.dtypes])


def percentile_of(lengths: Column, n: Column, p: float) -> Column:
    """The value at index round_half_even(p (n - 1)) of the lengths, given as sorted (length, count) pairs."""
    at = F.bround(F.lit(p) * (n - 1)).cast("long")
    step = F.aggregate(lengths, F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("hit")), lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.coalesce(s["hit"], F.when(s["seen"] + x["n"] > at, x["length"])).alias("hit")))
    return step["hit"]


def list_parts(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ";"), lambda x: F.btrim(x)), lambda x: x != "")


def column_facts(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each column of tables: t, column, rows, filled, fill, distinct, unique, lengths (p50, p90, max), shares of shapes,
    quote_blocks (styles met in 2 % of the cells or more, where the p90 length is 40 or more).

    All tables go through one chain of aggregations: cells by value, so a shape is looked at once for each different value, values by
    length, so a column is a list of as many pairs as it has different lengths."""
    facts, names = _facts(_values(tables)), _columns(tables)
    return facts.select(_name(names, 0, "c").alias("t"), _name(names, 1, "c").alias("column"), *[c for c in facts.columns if c != "c"])


def _columns(tables: dict[str, DataFrame]) -> list[tuple[str, str]]:
    """The tables' columns; their places here are their numbers."""
    return [(t, c) for t, df in tables.items() for c in df.columns]


def _name(names: list[tuple[str, str]], part: int, number: str) -> Column:
    """The table (0) or the column (1) of a column's number."""
    return F.element_at(F.array(*[F.lit(x[part]) for x in names]), F.col(number) + 1)


def _values(tables: dict[str, DataFrame]) -> DataFrame:
    """(c, value, n): the different cells of each column, by its number, as text, and how often each stands. Whole numbers are grouped as
    numbers and become text once each, the others are grouped by their text."""
    names = _columns(tables)
    rows: dict[bool, DataFrame] = {}
    for t, df in tables.items():
        for whole in (True, False):
            given = [(n, k) for n, k in df.dtypes if (k in INTEGERS) == whole]
            if given:
                cells = [(F.col(f"`{n}`").cast("long") if whole else cell(F.col(f"`{n}`"), k)).alias(str(names.index((t, n)))) for n, k in given]
                long = df.select(*cells).unpivot([], [str(names.index((t, n))) for n, _ in given], "c", "value")
                rows[whole] = rows[whole].union(long) if whole in rows else long
    grouped = [x.groupBy("c", "value").agg(F.count("*").alias("n")).select(F.col("c").cast("int").alias("c"), cell(F.col("value"), "string").alias("value"), "n") for x in rows.values()]
    return reduce(DataFrame.union, grouped)


def _facts(values: DataFrame) -> DataFrame:
    trimmed = F.btrim("value", F.lit(" \t\n\r\f\x0b"))
    filled = trimmed != ""
    weighed = lambda test: F.sum(F.when(filled & test, F.col("n")).otherwise(0))
    parts = list_parts(F.col("value"))
    listed = F.col("value").contains(";") & F.forall(parts, lambda x: x.rlike(TOKEN))
    tests = {f"n_{k}": (F.col("value") if k == "newline" else trimmed).rlike(v) for k, v in SHAPES.items()} | {"n_list": listed} | {f"n_{k}": F.col("value").rlike(v) for k, v in QUOTE_STYLES.items()}
    per = values.groupBy("c", F.when(filled, F.length("value")).alias("length")).agg(F.sum("n").alias("n"), F.count(F.when(filled, 1)).alias("distinct"), *[weighed(x).alias(k) for k, x in tests.items()])
    has = F.col("length").isNotNull()
    out = per.groupBy("c").agg(
        F.sum("n").alias("rows"), F.sum(F.when(has, F.col("n")).otherwise(0)).alias("filled"), F.sum("distinct").alias("distinct"),
        F.array_sort(F.collect_list(F.when(has, F.struct("length", "n")))).alias("lengths"), F.coalesce(F.max("length"), F.lit(0)).alias("len_max"), *[F.sum(k).alias(k) for k in tests],
    )
    share = lambda c: F.round(F.when(F.col("filled") > 0, F.col(c) / F.col("filled")).otherwise(0.0), 3)
    out = out.withColumns({"len_p50": percentile_of(F.col("lengths"), F.col("filled"), 0.5), "len_p90": percentile_of(F.col("lengths"), F.col("filled"), 0.9)})
    out = out.withColumns({"fill": F.round(F.col("filled") / F.col("rows"), 3), "unique": (F.col("filled") > 0) & (F.col("distinct") == F.col("filled")) & (F.col("filled") == F.col("rows"))})
    out = out.withColumns({f"share_{k}": share(f"n_{k}") for k in (*SHAPES, "list")})
    marks = F.filter(F.array(*[F.when((F.col("len_p90") >= 40) & (F.col(f"n_{k}") > 0) & (F.col(f"n_{k}") >= 0.02 * F.col("filled")), F.struct(F.lit(k).alias("style"), F.col(f"n_{k}").alias("n"))) for k in QUOTE_STYLES]), lambda x: x.isNotNull())
    return out.withColumn("quote_blocks", marks).drop("lengths", *tests)


def is_key() -> Column:
    """Of column_facts' rows: every cell filled, all different, short, in one line, not nearly all dates, three rows at least."""
    return F.col("unique") & (F.col("len_max") <= 80) & (F.col("share_newline") == 0) & (F.col("share_date") < 0.9) & (F.col("rows") >= 3)


def prefix_of(c: Column) -> Column:
    """The up to three letters before a value's digits, or none."""
    return F.regexp_extract(c, "^([A-Za-z]{1,3})\\d", 1)


def without_prefix(c: Column) -> Column:
    """`AB12` as `12`: up to three letters before digits go."""
    return F.regexp_replace(c, "^[A-Za-z]{1,3}(?=\\d)", "")


def apply_transform(value: Column, strip: Column, add: Column) -> Column:
    """A value with the prefix `strip` taken off where it has that one, and the prefix `add` before it; null prefixes: as it is."""
    return F.when(strip.isNull(), value).otherwise(F.concat(F.coalesce(add, F.lit("")), F.when((strip != "") & (prefix_of(value) == strip), without_prefix(value)).otherwise(value)))


def _short_columns(tables: dict[str, DataFrame], most: int = 400) -> dict[str, DataFrame]:
    """The tables' columns without a cell of over `most` code points: one row a table comes to the driver. Whole numbers are never as long."""
    longest = lambda given: F.to_json(F.array(*[F.coalesce(F.max(F.length(cell(F.col(f"`{c}`"), k))), F.lit(0)) for c, k in given])).alias("n")
    open_ = {t: given for t, df in tables.items() if (given := [(c, k) for c, k in df.dtypes if k not in INTEGERS])}
    rows = reduce(DataFrame.unionByName, [tables[t].agg(longest(given)).withColumn("t", F.lit(t)) for t, given in open_.items()]).collect() if open_ else []
    long = {(r["t"], c) for r in rows for (c, _), n in zip(open_[r["t"]], json.loads(r["n"]), strict=True) if n > most}
    kept = {t: [c for c in df.columns if (t, c) not in long] for t, df in tables.items()}
    return {t: df.select(*[F.col(f"`{c}`") for c in kept[t]]) for t, df in tables.items() if kept[t]}


def _met(values: DataFrame, facts: DataFrame, n: int) -> DataFrame:
    """(s, n, strip, plain, froms, tos): for each token of the `n` columns, the columns that have it among their tokens (froms) and, if they
    are keys, among their values (tos). Tokens alike but for prefixes (`strip`) lie together under one s; groups that are alike in prefixes and
    columns are counted (n), so that there are about as many rows as ways in which columns share values.

    Every token crosses one shuffle, by what is left of it without its prefix, and sets of columns are bits; a group has a prefix once."""
    role = lambda r, token: F.struct(r.alias("role"), token.alias("token"))
    own = F.array(role(F.when(F.col("key"), 3).otherwise(1), F.btrim("value")))
    parts = F.concat(F.transform(list_parts(F.col("value")), lambda x: role(F.lit(1), x)), F.when(F.col("key"), F.array(role(F.lit(2), F.btrim("value")))).otherwise(F.array().cast("array<struct<role:int,token:string>>")))
    open_ = facts.where("filled > 0 and len_max <= 400").select("c", "as_list", "key", F.expr(f"shiftleft(1L, c % {BITS})").alias("bit"))
    rows = values.join(F.broadcast(open_), "c").select("c", "bit", F.explode(F.when(F.col("as_list"), parts).otherwise(own)).alias("x")).select("c", "bit", "x.*").where("token <> ''")
    rows = rows.withColumn("strip", prefix_of(F.col("token"))).select("c", "bit", "role", "strip", F.when(F.col("strip") == "", F.col("token")).otherwise(without_prefix(F.col("token"))).alias("bare"))
    sets = {f"{side}{w}": F.coalesce(F.bit_or(F.when((F.floor(F.col("c") / BITS) == w) & (F.col("role").bitwiseAND(r) > 0), F.col("bit"))), F.lit(0).cast("long")) for side, r in (("f", 1), ("k", 2)) for w in range(-(-n // BITS))}
    tokens = rows.repartition("bare").groupBy("bare", "strip").agg(*[x.alias(k) for k, x in sets.items()])
    group = F.array_sort(F.collect_list(F.struct("strip", F.concat("strip", "bare").rlike(TOKEN).alias("plain"), *sets)))
    groups = checkpointed(tokens.groupBy("bare").agg(group.alias("x")).groupBy("x").agg(F.count("*").alias("n")).withColumn("s", F.monotonically_increasing_id()))
    of = lambda side: F.array_compact(F.array(*[F.when(F.col(f"x.{side}{i // BITS}").bitwiseAND(1 << i % BITS) != 0, F.lit(i)) for i in range(n)]))
    return groups.select("s", "n", F.explode("x").alias("x")).select("s", "n", "x.strip", "x.plain", of("f").alias("froms"), of("k").alias("tos"))


def find_links(tables: dict[str, DataFrame], least: float = 0.5, whole: float = 0.9) -> DataFrame:
    """(from_table, from_column, to_table, to_column, containment, partial, as_list, strip, add): columns whose values lie in another column's
    unique values, in the same table or in another one.

    Cells are split at semicolons where the column has lists. A column counts if it has five different tokens, or as many as rows, all of
    them token-like and no cell over 400 characters. Where less than `whole` of the tokens are found, prefixes of letters are taken off
    both sides; the commonest pair of prefixes is named. All columns meet in one grouping of all tokens, not in a join for each pair. Columns
    with longer cells are weighed out before any cell is a key; values, facts and groups of tokens are written once each."""
    tables = _short_columns(tables)
    names = _columns(tables)
    values = checkpointed(_values(tables))
    facts = checkpointed(_facts(values).select("c", "rows", "filled", "len_max", (F.col("share_list") > 0).alias("as_list"), is_key().alias("key")))
    met = _met(values, facts, len(names))
    sizes = met.select("n", "plain", F.explode("froms").alias("from")).groupBy("from").agg(F.sum("n").alias("n"), F.bool_and("plain").alias("plain"))
    sizes = sizes.join(F.broadcast(facts.select(F.col("c").alias("from"), "rows", "as_list")), "from").where("plain and n >= least(5, rows)").select("from", "as_list", "n")
    pair, other = ["from", "to"], F.col("from") != F.col("to")
    direct = met.select("n", "tos", F.explode("froms").alias("from")).select("n", "from", F.explode("tos").alias("to")).where(other).groupBy(*pair).agg(F.sum("n").alias("hits"))
    adds = met.select("s", "strip", F.explode("tos").alias("to")).groupBy("s", "to").agg(F.min("strip").alias("add"))
    loose = met.select("s", "n", "strip", F.explode("froms").alias("from")).join(adds, "s").where(other).groupBy(*pair, "strip", "add").agg(F.sum("n").alias("m"))
    loose = loose.groupBy(*pair).agg(F.sum("m").alias("loose"), F.max_by(F.struct("strip", "add"), F.struct("m", "strip", "add")).alias("prefix"))
    both = direct.join(loose, pair, "full").join(F.broadcast(sizes), "from")
    hits = F.coalesce("hits", F.lit(0))
    better = (hits < whole * F.col("n")) & (F.coalesce("loose", F.lit(0)) > hits)
    found = both.withColumn("share", F.when(better, F.col("loose")).otherwise(hits) / F.col("n")).where(F.col("share") >= least)
    ends = [_name(names, i, side).alias(f"{side}_{k}") for side in pair for i, k in enumerate(("table", "column"))]
    return found.select(*ends, F.round("share", 3).alias("containment"), (F.col("share") < whole).alias("partial"), "as_list", F.when(better, F.col("prefix.strip")).alias("strip"), F.when(better, F.col("prefix.add")).alias("add"))
