"""Joins of records: last and first wins, labels to owners, blocks around places, entities by shared keys, dates against introductions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last one in order."""
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return top.select(*keys, "x.*")


def first_wins(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """The tables' rows as one table; of rows with one key that of the earliest table stands. Keys are unique inside a table."""
    whole = reduce(DataFrame.unionByName, [t.withColumn("__at", F.lit(i)) for i, t in enumerate(tables)])
    rest = [c for c in whole.columns if c not in (*keys, "__at")]
    return whole.groupBy(*keys).agg(F.min_by(F.struct(*rest), "__at").alias("x")).select(*keys, "x.*")


def label_owners(codes: DataFrame) -> DataFrame:
    """(label, codebook, code): labels, whatever their case, that one code alone has; others have no owner."""
    low = F.lower("label")
    return codes.groupBy(low.alias("label")).agg(F.count_distinct("codebook", "code").alias("n"), F.min(F.struct("codebook", "code")).alias("x")).where("n = 1").select("label", "x.codebook", "x.code")


def block_at(places: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """(key, place, block): of places (key, place) the block (key, c0, c1, block) around each, else the next one behind it, else null. Blocks of
    a key don't overlap. One sort of both by place: no place meets all blocks."""
    none = F.lit(None)
    marks = blocks.select(key, F.col("c0").alias("place"), F.lit(0).alias("kind"), F.struct("c0", "c1", "block").alias("b"))
    asked = places.select(key, "place", F.lit(1).alias("kind"), none.cast(marks.schema["b"].dataType).alias("b"))
    both = marks.unionByName(asked)
    w = Window.partitionBy(key).orderBy("place", "kind")
    before = F.last("b", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("b", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = both.withColumns({"before": before, "after": after}).where("kind = 1")
    return rows.select(key, "place", F.when(F.col("place") < F.col("before.c1"), F.col("before.block")).otherwise(F.col("after.block")).alias("block"))


def columns_by(codings: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A row for each key with a column for each scheme of `columns`: its different labels in order, joined by semicolons."""
    return codings.groupBy(key).pivot("scheme", columns).agg(F.array_join(F.array_sort(F.collect_set("label")), ";"))


def labelled(codings: DataFrame, codes: DataFrame, key: str) -> DataFrame:
    """(key, labels): the labels of a key's codings (key, ord, code) by codes (code, label), each once, in the order of first use; a code
    without a label stands for itself."""
    named = codings.join(codes.select("code", "label"), "code", "left").select(key, F.struct("ord", F.coalesce("label", "code").alias("label")).alias("x"))
    return named.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["label"])).alias("labels"))


def field_changes(before: DataFrame, after: DataFrame, key: str, fields: list[str], approved: DataFrame | None = None) -> DataFrame:
    """(key, field, old, new) of the fields that differ in rows of both tables; approved (key, field, new) are left out."""
    long = lambda df, name: df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])).alias("x")).select(key, "x.*")
    out = long(before, "old").join(long(after, "new"), [key, "field"]).where(~F.col("old").eqNullSafe(F.col("new")))
    return out.join(approved, [key, "field", "new"], "left_anti") if approved is not None else out


def bare_doi(doi: Column) -> Column:
    return F.regexp_replace(F.lower(F.btrim(doi)), "^https?://(dx\\.)?doi\\.org/", "")


def by_doi(sources: DataFrame, works: DataFrame) -> DataFrame:
    """sources (source_id, doi) with the work (doi, work) of their DOI, whatever its spelling; null where there is none."""
    return sources.select("source_id", bare_doi(F.col("doi")).alias("k")).join(works.select(bare_doi(F.col("doi")).alias("k"), "work"), "k", "left").select("source_id", F.col("k").alias("doi"), "work")


def rating_pairs(one: DataFrame, two: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, a, b, n): how often the two tables rate a unit so and so, for each field that both rated."""
    long = lambda df, name: df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])).alias("x")).select(key, "x.*")
    return long(one, "a").join(long(two, "b"), [key, "field"]).where("a is not null and b is not null").groupBy("field", "a", "b").agg(F.count("*").alias("n"))


def groups(edges: DataFrame) -> DataFrame:
    """(id, group): the smallest id reachable over edges (a, b), for each id with an edge. In every round each id takes the smallest group
    among its neighbours and then that one's own group, so paths halve; rounds are written tables, and a count ends them."""
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("group")))
    while True:
        near = both.join(now.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("group").alias("m")).withColumnRenamed("a", "id")
        step = now.join(near, "id").select("id", F.least("group", "m").alias("next"), F.col("group").alias("old"))
        up = now.select(F.col("id").alias("next"), F.col("group").alias("up"))
        new = checkpointed(step.join(up, "next", "left").select("id", F.least("next", F.coalesce("up", "next")).alias("group"), "old"))
        if new.where("group <> old").isEmpty():
            return new.select("id", "group")
        now = new.select("id", "group")


def singular(term: Column) -> Column:
    """A term whose last word is a plural, as the singular: -es behind a hissing sound, else -s, but not -ss or -us and not of short words."""
    hissing = F.lit(False)
    for end in ("ches", "shes", "xes", "sses", "zes"):
        hissing = hissing | term.endswith(end)
    last = F.substring_index(term, " ", -1)
    plain = term.endswith("s") & ~term.endswith("ss") & ~term.endswith("us") & (F.length(last) > 3)
    left = lambda n: F.left(term, F.length(term) - n)
    return F.when(hissing, left(2)).when(plain, left(1)).otherwise(term)


def name_keys(name: Column, terms: bool = False) -> Column:
    """What a name may be known by, in lower case: the name without a note in brackets at its end; the note, if it is an acronym of 2 to 10
    characters; and what stands before a title (behind a comma or bracket), if it reads as a person's name of two or three capitalised words.
    terms: a note of several words counts as well, unless it is a list, and a plural is known by its singular, too."""
    whole = F.btrim(F.regexp_replace(F.coalesce(name, F.lit("")), "\\s+", " "))
    closed = whole.endswith(")") & (F.instr(whole, "(") > 0)
    note = F.when(closed, F.regexp_replace(F.substring_index(whole, "(", -1), "\\)$", ""))
    base = F.when(closed & ~note.contains(")"), F.rtrim(F.left(whole, F.length(whole) - F.length(note) - 2))).otherwise(whole)
    acronym = F.length(note).between(2, 10) & F.left(note, F.lit(1)).between("A", "Z") & (F.translate(F.lower(note), "abcdefghijklmnopqrstuvwxyz0123456789&.-", "") == "")
    several = note.contains(" ") & ~note.contains(",") & ~note.contains(";") if terms else F.lit(False)
    before = F.rtrim(F.substring_index(F.substring_index(whole, ",", 1), " (", 1))
    words = F.split(before, " ")
    capital = F.forall(words, lambda w: F.left(w, F.lit(1)).between("A", "Z") & (F.length(w) > 1) & (F.translate(F.substring(w, 2, 1 << 30), "abcdefghijklmnopqrstuvwxyz'\u2019.-", "") == ""))
    person = F.when((before != whole) & F.size(words).between(2, 3) & capital, before)
    keys = F.filter(F.array(F.rtrim(base, F.lit(".")), F.when(acronym | several, note), person), lambda k: k.isNotNull() & (k != ""))
    keys = F.transform(keys, F.lower)
    return F.array_distinct(F.concat(keys, F.transform(keys, singular)) if terms else keys)


def merged_entities(names: DataFrame, terms: bool = False) -> DataFrame:
    """(id, entity) of names (id, name): names that share a key, over others as well, are one entity, named by its smallest id. Names meet
    through the smallest id of each key, never pair by pair. terms: keys of terms instead of names."""
    keys = names.select("id", F.explode(name_keys(F.col("name"), terms)).alias("key"))
    stars = keys.join(keys.groupBy("key").agg(F.min("id").alias("b")), "key").where("id <> b").select(F.col("id").alias("a"), "b")
    return names.select("id").join(groups(stars), "id", "left").select("id", F.coalesce("group", "id").alias("entity"))


def glossary_hits(text: Column, terms: list[str]) -> Column:
    """The glossary terms in a text, in order: the longest variant first where several begin, none inside another, whole words only."""
    by_length = sorted(terms, key=lambda t: (-len(t), t))
    pattern = "(?i)\\b(" + "|".join("\\Q" + t.replace("\\E", "") + "\\E" for t in by_length) + ")\\b"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def too_early(units: DataFrame, introduced: DataFrame) -> DataFrame:
    """(unit, early): codes (semicolons between them) that a unit (unit, day, codes) cites before their introduction (code, since)."""
    cited = units.select("unit", F.substring("day", 1, 10).alias("day"), F.posexplode(F.split("codes", ";")).alias("at", "code"))
    bad = cited.join(introduced, "code").where((F.col("day") != "") & (F.col("day") < F.substring("since", 1, 10)))
    listed = bad.groupBy("unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), ";").alias("early"))
    return units.select("unit").join(listed, "unit", "left").na.fill("", ["early"])
