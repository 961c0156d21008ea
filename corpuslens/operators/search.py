"""Search and facets: keyword and vector hits, merged lists, filters with counts that ignore their own scheme."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import context


#: Vectors that meet a block of queries at once: a worker holds a few numbers for each pair of them.
ROWS = 500


def term_score(text: Column, terms: list[str]) -> Column:
    low = F.lower(text)
    return sum((F.contains(low, F.lit(t.lower())).cast("int") for t in terms), F.lit(0))


def keyword_search(texts: DataFrame, terms: list[str], limit: int | None = None) -> DataFrame:
    """texts with score (how many terms occur), best first."""
    hits = texts.withColumn("score", term_score(F.col("text"), terms)).where("score > 0")
    return hits if limit is None else hits.orderBy(F.desc("score"), texts.columns[0]).limit(limit)


def keyword_places(texts: DataFrame, key: str, term: str, most: int = 3, before: int = 200, after: int = 260) -> DataFrame:
    """(key, hit, start, context): the first places of a term in each text (the feature is the cut) with their surroundings."""
    low, t = F.lower("text"), term.lower()
    places = F.split(low, "\\Q" + t + "\\E", -1)
    lengths = F.transform(places, F.length)
    n = F.least(F.size(places) - 1, F.lit(most))
    at = F.transform(F.sequence(F.lit(1), n), lambda i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda s, x: s + x) + (i - 1) * len(t))
    rows = texts.where(F.contains(low, F.lit(t))).select(key, "text", F.posexplode(at).alias("hit", "start"))
    return rows.select(key, "hit", "start", context(F.col("text"), F.col("start"), F.col("start") + len(t), before, after).alias("context"))


def centroid(vectors: DataFrame, column: str = "embedding") -> list[float]:
    """The mean vector: partial sums by place, as many rows as there are dimensions."""
    rows = vectors.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).collect()
    return [r["m"] for r in sorted(rows, key=lambda r: r["i"])]


def nearest(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, mean: np.ndarray, k: int) -> list[pa.Array]:
    """Query, id and score of the k best of each query (ids; q: of length 1) among the vectors (id, embedding) that stream by."""
    best_s, best_i = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, dtype=np.int64)
    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1) - mean
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        s = np.concatenate([best_s, q @ x.T], axis=1)
        i = np.concatenate([best_i, np.broadcast_to(batch.column(0).to_numpy(), (len(ids), batch.num_rows))], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, :k]
        best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
    keep = best_i >= 0
    return [pa.array(np.repeat(ids, keep.sum(axis=1))), pa.array(best_i[keep]), pa.array(best_s[keep])]


def semantic_topk(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", block: int = 1024) -> DataFrame:
    """(query_id, key, rank, score): of every query (query_id, embedding) the k nearest vectors by cosine after the vectors' mean is taken off.

    A stated set of queries against all vectors: the queries are broadcast in blocks of bounded size, each task keeps its own k best of a query
    as its vectors stream by, and only those are ranked."""
    mean = np.array(centroid(vectors))
    spark = vectors.sparkSession
    n = queries.count()
    out = None
    for at in range(max(1, -(-n // block))):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // block)))) == at).collect()
        if not part:
            continue
        ids = np.array([r["query_id"] for r in part], dtype=np.int64)
        q = np.array([r["embedding"] for r in part], dtype=np.float64) - mean
        shared = spark.sparkContext.broadcast((ids, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays(nearest(batches, *shared.value, mean, k), ["query_id", key, "score"])

        found = vectors.select(F.col(key).cast("long"), "embedding").mapInArrow(run, f"query_id long, {key} long, score double")
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], f"query_id long, {key} long, score double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def merge(coded: DataFrame, semantic: DataFrame, keyword: DataFrame, limit: int) -> DataFrame:
    """(id, via, score) for a result page: coded passages first, then semantic ones, then keyword ones (half the limit at most), none twice."""
    a = coded.select("id", F.lit("coded").alias("via"), "score").orderBy(F.desc("score"), "id").limit(limit)
    b = semantic.join(a, "id", "left_anti").select("id", F.lit("semantic").alias("via"), "score").orderBy(F.desc("score"), "id").limit(limit)
    c = keyword.join(a, "id", "left_anti").join(b, "id", "left_anti").select("id", F.lit("keyword").alias("via"), "score").orderBy(F.desc("score"), "id").limit(max(1, limit // 2))
    return a.union(b).union(c)


def facet_filter(rows: DataFrame, ticks: dict[str, list], terms: tuple[str, ...] = (), text: str = "text") -> Column:
    """OR inside a scheme, AND between schemes and text terms."""
    cond = F.lit(True)
    for scheme, values in ticks.items():
        if values:
            cond = cond & F.col(scheme).isin(*values)
    for t in terms:
        cond = cond & F.contains(F.lower(text), F.lit(t.lower()))
    return cond


def facet_counts(rows: DataFrame, ticks: dict[str, list], schemes: list[str]) -> DataFrame:
    """(scheme, value, n): rows that all other schemes' ticks let through, in one pass over the rows."""
    parts = []
    for s in schemes:
        others = facet_filter(rows, {k: v for k, v in ticks.items() if k != s})
        parts.append(F.when(F.coalesce(others, F.lit(False)), F.struct(F.lit(s).alias("scheme"), F.col(s).cast("string").alias("value"))))
    long = rows.select(F.explode(F.array_compact(F.array(*parts))).alias("f"))
    return long.groupBy("f.scheme", "f.value").agg(F.count("*").alias("n"))


def findings_filter(support: list[str], kinds: list[str], places: list[str], terms: tuple[str, ...] = ()) -> Column:
    """Which findings (support, kind, places array, text) a reader's choices leave: of each list of choices one must hold, an empty one
    asks nothing; every term must stand in the text, whatever its case."""
    test = F.lit(True)
    if support:
        test = test & F.col("support").isin(*support)
    if kinds:
        test = test & F.col("kind").isin(*kinds)
    if places:
        test = test & F.arrays_overlap("places", F.array(*[F.lit(x) for x in places]))
    for term in terms:
        test = test & F.contains(F.lower("text"), F.lit(term.lower()))
    return F.coalesce(test, F.lit(False))


def by_strength(findings: DataFrame, overview: str) -> DataFrame:
    """findings (overview, ord, support_rank, studies) with their place from 1 in each overview: stronger first, then more studies, then as
    they stand."""
    w = Window.partitionBy(overview).orderBy(F.desc("support_rank"), F.desc("studies"), "ord")
    return findings.withColumn("place", F.row_number().over(w))


def by_coverage(codings: DataFrame, last: tuple[str, ...] = ()) -> DataFrame:
    """(scheme, sources, place): facet groups by how many sources they cover, those of `last` at the end."""
    per = codings.groupBy("scheme").agg(F.countDistinct("source").alias("sources"))
    w = Window.orderBy(F.col("scheme").isin(*last).cast("int") if last else F.lit(0), F.desc("sources"), "scheme")  # a row for each scheme
    return per.withColumn("place", F.row_number().over(w))
