"""Vector codes, centroid clustering and exact dedup against plain versions over lists of rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import centroids, exact_dedup, queries, vector_codes, vectors

from . import plain

SHAPE = "vec_id long, embedding array<double>, label int, v int, lk int, n int, code int, error int, cluster int, distance int, ids int"


def far(a, b) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def moved(centres, members):
    return [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else old for old, m in zip(centres, members, strict=True)]


def whole(v, scale: int) -> bool:
    return v is not None and all(x is not None and math.isfinite(x) and abs(x * scale) < vectors.LIMIT for x in v)


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def plain_codes(rows, scale=4096, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error) and the codebooks, by integers of any size."""
    kept = by_id([(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if whole(v, scale)])
    dim = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    d = dim // parts
    cut = [[r[1][p * d : p * d + d] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            members = [[] for _ in books[p]]
            for c in cut:
                members[nearest(c[p], books[p])].append(c[p])
            books[p] = moved(books[p], members)
    codes = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(far(c[p], books[p][k[p]]) for p in range(parts)) for c, k in zip(cut, codes, strict=True)]
    labels = Counter()
    for r, e in zip(kept, errors, strict=True):
        labels[r[2]] += e
    out = [(r[0], "".join(f"{x:02x}" for x in k), e, labels[r[2]]) for r, k, e in zip(kept, codes, errors, strict=True)]
    return out, books


def plain_clusters(rows, scale=256, dim=64, k=40, rounds=5, seed=2):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows if whole(v, scale) and len(v) == dim]
    order = sorted(kept, key=lambda r: (plain.sha(f"{seed}:{'' if r[0] is None else r[0]}"), r[1]))
    centres = [v for _, v in order[:k]]
    nearest = lambda v: min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))
    for _ in range(rounds):
        members = [[] for _ in centres]
        for _, v in kept:
            members[nearest(v)].append(v)
        centres = moved(centres, members)
    to = [nearest(v) for _, v in kept]
    gaps = [far(v, centres[c]) for (_, v), c in zip(kept, to, strict=True)]
    own = Counter()
    for c, g in zip(to, gaps, strict=True):
        own[c] += g
    return [(i, c, g, own[c], sum(gaps), plain.sha(",".join(map(str, centres[c])))) for (i, _), c, g in zip(kept, to, gaps, strict=True)]


def messy(dim: int, n: int = 150, seed: int = 4) -> list[tuple]:
    """Vectors of every broken kind, copies, repeated rows and ids, and groups in which distances tie."""
    r = np.random.default_rng(seed)
    broken = [None, [], [1.0] * (dim - 1), [None] + [0.5] * (dim - 1), [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [-float("inf")] * dim, [1e300] + [0.0] * (dim - 1)]
    rows: list[tuple] = [(1000 + i, v, 1) for i, v in enumerate(broken)]
    bases = r.normal(size=(6, dim))
    for i in range(n):
        v = bases[r.integers(6)] * r.choice([0.01, 1, 3]) + r.normal(size=dim) * r.choice([0, 0.001, 0.2])
        rows.append((i, v.tolist(), [None, 1, 2][r.integers(3)]))
    rows += [(5000 + i, r.integers(-1, 2, dim).astype(float).tolist(), 3) for i in range(60)]  # ties
    rows += [(6000 + i, [0.25] * dim, 4) for i in range(60)]  # copies
    rows += [(6000, [0.25] * dim, 4), (7, rows[20][1], None), (None, bases[0].tolist(), None), (None, bases[1].tolist(), 2)]
    rows += [(-3 - i, (bases[i] * 10_000.0).tolist(), 9) for i in range(3)]  # beyond what doubles multiply exactly
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, *range(8)) for r in rows], SHAPE).repartition(4)


def listed(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("dim", [8, 24])
def test_vector_codes_messy(spark, dim):
    rows = messy(dim)
    rows = [r for r in rows if r[0] is None or r[0] != 1001]  # the empty vector
    found, books = vector_codes.vector_codes(frame(spark, rows))
    want, plain_books = plain_codes([r for r in rows if r[1] is None or len(r[1]) == dim])
    assert listed(found) == sorted(want, key=repr)
    assert books.tolist() == plain_books


def test_vector_codes_small_tables(spark):
    none, books = vector_codes.vector_codes(frame(spark, []))
    assert none.collect() == [] and books.size == 0 and none.columns == ["vec_id", "code", "error", "label_error"]
    assert vector_codes.vector_codes(frame(spark, [(1, None, 1), (2, [], 1), (3, [1.0] * 7, 1)]))[0].collect() == []
    found, books = vector_codes.vector_codes(frame(spark, [(2, [1.0] * 8, None), (1, [2.0] * 8, None), (1, [2.0] * 8, 5)]))
    assert listed(found) == [(1, "00" * 8, 0, 0), (1, "00" * 8, 0, 0), (2, "02" * 8, 0, 0)] and books.shape == (8, 3, 1)


@pytest.mark.parametrize("size", [3, 1000, 1 << 20, (1 << 27) - 1])
@pytest.mark.parametrize("d", [1, 8, 40])
def test_screening_is_exact(size, d):
    """Rows and entries so close that float32 can't tell them apart, and exact ties."""
    r = np.random.default_rng(size + d)
    book = r.integers(-size, size + 1, (16, d))
    book[3] = book[9]
    book[5] = np.clip(book[4] + r.integers(-1, 2, d), -size, size)
    x = np.concatenate([r.integers(-size, size + 1, (300, d)), np.clip(book[r.integers(0, 16, 300)] + r.integers(-2, 3, (300, d)), -size, size)])
    exact = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (vector_codes.nearest(x, book) == exact.argmin(1)).all()
    score, reach = vector_codes.intervals(x, book)
    true = (book * book).sum(1)[None].astype(object) - 2 * (x.astype(object) @ book.T.astype(object))
    assert all(abs(int(t) - s) <= w for t, s, w in zip(true.ravel(), score.ravel(), reach.ravel(), strict=True))


def test_clusters_messy(spark):
    rows = messy(64, n=120)
    for block in (centroids.BLOCK, 50):  # one tree a task, and several
        found, _ = centroids.clusters(frame(spark, rows), block=block)
        assert listed(found) == sorted(plain_clusters(rows), key=repr)


def test_clusters_small_tables(spark):
    found, centres = centroids.clusters(frame(spark, [(1, None, 1), (2, [1.0] * 63, 1)]))
    assert found.collect() == [] and len(centres) == 0
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    few = [(1, [0.5] * 64, None), (1, [0.5] * 64, None), (None, [1.5] * 64, 2)]
    assert listed(centroids.clusters(frame(spark, few))[0]) == sorted(plain_clusters(few), key=repr)


@pytest.mark.parametrize("seed", range(12))
def test_filtering_assigns_as_brute_force(seed):
    r = np.random.default_rng(seed)
    dim, size = int(r.integers(1, 12)), int(r.choice([1, 4, 300, 1 << 26]))
    points = r.integers(-size, size + 1, (int(r.integers(1, 400)), dim))
    points[: len(points) // 3] = points[0]  # a ball without radius
    centres = np.concatenate([points[r.integers(0, len(points), 9)], r.integers(-size, size + 1, (6, dim))])
    tree, order = centroids.Tree.build(points, leaf=4)
    assert sorted(order.tolist()) == list(range(len(points))) and (tree.points == points[order]).all()
    for i in range(len(tree.start)):
        own = tree.points[tree.start[i] : tree.end[i]]
        assert (tree.sums[i] == own.sum(0)).all() and (((own - tree.pivot[i]) ** 2).sum(1).astype(float) <= tree.radius[i] ** 2 + 0.5).all()
    want = ((tree.points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (tree.assigned(centres) == want).all()
    total = np.zeros((len(centres), dim + 1), dtype=np.int64)
    tree.added(centres, total)
    assert (total[:, 0] == np.bincount(want, minlength=len(centres))).all()
    assert all((total[c, 1:] == tree.points[want == c].sum(0)).all() for c in range(len(centres)))


def test_whole_balls_are_assigned():
    """Of groups far apart only the leaves that a split shares between two of them are entered."""
    r = np.random.default_rng(0)
    points = np.concatenate([r.integers(-5, 6, (200, 64)) + 1000 * i for i in range(5)])
    tree, _ = centroids.Tree.build(points)
    balls, _, left, _ = tree.filtered(np.array([[1000 * i] * 64 for i in range(5)]))
    assert len(left) <= 4 * centroids.LEAF and len(balls) < 40


# exact dedup


def plain_exact(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups: dict[str, list] = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append(d)
    first = {t: min(ds, key=lambda d: (d is None, d or 0)) for t, ds in groups.items()}
    seen, out = set(), []
    for d, t in rows:
        n = norm(t)
        stays = d == first[n] and n not in seen
        if stays:
            seen.add(n)
        out.append((d, first[n], len(groups[n]), stays, plain.sha(n)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keys", [exact_dedup.BROADCAST_KEYS, 0])
def test_exact_dedup_messy(spark, messy, messy_docs, keys):
    extra = messy_docs.where("doc_id between 10 and 16").withColumn("text", F.regexp_replace(F.col("text"), " ", "\t\n "))
    both = messy_docs.unionByName(messy_docs.where("doc_id in (0, 5, 201)")).unionByName(extra).withColumn("fp", F.lit(1)).withColumn("group_size", F.lit("x"))
    given = [tuple(r) for r in both.select("doc_id", "text").collect()]
    assert listed(exact_dedup.exact_dedup(both, broadcast_keys=keys)) == plain_exact(given)


def test_exact_dedup_hot_text_and_equal_fingerprints(spark, monkeypatch):
    """A text with over a third of all rows, and fingerprints that are the same for different texts: bytes decide."""
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    r = random.Random(2)
    rows = [(i, "the  same") for i in range(900)] + [(i, r.choice(["the same ", " the same", "the same", "The same", "thesame"])) for i in range(900, 2000)]
    found = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert listed(found) == plain_exact(rows)


def test_exact_dedup_documents(spark, documents, plain_documents):
    assert listed(exact_dedup.exact_dedup(documents)) == plain_exact(plain_documents)


def test_exact_dedup_empty(spark, no_docs):
    found = exact_dedup.exact_dedup(no_docs)
    assert found.collect() == [] and found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


@pytest.mark.parametrize("bits", [3, 8, 20, 64])
@pytest.mark.parametrize("seed", range(4))
def test_quotient_filters_merge_without_loss(bits, seed):
    """Counts of any size, dense and sparse quotients, through bytes and merging."""
    r = random.Random(seed * 100 + bits)
    total: Counter = Counter()
    merger = exact_dedup.Merger()
    for _ in range(r.randint(1, 9)):
        top = r.choice([(1 << bits) - 1, min((1 << bits) - 1, 40)])
        own = Counter({r.randint(0, top): r.choice([1, 1, 2, 3, 1000, 1 << 40]) for _ in range(r.randint(0, 200))})
        keys = sorted(own)
        filter_ = exact_dedup.QuotientFilter.of(np.array(keys, dtype=np.uint64), np.array([own[k] for k in keys], dtype=np.int64), bits)
        merger.add(exact_dedup.QuotientFilter.from_bytes(filter_.to_bytes()))
        total.update(own)
    prints, counts = merger.whole().entries()
    assert dict(zip(prints.tolist(), counts.tolist(), strict=True)) == dict(total)
    assert prints.tolist() == sorted(total)


@pytest.mark.parametrize("shard_rows", [1 << 20, 16])
def test_repeated_fingerprints(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(exact_dedup, "FILTER_ROWS", 50)
    r = random.Random(1)
    prints = [r.choice([-(1 << 63), (1 << 63) - 1, 0, -1, r.randint(-(1 << 63), (1 << 63) - 1), r.randint(0, 300)]) for _ in range(2000)]
    found = exact_dedup.repeated(spark.createDataFrame([(p,) for p in prints], "fp long").repartition(5), len(prints), shard_rows)
    assert dict(map(tuple, found.collect())) == {p: n for p, n in Counter(prints).items() if n > 1}


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_centroids", "op13_exact_dedup"])
def test_queries_match_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    found = queries.queries()[name](spark, sf_dir)
    result = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    assert Counter(map(tuple, found.select(*columns).collect())) == Counter(result.fetchall())


def test_digest_of_codebooks():
    assert vector_codes.digest(np.array([[[1, -2]], [[3, 4]]])) == hashlib.sha256(b"1,-2,3,4").hexdigest()
