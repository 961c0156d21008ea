"""Operators that SQL can't express, known answers, and rules that the tables don't reach."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import text as tx
from corpuslens.sources import files
from corpuslens.functions import ident
from corpuslens.operators import anchoring, appraise, linking, passages, profile, reports, stats, units


def evidence(rows: list[tuple]) -> list[tuple]:
    """(paper, lead, verdict, gap, origin, grade) as evidence of one statement."""
    return [("s", *r, None) for r in rows]


SHAPE = "statement string, paper string, lead string, verdict string, gap string, origin string, grade string, runs array<string>"
OWN = ("none", "own")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("a", "x", "supports", *OWN, "High"), ("b", "y", "supports", *OWN, "Moderate"), ("c", "z", "supports", *OWN, "Low")], (3, 3, "robust", "high", "very high")),
        ([("a", "x", "supports", *OWN, "High"), ("b", "y", "supports", "none", "reported", "High"), ("c", "z", "supports", "none", "background", "High")], (1, 1, "medium", "medium", "medium")),
        ([("a", "x", "supports", *OWN, "Low")], (1, 1, "limited", "medium", "low")),
        ([("a", "x", "supports", *OWN, "High")], (1, 1, "medium", "medium", "medium")),
        ([("a", "x", "partly", "place", "own", "Low")], (1, 1, "limited", "low", "very low")),
        ([("a", "x", "does not support", *OWN, "High"), ("b", "y", "does not support", *OWN, "High")], (0, 0, None, None, "not supported by its passages")),
        ([("a", "x", "supports", *OWN, "Low"), ("b", "x", "supports", *OWN, "High"), ("c", "x", "supports", *OWN, "Low")], (1, 3, "medium", "medium", "medium")),
        ([("a", None, "supports", *OWN, "Low"), ("b", "", "supports", *OWN, "Moderate")], (2, 2, "medium", "high", "high")),
        ([("a", "x", "supports", *OWN, "Low"), ("b", "y", "does not support", *OWN, "High")], (1, 1, "limited", "low", "very low")),
        ([("a", "x", None, *OWN, "Low")], (0, 0, None, None, "not checked")),
    ],
)
def test_confidence(spark, rows, want):
    found = appraise.confidence(spark.createDataFrame(evidence(rows), SHAPE)).first()
    assert tuple(found)[1:] == want


def test_confidence_of_split_runs(spark):
    rows = [("s", "a", "x", None, "none", "own", "High", ["supports", "partly", "does not support"])]
    assert appraise.confidence(spark.createDataFrame(rows, SHAPE)).first()["confidence"] == "runs disagreed"


@pytest.mark.parametrize(
    ("start", "design", "answers", "want"),
    [
        ("High", "cohort", {"q1": "yes", "q2": "partly", "q3": "yes", "q4": "yes"}, "High"),
        ("High", "cohort", {"q1": "not found", "q2": "can't tell", "q3": "yes", "q4": "yes"}, "Low"),
        ("High", "cohort", {"q1": "not found", "q2": "not found", "q3": "not found", "q4": "yes"}, "Very low"),
        ("High", "cohort", {"q1": "yes", "q2": "yes", "q3": "can't tell", "q4": "yes"}, "Moderate"),
        ("High", "cohort", {"q1": "yes", "q2": "yes", "q3": "yes", "q5": "not found", "q6": "not found"}, "Moderate"),
        ("High", "cohort", {"q1": None, "q2": None, "q3": "can't tell", "q4": "yes"}, "Not appraisable"),
        ("Low", "cohort", {"q1": "not found", "q2": "can't tell", "q3": "can't tell", "q4": "yes", "q5": "yes", "q6": "yes"}, "Very low"),
        ("High", "systematic-review", {"q1": "yes", "q2": "yes", "q3": "yes", "q6": "partly", "q7": "yes"}, "Moderate"),
        ("High", "systematic-review", {"q1": "yes", "q2": "yes", "q3": "yes", "q6": "yes", "q7": "partly"}, "High"),
        ("Moderate", "systematic-review", {"q1": "yes", "q2": "yes", "q3": "yes", "q6": "partly", "q7": "yes"}, "Moderate"),
    ],
)
def test_grade(spark, start, design, answers, want):
    """q1 and q2 are one critical dimension, q3 another; the others aren't critical."""
    dims = {"q1": ("a", True), "q2": ("a", True), "q3": ("b", True)}
    rows = [("p", "x", design, start, q, *dims.get(q, ("c", False)), a) for q, a in answers.items()]
    found = appraise.grade(spark.createDataFrame(rows, "paper string, profile string, design string, start string, question string, dim string, critical boolean, answer string"))
    assert found.first()["grade"] == want


def test_links_inside_a_table_and_with_prefixes(spark):
    posts = spark.createDataFrame([(str(100 + i), str(100 + (i * 3) % 10) if i else "") for i in range(10)], "id string, quotes string")
    actions = spark.createDataFrame([(f"a{100 + i}", f"text {i}") for i in range(10)], "action string, note string")
    lists = spark.createDataFrame([("101; 102",), ("103;104",), ("105; 999",), ("106",)], "refs string")
    found = {(r["from_table"], r["from_column"], r["to_table"], r["to_column"]): r for r in profile.find_links({"posts": posts, "actions": actions, "lists": lists}).collect()}
    inner = found["posts", "quotes", "posts", "id"]
    assert (inner["containment"], inner["partial"], inner["strip"]) == (1.0, False, None)
    other = found["actions", "action", "posts", "id"]
    assert (other["containment"], other["strip"], other["add"]) == (1.0, "a", "")
    assert found["posts", "id", "actions", "action"]["add"] == "a"
    refs = found["lists", "refs", "posts", "id"]
    assert (refs["as_list"], refs["partial"], refs["containment"]) == (True, True, 0.857)
    assert not any(k[:2] == ("actions", "note") for k in found)


def plain_links(tables: dict, least: float = 0.5, whole: float = 0.9) -> dict:
    """find_links by sets and loops."""
    cut = lambda x: re.match("([A-Za-z]{1,3})(?=[0-9])", x)
    strip = lambda x: (m.group(1) if (m := cut(x)) else "", x[m.end() :] if m else x)
    toks, keys, out = {}, {}, {}
    for t, cols in tables.items():
        for c, cells in cols.items():
            cells = ["" if x is None else str(x) for x in cells]
            parts = lambda v: [p for x in v.split(";") if (p := x.strip(" "))]
            full = [x for x in cells if x.strip()]
            lists = [x for x in full if ";" in x and all(re.fullmatch(r"[A-Za-z]{0,3}[\w.-]{1,40}", p, re.A) for p in parts(x))]
            as_list = round(len(lists) / len(full), 3) > 0 if full else False
            found = {p for x in full for p in (parts(x) if as_list else [x.strip(" ")])}
            if found and len(found) >= min(5, len(cells)) and all(re.fullmatch(r"[A-Za-z]{0,3}[\w.-]{1,40}", x, re.A) for x in found):
                toks[t, c] = found
            if len(set(full)) == len(full) == len(cells) >= 3 and max(map(len, full)) <= 80:
                keys[t, c] = {x.strip(" ") for x in full}
    for a, mine in toks.items():
        for b, theirs in keys.items():
            if a != b:
                adds: dict = {}
                for x in theirs:
                    adds[strip(x)[1]] = min(strip(x)[0], adds.get(strip(x)[1], "zzzz"))
                hits, met = len(mine & theirs), Counter((strip(x)[0], adds[strip(x)[1]]) for x in mine if strip(x)[1] in adds)
                better = hits < whole * len(mine) and sum(met.values()) > hits
                share = (sum(met.values()) if better else hits) / len(mine)
                if share >= least:
                    out[a + b] = (round(share, 3), share < whole, *(max((n, *p) for p, n in met.items())[1:] if better else (None, None)))
    return out


def test_links_of_many_columns_against_loops(spark):
    """Over 63 columns, numbers beside texts, prefixes, lists, nulls, and a key's cells that differ in spaces alone (a token is one hit)."""
    r = random.Random(7)
    some = lambda: [f"{r.choice(['', '', 'a', 'b', 'Cd'])}{r.randint(1, 14)}" for _ in range(9)]
    tables = {
        "wide": {f"c{i}": r.sample(range(1, 30), 9) if i % 3 else some() for i in range(66)},
        "spaced": {"key": ["1", "2", "3", "4", "5", "5 ", "a6", "b6", "06"], "some": ["1", "2", "3", "4", "5", "5", "1", "", None]},
        "lists": {"refs": ["1; 2", "3;4", "5;5", "a6", "b6;06", "", "9", "1", "2"], "n": [1, 2, 3, 4, 5, 6, None, 7, 8], "key": ["1; 2", "3", "4", "5", "6", "7", "8", "9", "10"]},
    }
    frames = {t: spark.createDataFrame(list(zip(*cols.values(), strict=True)), ", ".join(f"{c} {'long' if all(isinstance(x, int) or x is None for x in cells) else 'string'}" for c, cells in cols.items())) for t, cols in tables.items()}
    found = {(x["from_table"], x["from_column"], x["to_table"], x["to_column"]): (x["containment"], x["partial"], x["strip"], x["add"]) for x in profile.find_links(frames).collect()}
    assert found == plain_links(tables) and found["spaced", "some", "spaced", "key"] == (1.0, False, None, None)


def test_a_token_is_one_hit(spark):
    """However many of a key's cells are that token but for spaces."""
    key = spark.createDataFrame([(x,) for x in ("1", "2", "3", "4", "5", "5 ")], "key string")
    some = spark.createDataFrame([(str(i),) for i in range(1, 6)], "some string")
    assert [x["containment"] for x in profile.find_links({"a": key, "b": some}).collect() if x["from_column"] == "some"] == [1.0]


def test_apply_transform(spark):
    rows = spark.createDataFrame([("a12", "a", ""), ("12", "", "b"), ("x12", "a", "b"), ("a12", None, None)], "v string, s string, a string")
    assert [r[0] for r in rows.select(profile.apply_transform(F.col("v"), F.col("s"), F.col("a"))).collect()] == ["12", "b12", "bx12", "a12"]


def test_quote_styles(spark):
    long_ = " and much more text that goes on for a while"
    df = spark.createDataFrame([(f"Ann said:\nthis{long_}",), (f"> that{long_}",), (f"plain{long_}",)], "post string")
    assert {x["style"]: x["n"] for x in profile.column_facts({"t": df}).first()["quote_blocks"]} == {"xenforo": 1, "markdown": 1}


def test_text_chunks(spark):
    short, mid, long_ = "x" * 30, "Sentence of words. " * 20, "Sentence of words. " * 100
    text = "\n\n".join((short, mid, mid, short, mid, mid, long_))
    spans = passages.chunk_spans(text)
    assert all(0 <= a < b <= len(text) and b - a <= 1400 for a, b in spans)
    assert sum(text[a:b].count("Sentence") for a, b in spans) == text.count("Sentence")
    rows = passages.chunks(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), "id").orderBy("chunk").collect()
    assert [r["text"] for r in rows] == [text[a:b] for a, b in spans]
    assert passages.chunk_spans("") == [] and passages.chunk_spans(short) == []


@pytest.mark.parametrize("seed", range(60))
def test_chunks_by_trial(seed):
    """The rule tried paragraph by paragraph and cut by cut."""
    r = random.Random(seed)
    piece = lambda: "".join(r.choice("ab. \n") for _ in range(r.choice([0, 3, 9, 15, 25, 70])))
    text = "\n\n".join(piece() for _ in range(r.randint(1, 12)))
    least, most, head = 8, 30, 5
    paragraphs, at = [], 0
    for x in text.split("\n\n"):
        paragraphs.append((at, at + len(x)))
        at += len(x) + 2
    want, packed = [], []
    for a, b in [p for p in paragraphs if p[1] - p[0] >= least]:
        if b - a <= most:
            if packed and packed[-1][1] - packed[-1][0] + b - a <= most:
                packed[-1] = (packed[-1][0], b)
            else:
                packed.append((a, b))
            continue
        while b - a > most:
            cut = max((i + 1 for i in range(a + head, a + most - 1) if text[i : i + 2] == ". "), default=a + most)
            want.append((a, cut))
            a = cut
        want.append((a, b))
    assert passages.chunk_spans(text, least, most, head) == sorted(want + packed)


@pytest.mark.parametrize("budget", [7, 50, 1000])
def test_model_parts(spark, budget):
    text = "one two\nthree four five six\n\nseven\n\n\n" + "y" * 120 + "\nend"
    spans = passages.part_spans(text, budget)
    assert all(0 < b - a <= budget for a, b in spans) or len(text) <= budget
    rows = passages.model_parts(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), "id", budget).orderBy("part").collect()
    assert "".join(r["text"] for r in rows if r["id"] == 1) == text
    assert len([r for r in rows if r["id"] == 2]) == 1


@pytest.mark.parametrize("seed", range(40))
def test_parts_reach_to_the_last_cut(seed):
    r = random.Random(seed)
    text = "".join(r.choice("ab\n\n") for _ in range(r.randint(0, 150)))
    budget = r.choice([5, 12, 40])
    spans = passages.part_spans(text, budget)
    assert "".join(text[a:b] for a, b in spans) == text and all(b - a <= budget for a, b in spans)
    for a, b in spans[:-1]:
        later = [i for i in range(b + 1, min(a + budget, len(text)) + 1) if text[:i].endswith("\n\n") and "\n\n" not in text[b : i - 2]]
        whole = [i for i in later if len(text[:i].rsplit("\n\n", 2)[-2]) + 2 <= budget and i - 2 - text.rfind("\n\n", 0, i - 2) <= budget and text.rfind("\n\n", 0, i - 2) + 2 == b]
        assert not whole, (a, b, whole)  # a paragraph that still fits isn't left to the next part


@pytest.mark.parametrize("together", [50_000, 3])
def test_hits_against_every_text_and_quotation(spark, monkeypatch, together):
    """Any script and length, frequent passages, overlapping places, texts with more candidates than a row holds."""
    monkeypatch.setattr(anchoring, "TOGETHER", together)
    monkeypatch.setattr(anchoring, "CANDIDATES", 5)
    monkeypatch.setattr(anchoring, "HOT", 1)
    r = random.Random(6)
    alphabet = "ab \n\u65e5\u672c\U0001f600\u00e9"
    common = "".join(r.choice(alphabet) for _ in range(50))
    texts = [(i, "".join(r.choice(alphabet) for _ in range(r.randint(0, 300))) + (common if i % 2 else "")) for i in range(60)] + [(60, None), (61, ""), (62, "\u65e5" * 200)]
    quotes = [(1, common), (2, common[3:40]), (3, common[5:12]), (4, ""), (5, None), (6, "a"), (7, "\u65e5" * 30), (8, "nowhere at all, and long"), (9, "\U0001f600"), (10, "zz")]
    for k in range(100, 160):
        _, text = texts[r.randrange(60)]
        s = r.randrange(len(text) + 1)
        quotes.append((k, text[s : s + r.choice([3, 15, 16, 17, 40])]))
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, other string").repartition(3)
    found = anchoring.hits(df, spark.createDataFrame(quotes, "quote_id long, quote string"))
    assert found.columns == ["doc_id", "text", "other", "quote_id", "quote"]
    got = sorted((x["doc_id"], x["quote_id"]) for x in found.collect())
    assert got == sorted((i, k) for i, t in texts for k, q in quotes if t and q and q in t)


def test_hits_have_no_nested_loop(spark):
    df = spark.createDataFrame([(1, "some text of a document here"), (2, "other")], "doc_id long, text string")
    found = anchoring.hits(df, spark.createDataFrame([(1, "a document here, or there"), (2, "text")], "quote_id long, quote string"))
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and found.count() == 1


def test_names_and_their_keys(spark):
    keys = lambda name, terms=False: set(spark.range(1).select(linking.name_keys(F.lit(name).cast("string"), terms)).first()[0])
    assert keys("Water  Energy Board (WEB)") == {"water energy board", "web"}
    assert keys("Ana Ruiz, Board Chair") == {"ana ruiz, board chair", "ana ruiz"}
    assert keys("Ana Ruiz (Chair, WEB)") == {"ana ruiz", "ana ruiz (chair, web)"} or keys("Ana Ruiz (Chair, WEB)") == {"ana ruiz"}
    assert keys("ABC Works, Ltd.") == {"abc works, ltd"}
    assert keys(None) == set() and keys("x (not an acronym)") == {"x"}
    assert keys("side roads (minor roads)", True) == {"side roads", "side road", "minor roads", "minor road"}
    assert {keys(x, True).pop() for x in ("branch", "bus", "glass")} == {"branch", "bus", "glass"} and "branch" in keys("branches", True)


def test_regions(spark):
    given = {"California, USA": "us", "Germany; Kenya": "europe", "Wales and England": "europe", "": "elsewhere", None: "elsewhere", "Texás": "us", "the United States (west)": "us", "Perú / France": "europe", "Andorra": "elsewhere", "Kenya, U.S.": "us"}
    rows = spark.createDataFrame([(c,) for c in given], "c string").select("c", reports.region_of(F.col("c")).alias("r")).collect()
    assert {r["c"]: r["r"] for r in rows} == given


def test_more_than_26_papers_of_a_name(spark):
    rows = passages.told_apart(spark.createDataFrame([(i, "Bo 2020") for i in range(800)] + [(900, "Xu 2021")], "paper int, author_year string")).collect()
    names = {r["paper"]: r["name"] for r in rows}
    assert [names[i] for i in (0, 25, 26, 27, 51, 52, 701, 702, 900)] == ["Bo 2020" + x for x in ("a", "z", "aa", "ab", "az", "ba", "zz", "aaa")] + ["Xu 2021"]
    assert len(set(names.values())) == 801


def test_values_as_readers_compare_them(spark):
    cases = [("a\u2013b", "x A-B", True), ("\uff12\uff10", "20 of", True), ("*it*  is", "It is", True), ("e\ufb03cient", "Efficient", True), ("\u201cso\u201d", 'He said "So"', True), ("", "x", False), (None, "x", False), ("x", None, False)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    assert {r["i"]: r["x"] for r in rows.select("i", passages.value_in(F.col("a"), F.col("b")).alias("x")).collect()} == {i: x for i, (_, _, x) in enumerate(cases)}


def test_sentences_and_lines(spark):
    rows = spark.createDataFrame([("See Fig. 2 by Bo et al. in 2020. It holds, e.g. here. Done!", "a bro-\nken line\nof text\n\nnext")], "a string, b string")
    r = rows.select(passages.whole_sentences(F.col("a")).alias("s"), passages.soft_wrapped(F.col("b")).alias("w")).first()
    assert r["s"] == ["See Fig. 2 by Bo et al. in 2020.", "It holds, e.g. here.", "Done!"]
    assert r["w"] == "a broken line of text\n\nnext"


def test_search_terms(spark):
    found = spark.range(1).select(tx.search_terms(F.lit("What does their Grid grid cost from the ridge?"))).first()[0]
    assert found == ["grid", "cost", "ridge"]


def test_screen_windows_with_overlap(spark):
    """Against a plain loop: whole rows up to the size, a row at least, the last row once more at the head of the next window."""
    rows = [(g, i, (g * 7 + i * 13) % 50 + 1) for g in range(4) for i in range(30)]
    found = units.screen_windows(spark.createDataFrame(rows, "g int, i int, n int"), "g", ["i"], "n", 100, overlap=1)
    got: dict = {}
    for r in found.collect():
        got.setdefault((r["g"], r["window"]), []).append(r["i"])
    for g in range(4):
        sizes = {i: n for gg, i, n in rows if gg == g}
        windows = [sorted(v) for (gg, _), v in sorted(got.items()) if gg == g]
        assert sorted({i for w in windows for i in w}) == list(range(30))
        for w, nxt in zip(windows, windows[1:], strict=False):
            assert nxt[0] == w[-1] or nxt[0] == w[-1] + 1
            assert len(w) <= 2 or sum(sizes[i] for i in w) <= 100


def test_stratified_sample_counts_strata(spark):
    rows = spark.createDataFrame([(i, "a" if i < 90 else "b") for i in range(100)], "id int, s string")
    per = {r["s"]: r["count"] for r in units.stratified(rows, "s", "id", 30).groupBy("s").count().collect()}
    assert per == {"a": 20, "b": 10}


def test_numbered_over_ranges(spark):
    rows = spark.createDataFrame([((i * 7919) % 1000, i) for i in range(1000)], "v int, id int").repartition(7)
    assert all(r["v"] == r["place"] for r in reports.numbered(rows, ["v", "id"], "place").collect())


def test_bootstrap_holds_kappa(spark):
    rows = [("x", "x")] * 40 + [("y", "y")] * 30 + [("x", "y")] * 10
    df = spark.createDataFrame(rows, "a string, b string")
    low, high = stats.bootstrap(df, 2000).first()
    assert low < 0.745 < high and 0.2 < high - low < 0.45


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTP://Example.ORG:80/a/./b/../c/?utm_source=x&b=2&a=1#f", "http://example.org/a/c?a=1&b=2"),
        ("https://example.org/a/b/..", "https://example.org/a"),
        ("https://example.org/%7Euser/%2e%2E/x", "https://example.org/x"),
        ("https://b\u00fccher.example/stra\u00dfe?q=\u00e4", "https://xn--bcher-kva.example/stra%C3%9Fe?q=%C3%A4"),
        ("ftp://Host.example:21/x/", "ftp://host.example/x"),
        ("urn:isbn:0451450523", "urn://isbn:0451450523"),
        ("mailto:a@b.example", "mailto://a@b.example"),
        ("git://Host/x/../y", "git://Host/y"),
        ("https://example.org/a b", "https://example.org/a%20b"),
        ("no url", None),
        ("https://", None),
    ],
)
def test_canonical_url(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "u string").select(ident.canonical_url(F.col("u"))).first()[0] == want


def test_tables_of_any_kind(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffx;y\n1;"a;b"\n2;c\n')
    (tmp_path / "b.jsonl").write_text('{"n": 1, "f": true, "l": ["p", "q"]}\n{"n": null, "f": false, "l": []}\n')
    (tmp_path / "c.tsv").write_text("x\ty\n1\t2\n")
    (tmp_path / ".hidden.csv").write_text("x\n1\n")
    rows = lambda name: sorted(map(tuple, files.any_table(spark, f"{tmp_path}/{name}").collect()))
    assert rows("a.csv") == [("1", "a;b"), ("2", "c")]
    assert files.any_table(spark, f"{tmp_path}/a.csv").columns == ["x", "y"]
    assert rows("b.jsonl") == [("False", "", ""), ("True", "p;q", "1")]
    assert rows("c.tsv") == [("1", "2")]
    found = files.table_files(spark, [str(tmp_path)])
    assert [x.rsplit("/", 1)[-1] for x in found] == ["a.csv", "b.jsonl", "c.tsv"]
    assert files.table_names(["/p/One X/t.csv", "/p/two/t.csv", "/p/two/u.csv"]) == {"/p/One X/t.csv": "one-x_t", "/p/two/t.csv": "two_t", "/p/two/u.csv": "u"}


def test_captions(spark):
    text = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.500 align:start\nAnn B: <i>Hello</i>\nthere\n\n00:03,500 --> 00:04,000\nno name\n\n00:05 --> 00:06\n\n00:07 --> 00:08\nat 10:30: now"
    found = files.captions(spark.createDataFrame([(1, text)], "id int, text string"), "id").orderBy("start").collect()
    assert [tuple(r)[2:] for r in found] == [(1.0, 2.5, "Ann B", "Hello there"), (3.5, 4.0, None, "no name"), (7.0, 8.0, None, "at 10:30: now")]


def test_hits_decide_behind_a_sort_merge_join(spark):
    """Where neither side is small enough for a broadcast, the text still decides."""
    texts = spark.createDataFrame([(1, "a passage of some length, twice: a passage of some length"), (2, "nothing"), (3, None)], "doc_id int, text string")
    quotes = spark.createDataFrame([(1, "passage of some length"), (2, "no passage of such a length"), (3, "thing")], "quote_id int, quote string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = anchoring.hits(texts, quotes)
        assert "SortMergeJoin" in found._jdf.queryExecution().toString()
        start = F.instr("text", F.col("quote")) - 1
        assert sorted(map(tuple, found.select("doc_id", "quote_id", start).collect())) == [(1, 1, 2), (2, 3, 2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_reach_python_in_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    anchoring.hits(spark.createDataFrame([(1, "x" * 20)], "doc_id int, text string"), spark.createDataFrame([(1, "x" * 17)], "quote_id int, quote string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
