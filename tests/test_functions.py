"""Known answers of scalar functions and statistics, readers, the journal as a stream."""

from __future__ import annotations

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import ident, text
from corpuslens.operators import anchoring, appraise, coding, diff, gates, search, stats, transcripts
from corpuslens.sources import files
from corpuslens.streaming import journal


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("HTTP://Example.COM:80/Path/", "http://example.com/Path"), ("https://a.org/?utm_source=z&b=2&a=1", "https://a.org/?a=1&b=2"), ("http://a.org/%7Euser%2f", "http://a.org/~user%2F"), ("https://a.org:8443#top", "https://a.org:8443/"), ("ftp://a.org/x", "ftp://a.org/x"), ("no url", None), (None, None), ("http://[::1]:80/x", "http://[::1]/x"), ("http://[2001:DB8:0:0:0:0:0:1]:8080", "http://[2001:db8::1]:8080/"), ("http://[::g]/x", None), ("http://0x7f.1/y", "http://127.0.0.1/y"), ("http://017700000001", "http://127.0.0.1/"), ("http://192.168.0.1:80/a", "http://192.168.0.1/a"), ("http://1.2.3.4.5/", None), ("http://a.256/", None), ("https://b\u00fccher.example/\u00e4?q=\u00f6", "https://xn--bcher-kva.example/%C3%A4?q=%C3%B6")])
def test_canonical_url(spark, raw, want):
    assert one(spark, ident.canonical_url(F.lit(raw).cast("string"))) == want
    rows = spark.createDataFrame([(1, raw)], "i int, u string")
    assert [r["c"] for r in ident.canonical_urls(rows, "u", "c").collect()] == [want]


@pytest.mark.parametrize(("raw", "want"), [("Caf\u00e9 Soci\u00e9t\u00e9", "cafe-societe"), ("\u6d4b\u8bd5", "untitled"), ("--A  b--", "a-b"), (None, "untitled")])
def test_slug(spark, raw, want):
    assert one(spark, ident.slugify(F.lit(raw).cast("string"))) == want


def test_reserved_slug_gets_a_suffix(spark):
    assert one(spark, ident.slug_with_suffix(F.lit("con"), F.lit("src-abcdef123456"), F.lit(0))) == "con--abcdef"


@pytest.mark.parametrize(("path", "bad"), [("a/b.txt", False), ("../a", True), ("a\\b", True), ("a:b", True), ("aux.txt", True), ("/a", True), ("", True), ("a. /b", True)])
def test_filename_problem(spark, path, bad):
    assert (one(spark, ident.filename_problem(F.lit(path))) is not None) == bad


def test_ids_hash_canonical_json(spark):
    locator = one(spark, ident.char_range_json(F.lit("rep-5e4a2d156536"), F.lit(247), F.lit(306)))
    assert locator == '{"representation_ref":"rep-5e4a2d156536","type":"char_range","value":{"end":306,"start":247}}'
    want = hashlib.sha256(f"ext\nsrc-1\nrep-1\n{locator}\nq".encode()).hexdigest()[:12]
    assert one(spark, ident.mint_ext_id(F.lit("src-1"), F.lit("rep-1"), F.lit(locator), F.lit("q"))) == f"ext-{want}"


def test_pseudonym_is_an_hmac(spark):
    for key in ("k", "long" * 40):
        assert one(spark, ident.pseudonym(F.lit("Ann"), key)) == "User-" + hmac.new(key.encode(), b"Ann", "sha256").hexdigest()[:6]


def test_satisfies(spark):
    for version, need, want in (("1.5.2", "^1.4.0", True), ("2.0.0", "^1.4.0", False), ("1.10.0", ">=1.9.9", True), ("1.0", "1.0.0", True)):
        assert one(spark, ident.satisfies(F.lit(version), F.lit(need))) is want


def test_spans_count_code_points(spark):
    assert one(spark, text.span(F.lit("a\U0001f600b"), F.lit(0), F.lit(2))) == "a\U0001f600"
    assert one(spark, text.occurrences(F.lit("aaaa"), F.lit("aa"))) == 3
    assert one(spark, text.occurrences(F.lit("x\\Ey"), F.lit("\\E"))) == 1


def test_markers(spark):
    t = 'He said "short one" [ext-0123456789ab].\n```quote ext-ba9876543210\nline one\nline two\n```\nand "this sentence is cited by nobody".'
    found = one(spark, text.quote_markers(F.lit(t)))
    assert [(r["form"], r["quote"]) for r in found] == [("block", "line one\nline two"), ("inline", "short one")]
    assert one(spark, text.uncited_quotes(F.lit(t))) == ["this sentence is cited by nobody"]


def test_refind(spark):
    source = "The co\u2010\noperation \u201cworked\u201d well\u2026 then it  stopped."
    assert one(spark, text.refind_status(F.lit(source), F.lit('cooperation "worked" well...')))["status"] == "refound"
    assert one(spark, text.refind_status(F.lit("x y x y"), F.lit("x y")))["status"] == "ambiguous"
    assert one(spark, text.refind_status(F.lit("x"), F.lit(" ")))["status"] == "not_found"


@pytest.mark.parametrize(("quote", "want"), [("a b", "ambiguous"), ("only here", "exact"), ("ONLY  here", "normalized"), ("twelve letters ... stands only here", "elided"), ("", "missing"), ("nowhere at all", "not found")])
def test_quote_check(spark, quote, want):
    assert one(spark, text.quote_check(F.lit("a b a b, twelve letters and what stands only here"), F.lit(quote))) == want


def test_clock_and_dates(spark):
    assert one(spark, text.clock(F.lit(3725.9))) == "1:02:05" and one(spark, text.clock(F.lit(65))) == "1:05"
    assert one(spark, text.clock_seconds(F.lit("1:02:05,5"))) == 3725.5
    assert one(spark, text.date_key(F.lit("2020-03"))) == "2020-03-99" and one(spark, text.date_key(F.lit("in 1999 or so"))) == "1999-99-99"


@pytest.mark.parametrize(("row", "want"), [((True, "char_range", 2, 4, "cd"), None), ((True, "char_range", 1, 3, "cd"), "quote_gate_failed"), ((True, "page", 2, 4, "cd"), "quote_locator_missing"), ((True, "char_range", 2, 9, "cd"), "locator_range_invalid"), ((False, "char_range", 2, 4, "cd"), "invalid_utf8"), ((True, "char_range", None, 4, "cd"), "locator_range_invalid")])
def test_hop_b_codes(spark, row, want):
    ok, kind, a, b, quote = row
    assert one(spark, gates.hop_b_code(F.lit("abcdef"), F.lit(ok), F.lit(kind), F.lit(a).cast("long"), F.lit(b).cast("long"), F.lit(quote))) == want


def test_statistics(spark):
    pairs = spark.createDataFrame([("y", "y")] * 10 + [("n", "n")] * 5 + [("y", "n")] * 3 + [("n", "y")] * 2, "a string, b string")
    pe = 13 / 20 * 12 / 20 + 7 / 20 * 8 / 20
    assert stats.kappa(pairs).first()["kappa"] == pytest.approx((0.75 - pe) / (1 - pe))
    same = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "a double, b double")
    assert stats.weighted_kappa(same, 0, 4).first()["kappa"] == 1 and stats.alpha_nominal(same).first()["alpha"] == 1
    low, high = one(spark, stats.wilson(F.lit(8), F.lit(10)))
    assert (round(low, 3), round(high, 3)) == (0.490, 0.943)
    assert stats.kappa(pairs.limit(0)).collect() == []


def test_bootstrap_holds_the_point_value(spark):
    pairs = spark.createDataFrame([("y", "y")] * 400 + [("n", "n")] * 300 + [("y", "n")] * 80 + [("n", "y")] * 90, "a string, b string")
    low, high = stats.bootstrap(pairs).first()
    assert low < stats.kappa(pairs).first()["kappa"] < high and high - low < 0.2


def test_codings(spark):
    codes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "code string, parent string")
    assert {(r["code"], r["depth"]) for r in coding.ancestors(codes).where("ancestor = 'a'").collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r[0] for r in coding.cycles(codes).collect()} == {"x", "y"}


def test_anchor_and_reanchor(spark):
    texts = spark.createDataFrame([(1, "one two three two")], "doc_id int, text string")
    found = anchoring.anchor(texts, spark.createDataFrame([(1, i, q) for i, q in enumerate(["one", "two", "Three.", "four", ""])], "doc_id int, quote_id int, quote string"), normalize=True)
    assert [r["status"] for r in found.orderBy("quote_id").collect()] == ["anchored", "ambiguous", "refound", "not_found", "invalid"]
    again = anchoring.reanchor(spark.createDataFrame([("e", 1, "three"), ("f", 1, "two")], "extraction_id string, doc_id int, direct_quote string"), texts)
    assert {r["extraction_id"]: r["status"] for r in again.collect()} == {"e": "reanchored", "f": "needs_review"}


ANSWERS = "paper string, profile string, design string, start string, question string, dim string, critical boolean, answer string"


@pytest.mark.parametrize(
    ("design", "start", "answers", "grade"),
    [
        ("trial", "High", "yes partly|yes", "High"),  # the start is kept
        ("trial", "High", "not found|yes", "Low"),  # a critical dimension unmet
        ("trial", "High", "not found,not found|yes", "Low"),  # two questions of one dimension
        ("trial", "High", "not found;not found|yes", "Very low"),  # two critical dimensions
        ("trial", "High", "can't tell;yes;yes|yes", "Moderate"),  # one unclear
        ("trial", "High", "yes|not found,yes,not found", "Moderate"),  # two missing elsewhere
        ("trial", "High", "yes|not found,yes", "High"),
        ("trial", "High", "can't tell|can't tell,yes", "Not appraisable"),  # over half
        ("trial", "Very low", "can't tell;yes|not found,not found,yes", "Very low"),  # never below
        ("systematic-review", "High", "yes|yes", "Moderate"),  # needs q6 and q7
        ("trial", None, "yes|yes", "Not appraisable"),
    ],
)
def test_grade_vectors(spark, design, start, answers, grade):
    """Critical dimensions stand before the bar, parted by semicolons; answers of a dimension are parted by commas."""
    critical, other = answers.split("|")
    dims = [(d, True) for d in critical.split(";")] + [(other, False)]
    given = [(f"d{i}", c, x.strip()) for i, (d, c) in enumerate(dims) for x in d.replace("yes partly", "yes,partly").split(",")]
    rows = [("p", "q", design, start, f"q{n + 10}", d, c, None if x == "can't tell" and n % 2 else x) for n, (d, c, x) in enumerate(given)]
    assert [r["grade"] for r in appraise.grade(spark.createDataFrame(rows, ANSWERS)).collect()] == [grade]


def test_grade_of_a_full_review(spark):
    rows = [("p", "q", "systematic-review", "High", q, "d", True, a) for q, a in (("q6", "yes"), ("q7", "partly"), ("q8", "yes"))]
    found = appraise.grade(spark.createDataFrame(rows, ANSWERS))
    assert [r["grade"] for r in found.collect()] == ["High"]
    weak = spark.createDataFrame([("p", "High"), ("p", "Low"), ("r", "Not appraisable"), ("r", "Moderate"), ("s", "Not appraisable")], "paper string, grade string")
    assert {r["paper"]: r["grade"] for r in appraise.weaker(weak).collect()} == {"p": "Low", "r": "Moderate", "s": "Not appraisable"}


def test_confidence_vectors(spark):
    shape = "statement string, paper string, lead string, verdict string, gap string, origin string, grade string, runs array<string>"
    rows = lambda s, *passages: [(s, p, lead, v, gap, origin, g, None) for p, lead, v, gap, origin, g in passages]
    given = rows("three", *[(p, p, "supports", "none", "own", "High") for p in "abc"])
    given += rows("relayed", ("a", "a", "supports", "none", "own", "Low"), ("b", "b", "supports", "none", "reported", "High"))
    given += rows("one", ("a", "a", "supports", "none", "own", "Moderate"))
    given += rows("one high", ("a", "a", "supports", "none", "own", "High"))
    given += rows("partly", ("a", "a", "partly", "big", "own", "Low"))
    given += rows("none", ("a", "a", "does not support", "none", "own", "High"))
    given += rows("same lead", *[(p, "L", "supports", "none", "own", "Moderate") for p in "abc"])
    given += [("runs", "a", "a", None, None, "own", "High", ["supports", "partly"]), ("open", "a", "a", None, None, "own", "High", ["supports"])]
    found = {r["statement"]: tuple(r)[1:] for r in appraise.confidence(spark.createDataFrame(given, shape)).collect()}
    assert found == {
        "three": (3, 3, "robust", "high", "very high"), "relayed": (1, 1, "limited", "medium", "low"), "one": (1, 1, "limited", "medium", "low"),
        "one high": (1, 1, "medium", "medium", "medium"), "partly": (1, 1, "limited", "low", "very low"), "none": (0, 0, None, None, "not supported by its passages"),
        "same lead": (1, 3, "limited", "medium", "low"), "runs": (0, 0, None, None, "runs disagreed"), "open": (0, 0, None, None, "not checked"),
    }


def test_keyword_places_and_merge(spark):
    found = search.keyword_places(spark.createDataFrame([(1, "ab x AB y ab z ab")], "id int, text string"), "id", "ab", most=3).orderBy("hit").collect()
    assert [r["start"] for r in found] == [0, 5, 10]
    hits = lambda *ids: spark.createDataFrame([(i, float(i)) for i in ids], "id int, score double")
    assert {(r["id"], r["via"]) for r in search.merge(hits(1), hits(1, 2), hits(2, 3), 4).collect()} == {(1, "coded"), (2, "semantic"), (3, "keyword")}


def test_turns_with_asides(spark):
    rows = [("r", 1, "M", False, False), ("r", 2, "R", True, False), ("r", 3, "M", False, False), ("r", 4, "R", False, False), ("r", 5, None, False, True), ("r", 6, "M", False, False)]
    found = transcripts.turns(spark.createDataFrame(rows, "rec string, ord int, speaker string, aside boolean, left_out boolean")).orderBy("ord").collect()
    assert [r["turn"] for r in found] == [1, 1, 1, 2, 3, 4]


def test_chains_by_doubling(spark):
    links = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)] + [(100, None)], "id int, supersedes int")
    assert {tuple(r) for r in diff.chains(links).select("first", "current", "revisions").distinct().collect()} == {(0, 39, 40), (100, 100, 1)}


def test_json_lines_findings(spark, tmp_path):
    good = json.dumps({"event_id": "e1", "outputs": {"ids": ["a"]}})
    (tmp_path / "torn.jsonl").write_text(f'{good}\n{{"event_id": "e')
    (tmp_path / "bad.jsonl").write_text(f"{good}\nnot json\n")
    rows, found = files.json_lines(spark, str(tmp_path), files.EVENT)
    assert [r["event_id"] for r in rows.collect()] == ["e1", "e1"]
    assert {(r["file"].rsplit("/")[-1], r["code"]) for r in found.collect()} == {("torn.jsonl", "jsonl_torn_tail"), ("bad.jsonl", "jsonl_invalid")}


def test_texts_and_tables(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_bytes("h\u00e9\U0001f600".encode())
    (tmp_path / "t" / "b.txt").write_bytes(b"\xff\xfe\x00")
    found = {r["path"].rsplit("/")[-1]: r for r in files.texts(spark, str(tmp_path / "t")).collect()}
    assert (found["a.txt"]["utf8_ok"], found["a.txt"]["char_count"]) == (True, 3) and not found["b.txt"]["utf8_ok"]
    (tmp_path / "x.csv").write_bytes('\ufeffid,text\r\n1,"two\r\nlines, and ""quotes"""\r\n2,\r\n'.encode())
    assert [tuple(r) for r in files.table(spark, str(tmp_path / "x.csv")).orderBy("id").collect()][0][0] == "1"


def test_stream_goes_on_from_where_it_stopped(spark, tmp_path):
    shape = "event_id long, ts timestamp, user_id long, event_type string, value double"
    put = lambda rows: spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").selectExpr("event_id", "cast(t as timestamp) ts", "user_id", "event_type", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([(1, "2024-01-01 10:10:00", 1, "a", 1.0), (2, "2024-01-01 10:50:00", 1, "a", 2.0)])
    go = lambda: journal.run(spark, spark.readStream.schema(shape).parquet(str(tmp_path / "in")), journal.windows, str(tmp_path / "out"), str(tmp_path / "progress"))
    assert [(r["n"], r["total"]) for r in go().collect()] == [(2, 3.0)]
    put([(3, "2024-01-01 10:20:00", 1, "a", 4.0), (4, "2024-01-01 11:20:00", 2, "a", 5.0)])
    assert [(r["n"], r["total"]) for r in go().orderBy("start").collect()] == [(3, 7.0), (1, 5.0)]


def test_leaks_finds_partial_short_and_rewrapped_ones(spark):
    hidden, short = "".join(chr(97 + i * 7 % 26) + str(i) + " " * (i % 3 == 0) for i in range(80)), "a short hidden passage 1"
    cut = lambda share: "x " + hidden[: int(len(hidden) * share)]
    docs = [(1, "x " + hidden), (2, cut(0.85)), (3, cut(0.5)), (4, f"has {short}."), (5, hidden.replace(" ", "\n  ")), (6, f"a SHORT {short[8:]}"), (7, None)]
    texts = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["found"] / r["windows"] for r in gates.leaks(texts, spark.createDataFrame([(1, hidden), (2, short), (3, "under twenty"), (4, None)], "item_id long, hidden string")).collect()}
    assert sorted(found) == [(1, 1), (2, 1), (4, 2), (5, 1)] and found[1, 1] == found[4, 2] == found[5, 1] == 1 and 0.6 <= found[2, 1] < 1
