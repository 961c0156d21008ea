"""Page furniture, reference lists, quoted blocks and units of a cell, on planted texts and against plain versions."""

from __future__ import annotations

import random
import re

import pytest

from corpuslens.operators import furniture, reports


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, text string")


def cleaned(spark, text, level="standard"):
    return furniture.without_furniture(texts(spark, text), "id", level).first()


def page(i: int, n: int = 4) -> str:
    prose = "\n".join(f"A line of prose number {i * 10 + k} stands on this page, as it should." for k in range(n))
    return f"## Page {i}\nJournal of Things {i}\n{prose}\n\n- {i} -"


def test_furniture_goes_and_prose_stays(spark):
    text = "\n".join(page(i) for i in range(1, 6)) + "\n[Home](/) | [About](/about)\nRead it at https://example.org/a-paper as the authors wrote in a long sentence."
    r = cleaned(spark, text)
    assert (r["page_marker"], r["page_number"], r["running_head"], r["repeated_line"], r["nav_line"]) == (5, 4, 6, 0, 1)  # the last number isn't at a page's end, but stands like the others
    assert r["text"].count("prose number") == 20 and "Journal" not in r["text"] and "Home" not in r["text"] and "Read it at" in r["text"]
    assert r["text"].endswith("sentence.\n") and "\n\n\n" not in r["text"]


def test_fences_are_verbatim(spark):
    text = "before\n```\nPage 3\n[x](y)\n- 4 -\n```\nPage 4\nafter"
    r = cleaned(spark, text)
    assert r["text"] == "before\n```\nPage 3\n[x](y)\n- 4 -\n```\nafter\n" and r["page_marker"] == 1


def test_numbers_inside_pages_are_data(spark):
    body = "\n".join(f"## Page {i}\nhead line of this one {'abcdef'[i]}\nwords\n12\n0.5\nC\nwords\nfoot {'ghijkl'[i]} of it" for i in range(5))
    r = cleaned(spark, body)
    assert r["page_number"] == 0 and r["text"].count("\n12\n") == 5 and r["running_head"] == 0


def test_pagination_without_dividers(spark):
    text = "\n".join(f"prose of page {i}\nmore of it\n{i}" for i in range(1, 8)) + "\n99\nend"
    r = cleaned(spark, text)
    assert r["page_number"] == 7 and "99" in r["text"] and not re.search(r"(?m)^[1-7]$", r["text"])


def test_levels(spark):
    text = "\n".join(f"prose {'abcdef'[i]} of it\nSubscribe now {i}" for i in range(5)) + "\nsee https://x.org for more about that thing"
    assert cleaned(spark, text)["repeated_line"] == 0
    r = cleaned(spark, text, "aggressive")
    assert r["repeated_line"] == 5 and r["nav_line"] == 1 and "Subscribe" not in r["text"]
    none = cleaned(spark, text, "none")
    assert none["text"] == text and none["nav_line"] == 0


def test_coversheet_is_told_and_kept(spark):
    cover = "University Repository\nLink to published version\nTerms of Use\nCiting this paper"
    r = cleaned(spark, cover + "\ntext")
    assert sorted(r["coversheet"]) == ["citing this paper", "link to published version", "repository", "terms of use"] and "Terms of Use" in r["text"]
    assert cleaned(spark, "\n" * 70 + cover)["coversheet"] == [] and cleaned(spark, "a repository of words")["coversheet"] == []


def test_empty_texts(spark):
    found = {r["id"]: r for r in furniture.without_furniture(texts(spark, None, "", "\n \n"), "id").collect()}
    assert [found[i]["text"] for i in range(3)] == ["", "", ""] and all(found[i]["page_marker"] == 0 for i in range(3))


def test_page_edges(spark):
    pages = [(1, p, f"Report {p}\n\n" + "\n".join(f"body {chr(96 + p)}{chr(97 + k)}" for k in range(9)) + f"\nReport {p}\n[{p}]") for p in range(1, 5)] + [(2, 1, "only"), (2, 2, None)]
    df = spark.createDataFrame(pages, "doc long, page long, text string")
    running = reports.running_lines(df, edge=3).withColumnRenamed("key", "line_key")
    found = {(r["doc"], r["page"]): r for r in furniture.page_edges(df, running, "doc").collect()}
    assert found[1, 2]["removed"] == 3 and "Report" not in found[1, 2]["text"] and found[1, 2]["text"].count("body") == 9
    assert found[2, 1]["text"] == "only" and found[2, 2]["text"] == ""


ENTRY = "Bo, A. ({}). The title of a work that is long enough to be weighed here, vol. 3, pp. 10-19. doi 10.1/x"
PROSE = "This is a paragraph of prose that goes on for long enough to be weighed, without any sign of a list in it at all."


def references(spark, *given):
    return [(r["start"], r["found_by"]) for r in furniture.references(texts(spark, *given), "id").orderBy("id").collect()]


def test_reference_lists(spark):
    prose = "\n\n".join([PROSE] * 12)
    entries = "\n\n".join(ENTRY.format(2000 + i) for i in range(5))
    at = len(prose) + 2
    footer = "Publisher's note: " + "words " * 15
    found = references(
        spark,
        f"{prose}\n\nReferences\n\n{entries}", f"{prose}\n\n5. Bibliography:\n{entries}", f"{prose}\n\n{entries}", f"{prose}\n\n{entries}\n\n{footer}\n\n{footer}",
        f"{prose}\n\n{entries}\n\n{footer}\n\n{footer}\n\n{footer}", f"{entries}\n\n{prose}", f"References\n\n{prose}", prose, None, "", f"{prose}\n\n{entries}\n\nshort\n\n{'long words ' * 60}", f"{prose}\n\nReferences: they are rare, as said.", f"{prose}\n\nReferenceless prose here.",
    )
    none = (None, None)
    assert found == [(at, "heading"), (at, "heading"), (at, "density"), (at, "density"), none, none, none, none, none, none, none, (at, "heading"), none]


def test_list_reaches_back_to_the_first_prose(spark):
    prose = "\n\n".join([PROSE] * 12)
    text = f"{prose}\n\n{ENTRY.format(1999)}\n\n{PROSE}\n\n{ENTRY.format(2001)}\n\ntiny\n\n{ENTRY.format(2002)}"
    assert references(spark, text) == [(text.index(ENTRY.format(2001)), "density")]


def blocks(spark, style, *given, nested=False):
    rows = [(i, t, s) for i, (t, s) in enumerate(x if isinstance(x, tuple) else (x, None) for x in given)]
    df = spark.createDataFrame(rows, "id long, text string, sources array<string>")
    out = {i: [] for i, _, _ in rows}
    for r in furniture.quote_blocks(df, "id", style, nested).orderBy("id", "start").collect():
        assert r["kind"] in ("own", "quote") and r["start"] < r["end"]
        out[r["id"]].append((r["kind"], rows[r["id"]][1][r["start"] : r["end"]], r["author"], r["source"]))
    for i, text, _ in rows:
        assert "".join(x[1] for x in out[i]) == (text or "")  # the parts are the whole cell
    return out


def test_forum_blocks(spark):
    one = "Hello.\nBo said:\nhis words\nClick to expand...\nMy answer."
    two = "A b said: \nx\nClick to expand...\nC said:\nD said: no line\ny\nClick to expand..."
    found = blocks(spark, "xenforo", (one, ["7"]), (two, ["7", "8"]), (two, ["7"]), ("no end here, Bo said:\nx", None), ("lost\nClick to expand...rest", ["1"]), ("", None), (None, None), ("\U0001f600 Bo said:\nq\nClick to expand...z", None))
    assert found[0] == [("own", "Hello.\n", "", ""), ("quote", "Bo said:\nhis words\nClick to expand...", "Bo", "7"), ("own", "\nMy answer.", "", "")]
    assert [x[2:] for x in found[1] if x[0] == "quote"] == [("A b", "7"), ("C", "8")]
    assert [x[3] for x in found[2] if x[0] == "quote"] == ["", ""]  # counts differ
    assert found[3] == [("own", "no end here, Bo said:\nx", "", "")]
    assert found[4][0] == ("quote", "lost\nClick to expand...", "", "1")
    assert found[5] == found[6] == [] and found[7][0][2] == "\U0001f600 Bo"


def nest(r: random.Random, depth: int) -> str:
    inner = "".join(nest(r, depth - 1) for _ in range(r.randint(0, 2))) if depth else ""
    return f"N{r.randint(0, 9)} said:\nwords {r.randint(0, 99)}\n{inner}more\nClick to expand...\n"


@pytest.mark.parametrize("seed", range(3))
def test_nested_blocks_pair_as_brackets(spark, seed):
    r = random.Random(seed)
    given, want = [], []
    for _ in range(12):
        parts = [(r.random() < 0.5, nest(r, 3)) for _ in range(r.randint(1, 4))]
        text = "".join(f"own {i}\n{x}" if quoted else f"own {i}\n" for i, (quoted, x) in enumerate(parts))
        given.append(text)
        want.append([x.rstrip("\n") for quoted, x in parts if quoted])
    found = blocks(spark, "xenforo", *given, "tail said:\nnever ended", "Click to expand...x\nA said:\ny\nClick to expand...", nested=True)
    assert [[x[1] for x in found[i] if x[0] == "quote"] for i in range(12)] == want
    assert [x[0] for x in found[12]] == ["own"]
    assert [x[1] for x in found[13] if x[0] == "quote"] == ["A said:\ny\nClick to expand..."]


def test_markdown_and_mail_blocks(spark):
    found = blocks(spark, "markdown", "> a\n > b\nmine\n\n> c", "mine\n", ">", None)
    assert [(k, t) for k, t, _, _ in found[0]] == [("quote", "> a\n > b\n"), ("own", "mine\n\n"), ("quote", "> c")]
    assert [(k, t) for k, t, _, _ in found[1]] == [("own", "mine\n")] and [(k, t) for k, t, _, _ in found[2]] == [("quote", ">")]
    found = blocks(spark, "email", "Yes.\nOn Monday, Bo wrote:\n> x", "no mail", "On Monday, Bo wrote:\nx")
    assert [(k, t) for k, t, _, _ in found[0]] == [("own", "Yes.\n"), ("quote", "On Monday, Bo wrote:\n> x")]
    assert [k for k, *_ in found[1]] == ["own"] and [k for k, *_ in found[2]] == ["quote"]
    assert [k for k, *_ in blocks(spark, "plain", "a")[0]] == ["own"]


def test_own_words(spark):
    df = spark.createDataFrame([(1, "a\n> b\nc", None), (2, None, None), (3, "> x", None)], "id long, text string, sources array<string>")
    assert {r["id"]: r["text"] for r in furniture.own_words(df, "id", "markdown").collect()} == {1: "a\nc", 2: "", 3: ""}


def test_units_of_a_cell(spark):
    text = "Aims of the rule\n- the first line of the list.\n• short\nBo said:\nA quoted line that is long.\nClick to expand...\nThe answer, which is long enough.\nRule 7 on posts\nits text follows here, too."
    df = spark.createDataFrame([(5, text, None), (6, None, None), (7, "x", None)], "id long, text string, sources array<string>")
    rows = furniture.segment_units(df, "id", style="xenforo", keep_heading=r"^Rule \d+").orderBy("id", "n").collect()
    assert [(r["unit"], text[r["start"] : r["end"]], r["heading"]) for r in rows] == [
        ("5-001", "the first line of the list.", "Aims of the rule"), ("5-002", "The answer, which is long enough.", "Aims of the rule"),
        ("5-003", "Rule 7 on posts", ""), ("5-004", "its text follows here, too.", "Rule 7 on posts"),
    ]
    whole = furniture.segment_units(spark.createDataFrame([(1, "  one paragraph\nof two lines  \n\n \nthe second one here\n\ntiny", None)], "id long, text string, sources array<string>"), "id", by="paragraph").orderBy("n").collect()
    assert [(r["n"], r["start"], r["end"]) for r in whole] == [(1, 2, 28), (2, 34, 53)]
    many = furniture.segment_units(spark.createDataFrame([(1, "\n".join(f"a line of the cell, {i}." for i in range(1200)), None)], "id long, text string, sources array<string>"), "id")
    assert many.where("unit = '1-1200'").count() == 1


@pytest.mark.parametrize("level", ["standard", "aggressive"])
def test_lines_stay_where_their_text_is(spark, level):
    """Whole texts and paginations are shuffled, lines aren't, and no frame looks at all lines ahead of each line."""
    found = furniture.without_furniture(texts(spark, "a\nPage 1\nb"), "id", level)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "1, unboundedfollowing" not in plan.replace("$()", "")
