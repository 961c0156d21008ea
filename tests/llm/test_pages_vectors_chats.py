"""HTML extraction, embedding near-dedup and chat formatting."""

from __future__ import annotations

import hashlib
import html
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import chat, html_text, near_vectors, queries

from . import plain

# HTML extraction


def extract(page: str) -> list[str]:
    return html_text.extract(page, html_text.PRIOR).split("\n\n")


def test_article_alone_is_kept():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1><a href=/>Home</a></header>
    <nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav><div class="cookie-notice"><p>We use cookies. Accept them all, please.</p></div>
    <article><h2>A &lt;title&gt; &amp; more</h2><p>First   paragraph of the article,
    with <b>bold</b> and <a href=z>a link</a>.<p>Second one &#233;&nbsp;x.<script>var a = "</p>";</script><ul><li>item one of the list.</ul></article>
    <form><label>Mail</label><input></form><section id="comments"><p>A reader's comment that is quite long and ends in a stop.</p></section>
    <aside>Related</aside><div class="ad">Buy now, it is cheap and good.</div><footer>&copy; Site</footer></body></html>"""
    assert extract(page) == ["A <title> & more", "First paragraph of the article, with bold and a link.", "Second one é x.", "item one of the list."]


def test_page_without_article_element():
    page = "<body><div id=menu><a href=a>A</a> <a href=b>B</a></div><div class=content><p>" + "A sentence of the text stands here. " * 5 + "</p><p>Another sentence, no longer than that.</p></div><div id=sidebar><p>Most read pages of this week are here.</p></div></body>"
    assert len(extract(page)) == 2


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "plain text only, no markup at all.", "<article><p>unclosed & < 3 &unknown;", "<!-- never closed <p>x", "<script>never closed <p>x", "</p></div>", "<p>" * 3000, "<div>" * 500 + "x" + "</div>" * 500])
def test_broken_markup_gives_some_text(page):
    assert isinstance(html_text.extract(page, html_text.PRIOR), str)


def brute_cut(odds, edges):
    cost = lambda s: sum(-o for o, x in zip(odds, s, strict=True) if x and o < 0) + sum(o for o, x in zip(odds, s, strict=True) if not x and o > 0) + sum(w for a, b, w in edges if s[a] != s[b])
    return min(cost(s) for s in itertools.product([False, True], repeat=len(odds))), cost


def test_minimum_cut_against_all_labellings():
    r = random.Random(1)
    for _ in range(200):
        n = r.randint(1, 8)
        odds = [r.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, r.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.5]
        least, cost = brute_cut(odds, edges)
        assert cost(html_text.minimum_cut(odds, edges)) == pytest.approx(least, abs=1e-9)


def test_minimum_cut_on_rows_and_rings():
    """Ties of few neighbours, as pages have them."""
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(2, 9)
        odds = [r.uniform(-1, 1) for _ in range(n)]
        edges = [(i, i + 1, r.uniform(0, 2)) for i in range(n - 1)] + [(i, i + 2, r.uniform(0, 2)) for i in range(n - 2) if r.random() < 0.5] + [(0, n - 1, 0.5)]
        least, cost = brute_cut(odds, edges)
        assert cost(html_text.minimum_cut(odds, edges)) == pytest.approx(least, abs=1e-9)


HOSTILE = {
    "no tag ends": lambda n: "<a " * n, "quotes without end": lambda n: "<a '>' " * n + '"', "quotes": lambda n: '<a "' * n, "deep": lambda n: "<div>x" * n, "wrong ends": lambda n: "<div>" * n + "</b>" * n,
    "inline in blocks": lambda n: "<b>" * n + "<h1>" * n, "undecided": lambda n: "<div class=content>" + "".join("<p>" + "a" * (3 + i * i % 17) for i in range(n)),
    "text between": lambda n: "<div class=content>" + "aaaaaaaaa<p>b</p>" * n, "lists": lambda n: "<article>" + "<li>x<p>yy. " * n, "one name": lambda n: "<div class=" + "a-" * n + ">x",
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_time_grows_with_the_page(kind):
    """Eight times the page takes no more than sixteen times as long (a fifth of a second aside)."""
    took = []
    for n in (2_000, 16_000):
        page = HOSTILE[kind](n)
        began = time.process_time()
        html_text.extract(page, html_text.PRIOR)
        took.append(time.process_time() - began)
    assert took[1] <= 16 * took[0] + 0.2


LONG = "A sentence of the article stands here, and it is followed by some more words. "


@pytest.mark.parametrize("attribute", ['id="related-work"', 'class="social-text"', 'class="footer-note"', 'class="legal-basis"', 'class="search-methods"', 'class="copyright-law"'])
def test_article_parts_keep_their_text_whatever_their_names(attribute):
    page = f"<nav><a href=a>A</a></nav><article><h1>Title of it</h1><p>{LONG}</p><section {attribute}><h2>A part</h2><p>{LONG * 3}</p><p>{LONG}</p></section><p>{LONG}</p></article><footer>c</footer>"
    text = html_text.extract(page, html_text.PRIOR)
    assert text.count("A sentence") == 6 and "A part" in text


@pytest.mark.parametrize("attribute", ['class="ad"', 'class="ad-box"', 'id="comments"', 'class="comment-list"', 'class="share-buttons"', 'class="newsletter signup"', 'class="cookie-notice"', 'class="related-posts"', "role=navigation"])
def test_furniture_inside_an_article_goes(attribute):
    page = f"<article><h1>Title of it</h1><p>{LONG * 3}</p><div {attribute}><p>Words of somebody else stand here.</p></div><p>{LONG}</p></article>"
    assert "somebody else" not in html_text.extract(page, html_text.PRIOR)


@pytest.mark.parametrize(
    ("inside", "want"),
    [
        ("<p>One part of it <script>x('</p>')</script>and the other part.</p>", ["One part of it and the other part."]),
        ("<p>One part <svg><g><title>t</title><path d=x /></g></svg>of it.</p>", ["One part of it."]),
        ("<p>One part <button><div>Press</div></button>of it.</p>", ["One part of it."]),
        ("<p>One part <input type=text>of <select><option>a<option>b</select>it.</p>", ["One part of it."]),
        ("<p>One <noscript><p>no</p></noscript>part <iframe src=x></iframe>of it.</p>", ["One part of it."]),
        ("<p>We have <math><mi>x</mi><mo>=</mo><mn>3</mn></math> as the result.</p>", ["We have x=3 as the result."]),
        ("<p>So <math><semantics><mi>y</mi><annotation encoding=tex>y_{tex}</annotation></semantics></math> follows.</p>", ["So y follows."]),
        ("<p>Before it.</p><form><label>Name</label><input></form><p>After it.</p>", ["Before it.", "After it."]),
        ("<p>An unclosed drawing <svg><path></p><p>is left here.</p>", ["An unclosed drawing"]),
    ],
)
def test_blocks_stay_whole(inside, want):
    found = [x for x in extract(f"<article><h1>Title of it</h1><p>{LONG * 2}</p>{inside}<p>{LONG}</p></article>") if x not in ("Title of it", LONG.strip(), (LONG * 2).strip())]
    assert found == want or inside.startswith("<p>An unclosed") and found[:1] == want


@pytest.mark.parametrize("holder", ["<article>", "<main>", "<h1>Of the page</h1><div class=content>"])
def test_page_inside_a_form(holder):
    page = f"<body><form method=post id=aspnet><input type=hidden name=state><nav><a href=a>A</a></nav>{holder}<p>{LONG * 3}</p><p>{LONG}</p></{re.findall('[a-z]+', holder)[-2] if 'div' in holder else holder[1:-1]}><footer>x</footer></form></body>"
    assert extract(page).count(LONG.strip()) == 1 and any(x.startswith(LONG.strip()) and len(x) > 2 * len(LONG) for x in extract(page))


@pytest.mark.parametrize("name", ["more", "social", "related", "legal", "footer", "search"])
def test_ambiguous_names_alone_decide_nothing_inside_an_article(name):
    text = html_text.extract(f"<article><h1>Title of it</h1><p>{LONG}</p><section class={name}><p>{LONG * 2}</p></section><p>{LONG}</p></article>", html_text.PRIOR)
    assert text.count("A sentence") == 4
    linked = html_text.extract(f"<article><h1>Title of it</h1><p>{LONG * 2}</p><div class={name}><a href=a>Some other page here</a> <a href=b>And another one</a></div><p>{LONG}</p></article>", html_text.PRIOR)
    assert "other page" not in linked


def test_references_and_notices_inside_an_article():
    references = "".join(f"<li><a href=r{i}>Author {i}. A title of a work, number {i}. Journal, 20{i + 10}.</a></li>" for i in range(5))
    text = html_text.extract(f"<article><h1>Title of it</h1><p>{LONG * 2}</p><p class=notice>This page was moved, please note it.</p><p>{LONG}</p><h2>References</h2><ol>{references}</ol></article>", html_text.PRIOR)
    assert "References" in text and text.count("Author") == 5 and "moved" not in text


def made_page(r: random.Random) -> tuple[str, list[str]]:
    """A page of one of several shapes and the blocks of its article."""
    word = lambda: "".join(r.choice("aeioubdgklmnprst") for _ in range(r.randint(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    text = lambda: " ".join(sentence(r.randint(6, 15)) for _ in range(r.randint(2, 5)))
    links = lambda n: "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(n))
    blocks, body = [], []

    def add(tag: str, content: str) -> None:
        blocks.append(content)
        words = content.split(" ")
        k = r.randrange(len(words))
        inside = r.choice([words[k], f"<b>{words[k]}</b>", f"<a href=x>{words[k]}</a>", f"<script>a('</p>')</script>{words[k]}", f"{words[k]}<svg><g></g></svg>", f"<em><i>{words[k]}</i></em>", f"<input>{words[k]}"])
        words[k] = inside
        body.append(f"<{tag}>{r.choice([' ', chr(10) + '  ']).join(words)}</{tag}>")

    add("h1", sentence(6)[:-1])
    for _ in range(r.randint(3, 8)):
        kind = r.random()
        if kind < 0.15:
            add("h2", sentence(4)[:-1])
        if kind > 0.9:
            body.append("<ul>")
            for _ in range(3):
                add("li", sentence(9))
            body.append("</ul>")
        add(r.choice(["p", "p", "p", "blockquote"]), text())
        if kind < 0.2:
            body.append(r.choice(["<div class='ad'>Buy it now</div>", "<div class='share-buttons'><a href=x>Share</a></div>", f"<aside>{sentence(5)}</aside>", "<!-- x -->", "<figure><img src=x></figure>"]))
    article = "".join(body)
    head = r.choice([f"<header><div id=logo>{word()}</div><nav><ul>{links(5)}</ul></nav></header>", f"<div id='menu'><ul>{links(6)}</ul></div>", f"<nav>{links(4)}</nav>"])
    side = r.choice([f"<aside><h3>{word()}</h3><ul>{links(5)}</ul></aside>", f"<div class='sidebar'><p>{sentence(8)}</p></div>", f"<div id='newsletter'><p>{sentence(7)}</p><form><input></form></div>", ""])
    below = r.choice([f"<section id='comments'><p>{text()}</p><p>{text()}</p></section>", f"<div class='related-posts'><ul>{links(4)}</ul></div>", f"<form><p>{sentence(5)}</p><textarea>x</textarea></form>", ""])
    foot = r.choice(["<footer>&copy; x <a href=i>Imprint</a></footer>", f"<div id='footer'><p>{sentence(5)}</p></div>"])
    shape = r.choice(["<article>{}</article>", "<main>{}</main>", "<div class='content'><article>{}</article></div>", "<main><div class='post-content'>{}</div></main>", "<table><tr><td><article>{}</article></td></tr></table>"])
    page = f"<html><head><title>{word()}</title><style>p{{}}</style></head><body>{head}{shape.format(article)}{side}{below}{foot}</body></html>"
    return (page.replace("<body>", "<body><form action=x>").replace("</body>", "</form></body>") if r.random() < 0.2 and "<form" not in page else page), blocks


@pytest.mark.parametrize("seed", range(40))
def test_made_up_pages(seed):
    page, want = made_page(random.Random(seed))
    assert extract(page) == want


def test_pages_against_their_articles(spark, sf_dir):
    """The tables' pages hold their article in one element; a plain reading of that is the answer."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r["page_id"]: r for r in html_text.extract_pages(pages).collect()}
    assert len(found) == pages.count()
    for r in pages.collect():
        inside = re.search(r"<article>(.*)</article>", r["html"], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        got = found[r["page_id"]]
        assert got["text"] == "\n\n".join(x for x in blocks if x)
        assert (got["url"], got["n_chars"]) == (r["url"], len(got["text"]))


def test_pages_nulls_repeats_and_empty(spark):
    shape = "page_id long, url string, html string, text string, n_chars string, page string"
    rows = [(1, "u", None, "t", "n", "p"), (1, "u", None, "t", "n", "p"), (None, None, "<article><p>A line of text here.</p></article>", None, None, None), (2, "v", "", "t", "n", "p"), (3, "w", "<article><p>" + "long text. " * 200_000 + "</p></article>", None, None, None)]
    found = html_text.extract_pages(spark.createDataFrame(rows, shape)).select("page_id", "url", "n_chars").collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(1, "u", 0), (1, "u", 0), (None, None, 20), (2, "v", 0), (3, "w", 11 * 200_000 - 1)], key=repr)
    assert html_text.extract_pages(spark.createDataFrame([], shape)).collect() == []


# embedding near-dedup


def vector_rows(seed: int = 1) -> list[tuple]:
    r = np.random.default_rng(seed)
    rows: list[tuple] = [(0, None, 1), (1, [], 1), (2, [0.0] * 8, 1), (3, [1.0, None] + [0.0] * 6, 1), (4, [float("nan")] * 8, 1), (5, [float("inf")] * 8, 1), (6, [1.0] * 8, None), (7, [1.0] * 8, None), (8, [1.0, 1.0], 1), (9, [1.0, 1.0, 1.0], 1), (10, [2.0, 2.0], 1)]
    at = 100
    for label in (1, 2):
        for _ in range(20):
            base = r.normal(size=8)
            for k in range(int(r.integers(1, 5))):
                rows.append((at, (base * (1 + k) + r.normal(size=8) * r.choice([0, 0.02, 0.1, 0.3])).tolist(), label))
                at += 1
    rows += [(at + i, [3.0] * 8, 2) for i in range(30)]
    rows.append((None, [3.0] * 8, 2))
    return rows


def test_near_vectors_messy(spark):
    given = vector_rows()
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in given], "vec_id long, embedding array<double>, label int, h int, g int, rep int, x int").repartition(3)
    found = near_vectors.near_vectors(df)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(plain.near_vectors(given), key=repr)


@pytest.mark.parametrize("exact", [False, True])
def test_near_vectors_of_any_size(spark, exact):
    """Components whose squares over- or underflow."""
    given = [(i, (np.array([1.0, 2.0, 3.0, -1.0]) * s + np.array([d, 0, 0, 0]) * s).tolist(), 1) for i, (s, d) in enumerate([(1e200, 0), (3e200, 0.01), (1e-200, 0), (5e-324, 0), (1e-310, 0.02), (1.0, 3.0), (1e300, 3.0)])]
    found = near_vectors.near_vectors(spark.createDataFrame(given, "vec_id long, embedding array<double>, label int"), exact=exact)
    assert sorted(map(tuple, found.collect())) == sorted(plain.near_vectors(given))


def test_near_vectors_exact(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 64)
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label")
    found = near_vectors.near_vectors(rows, exact=True)
    assert sorted(map(tuple, found.collect())) == sorted(plain.near_vectors([tuple(r) for r in rows.collect()]))


def test_near_vectors_large_bucket(spark, monkeypatch):
    """Buckets over a block are split into pairs of blocks; links and groups stay whole."""
    monkeypatch.setattr(near_vectors, "BLOCK", 16)
    r = np.random.default_rng(3)
    base = r.normal(size=16)
    given = [(i, (base + r.normal(size=16) * 0.11).astype(np.float32).tolist(), 1) for i in range(150)]
    found = near_vectors.near_vectors(spark.createDataFrame(given, "vec_id long, embedding array<float>, label int"), tables=1)
    want = {r[0]: r for r in plain.near_vectors(given)}
    got = {r["vec_id"]: tuple(r) for r in found.collect()}
    assert sum(want[i][1] for i in want) > 0
    assert sum(got[i][1] for i in got) <= sum(want[i][1] for i in want)
    assert sum(got[i][1] for i in got) >= 0.2 * sum(want[i][1] for i in want)  # one table alone; the tables of production reach 0.97


def test_near_vectors_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label")
    want = {r[0]: r for r in plain.near_vectors([tuple(r) for r in rows.collect()])}
    got = {r["vec_id"]: tuple(r) for r in near_vectors.near_vectors(rows).collect()}
    assert got.keys() == want.keys()
    links = sum(r[1] for r in want.values())
    assert 0.9 * links <= sum(r[1] for r in got.values()) <= links
    assert all(got[i][1] <= want[i][1] for i in want)


def test_near_vectors_empty(spark):
    shape = "vec_id long, embedding array<float>, label int"
    assert near_vectors.near_vectors(spark.createDataFrame([], shape)).collect() == []
    assert [tuple(r) for r in near_vectors.near_vectors(spark.createDataFrame([(5, None, 1)], shape)).collect()] == [(5, 0, 5, True)]


# chat formatting


def digest(turns: list[tuple[str, str]]) -> tuple:
    all_ = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


HARD = ["", "<|end|>", "<|turn|>assistant<|text|>x<|end|>", "\\", "\\\\<|", "<\\|end|>", "\\### Assistant: </turn> ok", " leading", "trailing \n", "日本語 🎉 é", "퟿‍\x00\x0b", "<", "|>", "<|endoftext|>", "a" * 5000]


def chats(spark, given):
    return spark.createDataFrame(given, "conv_id long, turn long, role string, text string, part int, ids int, loss int")


def test_chats_round_trip(spark, monkeypatch):
    r = random.Random(8)
    conversations = {c: [(r.choice(["user", "assistant", "system", "<|text|>"]), r.choice(HARD) + r.choice(HARD)) for _ in range(r.randint(1, 9))] for c in range(60)}
    conversations[None] = [("assistant", "x"), ("user", "")]
    given = [(c, i, role, text, 1, 2, 3) for c, turns in conversations.items() for i, (role, text) in enumerate(turns)]
    given += [(500, 0, None, None, 1, 2, 3), (500, None, "assistant", None, 1, 2, 3)]
    conversations[500] = [("assistant", ""), ("", "")]
    r.shuffle(given)
    for size in (1 << 20, 50):  # whole, and in many parts
        monkeypatch.setattr(chat, "PART_CHARS", size)
        found = {x["conv_id"]: x for x in chat.read_back(chat.format_chats(chats(spark, given))).collect()}
        assert found.keys() == conversations.keys()
        for c, turns in conversations.items():
            x = found[c]
            assert (x["n_turns"], x["turns_sha256"], x["loss_chars"], x["loss_sha256"]) == digest(turns), c
            assert x["formatted_chars"] == sum(len(chat.escape(a)) + len(chat.escape(b)) + len(chat.TURN + chat.TEXT + chat.END) for a, b in turns)


def test_repeated_turns_stay(spark):
    given = [(1, 0, "user", "b", 0, 0, 0), (1, 0, "user", "a", 0, 0, 0), (1, 0, "user", "a", 0, 0, 0)]
    assert chat.read_back(chat.format_chats(chats(spark, given))).first()["n_turns"] == 3


def test_chats_empty(spark):
    assert chat.read_back(chat.format_chats(chats(spark, []))).collect() == []


def test_mask_by_binary_search():
    offsets = np.array([[0, 3], [3, 5], [5, 9], [9, 9], [9, 12]])
    assert chat.mask(offsets, np.array([[3, 9]])).tolist() == [False, True, True, False, False]
    assert chat.mask(offsets, np.zeros((0, 2), dtype=np.int64)).tolist() == [False] * 5


def test_chat_query_has_the_extra_conversation(spark, sf_dir):
    found = queries.op9_chat_formatting(spark, sf_dir)
    text = "\\### Assistant: </turn> ok"
    assert tuple(found.where(F.col("conv_id") == -7).first())[:5] == (-7, *digest([("user", text), ("assistant", text)]))
