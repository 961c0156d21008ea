"""Alignment, chains, page places and widening against plain versions."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.functions import ident, prints
from corpuslens.operators import alignment, glossary, pageplaces, speakers, widening
from corpuslens.plans import streams
from corpuslens.plans.base import Tables


def table_walk(a, b):
    """The canonical common subsequence by the whole table of lengths."""
    n, m = len(a), len(b)
    size = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            size[i][j] = size[i + 1][j + 1] + 1 if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
    out, i, j = [], 0, 0
    while size[i][j]:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif size[i + 1][j] == size[i][j]:
            i += 1
        else:
            j += 1
    return out


def longest_run(values) -> int:
    best = [1] * len(values)
    for i, j in itertools.combinations(range(len(values)), 2):
        if values[i] < values[j]:
            best[j] = max(best[j], best[i] + 1)
    return max(best, default=0)


@pytest.mark.parametrize("seed", range(8))
def test_common_subsequence_is_the_tables(seed):
    r = random.Random(seed)
    for _ in range(80):
        a, b = ([r.choice("abcdef"[: r.randint(1, 6)]) for _ in range(r.randint(0, 40))] for _ in range(2))
        assert alignment.shared_walk(a, b) == table_walk(a, b)


@pytest.mark.parametrize("seed", range(5))
def test_increasing_runs(seed):
    r = random.Random(seed)
    for _ in range(100):
        v = [r.randint(0, 30) for _ in range(r.randint(0, 40))]
        found = alignment.increasing(v)
        assert found == sorted(set(found)) and all(v[x] < v[y] for x, y in itertools.pairwise(found)) and len(found) == longest_run(v)


def altered(words: list[str], r: random.Random) -> list[str]:
    """Words dropped, doubled, changed, and a passage moved."""
    out = []
    for w in words:
        x = r.random()
        out += [] if x < 0.04 else [w, w] if x < 0.06 else [w + "~"] if x < 0.1 else ["new"] if x < 0.11 else [w]
    if len(out) > 40 and r.random() < 0.5:
        k = r.randrange(len(out) - 20)
        part = out[k : k + 10]
        del out[k : k + 10]
        out[k // 2 : k // 2] = part
    return out


def plain_differences(a, b):
    """By the definition: unique words, their longest chain, the table between."""
    once = [w for w in a if a.count(w) == 1 and b.count(w) == 1]
    pairs = [(a.index(w), b.index(w)) for w in once]
    cuts = [(0, 0), *[pairs[i] for i in alignment.increasing([y for _, y in pairs])], (len(a), len(b))]
    shared = [(i + x, j + y) for (i, j), (k, m) in itertools.pairwise(cuts) for x, y in table_walk(a[i:k], b[j:m])]
    out, i, j = [], 0, 0
    for x, y in [*shared, (len(a), len(b))]:
        if (x, y) != (i, j):
            out.append((a[i:x], b[j:y]))
        i, j = x + 1, y + 1
    return shared, out


def pairs_of(spark, given):
    return spark.createDataFrame(given, "k long, a array<string>, b array<string>").repartition(4)


@pytest.mark.parametrize("together", [1 << 20, -1])
def test_differences_on_altered_words(spark, monkeypatch, together):
    """In one row and by pieces: the same differences, which turn one side into the other."""
    monkeypatch.setattr(alignment, "BUCKET", 16)
    r = random.Random(3)
    given = [(1, [], []), (2, ["x"], None), (3, None, ["x", "y"]), (4, ["a"], ["a"]), (5, ["a", "b"], ["b", "a"]), (6, ["q"] * 30, ["q"] * 20), (7, None, None)]
    for k in range(10, 40):
        vocabulary = [f"w{i}" for i in range(r.choice([5, 40, 1000]))]
        a = [r.choice(vocabulary) for _ in range(r.randint(0, 150))]
        given.append((k, a, altered(a, r)))
    found = {k: [] for k, _, _ in given}
    for x in alignment.differences(pairs_of(spark, given), "k", together=together).collect():
        found[x["k"]].append(x)
    for k, a, b in given:
        a, b = a or [], b or []
        rows = sorted(found[k], key=lambda x: (x["a_from"] if x["a_from"] is not None else -1, x["b_from"] if x["b_from"] is not None else -1))
        _, want = plain_differences(a, b)
        assert sorted((x["ours"], x["theirs"]) for x in rows) == sorted(want), k
        for x in rows:
            assert x["ours"] == ([] if x["a_from"] is None else a[x["a_from"] : x["a_to"] + 1]) and len(x["ours"]) == x["n_a"]
            assert x["theirs"] == ([] if x["b_from"] is None else b[x["b_from"] : x["b_to"] + 1]) and len(x["theirs"]) == x["n_b"]
            assert x["tag"] == ("replace" if x["n_a"] and x["n_b"] else "delete" if x["n_a"] else "insert")


def test_few_anchors_still_align(spark, monkeypatch):
    monkeypatch.setattr(alignment, "ANCHORS", 8)
    words = [f"w{i}" for i in range(500)]
    other = [w for i, w in enumerate(words) if i % 50 != 7]
    found = alignment.differences(pairs_of(spark, [(1, words, other), (2, words, words)]), "k", together=0).collect()
    assert sorted((x["k"], x["ours"]) for x in found) == sorted((1, [w]) for i, w in enumerate(words) if i % 50 == 7)


def test_long_pair_by_pieces(spark):
    """A pair far over a piece's size comes out as it does in one row."""
    r = random.Random(5)
    words = [r.choice(["the", "of", "a", f"n{r.randint(0, 20000)}"]) for _ in range(60_000)]
    other = altered(words, r)
    rows = lambda together: sorted(repr(tuple(x)) for x in alignment.differences(pairs_of(spark, [(1, words, other)]), "k", together=together).collect())
    assert rows(1 << 20) == rows(1000)


def test_error_rates(spark):
    given = [(1, "a b c d e f g h i j".split(), "a b x d e f g h i j k".split()), (2, [], ["x"]), (3, ["x"], []), (4, ["x"], ["x"]), (5, None, None), (6, "a b c".split(), "z".split())]
    found = {x["k"]: tuple(x)[1:] for x in alignment.error_rates(pairs_of(spark, given), "k").collect()}
    assert found == {1: (10, 1, 0, 1, 0.2), 2: (0, 0, 0, 1, 1.0), 3: (1, 0, 1, 0, 1.0), 4: (1, 0, 0, 0, 0.0), 5: (0, 0, 0, 0, 0.0), 6: (3, 1, 2, 0, 1.0)}


def test_error_rates_of_documents(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = {x["doc_id"]: x for x in alignment.error_rates(streams._versions(t), "doc_id").collect()}
    rows = streams._versions(t).where(F.size("a") < 400).collect()
    assert rows
    for x in rows:
        _, want = plain_differences(x["a"], x["b"])
        one = found[x["doc_id"]]
        assert one["substituted"] == sum(min(len(a), len(b)) for a, b in want)
        assert one["deleted"] == sum(max(0, len(a) - len(b)) for a, b in want) and one["inserted"] == sum(max(0, len(b) - len(a)) for a, b in want)


def test_disputes_leave_slips_and_fillers_out(spark):
    given = [(1, "We um met Bo, in May".split(), "we met Joe in may uh".split()), (2, [f"a{i}" for i in range(20)], [f"b{i}" for i in range(20)])]
    found = alignment.disputes(pairs_of(spark, given), "k", ("um", "uh")).collect()
    assert [(x["k"], x["ours"], x["theirs"]) for x in found] == [(1, ["bo"], ["joe"])]


def test_guard(spark):
    base = [f"w{i}" for i in range(20)]
    change = lambda n: [w + "~" if i < n else w for i, w in enumerate(base)]
    given = [(1, base, base, 0), (2, base, change(2), 1), (3, base, change(3), 9), (4, base, change(4), 1), (5, base[:5], change(3)[:5], None), (6, base, [*base, "x", "y", "z", "u"], 1)]
    found = {x["k"]: x["problem"] for x in alignment.guard(spark.createDataFrame(given, "k long, a array<string>, b array<string>, disputed int"), "k").collect()}
    assert found == {1: None, 2: None, 3: "kept too few words", 4: "changed too many words", 5: None, 6: "changed too many words"}


def test_moved_keys(spark):
    order = lambda names: [(1, n, i) for i, n in enumerate(names)]
    frame = lambda rows: spark.createDataFrame(rows, "g int, name string, place int")
    found = alignment.moved_keys(frame(order("abcdefx") + [(2, "a", 0)]), frame(order("yfabdce") + [(2, "a", 9)]), "g", "name", "place")
    assert {x["g"]: (x["common"], x["moved"]) for x in found.collect()} == {1: (6, 2), 2: (1, 0)}


def brute_chain(marks, gap):
    best = [1] * len(marks)
    for i, j in itertools.combinations(range(len(marks)), 2):
        if 0 < marks[j][1] - marks[i][1] <= gap:
            best[j] = max(best[j], best[i] + 1)
    return max(best, default=0)


@pytest.mark.parametrize("seed", range(6))
def test_ascending_chains(seed):
    r = random.Random(seed)
    for _ in range(100):
        marks = [(i, r.randint(0, 12)) for i in sorted(r.sample(range(100), r.randint(0, 25)))]
        chain = alignment.ascending(marks, 3)
        value = dict(marks)
        assert len(chain) == brute_chain(marks, 3) and all(0 < value[y] - value[x] <= 3 and x < y for x, y in itertools.pairwise(chain))


def test_folios(spark):
    page = lambda i: f"prose of page {i}\nmore prose here\n— {i} —"
    planted = "\n".join(page(i) for i in range(1, 9))
    noisy = "\n".join(page(i) + ("\n2024" if i % 2 else "") for i in range(1, 9))
    table = "\n".join(["1", "2", "3", "4", "5", "6"] + ["prose"] * 60)
    given = [(1, planted), (2, noisy), (3, table), (4, "1\nx\n2\nx\n3"), (5, None), (6, "\n".join(f"line\n{i} / 90" for i in range(3, 9))), (7, "x\n12 of 90\ny\n1.5\nC\niv")]
    found = {x["id"]: x for x in alignment.folios(spark.createDataFrame(given, "id long, text string"), "id").collect()}
    assert [planted.split("\n")[i] for i in found[1]["places"]] == [f"— {i} —" for i in range(1, 9)]
    assert [noisy.split("\n")[i] for i in found[2]["places"]] == [f"— {i} —" for i in range(1, 9)]
    assert found[3]["longest"] == 6 and found[3]["places"] == [] and found[4]["places"] == [] and found[5]["places"] == []
    assert len(found[6]["places"]) == 6 and found[7]["numbers"] == 1


# pages


def prose(r: random.Random, n: int) -> str:
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randint(2, 9))) for _ in range(60)]
    return " ".join(r.choice(words) + r.choice(["", "", "", ",", ". 12"]) for _ in range(n))


def test_rolling_prints_tell_runs_apart():
    r = np.random.default_rng(0)
    codes = r.integers(0, 4, 600)
    for width in (1, 5, 40):
        found = prints.rolling(codes, width)
        runs = [tuple(codes[i : i + width]) for i in range(len(codes) - width + 1)]
        assert len(found) == len(runs) and len({(a, b) for a, b in zip(runs, found.tolist(), strict=True)}) == len(set(runs)) == len(set(found.tolist()))


def test_pages_come_back_where_they_were_cut(spark):
    """With heads, wrapped lines, hyphens, empty pages, a page that stands twice, a garbled one and one that is quoted elsewhere."""
    r = random.Random(4)
    texts, pages, want = [], [], {}
    for doc in range(6):
        parts = [prose(r, 150) + " end " for _ in range(9)]
        parts[5] = parts[4] if doc == 1 else parts[5]  # twice in a row
        text = "".join(parts)
        text = (parts[6][:300] + " quoted " + text) if doc == 2 else text  # quoted in front
        texts.append((doc, text))
        at = len(text) - len("".join(parts))
        for i, p in enumerate(parts):
            shown = p.replace(" ", "\n", 7)
            shown = shown[:100] + "-\n" + shown[100:] if doc != 3 else shown
            shown = "".join(r.choice("xyz ") for _ in p) if doc == 4 and i == 3 else shown
            pages.append((doc, i + 1, "— 7 —\n" + shown))
            want[doc, i + 1] = at
            at += len(p)
        pages.append((doc, 10, " 12 "))
    pages.append((99, 1, "no text"))
    placed = pageplaces.locate_pages(spark.createDataFrame([*texts, (7, None)], "d long, text string"), spark.createDataFrame([*pages, (7, 1, None)], "d long, page long, text string"), "d")
    found = {(x["d"], x["page"]): x for x in placed.collect()}
    assert len(found) == 61 and found[7, 1]["how"] == "empty"
    for (d, p), at in want.items():
        x = found[d, p]
        if (d, p) == (4, 4):
            assert x["how"] == "interpolated" and abs(x["offset"] - at) < 200
        elif d == 1 and p in (5, 6):
            assert x["how"] == "located" and x["offset"] == at or x["how"] == "interpolated"
        else:
            assert (x["how"], x["offset"]) == ("located", at), (d, p)
    assert all(found[d, 10]["how"] == "empty" and found[d, 10]["offset"] == len(texts[d][1]) for d in range(6))
    health = {x["d"]: x for x in pageplaces.page_health(placed, "d").collect()}
    assert all(health[d]["ok"] == (d != 1) and health[d]["backwards"] == 0 and health[d]["pages"] == 10 for d in range(6))
    assert health[4]["interpolated"] == 1 and health[0]["located"] == health[0]["with_text"] == 9


def test_page_health_of_a_bad_map(spark):
    rows = [("a", 1, "located", 300, 0, 900), ("a", 2, "interpolated", 300, 300, 900), ("a", 3, "located", 300, 200, 900), ("b", 1, "located", 300, 0, 2000), ("b", 2, "located", 300, 900, 2000), ("b", 3, "located", 300, 1000, 2000)]
    found = {x["d"]: x for x in pageplaces.page_health(spark.createDataFrame(rows, "d string, page long, how string, letters long, start long, text_letters long"), "d").collect()}
    assert (found["a"]["backwards"], found["a"]["ok"]) == (1, False)
    assert (found["b"]["odd"], found["b"]["ok"]) == (3, False)


def test_quote_pages(spark):
    pages = [(1, 1, "Alpha beta gamma delta epsilon zeta, eta theta iota kappa"), (1, 2, "lambda mu nu xi omicron pi rho sigma tau upsilon"), (1, 3, "Alpha beta gamma delta epsilon zeta once more"), (2, 1, None)]
    quotes = [(1, 1, "lambda mu, nu xi omicron"), (1, 2, "alpha beta gamma delta"), (1, 3, "Alpha beta gamma delta epsilon"), (1, 4, "iota kappa lambda mu nu"), (1, 5, "xi omicron"), (1, 6, "nothing of this kind"), (2, 1, "lambda mu nu xi"), (3, 1, "lambda mu nu xi"), (1, 7, None)]
    found = pageplaces.quote_pages(spark.createDataFrame(quotes, "d long, quote_id long, quote string"), spark.createDataFrame(pages, "d long, page long, text string"), "d")
    assert {(x["d"], x["quote_id"]): x["page"] for x in found.collect()} == {(1, 1): 2, (1, 2): None, (1, 3): None, (1, 4): 1, (1, 5): None, (1, 6): None, (2, 1): None, (3, 1): None, (1, 7): None}


# widening


def occurs(text: str, part: str) -> int:
    return sum(text.startswith(part, i) for i in range(len(text)))


@pytest.mark.parametrize("seed", range(6))
def test_unique_lengths(seed):
    r = random.Random(seed)
    for _ in range(30):
        text = "".join(r.choice("ab \n"[: r.randint(1, 4)]) for _ in range(r.randint(0, 60)))
        most = r.choice([3, 10, 200])
        need = widening.unique_lengths(text, most)
        for i in range(len(text)):
            first = next((k for k in range(1, len(text) - i + 1) if occurs(text, text[i : i + k]) == 1), most + 1)
            assert need[i] == min(first, most + 1)


@pytest.mark.parametrize("seed", range(6))
def test_widening_by_trying_all(seed):
    r = random.Random(seed)
    for n in range(60):
        text = "".join(r.choice("ab \n" if n % 2 else "abcde   \n") for _ in range(r.randint(1, 150)))
        s = r.randrange(len(text))
        quote = text[s : s + r.randint(1, 6)]
        found = [i for i in range(len(text)) if text.startswith(quote, i)]
        tried = []
        for p in found if len(found) > 1 else []:
            begins, ends = widening.cuts(text, p, p + len(quote))
            assert all(text.find("\n", b, p) < 0 for b in begins) and len(begins) <= 12 >= len(ends)
            tried += [(e - b, -p, p - b, b, e) for b in begins for e in ends if (b, e) != (p, p + len(quote)) and occurs(text, text[b:e]) == 1]
        want = min(tried)[3:] if tried else None
        assert widening.widened(text, quote, widening.unique_lengths(text, len(quote) + 120)) == want


@pytest.mark.parametrize("seed", range(6))
def test_widening_over_whole_lines(seed):
    """By trying every span of whole words on the line, however far it reaches."""
    r = random.Random(seed)
    far = 0
    for n in range(40):
        text = "".join(r.choice(("ab \n", "abcde   \n", "ab ", "a\u3000\x85\n")[n % 4]) for _ in range(r.randint(1, 90)))
        text += r.choice(("", " ", "\n")) + text * (n % 3 == 0)
        text = text if n % 5 else r.choice(("a b ", "ab ")) * r.randint(14, 18) + r.choice("ac")
        s = r.randrange(len(text))
        quote = text[s : s + r.randint(1, 6)]
        found = [i for i in range(len(text)) if text.startswith(quote, i)]
        tried = []
        for p in found if len(found) > 1 else []:
            end = p + len(quote)
            line, stop = text.rfind("\n", 0, p) + 1, text.find("\n", end)
            stop = len(text) if stop < 0 else stop
            begins = [b for b in range(line, p + 1) if b in (line, p) or text[b - 1].isspace()]
            ends = [e for e in range(end, stop + 1) if e in (end, stop) or text[e].isspace()]
            tried += [(e - b, -p, p - b, b, e) for b in begins for e in ends if (b, e) != (p, end) and text.find(text[b:e]) == text.rfind(text[b:e])]
        want = min(tried)[3:] if tried else None
        need = widening.unique_lengths(text, widening.Lines.reach(text, len(quote)))
        assert widening.Lines(text, need).widened(quote) == want
        far += want is not None and want != widening.widened(text, quote, widening.unique_lengths(text, len(quote) + 120))
    assert far


def test_words_far_away_make_unique(spark):
    """What tells a quotation apart may be hundreds of words away on its line."""
    text = "\n".join(f"{'very ' * 300}odd and {'quite ' * 300}{x}" for x in ("plain", "queer"))
    rows = widening.unique_quotes(spark.createDataFrame([(1, 1, "odd and"), (1, 2, "very odd")], "d long, quote_id long, quote string"), spark.createDataFrame([(1, text)], "d long, text string"), "d").collect()
    found = {x["quote_id"]: x for x in rows}
    assert found[1]["places"] == 2 and found[1]["quote"] == f"odd and {'quite ' * 300}queer"
    assert found[2]["quote"] == f"very odd and {'quite ' * 300}queer" and text[found[2]["start"] : found[2]["end"]] == found[2]["quote"]


def test_unique_quotes(spark, monkeypatch):
    monkeypatch.setattr(widening, "BLOCK", 2)
    text = "A dog came. The dog sat. It was late.\nThe dog ran. It was late."
    quotes = [(1, 1, "The dog"), (1, 2, "ran"), (1, 3, "It was late."), (1, 4, ""), (1, 5, None), (1, 6, "no"), (2, 1, "x"), (1, 7, "."), (3, 1, "x")]
    df = spark.createDataFrame(quotes, "d long, quote_id long, quote string")
    texts = spark.createDataFrame([(1, text), (2, None)], "d long, text string")
    words = {(x["d"], x["quote_id"]): tuple(x)[2:] for x in widening.unique_quotes(df, texts, "d").collect()}
    assert len(words) == 9 and words[1, 1][3] == "The dog ran." and words[1, 2] == (1, 46, 49, "ran") and words[1, 3][3] == "ran. It was late."
    assert words[1, 4] == words[1, 5] == words[1, 6] == words[2, 1] == words[3, 1] == (0, None, None, None)
    whole = {(x["d"], x["quote_id"]): tuple(x)[2:] for x in widening.unique_quotes(df, texts, "d", how="sentences").collect()}
    assert whole[1, 1][3] == "The dog sat." and whole[1, 3][3] == "The dog sat. It was late."
    assert all(text.count(x[3]) == 1 for x in [*words.values(), *whole.values()] if x[3])


def test_widened_quotes_of_documents(spark, sf_dir):
    t = Tables(spark, sf_dir)
    texts = {x["doc_id"]: x["text"] for x in t.documents.collect()}
    rows = widening.unique_quotes(streams._short_quotes(t, 2), t.documents.select("doc_id", "text"), "doc_id").collect()
    assert sum(x["places"] > 1 and x["start"] is not None for x in rows) > 20
    for x in rows:
        if x["start"] is not None:
            assert texts[x["doc_id"]][x["start"] : x["end"]] == x["quote"] and occurs(texts[x["doc_id"]][:20000], x["quote"]) <= 1


# glossaries


def plain_places(text, terms):
    """At each place the longest term that stands there as whole words, then on behind it."""
    text, low = text or "", (text or "").lower()
    wordy = lambda c: c.isalnum() or c == "_"
    out, at = [], 0
    while at < len(text):
        best = None
        for t in sorted(terms, key=len, reverse=True):
            end = at + len(t)
            if low.startswith(t.lower(), at) and not (at and wordy(text[at - 1]) and wordy(text[at])) and not (end < len(text) and wordy(text[end]) and wordy(text[end - 1])):
                best = t
                break
        out += [(at, at + len(best), best)] if best else []
        at += len(best) if best else 1
    return out


@pytest.mark.parametrize(("n", "block"), [(1, 1 << 20), (40, 1 << 20), (40, 60), (1000, 1 << 20), (1000, 2000)])
def test_terms_in_texts(spark, n, block):
    r = random.Random(n)
    word = lambda: "".join(r.choice("abé日") for _ in range(r.randint(1, 3)))
    terms = sorted({" ".join(word() for _ in range(r.randint(1, 3))) for _ in range(n)} | ({"(x)", "a-b", "C"} if n > 1 else set()))
    low = {}
    for t in terms:
        low.setdefault(t.lower(), t)
    texts = [(i, " ".join(r.choice([word(), word().upper(), r.choice(terms), "(x)", "a-b", "c_c", "😀"]) + r.choice(["", ",", "."]) for _ in range(r.randint(0, 40)))) for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    given = spark.createDataFrame([(t, f"<{t}>") for t in [*terms, terms[0]]] + [(None, "x"), ("", "y")], "term string, replacement string")
    want = {i: plain_places(t, low.values()) for i, t in texts}
    found = {i: [] for i, _ in texts}
    for x in glossary.term_places(df, given, "id", block).collect():
        found[x["id"]].append((x["start"], x["end"], x["term"]))
    assert {i: sorted(x) for i, x in found.items()} == want
    done = {x["id"]: x for x in glossary.replaced(df, given, "id", block).collect()}
    for i, t in texts:
        new, at = "", 0
        for a, b, term in want[i]:
            new, at = new + t[at:a] + f"<{term}>", b
        assert done[i]["text"] == (None if t is None else new + t[at:]) and done[i]["n"] == len(want[i])


def test_no_terms(spark):
    df = spark.createDataFrame([(1, "a text")], "id long, text string")
    none = spark.createDataFrame([], "term string, replacement string")
    assert glossary.term_places(df, none, "id").collect() == []
    assert [tuple(x) for x in glossary.replaced(df, none, "id").collect()] == [(1, "a text", 0)]


def test_names_become_pseudonyms(spark):
    df = spark.createDataFrame([(1, "Ann Lee met ann, and Annie. Ann-Lee?")], "id long, text string")
    names = spark.createDataFrame([("Ann",), ("Ann Lee",), (None,)], "name string")
    text = glossary.pseudonymised(df, names, "id", "k").first()["text"]
    whole, first = (spark.range(1).select(ident.pseudonym(F.lit(x), "k")).first()[0] for x in ("Ann Lee", "Ann"))
    assert text == f"{whole} met {first}, and Annie. {first}-Lee?"


# recordings


def plain_names(segments, cues, known, intake):
    """{sid: (name, how)} of one recording."""
    talk, since, said = {}, {}, {}
    for sid, a, b, text in segments:
        talk[sid] = talk.get(sid, 0) + b - a
        since[sid] = min(since.get(sid, a), a)
        said.setdefault(sid, []).append(text.rstrip().endswith("?"))
    out = {s: (known[s], "voice") for s in talk if known.get(s)}
    for sid in sorted(talk, key=lambda s: (since[s], s)):
        votes = {}
        for s, a, b, _ in segments:
            for c, d, name in cues:
                if s == sid and name and c < b and a < d:
                    votes[name] = votes.get(name, 0) + min(b, d) - max(a, c)
        if sid not in out and votes:
            name = max(votes, key=lambda n: (votes[n], n))
            if votes[name] >= 0.6 * sum(votes.values()) and name not in [n for n, _ in out.values()]:
                out[sid] = (name, "caption")
    open_ = [s for s in sorted(talk, key=lambda s: (-talk[s], s)) if s not in out and talk[s] >= 0.08 * sum(talk.values())]
    free = [n for n in intake if n and n not in [x for x, _ in out.values()]]
    if len(free) == 2 and len(open_) >= 2:
        rate = [sum(said[s]) / len(said[s]) for s in open_[:2]]
        order = open_[:2] if rate[0] >= rate[1] else open_[1::-1]
        out |= {s: (n, "intake") for s, n in zip(order, free, strict=True)}
    elif len(free) == 1 and open_:
        out[open_[0]] = (free[0], "intake")
    rest = [s for s in sorted(talk, key=lambda s: (since[s], s)) if s not in out]
    return out | {s: (f"Speaker {i}", "unnamed") for i, s in enumerate(rest, 1)}


def test_speakers_by_captions_and_intake(spark):
    """Many small recordings, ties of times and names, speakers who share a caption, one long recording over many buckets."""
    r = random.Random(12)
    data = {}
    for rec in range(40):
        n = 400 if rec == 0 else r.randint(1, 14)
        segments = [(r.choice("abcde"), a := r.randint(0, 60 * (20 if rec == 0 else 1)), a + r.randint(1, 30), r.choice(["so?", "yes.", "no? "])) for _ in range(n)]
        cues = [(a := r.randint(0, 80), a + r.randint(0, 25), r.choice(["Ann", "Bo", "Cy", "", None])) for _ in range(r.choice([0, 3, n]))]
        data[rec] = (segments, cues, {s: r.choice(["Ann", "Dee", ""]) for s in r.sample("abcde", r.choice([0, 0, 1]))}, (r.choice(["Ann", "Ina", "", None]), r.choice(["Eve", None])))
    frame = lambda rows, shape: spark.createDataFrame(rows, shape).repartition(3)
    segments = frame([(k, *s) for k, d in data.items() for s in d[0]], "rec int, sid string, start int, end int, text string")
    cues = frame([(k, *c) for k, d in data.items() for c in d[1]], "rec int, start int, end int, speaker string")
    known = frame([(k, s, n) for k, d in data.items() for s, n in d[2].items()], "rec int, sid string, name string")
    intake = frame([(k, *d[3]) for k, d in data.items()], "rec int, interviewer string, interviewee string")
    found = {}
    for x in speakers.named_speakers(segments, cues, known, intake).collect():
        found.setdefault(x["rec"], {})[x["sid"]] = (x["name"], x["how"])
    for k, d in data.items():
        assert found[k] == plain_names(*d), k


def test_words_of_captions(spark):
    cues = spark.createDataFrame([("r", 1, 1.0, 2.0, "one  two three", "Ann"), ("r", 2, 2.0, 3.0, " ", None), ("r", 3, 3.0, 3.0, "x", None)], "rec string, cue int, start double, end double, text string, speaker string")
    found = [tuple(x)[1:6] for x in speakers.cue_words(cues).orderBy("cue", "n").collect()]
    assert found == [(1, 0, "one", 1.0, 1.33), (1, 1, "two", 1.33, 1.67), (1, 2, "three", 1.67, 2.0), (3, 0, "x", 3.0, 3.0)]


@pytest.mark.parametrize("seed", range(5))
def test_cuts_of_long_segments(seed):
    """Each piece is as long as the rule lets it: tried word by word."""
    r = random.Random(seed)
    for _ in range(60):
        t, words = 0.0, []
        for _ in range(r.randint(0, 60)):
            t += r.choice([0, 0, 0.5, 1.5])
            length = r.choice([0.3, 1, 2, 40 if r.random() < 0.05 else 1])
            words.append((r.choice(["a", "b", "c.", "d,"]) if r.random() < 0.4 else "w", t, t + length))
            t += length
        want, a = [], 0
        while True:
            b = next((i for i in range(a, len(words)) if words[i][2] - words[a][1] > 15), None) if a < len(words) else None
            if b is None:
                break
            b = max(b, a + 1)
            if b >= len(words):
                break
            late = [i for i in range(a + 1, b) if words[i - 1][2] - words[a][1] >= 8]
            ends = [i for i in late if words[i - 1][0][-1] in ".,;?!"]
            a = ends[-1] if ends else max(late, key=lambda i: (words[i][1] - words[i - 1][2], i)) if late else b
            want.append(a)
        got = speakers.cut_places([w for w, _, _ in words], np.array([s for _, s, _ in words]), np.array([e for _, _, e in words])) if words else []
        assert got == want


def test_split_segments(spark):
    rows = [("r", s, i, f"w{i}" + ("." if i == 10 else ""), float(i), i + 0.9) for s in (1, 2) for i in range(20 if s == 1 else 45)]
    found = speakers.split_segments(spark.createDataFrame(rows, "rec string, seg int, n int, word string, start double, end double")).orderBy("seg", "piece").collect()
    assert [(x["seg"], x["piece"], x["first"], x["last"]) for x in found] == [(1, 0, 0, 10), (1, 1, 11, 19), (2, 0, 0, 10), (2, 1, 11, 24), (2, 2, 25, 38), (2, 3, 39, 44)]
    assert found[0]["text"].split()[-1] == "w10." and (found[3]["start"], found[3]["end"]) == (11.0, 24.9)


def test_equal_pieces_are_passed_over(monkeypatch):
    """Only the pieces that differ are walked through, and the differences are those of the walk through all."""
    from corpuslens.operators import alignment

    a = [f"w{i}" for i in range(2000)]
    b = [*a[:700], "um", *a[700:1200], *a[1201:]]
    walked, walk = [], alignment.shared_walk
    monkeypatch.setattr(alignment, "shared_walk", lambda x, y: walked.append(len(x)) or walk(x, y))
    found = alignment.whole_differences(a, b)
    assert [x[:7] for x in found] == [("insert", None, None, 700, 700, 0, 1), ("delete", 1200, 1200, None, None, 1, 0)]
    assert [x[7:] for x in found] == [([], ["um"]), (["w1200"], [])]
    assert len(walked) == 2


def test_nearest_holds_few_pairs_at_once():
    """A block of queries and a batch of vectors: far less than a number for each of their pairs, and the k best of all."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    from corpuslens.operators import search

    r = np.random.default_rng(4)
    x, q = r.normal(size=(10_000, 8)), r.normal(size=(512, 8))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(list(x))], ["vec_id", "embedding"])
    tracemalloc.start()
    found = search.nearest(iter([batch]), np.arange(512), q, np.zeros(8), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 512 * 10_000 * 8 / 2
    score = q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    assert (found[1].to_numpy().reshape(512, 5) == np.argsort(-score, axis=1)[:, :5]).all()


def test_pages_look_at_the_fingerprints_they_need(monkeypatch):
    """A page found by its first fingerprint doesn't check the other ones, and letters are told by code point."""
    import numpy as np
    from corpuslens.operators import pageplaces

    r = random.Random(3)
    text = "".join(r.choice("abcdefgh日é\U00010400 1.\n") for _ in range(9000))
    whole, at = pageplaces.letters(text)
    assert whole == "".join(filter(str.isalpha, text))
    assert at.tolist() == [i for i, c in enumerate(text) if c.isalpha()]
    pages, asked, of = [whole[i : i + 1500] for i in range(0, len(whole), 1500)], [], pageplaces.Places.of
    monkeypatch.setattr(pageplaces.Places, "of", lambda self, page: (asked.append(x) or x for x in of(self, page)))
    assert pageplaces.located(whole, pages) == list(range(0, len(whole), 1500))
    assert len(asked) == len(pages)


def test_few_sorts_tell_what_is_unique(monkeypatch):
    """The shortest runs of code points are numbers as they are; only longer ones are ranked by sorting."""
    import numpy as np
    from corpuslens.operators import widening

    text, calls, unique = "abcab dabcabc " * 40 + "xyz", [], np.unique
    monkeypatch.setattr(widening.np, "unique", lambda *a, **k: calls.append(1) or unique(*a, **k))
    need = widening.unique_lengths(text, 7)
    assert len(calls) == 2
    for i in range(0, len(text), 17):
        short = next((n for n in range(1, min(7, len(text) - i) + 1) if text.find(text[i : i + n]) == i == text.rfind(text[i : i + n])), 8)
        assert need[i] == short


def test_chains_end_without_a_join_of_rounds(spark, monkeypatch):
    """A long chain, one alone, and one of two: as many written rounds as doublings, and one more."""
    from corpuslens.operators import diff

    written, put = [], diff.checkpointed
    monkeypatch.setattr(diff, "checkpointed", lambda df: written.append(df.columns) or put(df))
    links = spark.createDataFrame([(i, i - 1 if i > 1 else None) for i in range(1, 9)] + [(20, None), (31, 30), (30, None)], "id long, supersedes long")
    found = {x["id"]: tuple(x)[1:] for x in diff.chains(links).collect()}
    assert found == {i: (1, 8, 8) for i in range(1, 9)} | {20: (20, 20, 1), 31: (30, 31, 2), 30: (30, 31, 2)}
    assert written == [["id", "up", "d", "moved"]] * 4
