"""Line dedup, decontamination, SimHash, packing, token counts, language ID and LM scores against plain versions."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import bloom_lm, decontaminate, langid, line_dedup, packing, queries, simhash, tokencount
from corpuslens.llm.common import fold, joined

from . import plain


def rows(df, *cols) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def by_repr(found) -> list[tuple]:
    return sorted(found, key=repr)


# line dedup


def test_line_dedup_messy(messy, messy_docs):
    found = line_dedup.line_dedup(messy_docs)
    assert rows(found, "doc_id", "n_lines", "n_dropped", "text") == by_repr(plain.line_dedup([r[:2] for r in messy]))
    assert found.select("lost").distinct().first()[0] == 9  # other columns pass through


def test_line_dedup_repeated_rows(spark):
    given = [(1, "a line of some length\nb"), (1, "a line of some length\nb"), (2, "A LINE of some length \nc"), (None, "a line of some length"), (None, "another long line"), (None, "another long line")]
    found = line_dedup.line_dedup(spark.createDataFrame(given, "doc_id long, text string"))
    assert rows(found, "doc_id", "n_lines", "n_dropped", "text") == by_repr(plain.line_dedup(given))


def test_line_dedup_documents(documents, plain_documents):
    assert rows(line_dedup.line_dedup(documents), "doc_id", "n_lines", "n_dropped", "text") == by_repr(plain.line_dedup(plain_documents))


def test_line_dedup_empty(no_docs):
    assert line_dedup.line_dedup(no_docs).collect() == []


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    made = line_dedup.PerfectHash.build(np.unique(keys))
    again = line_dedup.PerfectHash.unpacked(*made.packed())
    assert sorted(again.places(np.unique(keys)).tolist()) == list(range(made.size))


def test_place_keys_that_meet_are_told_apart():
    """Two lines whose hashes meet in one place key get another seed; equal keys are an error, not an endless build."""
    f = np.array([3, 5, 11], dtype=np.int64)
    with np.errstate(over="ignore"):
        h = (np.uint64(77) ^ (f.view(np.uint64) * line_dedup.MIX)).view(np.int64)
    assert len(set(line_dedup._place_keys(h, f).tolist())) == 1
    seed, keys = line_dedup.different_keys(h, f)
    assert seed > 0 and sorted(line_dedup.PerfectHash.build(keys).places(keys).tolist()) == [0, 1, 2]
    with pytest.raises(ValueError):
        line_dedup.PerfectHash.build(np.array([9, 9], dtype=np.uint64))


def test_line_in_every_document_is_spread(spark, monkeypatch):
    """A frequent line's shard gets as many tasks as its rows need; results stay the same."""
    monkeypatch.setattr(line_dedup, "TASK_ROWS", 20)
    monkeypatch.setattr(line_dedup, "COPIES", 2)
    given = [(i, f"the line of every document\nline of its own, {i}\nshared by a few, {i % 40}") for i in range(400)]
    found = line_dedup.line_dedup(spark.createDataFrame(given, "doc_id long, text string").repartition(5))
    assert rows(found, "doc_id", "n_lines", "n_dropped", "text") == by_repr(plain.line_dedup(given))


# decontamination


def items_of(spark, given):
    return spark.createDataFrame(given, "item_id long, text string")


def test_contamination_messy(spark, messy, messy_docs):
    long_ = next(t for d, t, _ in messy if d == 100)
    items = [(1, " ".join(long_.split()[20:50])), (1, "12 34"), (2, "é"), (3, None), (4, ""), (5, "--"), (None, "12 34"), (6, " ".join(long_.split()[:13]).upper()), (7, "no such words at all in any text here")]
    found = decontaminate.contamination(messy_docs, items_of(spark, items))
    want = plain.contamination([r[:2] for r in messy], items)
    assert rows(found, "doc_id", "n_words", "n_hit", "item_ids", "contaminated") == by_repr(want)
    assert any(x[4] for x in want)


def test_contamination_in_blocks(spark, messy, messy_docs, monkeypatch):
    long_ = next(t for d, t, _ in messy if d == 100)
    items = [(i, " ".join(long_.split()[i * 5 : i * 5 + 20])) for i in range(30)] + [(99, "12 34")]
    monkeypatch.setattr(decontaminate, "QUERY_BYTES", 900)
    found = decontaminate.contamination(messy_docs, items_of(spark, items))
    assert rows(found, "doc_id", "n_words", "n_hit", "item_ids", "contaminated") == by_repr(plain.contamination([r[:2] for r in messy], items))


@pytest.mark.parametrize("size", [8 << 20, 400])
def test_contamination_repeated_ids_in_blocks(spark, monkeypatch, size):
    """Rows that share a doc_id stay apart, whatever the number of blocks, parts and kept words."""
    docs = [(1, "alpha beta gamma"), (1, "delta eps zeta"), (1, "alpha beta gamma"), (None, "alpha beta"), (None, "delta eps zeta alpha beta gamma"), (2, "x " * 70 + "eta theta"), (3, None)]
    long_ = " ".join(f"w{i}" for i in range(100))
    docs += [(4, long_), (4, long_[:60]), (5, "alpha beta gamma " + long_)]
    items = [(1, "Alpha beta gamma"), (2, "delta eps, zeta"), (2, "alpha beta gamma"), (None, "eta theta"), (3, long_), (4, None)]
    monkeypatch.setattr(decontaminate, "QUERY_BYTES", size)
    monkeypatch.setattr(decontaminate, "PART_WORDS", 7)
    want = by_repr(plain.contamination(docs, items))
    given = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for terms in (1 << 20, 5):
        monkeypatch.setattr(decontaminate, "TERMS", terms)
        found = decontaminate.contamination(given, items_of(spark, items))
        assert rows(found, "doc_id", "n_words", "n_hit", "item_ids", "contaminated") == want


def test_contamination_documents(spark, sf_dir, documents, plain_documents):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(documents, items)
    assert rows(found, "doc_id", "n_words", "n_hit", "item_ids", "contaminated") == by_repr(plain.contamination(plain_documents, [tuple(r) for r in items.select("item_id", "text").collect()]))


def test_contamination_empty(spark, no_docs, messy_docs):
    assert decontaminate.contamination(no_docs, items_of(spark, [(1, "a b")])).collect() == []
    assert decontaminate.contamination(messy_docs, items_of(spark, [])).where("n_hit > 0 or contaminated or size(item_ids) > 0").isEmpty()


def test_phrase_and_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "x the quick brown fox jumps y quick brown fox"), (2, "fox brown quick"), (None, "the quick, red, brown fox jumps")], "doc_id long, text string")
    items = items_of(spark, [(7, "The quick brown fox jumps")])
    found = decontaminate.phrase_matches(docs, items, width=3)
    assert rows(found, "doc_id", "item_id", "position", "length") == by_repr([(1, 7, 1, 3), (1, 7, 2, 3), (1, 7, 3, 3), (1, 7, 7, 3), (None, 7, 3, 3)])
    near = decontaminate.proximity_matches(docs, items, slop=2, rarest=4)
    assert {r["doc_id"] for r in near.collect()} == {1, None}


# SimHash


def test_simhash_messy(messy, messy_docs):
    assert rows(simhash.simhash_groups(messy_docs), "doc_id", "fingerprint", "component_id") == by_repr(plain.simhash([r[:2] for r in messy]))


def test_simhash_documents(documents, plain_documents):
    assert rows(simhash.simhash_groups(documents), "doc_id", "fingerprint", "component_id") == by_repr(plain.simhash(plain_documents))


def test_simhash_empty(no_docs):
    assert simhash.simhash_groups(no_docs).collect() == []


def test_golay_decodes_three_errors():
    decode = simhash.decodings()
    assert np.bincount(decode).tolist() == [2048] * 4096  # perfect: 1 + 23 + 253 + 1771 words each


def test_simhash_links_every_near_pair(spark):
    """Chains and pairs at 0 to 5 bits around random fingerprints, and one bucket larger than a block."""
    r = np.random.default_rng(9)
    base = r.integers(0, 1 << 63, 120).astype(np.uint64)
    made = [base]
    for bits in range(1, 6):
        flips = np.array([np.bitwise_or.reduce(np.uint64(1) << r.choice(64, bits, replace=False).astype(np.uint64)) for _ in base])
        made.append(base ^ flips)
    hot = base[0] ^ (np.uint64(1) << r.integers(46, 64, 6000).astype(np.uint64)) ^ (np.uint64(1) << r.integers(46, 64, 6000).astype(np.uint64)) ^ (np.uint64(1) << r.integers(40, 64, 6000).astype(np.uint64))
    f = np.unique(np.concatenate([*made, hot]))
    classes = spark.createDataFrame([(int(x), i) for i, x in enumerate(f.view(np.int64).tolist())], "f long, rep long")
    edges = [(i, int(j)) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= 3) if i < j]
    want = plain.groups(len(f), edges)
    got = list(range(len(f)))
    for x in simhash.components(simhash.links(classes)).collect():
        got[x["id"]] = x["component"]
    assert got == want


def test_joined_components():
    r = np.random.default_rng(4)
    a, b = r.integers(0, 500, 400), r.integers(0, 500, 400)
    assert joined(a, b, 500).tolist() == plain.groups(500, list(zip(a.tolist(), b.tolist(), strict=True)))


# packing


def check_packing(given: list[tuple], found: list, most: int = 1024) -> None:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for d, text in given:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) % most or most
        cuts = [0, *range(first, len(ids) + 1, most)]
        want.update((d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    total = sum(r["length"] for r in found)
    assert len(sequences) <= max(math.ceil(total / most) + 2, 1.01 * total / most, sum(r["length"] > most // 2 for r in found))


def test_packing_messy(messy, messy_docs):
    check_packing([r[:2] for r in messy], packing.pack(messy_docs).collect())


def test_packing_documents(documents, plain_documents):
    check_packing(plain_documents, packing.pack(documents).collect())


def test_packing_keeps_ids(spark):
    docs = spark.createDataFrame([(1, "one two <|endoftext|>"), (1, "one two <|endoftext|>"), (2, None)], "doc_id long, text string")
    found = packing.pack(docs, keep_ids=True, max_tokens=8).collect()
    check_packing([(1, "one two <|endoftext|>"), (1, "one two <|endoftext|>"), (2, None)], found, 8)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in found)


def test_packing_empty(no_docs):
    assert packing.pack(no_docs).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_plan_holds_every_piece_once(seed):
    r = np.random.default_rng(seed)
    histogram = np.bincount(np.minimum(128, r.geometric(0.02, r.integers(1, 3000))), minlength=129)
    histogram[0] = 0
    used = np.zeros_like(histogram)
    sequences = 0
    for content, n in packing.plan(histogram, 128):
        assert sum(a * m for a, m in content) <= 128
        sequences += n
        for a, m in content:
            used[a] += n * m
    assert (used == histogram).all()
    assert sequences <= math.ceil(1.02 * (histogram * np.arange(129)).sum() / 128) + 2


# token counts


def test_token_counts_messy(messy, messy_docs):
    import base64

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        vocabulary = {base64.b64decode(x.split()[0]) for x in f}
    want = []
    for d, text, _ in messy:
        n = [plain.tokens_in(b" " + w, vocabulary) for w in (text or "").encode().split()] if d != 301 else None
        if n is not None:
            want.append((d, len(n), sum(n), max(n, default=0)))
    found = tokencount.token_counts(messy_docs).where("doc_id is null or doc_id <> 301")
    assert rows(found, "doc_id", "n_words", "n_tokens", "longest") == by_repr(want)


def test_automaton_against_plain():
    r = np.random.default_rng(2)
    for _ in range(30):
        vocabulary = {bytes(r.integers(97, 100, r.integers(1, 6)).tolist()) for _ in range(8)} | {b"a", b"b"}
        automaton = tokencount.LongestMatch(vocabulary)
        for _ in range(200):
            word = bytes(r.integers(97, 100, r.integers(0, 14)).tolist())
            assert automaton.count(word) == plain.tokens_in(word, vocabulary), (word, vocabulary)


def test_token_counts_empty(no_docs):
    assert tokencount.token_counts(no_docs).collect() == []


# language ID


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.language_id(docs)
    held = found.where("held_out and lang is not null and lang_pred <> 'und'").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert held[1] > 100 and held[0] > 0.97
    assert found.where("score < 0 or score > 1 or score is null").isEmpty()
    assert found.count() == docs.count()
    assert found.where((fold() % 5 == 0) != F.col("held_out")).isEmpty()


def test_language_id_messy(messy, messy_docs):
    found = {r["doc_id"]: r for r in langid.language_id(messy_docs).collect()}
    assert len(found) == len(messy)
    for d, text, _ in messy:
        letters = any(map(str.isalpha, text or ""))
        assert (found[d]["lang_pred"] == "und") == (not letters)
        assert found[d]["lang_pred"] in ("und", "en", "de", "fr")
        assert found[d]["k"] == 3


def test_language_sample_counts_copies_once(spark):
    given = [("the same text", "en")] * 500 + [(f"text number {i}", "en") for i in range(100)] + [(f"ein Text {i}", "de") for i in range(30)]
    docs = spark.createDataFrame(given, "text string, lang string").repartition(4)
    _, langs = langid.sample(docs, per_lang=40)
    assert langs.count("de") == 60 and langs.count("en") == 80  # two windows of each text


def test_language_sample_is_bounded_and_the_smallest_hashes(spark):
    """However many texts there are: per_lang of each language, those with the smallest hashes as unsigned numbers."""
    docs = spark.range(60_000).select(F.concat(F.lit("text number "), "id").alias("text"), F.when(F.col("id") % 3 == 0, "de").otherwise("en").alias("lang"))
    windows, langs = langid.sample(docs, per_lang=7)
    assert langs == ["de"] * 14 + ["en"] * 14
    order = docs.where("lang = 'de'").select("text", F.shiftrightunsigned(F.xxhash64("text"), 11).alias("h")).orderBy("h").limit(7).collect()
    assert {bytes(x).rstrip(b"\0")[-3:] for x in windows[:14]} <= {r["text"].encode()[-3:] for r in order}


def plain_network(net, window):
    """Probabilities of one window by loops over places, widths and filters."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    pooled = []
    for w in langid.WIDTHS:
        for f in range(langid.FILTERS):
            at = [sum(float(p["e"][int(window[i + k])] @ p[f"w{w}"][k * langid.VECTOR : (k + 1) * langid.VECTOR, f]) for k in range(w)) for i in range(len(window) - w + 1)]
            pooled.append(max(0.0, max(at) + p[f"b{w}"][f]))
    q = np.array(pooled) @ p["o"] + p["c"]
    q = np.exp(q - q.max())
    return q / q.sum()


def test_predictor_against_plain_convolution():
    r = np.random.default_rng(3)
    net = langid.ByteCNN(["a", "b", "c"])
    for k, v in net.p.items():
        net.p[k] = v + r.normal(0, 0.1, v.shape).astype(np.float32)
    windows = np.concatenate([r.integers(0, 256, (3, langid.WINDOW)), np.zeros((1, langid.WINDOW), dtype=int)]).astype(np.uint8)
    windows[1, 20:] = 0
    found = langid.Predictor(net)(windows)
    assert np.allclose(found, [plain_network(net, x) for x in windows], atol=1e-5)


def test_gradients_against_differences():
    """Of the loss, at every kind of parameter, in double precision."""
    r = np.random.default_rng(4)
    net = langid.ByteCNN(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = r.integers(1, 256, (5, langid.WINDOW)).astype(np.uint8)
    y, weight = r.integers(0, 3, 5), np.array([1.0, 2, 1, 1, 3])

    def loss():
        q = np.array([plain_network(net, row) for row in x])
        return -(np.log(q[np.arange(5), y]) * weight).sum() / weight.sum() + 0.5e-4 * (net.p["o"] ** 2).sum()

    g = net._gradients(x, y, weight)
    for name in net.p:
        for at in {tuple(int(r.integers(n)) for n in net.p[name].shape) if name != "e" else (int(x[0, r.integers(200)]), int(r.integers(langid.VECTOR))) for _ in range(3)}:
            old = net.p[name][at]
            net.p[name][at] = old + 1e-5
            up = loss()
            net.p[name][at] = old - 1e-5
            down = loss()
            net.p[name][at] = old
            assert g[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6), (name, at)


def test_language_id_without_labels(spark, no_docs):
    assert langid.language_id(no_docs).collect() == []
    found = langid.language_id(spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")).first()
    assert (found["lang_pred"], found["score"]) == ("und", 0.0)


def test_language_inputs_are_texts_alone(spark, documents):
    """The same text gets the same answer whatever its labels and ids."""
    twice = documents.select("doc_id", "text", "lang").union(documents.select(F.lit(5).cast("long"), "text", F.lit(None).cast("string")))
    per = langid.language_id(twice).groupBy("text").agg(F.countDistinct("lang_pred", F.round("score", 9)).alias("n"))
    assert per.where("n > 1").isEmpty()


# LM scores


def base_of(given: list[tuple]):
    """(token counts of the training part, all documents' tokens) as the contract puts them."""
    tokens = {d: [*(text or "").translate(plain.AZ).encode().split(), b"\n"] for d, text in given}
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in given}
    counts = Counter(t for d, ts in tokens.items() if not held[d] for t in ts)
    return counts, tokens, held


def check_scores(given: list[tuple], found: list) -> None:
    counts, tokens, held = base_of(given)
    n, v = sum(counts.values()), len(counts)
    assert len(found) == len(given)
    for r in found:
        ts = tokens[r["doc_id"]]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ts), sum(counts[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert -1e9 < r["score"] <= 0


@pytest.mark.parametrize("shards", [1, 64])
def test_lm_scores_messy(messy, messy_docs, monkeypatch, shards):
    monkeypatch.setattr(bloom_lm, "SHARDS", shards)
    check_scores([r[:2] for r in messy], bloom_lm.lm_scores(messy_docs).collect())


def test_lm_scores_documents(documents, plain_documents):
    found = bloom_lm.lm_scores(documents).collect()
    check_scores(plain_documents, found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # pairs of words tell more than words


def test_lm_probabilities_add_up():
    """Over all known tokens and the unknown one, a context's probabilities add up to 1, less what the levels round off."""
    r = np.random.default_rng(5)
    c = np.bincount(r.zipf(1.4, 5000) % 400)
    n, v = int(c.sum()), int((c > 0).sum())
    words = bloom_lm.word_probabilities(np.append(c[c > 0], 0), n, v, int((c == 1).sum()), int((c == 2).sum()))
    assert words.sum() == pytest.approx(1)
    for seen in (np.array([1, 2, 3, 4, 1, 1]), np.array([700, 90, 33, 5, 5, 1]), np.zeros(0)):
        follow = np.zeros(len(words))
        follow[: len(seen)] = seen
        context = np.full(len(words), seen.sum(), dtype=float)
        assert bloom_lm.probabilities(follow, context, words).sum() == pytest.approx(1)
        rounded = bloom_lm.probabilities(bloom_lm.counted(bloom_lm.levels(follow)), context, words).sum()
        assert 2 / 3 <= rounded <= 1 + 1e-9
        assert seen.max(initial=0) > 4 or rounded == pytest.approx(1)


def test_filter_never_undercounts():
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 1 << 63, 3000).astype(np.uint64))
    level = bloom_lm.levels(r.integers(1, 5000, len(keys)))
    made = bloom_lm.Filter(keys, level)
    got = made.level(keys)
    assert (got >= level).all() and (got == level).mean() > 0.98
    assert (made.level(r.integers(0, 1 << 63, 5000).astype(np.uint64)) == 0).mean() > 0.98
    assert bloom_lm.Filter(keys[:0], level[:0]).level(keys).sum() == 0


def test_lm_key_packing():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (bloom_lm.from_steps(bloom_lm.steps(keys)) == keys).all()
    assert len(bloom_lm.from_steps(bloom_lm.steps(keys[:0]))) == 0


def test_lm_scores_empty(spark, no_docs):
    assert bloom_lm.lm_scores(no_docs).collect() == []
    held = spark.createDataFrame([(d, "a b") for d in range(40)], "doc_id long, text string").where(fold() % 5 == 1)
    found = bloom_lm.lm_scores(held).collect()
    assert found and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0 for r in found)


def test_queries_are_named_by_number():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("shards", [1, 64])
def test_lm_scores_against_a_plain_model(spark, monkeypatch, shards):
    """Every pair of words counts, those seen once and those of rare words, too, whatever the number of shards."""
    monkeypatch.setattr(bloom_lm, "SHARDS", shards)
    r = np.random.default_rng(8)
    given = [(d, " ".join(f"w{int(x)}" for x in r.zipf(1.3, 60) % 3000)) for d in range(150)] + [(150, None), (None, "w1 W2 w3"), (151, "unseen words")]
    counts, tokens, held = base_of(given)
    n, v = sum(counts.values()), len(counts)
    pairs = Counter(p for d, ts in tokens.items() if not held[d] for p in zip([b"\n", *ts[:-1]], ts, strict=True))
    once = Counter(counts.values())
    d = min(0.9, max(0.1, once[1] / (once[1] + 2 * once[2])))

    def rounded(c: int) -> int:
        level = 0
        while math.ceil(bloom_lm.BASE**level - 1e-6) <= c:
            level += 1
        return math.ceil(bloom_lm.BASE ** (level - 1) - 1e-6) if level else 0

    def score(ts: list[bytes]) -> float:
        out = 0.0
        for a, b in zip([b"\n", *ts[:-1]], ts, strict=True):
            p = (counts[b] - d) / n if counts[b] else d * v / n
            more = counts[a] ** bloom_lm.GROWTH
            out += math.log10(min(1, (rounded(pairs[a, b]) + more * p) / (counts[a] + more) if counts[a] else p))
        return out

    found = bloom_lm.lm_scores(spark.createDataFrame(given, "doc_id long, text string").repartition(3), level_bits=1000).collect()
    check_scores(given, found)
    for x in found:
        assert x["score"] == pytest.approx(score(tokens[x["doc_id"]]), rel=1e-6)


def test_lm_scores_at_production_bits(spark):
    """The filter's own error at 16 bits a level: scores move little against a thousand bits, and never far down."""
    r = np.random.default_rng(9)
    given = [(d, " ".join(f"w{int(x)}" for x in r.zipf(1.2, 300) % 5000)) for d in range(200)]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    few, many = ({x["doc_id"]: x for x in bloom_lm.lm_scores(docs, level_bits=b).collect()} for b in (bloom_lm.LEVEL_BITS, 1000))
    gap = np.array([(few[d]["score"] - many[d]["score"]) / few[d]["n_tokens"] for d in few])
    assert (gap >= -1e-9).all()  # false positives only add
    assert gap.mean() < 0.004 and gap.max() < 0.05  # log10 a token


def test_lm_rows_and_questions_stay_in_proportion(spark, monkeypatch):
    """However many segments: no more rows than keys, and the same scores."""
    r = np.random.default_rng(2)
    docs = spark.createDataFrame([(d, " ".join(f"w{int(x)}" for x in r.zipf(1.3, 200) % 3000)) for d in range(100)], "doc_id long, text string").repartition(2)
    monkeypatch.setattr(bloom_lm, "SLICE_BYTES", 4000)
    rows = bloom_lm.in_slices(docs, 5, 1)
    keys = sum(len(t.words) + len(t.pairs) for x in rows.collect() for t in [bloom_lm.Tokens([bytes(y) for y in x["texts"]])])
    found = {}
    for shards in (64, 4096, 1 << 16):
        monkeypatch.setattr(bloom_lm, "SHARDS", shards)
        model = bloom_lm.fitted(rows, 1000)
        assert model.table.where("kind = 1 and keys is not null").count() == 0  # bits only
        assert bloom_lm.answered(rows, model).count() <= keys
        found[shards] = sorted((x["doc_id"], x["base_score"], round(x["score"], 6)) for x in bloom_lm.scored(rows, model).collect())
    assert found[64] == found[4096] == found[1 << 16]


def test_a_model_scores_other_texts(spark):
    """Texts that weren't there when the model was fitted: unknown words, known pairs."""
    learn = bloom_lm.in_slices(spark.createDataFrame([(d, "the cat sat on the mat") for d in range(50)], "doc_id long, text string"), 5, 1)
    model = bloom_lm.fitted(learn)
    other = bloom_lm.in_slices(spark.createDataFrame([(1, "the cat sat"), (2, "sat cat the"), (3, "dogs bark loudly")], "doc_id long, text string"), 5, 1)
    found = {x["doc_id"]: x for x in bloom_lm.scored(other, model).collect()}
    assert found[1]["score"] > found[2]["score"] > found[3]["score"] and found[3]["n_known"] == 1


def plain_ids(text: str) -> list[int]:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path()).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("space", [" ", "\n", "\t \u00a0", " \n"])
@pytest.mark.parametrize("n", [999, 1000, 1001, 50_000])
def test_packing_ids_of_long_white_space(space, n):
    encode = packing.encoder(packing.tokenizer_path())
    run = (space * n)[:n]
    for text in (run, f"a{run}b", f"{run}<|endoftext|>{run} x"):
        assert encode(text).tolist() == plain_ids(text)


@pytest.mark.parametrize("text", ["one <|endoftext|> two", "<|endoftext|>", "<|endoftext|><|endoftext|>x", " <|endoftext|>\n", "<|endoftext", "a" * 200_000, "é" * 50_000, "x1" * 50_000, "'ll've it's\u2019s", "\u3000\u2028\x85 \x1c\x1d x", ""])
def test_packing_ids_are_the_file_tokenizers(text):
    assert packing.encoder(packing.tokenizer_path())(text).tolist() == plain_ids(text)


def test_both_encoders_class_every_character_alike():
    import tiktoken
    from tokenizers import Regex, normalizers

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        one = tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        others = set(normalizers.Replace(Regex(kind), "").normalize_str(every))
        assert bytes(one.encode_ordinary(every)).decode() == "".join(c for c in every if c not in others)


def test_packing_long_white_space_rows(spark):
    given = [(1, " " * 1_000_000), (2, "\n" * 1_000_000), (3, "one <|endoftext|> two"), (4, "a" + " " * 5_000_000 + "b")]
    check_packing(given, packing.pack(spark.createDataFrame(given, "doc_id long, text string")).collect())


def test_a_segment_takes_little_more_than_its_keys():
    """Counts added up and a filter made in parts: the same as at once, within a few times the bytes of keys and counts."""
    import tracemalloc

    r = np.random.default_rng(5)
    keys = [np.unique(r.integers(1 << 30, 1 << 36, 50_000).astype(np.uint64) >> np.uint64(14)) for _ in range(40)]
    n = [r.integers(1, 9, len(k)).astype(np.uint32) for k in keys]
    tracemalloc.start()
    found, sums = bloom_lm.added_up(keys, n)
    level = bloom_lm.levels(sums)
    filled = bloom_lm.Filter(found, level)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    assert (found == every).all()
    assert (sums == np.bincount(at, weights=np.concatenate(n))).all()
    assert peak < 4 * sum(k.nbytes + m.nbytes for k, m in zip(keys, n, strict=True))
    on = np.zeros(len(filled.data) * 8, dtype=np.uint8)
    for j in range(1, filled.top + 1):
        for place in filled.places(found[level >= j], j):
            on[place] = 1
    assert (np.packbits(on, bitorder="little") == filled.data).all()


def test_a_slice_takes_little_more_than_its_text():
    import tracemalloc

    r = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in r.zipf(1.3, 2_000) % 30_000).encode() for _ in range(200)]
    tracemalloc.start()
    t = bloom_lm.Tokens(texts, 43)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(t.word) == 200 * 2_001
    assert [len(x) for x in (t.first, t.last)] == [200, 200]
    assert peak < 60 * len(t.word)


def test_lm_tables_end_their_groups_by_bytes(spark, monkeypatch):
    """Rows of some MB: what is read at once of a written table is a slice or two, not a task's slices, whatever a task was given."""
    import pyarrow.parquet as pq

    r = np.random.default_rng(8)
    docs = spark.createDataFrame([(d, " ".join(f"w{int(x)}" for x in r.integers(0, 1 << 40, 300))) for d in range(80)], "doc_id long, text string").repartition(1)
    monkeypatch.setattr(bloom_lm, "SLICE_BYTES", 8000)
    rows = bloom_lm.in_slices(docs, 5, 1)
    for table in (rows, bloom_lm.fitted(rows).table):
        for path in table.inputFiles():
            found = pq.ParquetFile(path.removeprefix("file://")).metadata
            groups = [found.row_group(i) for i in range(found.num_row_groups)]
            assert all(g.num_rows == 1 or g.total_byte_size < 4 * 8000 for g in groups)
    assert rows.count() >= 40
