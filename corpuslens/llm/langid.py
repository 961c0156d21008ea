"""Language ID: a byte convolutional network over fixed-length windows, trained in numpy.

Each window of WINDOW bytes goes through filters of several widths over byte vectors, a maximum over the window and a softmax. A whole
text is cut into windows of that length, the last one filled up with zeros; a text's probabilities are the windows' mean, weighted by
their bytes. For prediction, the byte vectors and the filters are multiplied out into tables over pairs of bytes.

Training takes a bounded sample, whatever the corpus' size: of each of the MOST_LANGS languages with the most different labelled texts, the
`per_lang` texts with the smallest hashes (all of them in a smaller language), of each two windows. The number of training steps is fixed.

Nulls: texts that are null or hold no letter get `und` and score 0, as all do if no text is labelled. A null doc_id belongs to the
training part (its id text is empty). Extra columns pass through `identify`. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, binary, column, fold, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
VECTOR = 8
PER_LANG = 1500
#: Languages that are learned at most.
MOST_LANGS = 1000
#: Training steps and windows of each.
STEPS, BATCH = 560, 64
UNKNOWN = "und"
#: The columns that are added.
COLUMNS = ("held_out", "lang_pred", "score")


class ByteCNN:
    def __init__(self, langs: list[str], seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"e": r.normal(0, 0.5, (256, VECTOR))}
        self.p["e"][0] = 0
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, (2 / (w * VECTOR)) ** 0.5, (w * VECTOR, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["o"] = r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs)))
        self.p["c"] = np.zeros(len(langs))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def train(self, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 4e-3, seed: int = 11) -> ByteCNN:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, order = 0, np.zeros(0, dtype=np.int64)
        for step in range(1, steps + 1):
            if len(order) < batch:
                order = np.concatenate([order, *[r.permutation(len(windows)) for _ in range(-(-batch // len(windows)))]])
            rows, order = order[:batch], order[batch:]
            x = windows[rows].copy()
            for i in np.flatnonzero(r.random(len(rows)) < 0.5):  # short texts are learned, too
                x[i, int(np.exp(r.uniform(np.log(3), np.log(WINDOW)))) :] = 0
            g = self._gradients(x, labels[rows], weights[rows])
            now = rate * (1 - step / (steps + 1))
            for k, v in g.items():
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.999 * s[k] + 0.001 * v * v
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            self.p["e"][0] = 0
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        e = p["e"][x]
        pooled, best, patches = [], [], []
        for w in WIDTHS:
            cut = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - w + 1, w * VECTOR)
            z = cut @ p[f"w{w}"]
            at = z.argmax(axis=1)
            best.append(at)
            patches.append(cut)
            pooled.append(np.take_along_axis(z, at[:, None, :], 1)[:, 0] + p[f"b{w}"])
        h = np.concatenate(pooled, axis=1)
        a = np.maximum(h, 0)
        q = a @ p["o"] + p["c"]
        q = np.exp(q - q.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(n), y] -= 1
        q *= (weight / weight.sum())[:, None]
        g = {"o": a.T @ q + 1e-4 * p["o"], "c": q.sum(axis=0), "e": np.zeros_like(p["e"])}
        dh = (q @ p["o"].T) * (h > 0)
        for i, w in enumerate(WIDTHS):
            d = dh[:, i * FILTERS : (i + 1) * FILTERS]
            chosen = np.take_along_axis(patches[i], best[i][:, :, None], 1)  # n, filters, w * vector
            g[f"w{w}"] = np.einsum("nf,nfk->kf", d, chosen)
            g[f"b{w}"] = d.sum(axis=0)
            back = d[:, :, None] * p[f"w{w}"].T[None]
            for k in range(w):
                np.add.at(g["e"], np.take_along_axis(x, best[i] + k, 1), back[:, :, k * VECTOR : (k + 1) * VECTOR])
        return g

    def tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """For each width, tables of a filter's responses: over pairs of bytes, and a last odd byte."""
        out = []
        for w in WIDTHS:
            own = self.p["e"] @ self.p[f"w{w}"].reshape(w, VECTOR, FILTERS)  # w, 256, filters
            made = [(k, (own[k][:, None] + own[k + 1][None]).reshape(-1, FILTERS)) for k in range(0, w - 1, 2)]
            out.append(made + ([(w - 1, own[w - 1])] if w % 2 else []))
        return out


class Predictor:
    def __init__(self, net: ByteCNN) -> None:
        self.net, self.made = net, net.tables()

    def __call__(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities, a row for each window."""
        out = np.empty((len(windows), len(self.net.langs)))
        for at in range(0, len(windows), 64):
            x = windows[at : at + 64].astype(np.int64)
            pairs = (x[:, :-1] << 8) + x[:, 1:]
            pooled = []
            for w, tables in zip(WIDTHS, self.made, strict=True):
                n = WINDOW - w + 1
                z = None
                for k, t in tables:
                    y = np.take(t, (pairs if len(t) > 256 else x)[:, k : k + n], axis=0)
                    z = y if z is None else np.add(z, y, out=z)
                pooled.append(z.max(axis=1) + self.net.p[f"b{w}"])
            q = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.net.p["o"] + self.net.p["c"]
            q = np.exp(q - q.max(axis=1, keepdims=True))
            out[at : at + 64] = q / q.sum(axis=1, keepdims=True)
        return out


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' windows, each window's text, and its bytes."""
    size = np.array([len(x) for x in texts], dtype=np.int64)
    count = np.maximum(1, -(-size // WINDOW))
    flat = np.zeros(int(count.sum()) * WINDOW, dtype=np.uint8)
    first = (np.cumsum(count) - count) * WINDOW
    for at, text in zip(first.tolist(), texts, strict=True):
        flat[at : at + len(text)] = np.frombuffer(text, np.uint8)
    of = np.repeat(np.arange(len(texts)), count)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    return flat.reshape(-1, WINDOW), of, np.maximum(1, np.minimum(WINDOW, size[of] - inside * WINDOW))


def has_letter(text: bytes) -> bool:
    if text[:64].isalpha():
        return True
    return any(map(str.isalpha, text.decode()))


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> tuple[np.ndarray, list[str]]:
    """Windows and languages of the per_lang different texts with the smallest hashes of each language: a group of copies counts once, so no
    group makes the sample larger. The languages' sizes are estimated (within a few hundredths); a hash's share of its range tells rows
    that may be among the smallest, half as many again as are taken, so that no task sorts a language and the driver gets a bounded table."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")).withColumn("h", F.xxhash64("text"))
    counted = labelled.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS)
    sizes = {r[0]: max(1, r[1]) for r in counted.collect()}
    if not sizes:
        return np.zeros((0, WINDOW), np.uint8), []
    place = F.shiftrightunsigned("h", 11) / F.lit(2.0**53)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, (1.5 * per_lang + 50) / n)]), F.col("lang"))
    spread = lambda seed: F.substring("text", 1 + F.pmod(F.xxhash64("text", F.lit(seed)), F.greatest(F.lit(1), F.length("text") - WINDOW // 2)).cast("int"), F.lit(WINDOW))
    near = labelled.where(F.col("lang").isin(*sizes)).where(place < share).groupBy("lang", place.alias("place"), "h").agg(F.min(F.array(spread(1), spread(2))).alias("cuts"))
    rows, taken = [], Counter()
    for r in sorted(near.collect(), key=lambda r: (r["lang"], r["place"], r["h"])):
        if taken[r["lang"]] < per_lang:
            taken[r["lang"]] += 1
            rows.append((r["lang"], r["cuts"]))
    texts = [x.encode()[:WINDOW] for _, cuts in rows for x in cuts if x.strip()]
    langs = [lang for lang, cuts in rows for x in cuts if x.strip()]
    if not langs:
        raise ValueError("texts are labelled, but the sample to learn from is empty")
    return windows_of(texts)[0], langs


def fit(train: DataFrame, per_lang: int = PER_LANG) -> ByteCNN | None:
    """A network trained on the rows (text, lang); None if none is labelled."""
    windows, langs = sample(train, per_lang)
    if not langs:
        return None
    names = sorted(set(langs))
    labels = np.searchsorted(names, langs)
    counts = np.bincount(labels)
    return ByteCNN(names).train(windows, labels, (1 / counts)[labels].astype(np.float32))


def identify(docs: DataFrame, net: ByteCNN | None) -> DataFrame:
    """docs with lang_pred string and score double (0 to 1), from whole texts; columns of these names are replaced."""
    base = docs.drop("lang_pred", "score")
    shape = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared, names = docs.sparkSession.sparkContext.broadcast(net), base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, net = arrow_type(shape), shared.value
        predict = Predictor(net) if net else None
        for batch in slices(batches, "text"):
            texts = binary(batch, "text")
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            known = [i for i, x in enumerate(texts) if net and has_letter(x)]
            if known:
                windows, of, size = windows_of([texts[i] for i in known])
                q = np.zeros((len(known), len(net.langs)))
                for at in range(0, len(windows), 4096):
                    part = slice(at, at + 4096)
                    np.add.at(q, of[part], predict(windows[part]) * size[part, None])
                q /= q.sum(axis=1, keepdims=True)
                for i, best, s in zip(known, q.argmax(axis=1).tolist(), q.max(axis=1).tolist(), strict=True):
                    lang[i], score[i] = net.langs[best], min(1.0, s)
            out = [column(batch, n).cast(kinds.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([*out, pa.array(lang), pa.array(score, pa.float64())], schema=kinds)

    return base.mapInArrow(run, shape)


def language_id(docs: DataFrame, folds: int = 5, held: int = 0, per_lang: int = PER_LANG) -> DataFrame:
    """docs with held_out, lang_pred, score: learned from the rows whose fold (crc32 of the id as text) isn't `held`."""
    train = docs.where(fold() % folds != held).select("text", "lang")
    return identify(docs.drop("held_out").withColumn("held_out", fold() % folds == held), fit(train, per_lang))
