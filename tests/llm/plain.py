"""Plain versions of the operators over lists of rows, as the contracts put them: slow, small, without Spark."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

from corpuslens.llm.common import NULL_ID

BLANK = " \t\n\x0b\x0c\r"
AZ = {x: x + 32 for x in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def groups(n: int, edges) -> list[int]:
    """The smallest index of each one's component."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return [root(x) for x in range(n)]


def line_dedup(docs: list[tuple]) -> list[tuple]:
    """(doc_id, n_lines, n_dropped, kept text) of rows (doc_id, text); rows that share an id are one document."""
    key = lambda line: line.strip(BLANK).translate(AZ)
    held: dict[str, set[int]] = {}
    for d, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(NULL_ID if d is None else d)
    out = []
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == (NULL_ID if d is None else d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def contamination(docs: list[tuple], items: list[tuple], width: int = 13) -> list[tuple]:
    """(doc_id, n_words, n_hit, item ids, contaminated)."""
    words = lambda text: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(AZ))
    windows: dict[tuple, set[int]] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).update(() if item is None else [item])
    out = []
    for d, text in docs:
        w = words(text)
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (names := windows.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    found |= names
        out.append((d, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def fingerprint(text: str | None) -> str:
    w = re.findall(f"[^{BLANK}]+", (text or "").translate(AZ))
    if not w:
        return "0" * 16
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return f"{sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles)):016x}"


def simhash(docs: list[tuple]) -> list[tuple]:
    """(doc_id, fingerprint, component id) of rows whose ids differ."""
    docs = sorted(docs, key=lambda r: NULL_ID if r[0] is None else r[0])
    prints = [fingerprint(t) for _, t in docs]
    f = np.array([int(x, 16) for x in prints], dtype=np.uint64)
    edges = [(i, int(j)) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= 3)]
    return [(d, p, docs[c][0]) for (d, _), p, c in zip(docs, prints, groups(len(docs), edges), strict=True)]


def near_vectors(rows: list[tuple], least: float = 0.98) -> list[tuple]:
    """(vec_id, n_links, component_id, kept) of rows (vec_id, vector, label) whose ids differ."""
    rows = sorted(rows, key=lambda r: NULL_ID if r[0] is None else r[0])
    fine = [i for i, (_, x, label) in enumerate(rows) if label is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    edges = []
    for n, i in enumerate(fine):
        for j in fine[n + 1 :]:
            a, b = (np.array(rows[k][1], dtype=np.longdouble) for k in (i, j))
            if rows[i][2] == rows[j][2] and len(a) == len(b) and (a * b).sum() / np.sqrt((a * a).sum()) / np.sqrt((b * b).sum()) >= least:
                edges.append((i, j))
    links = np.bincount(np.array(edges, dtype=int).reshape(-1), minlength=len(rows))
    return [(r[0], int(n), rows[c][0], c == i) for i, (r, n, c) in enumerate(zip(rows, links, groups(len(rows), edges), strict=True))]


def tokens_in(word: bytes, vocabulary: set[bytes]) -> int:
    """Tokens of the greedy longest-match segmentation; 1 where there is none."""
    n = at = 0
    longest = max(map(len, vocabulary))
    while at < len(word):
        size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocabulary), 0)
        if not size:
            return 1
        n, at = n + 1, at + size
    return n
