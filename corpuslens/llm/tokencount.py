"""Token counts: a linear longest-match automaton over a trie of the vocabulary.

Every trie node has a failure link and the number of tokens popped on the way along it, both precomputed, so that a word is read once
from left to right and the length of its greedy longest-match segmentation comes out without building pieces. A word is taken with
the word mark (by default a space) before it, as word-initial tokens have it in the vocabulary file. A word with a byte that no token
starts with counts as one unknown token. Words repeat, so a worker keeps the counts of a bounded number of words.

Nulls: a null or empty text has no words. A null doc_id stays null; rows that share one are separate rows. Extra columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, column, slices, typed

KEPT_WORDS = 400_000


class LongestMatch:
    def __init__(self, vocabulary: Iterable[bytes]) -> None:
        #: (node << 8 | byte) to the next node; node 0 is the root.
        self.next: dict[int, int] = {}
        order: list[tuple[int, int, int]] = []  # parent, byte, node by rising depth
        whole: set[int] = set()
        depth = {0: 0}
        for token in vocabulary:
            node = 0
            for byte in token:
                edge = node << 8 | byte
                if edge not in self.next:
                    self.next[edge] = new = len(depth)
                    depth[new] = depth[node] + 1
                    order.append((node, byte, new))
                node = self.next[edge]
            if node:
                whole.add(node)
        order.sort(key=lambda x: depth[x[2]])
        self.fail: list[int] = [-1] * len(depth)
        self.popped: list[int] = [0] * len(depth)
        for parent, byte, node in order:
            if node in whole:
                self.fail[node], self.popped[node] = 0, 1
                continue
            n, z = self.popped[parent], self.fail[parent]
            while z >= 0 and (z << 8 | byte) not in self.next:
                n += self.popped[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[node], self.popped[node] = self.next[z << 8 | byte], n

    def count(self, word: bytes) -> int:
        """Tokens of the word's greedy segmentation; 1 if it has none."""
        step, fail, popped = self.next, self.fail, self.popped
        node = n = 0
        for byte in word:
            to = step.get(node << 8 | byte)
            while to is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
                to = step.get(node << 8 | byte)
            node = to
        while node > 0:
            n += popped[node]
            node = fail[node]
        return n if node == 0 else 1


class _Counts(dict):
    def __init__(self, automaton: LongestMatch, mark: bytes) -> None:
        super().__init__()
        self.automaton, self.mark = automaton, mark

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = n = self.automaton.count(self.mark + word)
        return n


@cache
def counter(path: str, mark: bytes) -> _Counts:
    with open(path, "rb") as f:
        return _Counts(LongestMatch(base64.b64decode(x.split()[0]) for x in f if x.strip()), mark)


def token_counts(docs: DataFrame, path: str | None = None, mark: bytes = b" ") -> DataFrame:
    """(doc_id, n_words, n_tokens, longest) for each row: words `[^\\x20\\x09-\\x0D]+`, their tokens, the most of a word.

    path: a vocabulary of one base64 token and rank a line.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = counter(path, mark).__getitem__
        for batch in slices(batches, "text"):
            found = [list(map(get, x.split())) for x in binary(batch, "text")]
            yield typed([column(batch, "doc_id"), list(map(len, found)), list(map(sum, found)), [max(x, default=0) for x in found]], [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("longest", pa.int64())])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long, longest long")
