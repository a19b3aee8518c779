"""Token counts by a linear longest-match automaton (after Song et al., "Fast WordPiece Tokenization", 2021).

A vocabulary trie has failure links: at a node whose string has no way on, the link gives the node of what is left after the
longest-match pieces at its front are taken off, and a precomputed number says how many those were. So the length of a word
in greedy longest-match pieces is counted in one pass over its bytes, and no piece is built. A word is its bytes after one
blank (first pieces carry the blank, as in the vocabulary). The vocabulary must hold each single byte, so every word has
pieces. Words are `[^\\x20\\x09-\\x0D]+`; the count of a word seen before comes from a table of at most `cache` words.

The vocabulary file is read on the driver and broadcast (under 1 MB, fixed); each task builds the automaton once.

A null or empty text has no words and no tokens. Texts are whole. Repeated rows and null ids keep their rows. Columns other
than the two named are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

CACHE_WORDS = 200_000


def vocabulary(path: str | None = None) -> list[bytes]:
    """The pieces of a ranks file (one base64 piece a line)."""
    if path is None:
        import public_tokenizers as P

        path = P.path("byte_bpe_50k.tiktoken")
    return [base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line.strip()]


class Automaton:
    """next: for each node, byte -> node. link and popped: where to go on, and how many pieces that closes."""

    def __init__(self, pieces: list[bytes]):
        white = frozenset(b"\t\n\x0b\x0c\r ")
        pieces = sorted({p for p in pieces if p and not white.intersection(p[1:]) and (p[0] not in white or p[0] == 32)})
        self.next: list[dict[int, int]] = [{}]
        piece = [False]
        for p in pieces:
            at = 0
            for c in p:
                if (to := self.next[at].get(c)) is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    piece.append(False)
                at = to
            piece[at] = True
        if missing := [c for c in range(256) if (c not in white or c == 32) and not piece[self.next[0].get(c, 0)]]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        n = len(self.next)
        self.link, self.popped = [-1] * n, [0] * n
        level = [0]
        while level:
            below = []
            for v in level:
                for c, u in self.next[v].items():
                    if piece[u]:
                        self.link[u], self.popped[u] = 0, 1
                    else:
                        z, popped = self.link[v], self.popped[v]
                        while z >= 0 and c not in self.next[z]:
                            popped += self.popped[z]
                            z = self.link[z]
                        if z >= 0:
                            self.link[u], self.popped[u] = self.next[z][c], popped
                    below.append(u)
            level = below

    def length(self, word: bytes) -> int:
        """The number of greedy longest-match pieces of a word."""
        step, link, popped = self.next, self.link, self.popped
        at, count = 0, 0
        for c in word:
            while (to := step[at].get(c)) is None:
                if link[at] < 0:
                    return -1
                count += popped[at]
                at = link[at]
            at = to
        while at:  # what is left is popped to its end
            if link[at] < 0:
                return -1
            count += popped[at]
            at = link[at]
        return count


def greedy_pieces(word: bytes, pieces: frozenset[bytes]) -> list[bytes]:
    """The plain definition, for tests."""
    out, at = [], 0
    while at < len(word):
        end = next(e for e in range(len(word), at, -1) if word[at:e] in pieces)
        out.append(word[at:end])
        at = end
    return out


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", pieces: list[bytes] | None = None, cache: int = CACHE_WORDS) -> DataFrame:
    """doc_id, n_words, n_tokens, max_word_tokens."""
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(pieces if pieces is not None else vocabulary())

    def run(batches):
        automaton = Automaton(shared.value)
        known: dict[bytes, int] = {}

        class Lengths(dict):
            def __missing__(self, word):
                if len(self) >= cache:
                    self.clear()
                n = self[word] = automaton.length(b" " + word)
                return n

        known = Lengths()
        for b in batches:
            out = np.zeros((3, b.num_rows), dtype=np.int64)
            for i, x in enumerate(b.column(1)):
                if words := (x.as_py() or b"").split():
                    counts = [known[w] for w in words]
                    out[:, i] = len(words), sum(counts), max(counts)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out)], names=["doc_id", "n_words", "n_tokens", "max_word_tokens"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_tokens long, max_word_tokens long")
