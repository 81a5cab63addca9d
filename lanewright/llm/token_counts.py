"""Word-piece token counts by a linear longest-match automaton.

Greedy longest-match-first word pieces need only be counted.  The vocabulary
trie has a failure link at each node, and with it the number of pieces that
are popped when the link is taken, so a word is read once, character by
character, without building a piece or looking back.

Words are runs of anything but ASCII white space and ASCII punctuation, and
each ASCII punctuation character alone.  A word that the vocabulary cannot
cover counts as one (unknown) token, as word-piece models define it; the same
goes for words over ``max_chars`` if that is set.

Nulls and empty texts have no tokens.  Rows repeat as they come; columns other
than the id and the text are not read.
"""

from __future__ import annotations

import string
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.llm import _text
from lanewright.llm._state import read_table
from lanewright.llm.sentencepiece import MARK, MODEL_PATH, PieceModel, model_bytes

#: Distinct words whose counts a Python worker remembers between batches.
CACHE_WORDS = 1_000_000

_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in string.punctuation]] = True


def wordpieces(model: PieceModel) -> tuple[set[str], set[str]]:
    """(initial pieces, continuing pieces) of a vocabulary that marks word starts.

    Single characters may start a word, marked or not.
    """
    whole = {p[1:] for p in model.ids if p[0] == MARK and p[1:] and MARK not in p[1:]}
    rest = {p for p in model.ids if MARK not in p}
    return whole | {p for p in rest if len(p) == 1}, rest


class LongestMatch:
    """The automaton: goto edges, failure links and popped-token counts."""

    DEAD = -1

    def __init__(self, initial: Iterable[str], continuing: Iterable[str]):
        #: Node 0 is the root for initial pieces, node 1 for continuing ones.
        self.edges: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, vocabulary in ((0, initial), (1, continuing)):
            for piece in vocabulary:
                node = root
                for char in piece:
                    following = self.edges[node].get(char)
                    if following is None:
                        following = self.edges[node][char] = len(self.edges)
                        self.edges.append({})
                        final.append(False)
                    node = following
                final[node] = True
        self.fail = [self.DEAD] * len(self.edges)
        self.pops = [0] * len(self.edges)
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for char, node in self.edges[parent].items():
                queue.append(node)
                if final[node]:
                    self.fail[node], self.pops[node] = 1, 1
                    continue
                link, popped = self.fail[parent], self.pops[parent]
                while link != self.DEAD and char not in self.edges[link]:
                    popped += self.pops[link]
                    link = self.fail[link]
                if link != self.DEAD:
                    self.fail[node], self.pops[node] = self.edges[link][char], popped
        #: Steps seen so far: (node, character) -> (node, pieces popped).
        self.steps: list[dict[str, tuple[int, int]]] = [{} for _ in self.edges]

    def _step(self, node: int, char: str) -> tuple[int, int]:
        popped, at = 0, node
        while at != self.DEAD and char not in self.edges[at]:
            popped += self.pops[at]
            at = self.fail[at]
        found = (self.DEAD, 0) if at == self.DEAD else (self.edges[at][char], popped)
        self.steps[node][char] = found
        return found

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if the vocabulary cannot cover it."""
        node = total = 0
        steps = self.steps
        for char in word:
            got = steps[node].get(char) or self._step(node, char)
            node, popped = got
            if node < 0:
                return 0
            total += popped
        while node > 1:
            total += self.pops[node]
            node = self.fail[node]
        return total if node == 1 else 0


class Counter:
    """Counts of batches, with a bounded memory of words."""

    def __init__(self, automaton: LongestMatch, max_chars: int | None):
        self.automaton, self.max_chars = automaton, max_chars
        self.known: dict[bytes, int] = {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, tokens, unknown words) of each text."""
        raw, off = _text.flat(texts)
        zero = np.zeros(len(texts), np.int64)
        if not len(raw):
            return zero, zero, zero
        punct = _PUNCT[raw]
        plain = ~(punct | _text._SPACE[raw])
        first = np.zeros(len(raw), bool)
        first[off[:-1][off[:-1] < len(raw)]] = True
        begins, ends = plain | punct, plain | punct
        begins[1:] &= ~(plain[1:] & plain[:-1] & ~first[1:])
        ends[:-1] &= ~(plain[:-1] & plain[1:] & ~first[1:])
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if not len(start):
            return zero, zero, zero
        words, number = _text.distinct(raw, start, end)
        known, count, most = self.known, self.automaton.count, self.max_chars
        new = [w for w in words if w not in known]
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = words
        for w in new:
            text = w.decode()
            known[w] = 0 if most is not None and len(text) > most else count(text)
        pieces = np.fromiter(map(known.__getitem__, words), np.int64, len(words))[number]
        at = np.searchsorted(start, off)
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
        return np.diff(at), sums(np.maximum(pieces, 1)), sums(pieces == 0)


_COUNTERS: dict[tuple, Counter] = {}


def token_counts(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", max_chars: int | None = None) -> DataFrame:
    """One row for each row of docs: id, n_words, n_tokens, n_unknown."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (hash(model), max_chars)
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = Counter(LongestMatch(*wordpieces(PieceModel(model))), max_chars)
        for batch in batches:
            for part in _text.pieces(batch, "text"):
                columns = [pa.array(x, pa.int64()) for x in _COUNTERS[key](part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=[id_col, "n_words", "n_tokens", "n_unknown"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"`{id_col}` {kind}, n_words long, n_tokens long, n_unknown long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), model_bytes(MODEL_PATH))
