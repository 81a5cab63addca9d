"""Quality rules with a line labeller: a linear-chain CRF marks each line.

Word statistics reject texts that are too short or too repetitive (the base
rules).  For the rest, every line gets features of its own; Viterbi decoding
of a two-state linear-chain conditional random field labels lines as content
or boilerplate, and the share of word characters on content lines decides.

The CRF is trained here, from the labelled table: lines start with the quality
label of their document; then, twice, lines of low-quality documents are
relabelled by the model itself (lines of good documents stay content), so that
sound lines inside bad documents are not learnt as boilerplate.  Training uses
at most ``SAMPLE_DOCS`` labelled documents, those with the smallest hash of
their id; everything else reads all documents, whole.

Null and empty texts have no words: they fail the base rules.  Null ids stay
null.  With no usable label the prior weights stand.  Repeated rows are judged
each; columns other than the id and the text are passed on where documents are
returned.  Equality of lines and of windows within a text is by 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.llm import _text
from lanewright.llm._state import read_table

#: At most so many labelled documents are used for training.
SAMPLE_DOCS = 4_000
#: Lines of one training sequence; longer documents give several.
SEQUENCE = 64
#: Least share of word characters that must be on content lines.
CONTENT_SHARE = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC0:] = True  # the first byte of a longer sequence
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True

FEATURES = (
    "bias", "blank", "short", "long", "symbols", "many_symbols", "upper", "mostly_upper", "digits", "exclaims",
    "echo", "many_echoes", "repeats", "earlier_line", "sentence_end", "few_letters", "bars",
)
#: Weights for content, used where nothing can be learnt: one for each feature.
PRIOR = np.array([1.5, 0, 0, 0, -2, -3, 0, -3, -1, -2, -1, -3, -2, -1, 0.5, -1, -2], float)


class Lines:
    """Word statistics of texts, and the features of their lines."""

    def __init__(self, texts: pa.Array):
        raw, off = _text.flat(texts)
        self.n = len(texts)
        start, end, doc = _text.word_bounds(raw, off)
        starts_char = (raw & 0xC0) != 0x80
        symbol = _SYMBOL[raw]
        word = _text.span_hash(raw, start, end)
        sums = lambda x, at: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[at])
        self.n_words = np.bincount(doc, minlength=self.n)
        self.word_chars = sums(starts_char & ~_text._SPACE[raw], off)
        self.n_symbols = sums(symbol, off)

        # windows found twice or more in one text, and the words they cover
        value, first = _text.windows(word, doc, WINDOW)
        salt = _text.mix(np.arange(self.n, dtype=np.uint64) + np.uint64(1))
        _, number, count = np.unique(value ^ salt[doc[first]], return_inverse=True, return_counts=True)
        again = first[count[number] > 1]
        cover = np.zeros(len(word) + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + WINDOW, -1)
        covered = np.cumsum(cover[:-1]) > 0
        self.n_repeat_words = np.bincount(doc[covered], minlength=self.n)

        # lines: each text has one more than it has line feeds
        feeds = np.flatnonzero(raw == 10)
        at = np.sort(np.concatenate([off[:-1], feeds + 1]), kind="stable")
        self.line_doc = np.sort(np.concatenate([np.arange(self.n), np.searchsorted(off, feeds, side="right") - 1]), kind="stable")
        stop = np.append(at[1:], len(raw))
        last = np.append(self.line_doc[1:] != self.line_doc[:-1], True) if len(at) else np.zeros(0, bool)
        stop = np.where(last, stop, stop - 1)
        inside = stop > at
        bound = np.empty(2 * len(at), np.int64)
        bound[0::2], bound[1::2] = at, stop
        per_line = lambda x: sums(x, bound)[0::2] if len(bound) else np.zeros(0, np.int64)
        word_line = np.searchsorted(at, start, side="right") - 1
        words = np.bincount(word_line, minlength=len(at))
        chars = per_line(starts_char & ~_text._SPACE[raw])
        self.line_chars = chars
        line_hash = np.zeros(len(at), np.uint64)
        line_hash[inside] = _text.span_hash(raw, at[inside], stop[inside])
        earlier = np.ones(len(at), bool)
        _, opening = np.unique(line_hash ^ salt[self.line_doc], return_index=True)
        earlier[opening] = False
        earlier &= words > 0
        self.n_dup_lines = np.bincount(self.line_doc[earlier], minlength=self.n)

        same = np.zeros(len(word), bool)
        same[1:] = (word[1:] == word[:-1]) & (word_line[1:] == word_line[:-1])
        echo = np.bincount(word_line[same], minlength=len(at))
        repeated = np.bincount(word_line[covered], minlength=len(at))
        end_byte = np.zeros(len(at), np.uint8)
        end_byte[inside] = raw[stop[inside] - 1]
        size = np.maximum(chars, 1)
        some = np.maximum(words, 1)
        symbols, upper, letters = per_line(symbol), per_line(_UPPER[raw]), per_line(_LETTER[raw])
        digits, exclaims, bars = per_line(_DIGIT[raw]), per_line(raw == 33), per_line(raw == 124)
        self.features = np.stack(
            [
                np.ones(len(at), bool), words == 0, (words > 0) & (words < 4), words > 30, symbols * 5 > words, symbols * 2 > words,
                upper * 4 > letters, upper * 2 > letters, digits * 10 > size, exclaims * 3 > words, echo * 10 > some, echo * 3 > some,
                repeated * 5 > some, earlier, np.isin(end_byte, [33, 46, 63]), letters * 2 < size, bars * 4 > some,
            ],
            axis=1,
        ).astype(np.float32)

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words)


class LineField:
    """A linear-chain CRF with two states: 0 boilerplate, 1 content."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.weights = PRIOR.copy() if weights is None else weights
        self.moves = np.array([[0.5, -0.5], [-0.5, 0.5]]) if moves is None else moves

    def viterbi(self, features: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The best label of each line; a new sequence starts where doc changes."""
        score = (features @ self.weights).tolist()
        new = np.append(True, doc[1:] != doc[:-1]).tolist() if len(doc) else []
        (m00, m01), (m10, m11) = self.moves.tolist()
        back, a, b = [0] * len(score), 0.0, 0.0
        tops = [0] * len(score)
        for i, s in enumerate(score):
            if new[i]:
                a, b, how = 0.0, s, 0
            else:
                from0, from1 = a + m00, b + m10
                to0, how = (from1, 1) if from1 > from0 else (from0, 0)
                from0, from1 = a + m01, b + m11
                to1 = from0
                if from1 >= from0:
                    to1, how = from1, how | 2
                a, b = to0, to1 + s
            back[i] = how
            tops[i] = 1 if b >= a else 0
        labels, state = [0] * len(score), 0
        for i in range(len(score) - 1, -1, -1):
            if i + 1 == len(score) or new[i + 1]:
                state = tops[i]
            labels[i] = state
            state = back[i] >> state & 1
        return np.array(labels, bool)

    def train(self, features: np.ndarray, doc: np.ndarray, good: np.ndarray, rounds: int = 3) -> None:
        """Maximum likelihood with a small ridge; good: the label of each line's document."""
        place = np.arange(len(doc)) - np.maximum.accumulate(np.where(np.append(True, doc[1:] != doc[:-1]), np.arange(len(doc)), 0))
        sequence = np.cumsum(place % SEQUENCE == 0) - 1
        slot = place % SEQUENCE
        n = sequence[-1] + 1
        x = np.zeros((n, SEQUENCE, features.shape[1]), np.float32)
        x[sequence, slot] = features
        there = np.zeros((n, SEQUENCE), bool)
        there[sequence, slot] = True
        labels = good.astype(bool)
        for _ in range(rounds):
            y = np.zeros((n, SEQUENCE), np.int64)
            y[sequence, slot] = labels
            self._fit(x, there, y)
            labels = self.viterbi(features, doc) | good

    @staticmethod
    def slope(theta: np.ndarray, x: np.ndarray, there: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """The log-likelihood of labels y and its gradient, by forward and backward sums.

        theta: weights, then moves; x: features of each slot of each sequence;
        there: which slots are filled, the first ones of each.
        """
        n, length, width = x.shape
        flat, pair = x.reshape(-1, width), there[:, 1:]
        moves = theta[width:].reshape(2, 2)
        emit = np.zeros((n, length, 2))
        emit[:, :, 1] = (flat @ theta[:width].astype(x.dtype)).reshape(n, length)
        alpha, beta = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        alpha[:, 0] = emit[:, 0]
        for t in range(1, length):
            ahead = np.logaddexp(alpha[:, t - 1, :1] + moves[0], alpha[:, t - 1, 1:] + moves[1]) + emit[:, t]
            alpha[:, t] = np.where(there[:, t, None], ahead, alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            after = emit[:, t + 1] + beta[:, t + 1]
            behind = np.logaddexp(after[:, :1] + moves[:, 0], after[:, 1:] + moves[:, 1])
            beta[:, t] = np.where(there[:, t + 1, None], behind, 0)
        log_z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])[:, None]
        share = np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - log_z, 0)) * there
        grad_w = (flat * (there & (y == 1)).reshape(-1, 1)).sum(0) - share.reshape(-1) @ flat
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][pair], y[:, 1:][pair]), 1)
        grad_m = seen.copy()
        for i in range(2):
            for j in range(2):
                both = alpha[:, :-1, i] + moves[i, j] + emit[:, 1:, j] + beta[:, 1:, j] - log_z
                grad_m[i, j] -= (np.exp(np.minimum(both, 0)) * pair).sum()
        likelihood = emit[:, :, 1][there & (y == 1)].sum() + (seen * moves).sum() - log_z.sum()
        return float(likelihood), np.concatenate([grad_w, grad_m.ravel()])

    def _fit(self, x: np.ndarray, there: np.ndarray, y: np.ndarray, steps: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> None:
        width, total = x.shape[2], max(1, int(there.sum()))
        theta = np.concatenate([self.weights, self.moves.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            grad = self.slope(theta, x, there, y)[1] / total - ridge * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights, self.moves = theta[:width], theta[width:].reshape(2, 2)


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineField:
    """A field trained on at most sample_docs labelled documents."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("good"))
    chosen = usable.orderBy(F.xxhash64("id"), "id", "good").limit(sample_docs)  # a bounded table
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.pieces(batch, "text"):
                lines = Lines(part.column("text"))
                first = np.searchsorted(lines.line_doc, np.arange(lines.n + 1))
                packed = [lines.features[a:b].astype(np.uint8).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("good"), pa.array(packed, pa.binary())], names=["id", "good", "lines"])

    # ids may repeat in docs, and labels in labels: one text for each chosen row
    known = texts.join(F.broadcast(chosen.distinct()), "id").groupBy("id", "good").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))
    rows = known.mapInArrow(work, "id long, good int, lines binary").collect()
    field = LineField()
    rows.sort(key=lambda r: (r["id"], r["good"], bytes(r["lines"])))
    if len({r["good"] > 0 for r in rows}) == 2:
        features = [np.frombuffer(r["lines"], np.uint8).reshape(-1, len(FEATURES)) for r in rows]
        size = [len(x) for x in features]
        good = np.repeat([r["good"] > 0 for r in rows], size)
        field.train(np.concatenate(features).astype(np.float32), np.repeat(np.arange(len(rows)), size), good)
    return field


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long, content_lines long"


def judge(texts: pa.Array, field: LineField, share: float) -> list[pa.Array]:
    """The columns of SCHEMA for each text."""
    lines = Lines(texts)
    content = field.viterbi(lines.features, lines.line_doc)
    count = np.bincount(lines.line_doc, minlength=lines.n)
    good_chars = np.bincount(lines.line_doc, weights=lines.line_chars * content, minlength=lines.n)
    part = good_chars / np.maximum(lines.word_chars, 1)
    failed = lines.base_failed
    whole = [lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words]
    return [
        *(pa.array(x, pa.int64()) for x in whole),
        pa.array(failed),
        pa.array(~failed & (part >= share)),
        pa.array(part, pa.float64()),
        pa.array(count, pa.int64()),
        pa.array(np.bincount(lines.line_doc[content], minlength=lines.n), pa.int64()),
    ]


def quality(docs: DataFrame, field: LineField, share: float = CONTENT_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the id and the columns of SCHEMA."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), *judge(part.column("text"), field, share)], names=[id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"`{id_col}` {kind}, {SCHEMA}")


def keep_good(docs: DataFrame, field: LineField, share: float = CONTENT_SHARE, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.pieces(batch, text_col):
                yield part.filter(judge(part.column(text_col), field, share)[6])

    return docs.mapInArrow(work, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality(docs, train(docs, read_table(spark, sf_dir, "labels")))
