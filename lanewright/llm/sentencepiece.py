"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is split into *marked words* (``▁+`` and what follows up to the next
``▁``), which no piece of the model crosses.  The distinct words of a batch
are sorted, which is a depth-first walk of their trie: the forward column of
a prefix is computed once and kept on a stack for all words that share it.
A column holds the last piece (and its score); the pieces of a word are read
off backwards from its last column, so memory grows with a word's length only.

The forward step depends on the model:

* unigram: the best-scoring piece that ends here (the usual Viterbi);
* BPE: merge order, not a sum of scores, defines the result, so a score
  maximum would be wrong.  Each prefix has exactly one piece that its BPE
  encoding ends with, and a piece may follow another iff encoding the two
  alone gives back the two.  The forward column then holds that piece.

Both give what the reference library gives for the model (tested).  Models
that normalise text (anything but the identity rules) are refused.

Nulls and empty texts encode to no pieces.  Control and undefined pieces
never match text.  Characters outside the vocabulary become byte pieces, or
the unknown piece if the model has none.  A literal ``▁`` decodes to a space,
as SentencePiece defines it; ``round_trip`` is false for such texts.  Rows
repeat as they come; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.llm import _text
from lanewright.llm._state import read_table

MARK = "▁"
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
UNIGRAM, BPE = 1, 2
#: Distinct words, their bytes, and pairs of pieces that a Python worker remembers between batches.
CACHE_WORDS, CACHE_BYTES, CACHE_PAIRS = 150_000, 16 << 20, 1_000_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of one protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 1:
            value, at = data[at : at + 8], at + 8
        elif key & 7 == 5:
            value, at = data[at : at + 4], at + 4
        else:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceModel:
    """Pieces, scores and kind of a serialised SentencePiece model."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, data: bytes):
        self.kind, self.dummy_prefix = UNIGRAM, True
        names, scores, kinds = [], [], []
        squeeze, rules = True, ""
        for number, value in _fields(data):
            if number == 1:
                got = dict(_fields(value))
                names.append(got.get(1, b"").decode())
                scores.append(float(np.frombuffer(got.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(got.get(3, self.NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                got = dict(_fields(value))
                rules = got.get(1, b"").decode()
                self.dummy_prefix, squeeze = bool(got.get(3, 1)), bool(got.get(4, 1))
        if rules != "identity" or squeeze or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models that leave text as it is")
        self.names, self.scores, self.kinds = names, scores, kinds
        self.ids = {p: i for i, p in enumerate(names) if kinds[i] == self.NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses a word's start")
        self.unknown = kinds.index(self.UNKNOWN)
        self.bytes = {int(names[i][1:-1], 16): i for i in range(len(names)) if kinds[i] == self.BYTE}
        self.longest = max(map(len, self.ids))
        self.floor = min(s for s, k in zip(scores, kinds, strict=True) if k == self.NORMAL) - 10.0
        lone = "".join(c for c in "\n\t\x0b\x0c" if not any(c in p for p in self.ids))
        self.lone = lone
        #: What each id stands for when decoded; control pieces for nothing.
        shown = []
        for i, p in enumerate(names):
            if kinds[i] == self.BYTE:
                shown.append(bytes([int(p[1:-1], 16)]))
            elif kinds[i] == self.CONTROL:
                shown.append(b"")
            elif kinds[i] == self.UNKNOWN:
                shown.append(" ⁇ ".encode())
            else:
                shown.append(p.replace(MARK, " ").encode())
        self.shown = shown
        self.size = [len(p) for p in names]
        self._follows: dict[int, bool] = {}
        self._halves: dict[str, tuple[str, str]] = {}
        self._left: dict[int, list] = {}
        self._right: dict[int, list] = {}
        usable = [p for p in self.ids if self.kind == UNIGRAM or self.merge(p) == [p]]
        self.match = ahocorasick.Automaton()
        for p in usable:
            self.match.add_word(p, (self.ids[p], len(p)))
        self.match.make_automaton()

    def fallback(self, char: str) -> tuple[int, ...]:
        if len(self.bytes) == 256:
            return tuple(self.bytes[b] for b in char.encode("utf-8", "surrogatepass"))
        return (self.unknown,)

    def merge(self, text: str) -> list[str]:
        """BPE by definition: join the best-scored neighbours, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = max(
                ((self.scores[self.ids[a + b]], -i) for i, (a, b) in enumerate(pairwise(parts)) if a + b in self.ids),
                default=None,
            )
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def spine(self, piece: int, side: int) -> list[tuple[str, float]]:
        """The symbols at one edge while the piece is merged, outermost first.

        side 0 is the left edge, 1 the right one.  With each symbol comes the
        score of the merge that uses it up (none for the piece itself).
        """
        out, text, death = [], self.names[piece], -np.inf
        while True:
            out.append((text, death))
            halves = self.halves(text)
            if halves is None:
                return out
            death, text = self.scores[self.ids[text]], halves[side]

    def halves(self, text: str) -> tuple[str, str] | None:
        """The two symbols whose merge made this one; None for a character."""
        if len(text) == 1:
            return None
        known = self._halves.get(text)
        if known is None:
            parts = list(text)
            while len(parts) > 2:
                best = max(
                    ((self.scores[self.ids[a + b]], -i) for i, (a, b) in enumerate(pairwise(parts)) if a + b in self.ids),
                )
                i = -best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            known = self._halves[text] = (parts[0], parts[1])
        return known

    def follows(self, left: int, right: int) -> bool:
        """Whether BPE keeps the border between these two pieces.

        Walk both edges back in time.  A merge across the border happens iff
        its score beats the merges that use up either edge symbol first; of
        equal scores the leftmost merge goes first.
        """
        key = left * 0x100000 + right
        known = self._follows.get(key)
        if known is None:
            known = True
            if left >= 0:
                for table, piece, side in ((self._right, left, 1), (self._left, right, 0)):
                    if piece not in table:
                        table[piece] = self.spine(piece, side)
                one, two = self._right[left], self._left[right]
                i = j = 0
                while True:
                    (a, dies_a), (b, dies_b) = one[i], two[j]
                    joined = self.ids.get(a + b)
                    if joined is not None and self.scores[joined] > dies_a and self.scores[joined] >= dies_b:
                        known = False
                        break
                    # the symbols that stood here before: undo the later of the two merges that made a and b
                    if i + 1 < len(one) and (j + 1 == len(two) or one[i + 1][1] <= two[j + 1][1]):
                        i += 1
                    elif j + 1 < len(two):
                        j += 1
                    else:
                        break
            if len(self._follows) >= CACHE_PAIRS:
                self._follows.clear()
            self._follows[key] = known
        return known


class SharedPrefixViterbi:
    """Encodes sorted words; a column is the last piece (-1: a fallback character) and its score."""

    def __init__(self, model: PieceModel):
        self.model = model

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        columns = self.best if self.model.kind == UNIGRAM else self.merged
        last: list[int] = [-1]
        score: list[float] = [0.0]
        before = ""
        for word in words:
            depth, most = 0, min(len(before), len(word))
            while depth < most and before[depth] == word[depth]:
                depth += 1
            del last[depth + 1 :], score[depth + 1 :]
            columns(word, depth, last, score)
            last.extend([-1] * (len(word) + 1 - len(last)))
            before = word
            yield self.pieces(word, last)

    def merged(self, word: str, depth: int, last: list[int], score: list[float]) -> None:
        """Appends the columns beyond depth of a BPE model, up to the last piece."""
        model = self.model
        follows, reached = model.follows, depth
        for at, (piece, size) in model.match.iter(word, max(0, depth - model.longest + 1)):  # by end, longest first
            end = at + 1
            if end > reached:
                left = end - size
                if follows(last[left] if left <= reached else -1, piece):
                    if end - reached > 1:
                        last.extend([-1] * (end - 1 - reached))
                    last.append(piece)
                    reached = end

    def best(self, word: str, depth: int, last: list[int], score: list[float]) -> None:
        """Appends the columns beyond depth of a unigram model."""
        model, reached = self.model, depth
        for at, (piece, size) in model.match.iter(word, max(0, depth - model.longest + 1)):
            end = at + 1
            if end <= depth:
                continue
            while reached < end - 1:
                reached += 1
                last.append(-1)
                score.append(score[-1] + model.floor)
            total = score[end - size] + model.scores[piece]
            if end > reached:
                reached = end
                alone = score[-1] + model.floor if word[at] not in model.ids else -np.inf
                last.append(piece if total > alone else -1)
                score.append(max(total, alone))
            elif total > score[end]:
                last[end], score[end] = piece, total
        while reached < len(word):
            reached += 1
            last.append(-1)
            score.append(score[-1] + model.floor)

    def pieces(self, word: str, last: list[int]) -> list[int]:
        """The ids of a word, read off its columns backwards."""
        out: list[int] = []
        end, size = len(word), self.model.size
        while end:
            piece = last[end]
            if piece < 0:
                out += reversed(self.model.fallback(word[end - 1]))
                end -= 1
            else:
                out.append(piece)
                end -= size[piece]
        out.reverse()
        return out


class Codec:
    """Text columns to ids and back, with a bounded memory of words."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.viterbi = SharedPrefixViterbi(model)
        self.lone_bytes = np.zeros(256, bool)
        self.lone_bytes[[ord(c) for c in model.lone]] = True
        self.forget()
        self.shown_bytes = np.frombuffer(b"".join(model.shown), np.uint8)
        self.shown_size = np.array([len(x) for x in model.shown], np.int64)
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size

    def forget(self) -> None:
        self.model._follows.clear()
        self.number: dict[bytes, int] = {}
        self.held = 0
        self.ids, self.size, self.at = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[bytes]) -> None:
        """Adds words, all distinct, that are not known yet."""
        found = list(self.viterbi.encode_sorted([w.replace(b" ", MARK.encode()).decode() for w in words]))
        base = len(self.number)
        self.held += sum(map(len, words))
        self.number.update(zip(words, range(base, base + len(words)), strict=True))
        size = np.array([len(x) for x in found], np.int64)
        flat = np.fromiter((i for x in found for i in x), np.int32, int(size.sum()))
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(size) - size])
        self.ids, self.size = np.concatenate([self.ids, flat]), np.concatenate([self.size, size])

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Rows of the word memory for these sorted, distinct words."""
        new = [w for w in words if w not in self.number]
        if len(self.number) + len(new) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.forget()
            new = words
        self.learn(new)
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of all texts."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        if self.model.dummy_prefix:
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
        raw, off = _text.flat(texts)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        space, lone = raw == 32, self.lone_bytes[raw]
        begins = lone.copy()
        begins[1:] |= lone[:-1] | (space[1:] & ~space[:-1])
        begins[off[:-1][off[:-1] < len(raw)]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(raw))
        words, number = _text.distinct(raw, start, end)
        number = self.numbers(words)[number]
        size = self.size[number]
        ids = self.ids[_text.take_spans(self.at[number], size)]
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, total[np.searchsorted(start, off)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts that the ids stand for."""
        size = self.shown_size[ids]
        out = self.shown_bytes[_text.take_spans(self.shown_at[ids], size)]
        at = np.concatenate([[0], np.cumsum(size)])[offsets]
        if self.model.dummy_prefix:  # one space in front of each text is not part of it
            first = at[:-1][(at[1:] > at[:-1])]
            first = first[out[first] == 32]
            out = np.delete(out, first)
            at = at - np.searchsorted(first, at, side="left")
        return out, at


_CODECS: dict[str, Codec] = {}


def _codec(data: bytes) -> Codec:
    """One codec for each model and Python worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(PieceModel(data))
    return _CODECS[key]


def model_bytes(path: str = MODEL_PATH) -> bytes:
    """A model's file, read by the driver; executors get its bytes."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_tokens, token_ids, decoded_sha256, round_trip.

    Every text is encoded and the ids are decoded again; decoded_sha256 is of
    the decoded text, round_trip says whether it equals the input.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            for part in _text.pieces(batch, "text"):
                ids, at = codec.encode(part.column("text"))
                raw, back = codec.decode(ids, at)
                was, off = _text.flat(part.column("text"))
                view, orig = raw.tobytes(), was.tobytes()
                plain = [view[a:b] for a, b in pairwise(back.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(np.diff(at), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())),
                        pa.array([hashlib.sha256(x).hexdigest() for x in plain]),
                        pa.array([x == orig[a:b] for x, (a, b) in zip(plain, pairwise(off.tolist()), strict=True)]),
                    ],
                    names=[id_col, "n_tokens", "token_ids", "decoded_sha256", "round_trip"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        work, f"`{id_col}` {kind}, n_tokens long, token_ids array<int>, decoded_sha256 string, round_trip boolean"
    )


def decode(tokens: DataFrame, model: bytes, ids_col: str = "token_ids", text_col: str = "text") -> DataFrame:
    """All columns of tokens, and the text of ids_col (null: null).  A column named as text_col is replaced."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            lists = batch.column("ids")
            rows = [x or [] for x in lists.to_pylist()]
            size = np.array([len(x) for x in rows], np.int64)
            ids = np.fromiter((i for x in rows for i in x), np.int64, int(size.sum()))
            raw, at = codec.decode(ids, np.concatenate([[0], np.cumsum(size)]))
            view = raw.tobytes()
            texts = [None if null else view[a:b].decode("utf-8", "replace") for null, (a, b) in zip(lists.is_null().to_pylist(), pairwise(at.tolist()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", text_col])

    rest = [c for c in tokens.columns if c != text_col]
    packed = tokens.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(ids_col).alias("ids"))
    schema = f"row {packed.schema['row'].dataType.simpleString()}, `{text_col}` string"
    return packed.mapInArrow(work, schema).select("row.*", f"`{text_col}`")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"), model_bytes())
