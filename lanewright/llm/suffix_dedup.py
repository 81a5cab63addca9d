"""Exact substring dedup by deep-shallow sorting of anchored suffixes.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts earlier
(smaller id, or earlier in the same text).  Sorting every suffix of a corpus
would shuffle it a hundred times over, so only suffixes at *anchors* are
sorted.  Each window of LENGTH bytes has one anchor: the rightmost of its
k-grams (``GRAM`` bytes) with the smallest hash.  Equal windows have their
anchor at the same place, so they can only meet in the group of that k-gram.

1. Texts that are copies as a whole go at once; only first copies are read on.
2. K-grams that are an anchor only once are dropped: their windows are unique.
3. The others' contexts (all windows of an anchor, 168 bytes at most) are
   united where they are equal, keeping the earliest.
4. In each group the suffixes from the anchor, and the prefixes before it read
   backwards, are sorted: multikey quicksort on words to a shallow depth, then
   blind tries for groups with a long common prefix.  The common prefix
   lengths give, for every offset of the anchor in a window, the classes of
   equal windows; all but the earliest of a class go.
   One task holds at most ``GROUP`` contexts of a group.  A larger group is
   split by longer strings first: the offsets that its windows have before the
   anchor are halved, and for each half a context goes on to the group of the
   bytes that all its windows of that half share, cut to those windows.  So a
   context makes two rows a level at most, equal ones are united again, and
   after seven levels at most every group is one window.
5. Windows that go are laid over the text.

Hashes only bring windows together; equality is decided on bytes (for whole
copies by SHA-256).

Null and empty texts have no bytes.  A null id ranks after all others.  Rows
with one id and one text are one document; rows with one id and several texts
are ranked by the text's digest.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.llm import _text
from lanewright.llm._state import Scratch, read_table

LENGTH, GRAM = 100, 32
#: Bytes that multikey quicksort looks at before blind tries take over.
SHALLOW = 48
#: Most different contexts of one string that one task sorts together.
GROUP = 4_000
#: Contexts sorted together.
BLOCK = 20_000
PIECE = 1_000_000
_LAST = (1 << 63) - 1
_SPAN = LENGTH - GRAM + 1  # k-grams of a window
_TABLE = _text.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)


def anchors(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k-gram at each byte, anchor of the window at each byte or -1)."""
    n = len(raw)
    if n < LENGTH:
        return np.zeros(n, np.uint64), np.full(n, -1, np.int64)
    with np.errstate(over="ignore"):
        gram, width, factor = _TABLE[raw], 1, 0xD6E8FEB86659FD93
        while width < GRAM:
            gram = gram[:-width] * np.uint64(factor) + gram[width:]
            width, factor = 2 * width, factor * factor & 0xFFFFFFFFFFFFFFFF
        gram = _text.mix(gram)
    # the smallest hash first, of equal ones the rightmost
    least = (gram & ~_LOW) | (_LOW - np.arange(len(gram), dtype=np.uint64))
    size = np.diff(off)
    ends = np.repeat(off[1:], size)
    here = np.arange(n)
    inside = here + GRAM <= ends
    window = here + LENGTH <= ends
    least[~inside[: len(least)]] = _NONE
    width = 1
    while 2 * width <= _SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = _SPAN - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    anchor = np.full(n, -1, np.int64)
    anchor[: len(least)] = (_LOW - (least & _LOW)).astype(np.int64)
    anchor[~window] = -1
    full = np.zeros(n, np.uint64)
    full[: len(gram)] = gram
    return full, anchor


def _runs(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of each anchor that windows have."""
    some = np.flatnonzero(anchor >= 0)
    if not len(some):
        return some, some, some
    value = anchor[some]
    first = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (some[1:] != some[:-1] + 1)))
    last = np.append(first[1:], len(some)) - 1
    return value[first], some[first], some[last]


class BlindTrie:
    """Orders strings by inserting each with one descent and one comparison.

    Inner nodes know only where their strings first differ and the bytes that
    follow; the descent skips what lies between, and comparing with the leaf
    that it ends at tells where the new string really branches off.
    """

    def __init__(self, strings: list[bytes], width: int):
        self.strings, self.width = strings, width
        self.number = [int.from_bytes(s, "big") for s in strings]
        #: A node is [depth, {byte: node or leaf}]; a leaf is a list of equal strings' numbers.
        self.root: list | None = None

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = [i]
            return
        string, path, node = self.strings[i], [], self.root
        while type(node[-1]) is dict:
            path.append(node)
            node = node[1].get(string[node[0]]) or next(iter(node[1].values()))
        differ = self.number[i] ^ self.number[node[0]]
        if not differ:
            node.append(i)
            return
        depth = self.width - (differ.bit_length() + 7) // 8
        at = len(path)
        while at and path[at - 1][0] > depth:
            at -= 1
        if at and path[at - 1][0] == depth:
            path[at - 1][1][string[depth]] = [i]
            return
        below = path[at] if at < len(path) else node
        mine = [depth, {self.strings[node[0]][depth]: below, string[depth]: [i]}]
        if at:
            parent = path[at - 1]
            parent[1][string[parent[0]]] = mine
        else:
            self.root = mine

    def ordered(self) -> Iterator[tuple[int, int]]:
        """(string, bytes that it shares with the one before) in order."""
        shared, stack = 0, [(0, self.root)]
        while stack:
            depth, node = stack.pop()
            if type(node[-1]) is dict:
                children = sorted(node[1].items(), reverse=True)
                stack += [(node[0], child) for _, child in children[:-1]]
                stack.append((depth, children[-1][1]))
            else:
                shared = depth
                for i in node:
                    yield i, shared
                    shared = self.width


def deep_shallow(matrix: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix with the one before) of rows, by group and then bytes.

    The first of each group has -1.  Rows are of one width; ties stay in order.
    """
    m, width = matrix.shape
    order = np.argsort(group, kind="stable")
    shared = np.full(m, width, np.int64)
    edge = group[order][1:] != group[order][:-1]
    shared[0] = -1
    shared[1:][edge] = -1
    words = np.zeros((m, (width + 7) // 8 * 8), np.uint8)
    words[:, :width] = matrix
    words = words.view(">u8").astype(np.uint64)
    for depth in range(0, min(SHALLOW, width), 8):  # multikey quicksort, eight bytes as one character
        bucket = np.cumsum(shared < depth)
        size = np.bincount(bucket)
        many = size[bucket] > 1
        if not many.any():
            break
        place = np.flatnonzero(many)
        key = words[order[place], depth // 8]
        by = np.lexsort((key, bucket[place]))
        order[place] = order[place][by]
        key, home = key[by], bucket[place]
        differ = key[1:] ^ key[:-1]
        split = np.flatnonzero((differ != 0) & (home[1:] == home[:-1]))
        zeros = (7 - np.floor(np.log2(np.maximum(differ[split], 1).astype(np.longdouble))).astype(np.int64) // 8)
        shared[place[split + 1]] = np.minimum(depth + zeros, width)
    reached = min((min(SHALLOW, width) + 7) // 8 * 8, width)
    start = np.flatnonzero(shared < reached)
    stop = np.append(start[1:], m)
    for a, b in zip(start[stop - start > 1].tolist(), stop[stop - start > 1].tolist(), strict=True):
        rows = order[a:b]
        trie = BlindTrie([r.tobytes() for r in matrix[rows]], width)
        for i in range(b - a):
            trie.insert(i)
        got = list(trie.ordered())
        order[a:b] = rows[[i for i, _ in got]]
        shared[a + 1 : b] = [s for _, s in got[1:]]
    return order, shared


def earliest(contexts: list[bytes], before: np.ndarray, group: np.ndarray) -> np.ndarray:
    """keep[x, d]: whether x's window with d bytes before the anchor is the first of its kind.

    Contexts come in order of rank; before is the anchor's place in each.  The
    windows of a context are those that it holds whole.
    """
    m = len(contexts)
    size = np.array([len(c) for c in contexts], np.int64)
    right, left = np.zeros((m, LENGTH), np.uint8), np.zeros((m, _SPAN), np.uint8)
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    at = np.cumsum(size) - size
    after = size - before
    rows = np.repeat(np.arange(m), after)
    column = _text.take_spans(np.zeros(m, np.int64), after)
    right[rows, column] = flat[_text.take_spans(at + before, after)]
    rows = np.repeat(np.arange(m), before)
    column = _text.take_spans(np.zeros(m, np.int64), before)
    left[rows, column] = flat[(at + before - 1)[rows] - column]
    order_r, shared_r = deep_shallow(right, group)
    order_l, shared_l = deep_shallow(left, group)
    keep = np.zeros((m, _SPAN), bool)
    class_r, class_l = np.empty(m, np.int64), np.empty(m, np.int64)
    for d in range(_SPAN):
        mine = np.flatnonzero((before >= d) & (after >= LENGTH - d))
        if len(mine):
            class_r[order_r] = np.cumsum(shared_r < LENGTH - d)
            class_l[order_l] = np.cumsum(shared_l < d) if d else np.cumsum(shared_l < 0)
            _, first = np.unique(class_r[mine] * (m + 1) + class_l[mine], return_index=True)
            keep[mine[first], d] = True
    return keep


def split(over: DataFrame) -> DataFrame:
    """The contexts of over-full groups, dealt to the groups of longer strings.

    A row judges its windows with lo to hi bytes before the anchor.  All those
    share the string from lo bytes before the anchor to LENGTH - hi behind it.
    """
    halves = F.array(F.struct(F.col("lo").alias("lo"), F.expr("(lo + hi) div 2").alias("hi")), F.struct(F.expr("(lo + hi) div 2 + 1").alias("lo"), F.col("hi").alias("hi")))
    half = over.withColumn("half", F.explode(halves)).withColumns({"lo": F.col("half.lo"), "hi": F.col("half.hi"), "size": F.octet_length("context")})
    mine = half.where(f"greatest(lo, {LENGTH} - (size - before)) <= least(hi, before)")
    core = F.expr(f"substring(context, cast(before - lo + 1 as int), cast({LENGTH} - (hi - lo) as int))")
    start, stop = F.expr("greatest(0, before - hi)"), F.expr(f"least(size, before + {LENGTH} - lo)")
    cut = mine.withColumns({"gram": F.xxhash64("gram", "lo", core), "start": start, "stop": stop}).withColumns(
        {"context": F.expr("substring(context, cast(start + 1 as int), cast(stop - start as int))"), "before": F.col("before") - F.col("start")}
    )
    return _united(cut)


def _united(found: DataFrame) -> DataFrame:
    """Equal contexts of one group as one, the earliest."""
    least = found.groupBy("gram", "lo", "hi", "context", "before").agg(F.min(F.struct("id", "sha", "at")).alias("x"))
    return least.select("gram", "lo", "hi", "context", "before", "x.id", "x.sha", "x.at")


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part in _text.pieces(batch, "text", PIECE):
        yield (part, *_text.flat(part.column("text")))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    spans are the removed byte ranges (start, end) of the original text; cuts
    may fall inside a character.  ``without`` takes them out of the texts.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    keyed = plain.withColumn("digest", F.sha2("text", 256)).withColumn("sha", F.xxhash64("digest"))
    rows = scratch.cut(keyed.select("id", "sha", "digest", F.octet_length("text").cast("long").alias("n_bytes")))
    first = rows.groupBy("digest").agg(F.min("id").alias("first_id"), F.min("n_bytes").alias("n_bytes"))
    first = scratch.cut(first.where(F.col("n_bytes") >= LENGTH).select(F.col("first_id").alias("id"), F.xxhash64("digest").alias("sha")))
    texts = scratch.cut(keyed.join(first, ["id", "sha"], "left_semi").dropDuplicates(["id", "sha"]).select("id", "sha", "text"))
    scratch.release()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in _texts(batch):
                gram, anchor = anchors(raw, off)
                at, _, _ = _runs(anchor)
                doc = np.searchsorted(off, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram[at].view(np.int64)),
                        part.column("id").take(pa.array(doc)),
                        part.column("sha").take(pa.array(doc)),
                        pa.array(at - off[doc], pa.int64()),
                    ],
                    names=["gram", "id", "sha", "at"],
                )

    marks = scratch.cut(texts.mapInArrow(find, "gram long, id long, sha long, at long"))
    # written, so that the join deals both sides anew and a hot k-gram's rows can be split
    often = scratch.cut(marks.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    chosen = scratch.cut(marks.join(often, "gram").groupBy("id", "sha").agg(F.collect_list("at").alias("at")))
    scratch.drop(marks, often)
    scratch.release()
    within = scratch.cut(texts.join(chosen, ["id", "sha"]))
    scratch.drop(texts, chosen)
    scratch.release()

    def open_(part: pa.RecordBatch, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """(k-gram hashes, anchor, first window, last window) of the repeated anchors."""
        gram, anchor = anchors(raw, off)
        at, low, high = _runs(anchor)
        chosen = np.zeros(len(raw) + 1, bool)
        lists = part.column("at")
        size = np.asarray(lists.value_lengths(), dtype=np.int64)
        chosen[np.asarray(lists.flatten()) + np.repeat(off[:-1], size)] = True
        mine = chosen[at]
        return gram, at[mine], low[mine], high[mine]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in _texts(batch):
                gram, at, low, high = open_(part, raw, off)
                doc = np.searchsorted(off, at, side="right") - 1
                view = raw.tobytes()
                cut = [view[a:b] for a, b in zip(low.tolist(), (high + LENGTH).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram[at].view(np.int64)), pa.array(cut, pa.binary()), pa.array(at - low, pa.int64()),
                        part.column("id").take(pa.array(doc)), part.column("sha").take(pa.array(doc)), pa.array(at - off[doc], pa.int64()),
                    ],
                    names=["gram", "context", "before", "id", "sha", "at"],
                )

    found = within.mapInArrow(contexts, "gram long, context binary, before long, id long, sha long, at long")
    whole_range = {"lo": F.lit(0).cast("long"), "hi": F.lit(_SPAN - 1).cast("long")}
    groups = scratch.cut(_united(found.withColumns(whole_range)))
    scratch.release()
    ready: list[DataFrame] = []
    while True:  # seven times at most
        full = scratch.cut(groups.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("gram"))
        if full.isEmpty():
            ready.append(groups)
            break
        ready.append(groups.join(full, "gram", "left_anti"))
        groups = scratch.cut(split(groups.join(full, "gram", "left_semi")))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            table = pa.Table.from_batches(held).combine_chunks()
            gram = np.asarray(table.column("gram"))
            whole = len(gram) if last else int(np.searchsorted(gram, gram[-1]))  # the last group may go on
            if whole:
                yield from _kept(table.slice(0, whole))
            held = table.slice(whole).to_batches()
            count = len(gram) - whole

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
                if count >= BLOCK:
                    yield from done(False)
        if held:
            yield from done(True)

    spans = "id long, sha long, low long, high long"
    kept = scratch.cut(reduce(DataFrame.union, ready).repartition("gram").sortWithinPartitions("gram", "id", "sha", "at").mapInArrow(sort, spans))
    scratch.drop(groups)
    stay = kept.groupBy("id", "sha").agg(F.collect_list(F.struct("low", "high")).alias("stay"))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in _texts(batch):
                _, _, low, high = open_(part, raw, off)
                level = np.zeros(len(raw) + 1, np.int64)
                np.add.at(level, low, 1)
                np.add.at(level, high + 1, -1)
                lists = part.column("stay")
                size = np.asarray(pa.compute.fill_null(lists.value_lengths(), 0), dtype=np.int64)
                values = lists.flatten()
                if len(values):
                    base = np.repeat(off[:-1], size)
                    np.add.at(level, np.asarray(values.field("low")) + base, -1)
                    np.add.at(level, np.asarray(values.field("high")) + 1 + base, 1)
                gone = np.flatnonzero(np.cumsum(level[:-1]) > 0)
                cover = np.zeros(len(raw) + 1, np.int64)
                np.add.at(cover, gone, 1)
                np.add.at(cover, gone + LENGTH, -1)
                removed = np.cumsum(cover[:-1]) > 0
                first = np.zeros(len(raw), bool)
                first[off[:-1][off[:-1] < len(raw)]] = True
                opens = removed & (np.append(True, ~removed[:-1]) | first) if len(raw) else removed
                shuts = removed & (np.append(~removed[1:], True) | np.append(first[1:], True)) if len(raw) else removed
                start, stop = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
                n_removed = np.diff(np.concatenate([[0], np.cumsum(removed)])[off])
                at = np.searchsorted(start, off)
                doc = np.searchsorted(off, start, side="right") - 1
                pairs = pa.StructArray.from_arrays([pa.array(start - off[doc], pa.int64()), pa.array(stop - off[doc], pa.int64())], names=["start", "end"])
                left = np.concatenate([[0], np.cumsum(~removed)])[off]
                rest = raw[~removed].tobytes()
                pieces = [rest[a:b] for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), part.column("sha"), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in pieces]),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pairs),
                    ],
                    names=["id", "sha", "n_removed", "kept_sha256", "spans"],
                )

    schema = "id long, sha long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    cut = within.join(stay, ["id", "sha"], "left").mapInArrow(lay, schema)
    # the rest: first copies that nothing is cut from, short texts and later copies
    out = rows.join(first.withColumn("first", F.lit(True)), ["id", "sha"], "left").join(cut, ["id", "sha"], "left")
    whole = (F.col("n_bytes") >= LENGTH) & F.col("first").isNull()
    all_bytes = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)")
    return out.withColumn("spans", F.when(whole, all_bytes).otherwise(F.coalesce("spans", none))).select(
        F.nullif("id", F.lit(_LAST)).alias(id_col),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
        "spans",
    )


def _kept(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The ranges of window starts that stay, for contexts sorted by k-gram and rank."""
    gram = np.asarray(table.column("gram"))
    group = np.cumsum(np.append(True, gram[1:] != gram[:-1]))
    before = np.asarray(table.column("before"))
    keep = earliest(table.column("context").to_pylist(), before, group)
    at = np.asarray(table.column("at"))
    edge = np.diff(np.pad(keep, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    pick = pa.array(row)
    yield pa.RecordBatch.from_arrays(
        [
            table.column("id").combine_chunks().take(pick), table.column("sha").combine_chunks().take(pick),
            pa.array(at[row] - (high - 1), pa.int64()), pa.array(at[row] - low, pa.int64()),
        ],
        names=["id", "sha", "low", "high"],
    )


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text's bytes without these ranges."""
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return b"".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
