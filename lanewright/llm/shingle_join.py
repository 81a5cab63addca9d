"""Near-duplicate texts by an n-gram Jaccard join over a MinHash LSH forest.

A text's set is its distinct five-word shingles (words are runs of anything
but ASCII white space; a shorter text is one shingle of all its words, one
without words has none and no links).  Texts with one set form a class.

Each class has a key in every tree of the forest: the levels of a tree are
MinHash values, the first level in the highest bits, so keys sort as a prefix
trie does.  Matching starts at whole keys; prefixes are shortened level by
level until the forest meets ``TARGET`` of pairs.  That is measured twice, and
both must hold: on the links of a sample of documents (``AUDIT`` rows of
``AUDIT_BYTES`` at most; exact counts against all rows), and on planted pairs,
the sampled sets and others at just the threshold from them.

Classes that share a prefix of that length in a tree are a bucket.  A bucket
whose members share a prefix in an earlier tree too is dropped, as all its
pairs meet there.  In the others all pairs that meet there first are verified
exactly on the shingle sets (of 64-bit hashes), in blocks, so that no task ever
holds an unbounded bucket and links are counted where they are found, not
written out.

The result has a row for each row of the input: its class, the number of other
rows that it is linked to directly, the smallest id reachable by links, and the
recall measured on the sample's links (null if the sample has none).

Null and empty texts: a class of their own each, no links.  A null id ranks
after all others.  Rows with one text are one class, whatever their ids, and
count as linked.  Only id and text are read, so other names may clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.llm import _text
from lanewright.llm._graph import components, local_roots
from lanewright.llm._state import Scratch, read_table

WORDS, THRESHOLD, TARGET = 5, 0.8, 0.999
TREES = 16
#: Bits of a tree's levels, 64 together.
LEVELS = (12, 12, 12, 12, 8, 8)
#: Rows and bytes of text of the sample that recall is measured on, at most; planted pairs for each of its sets.
AUDIT, AUDIT_BYTES, PLANTED = 1_024, 16 << 20, 4
#: Members of one block; a task verifies the pairs of one or two blocks.
BLOCK = 512
_LAST = (1 << 63) - 1
_SEEDS = _text.mix(np.arange(1, TREES * len(LEVELS) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingles of each text."""
    raw, off = _text.flat(texts)
    start, end, doc = _text.word_bounds(raw, off)
    word = _text.span_hash(raw, start, end)
    value, first = _text.windows(word, doc, n)
    owner = doc[first]
    count = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        at = np.searchsorted(doc, short)
        with np.errstate(over="ignore"):
            extra = _text.mix(count[short].astype(np.uint64))
            for j in range(n - 1):
                there = count[short] > j
                extra[there] = _text.mix(extra[there] * np.uint64(0x9E3779B97F4A7C15) ^ word[at[there] + j])
        value, owner = np.concatenate([value, extra]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    if len(value):
        new = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))
        value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


def class_hash(value: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a set, the hash of each such set)."""
    some = np.flatnonzero(np.diff(off))
    if not len(some):
        return some, np.zeros(0, np.uint64)
    at = off[:-1][some]
    with np.errstate(over="ignore"):
        size = np.diff(off)[some].astype(np.uint64)
        return some, _text.mix(np.add.reduceat(_text.mix(value), at) ^ _text.mix(np.add.reduceat(value * value, at) + size))


def tree_keys(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The keys in all trees of the sets that start at these places."""
    keys = np.zeros((len(at), TREES), np.uint64)
    if len(at):
        with np.errstate(over="ignore"):
            for tree in range(TREES):
                for level, bits in enumerate(LEVELS):
                    seed = _SEEDS[tree * len(LEVELS) + level]
                    least = np.minimum.reduceat((value ^ (seed >> np.uint64(7))) * seed, at)
                    keys[:, tree] = keys[:, tree] << np.uint64(bits) | _text.mix(least) >> np.uint64(64 - bits)
    return keys


def shared_levels(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """For each pair of rows of keys the levels of the longest prefix that they share in a tree."""
    differ, out, used = one ^ two, np.zeros(len(one), np.int64), 0
    for bits in LEVELS:
        used += bits
        out += (differ >> np.uint64(64 - used) == 0).any(axis=1)
    return out


class Sample:
    """Shingle sets that links are counted for by brute force, and their keys."""

    def __init__(self, sets: list[np.ndarray], threshold: Fraction):
        self.threshold = threshold
        self.size = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        off = np.cumsum(self.size) - self.size
        self.keys = tree_keys(flat, off)
        _, self.cls = class_hash(flat, np.append(off, len(flat)))
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.size)[order]
        self.value, self.first = np.unique(flat[order], return_index=True)
        self.times = np.diff(np.append(self.first, len(flat)))

    def planted(self) -> np.ndarray:
        """The levels shared by planted pairs: each set and others that are just near enough."""
        rng, levels = np.random.default_rng(3), [np.zeros(0, np.int64)]
        sets = np.split(self.value[np.repeat(np.arange(len(self.value)), self.times)][np.argsort(self.owner, kind="stable")], np.cumsum(self.size)[:-1]) if len(self.size) else []
        share = (1 - self.threshold) / (1 + self.threshold)
        for x, keys in zip(sets, self.keys, strict=True):
            other = int(len(x) * share)
            if other:
                near = np.concatenate([np.concatenate([rng.permutation(x)[other:], rng.integers(0, 1 << 63, other).astype(np.uint64)]) for _ in range(PLANTED)])
                levels.append(shared_levels(np.repeat(keys[None, :], PLANTED, axis=0), tree_keys(near, np.arange(PLANTED) * len(x))))
        return np.concatenate(levels)

    def links(self, value: np.ndarray, off: np.ndarray, cls: np.ndarray, keys: np.ndarray) -> list[tuple[int, int, int]]:
        """(number in the sample, levels shared, links) over these sets, which are not empty."""
        size = np.diff(off)
        if not len(size) or not len(self.value):
            return []
        at = np.minimum(np.searchsorted(self.value, value), len(self.value) - 1)
        held = self.value[at] == value
        # a near set has at least that share of its shingles in the sample
        enough = np.add.reduceat(held, off[:-1]) * self.threshold.denominator >= size * self.threshold.numerator
        row = np.repeat(np.arange(len(size)), size)
        mine = held & enough[row]
        at, row, (some, row_of) = at[mine], row[mine], np.unique(row[mine], return_inverse=True)
        total: dict[tuple[int, int], int] = {}
        step = max(1, 4_000_000 // len(self.size))
        for k in range(0, len(some), step):
            here = (row_of >= k) & (row_of < k + step)
            times = self.times[at[here]]
            query = self.owner[_text.take_spans(self.first[at[here]], times)]
            count = min(step, len(some) - k)
            common = np.bincount(np.repeat(row_of[here] - k, times) * len(self.size) + query, minlength=count * len(self.size)).reshape(count, -1)
            union = size[some[k : k + count]][:, None] + self.size[None, :] - common
            near = (common * self.threshold.denominator >= union * self.threshold.numerator) & (cls[some[k : k + count]][:, None] != self.cls[None, :])
            r, q = np.nonzero(near)
            for i in range(0, len(r), 100_000):
                levels = shared_levels(keys[some[k + r[i : i + 100_000]]], self.keys[q[i : i + 100_000]])
                pair, n = np.unique(q[i : i + 100_000] * (len(LEVELS) + 1) + levels, return_counts=True)
                for x, m in zip(pair.tolist(), n.tolist(), strict=True):
                    total[divmod(x, len(LEVELS) + 1)] = total.get(divmod(x, len(LEVELS) + 1), 0) + m
        return [(*x, m) for x, m in total.items()]


def _sample(plain: DataFrame, n: int, threshold: Fraction) -> Sample:
    """The sets of a bounded sample of texts; equal ones once."""
    hashed = plain.select(F.xxhash64("id", "text").alias("h"), "text").where("text IS NOT NULL")
    sizes = hashed.select("h", F.octet_length("text").alias("size")).orderBy("h", "size").limit(AUDIT).collect()  # bounded
    total, chosen = 0, []
    for r in sizes:
        if total + r["size"] <= AUDIT_BYTES:
            total += r["size"]
            chosen.append((r["h"],))
    spark = plain.sparkSession
    texts = hashed.join(F.broadcast(spark.createDataFrame(sorted(set(chosen)), "h long")), "h", "left_semi").where(F.octet_length("text") <= AUDIT_BYTES)
    # rows with one hash are copies: one of each
    found = texts.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect()
    value, off = shingle_sets(pa.array([r["text"] for r in found], pa.string()), n)
    some, cls = class_hash(value, off)
    first = some[np.sort(np.unique(cls, return_index=True)[1])]
    return Sample([value[off[i] : off[i + 1]] for i in first], threshold)


def _classes(docs: DataFrame, n: int, sample: Sample) -> DataFrame:
    """(id, n, cls, trees, met) of each row; cls and trees are null without words.

    met holds the sample's links in some rows' texts: (number, levels, links).
    """
    held = docs.sparkSession.sparkContext.broadcast(sample)
    met_type = pa.list_(pa.struct([("q", pa.int32()), ("levels", pa.int32()), ("links", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.pieces(batch, "text"):
                value, off = shingle_sets(part.column("text"), n)
                some, cls = class_hash(value, off)
                keys = tree_keys(value, off[:-1][some])
                full = np.zeros(len(part), bool)
                full[some] = True
                place = np.cumsum(full) - 1
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * TREES, pa.int32()), pa.array(keys.view(np.int64).ravel()))
                pick = pa.array(place, pa.int64(), mask=~full)
                met = [{"q": q, "levels": levels, "links": m} for q, levels, m in held.value.links(value, np.append(off[:-1][some], len(value)), cls, keys)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(off), pa.int64()), pa.array(cls.view(np.int64)).take(pick), lists.take(pick), pa.array([met or None, *[None] * (len(part) - 1)], met_type)],
                    names=["id", "n", "cls", "trees", "met"],
                )

    return docs.mapInArrow(work, "id long, n long, cls long, trees array<long>, met array<struct<q:int,levels:int,links:long>>")


def _depth(rows: DataFrame, sample: Sample, target: float) -> tuple[int, float | None]:
    """The longest prefix, in levels, that meets the target, and its recall on the sample's links.

    The recall is a mean over documents of the share of links that are met; one
    with n links weighs 1/(n + 1), so a large group weighs as much as a pair.
    """
    planted = sample.planted()
    met = rows.where("met IS NOT NULL").select(F.explode("met").alias("m")).groupBy("m.q", "m.levels").agg(F.sum("m.links").alias("links")).collect()  # of the sample
    count = np.zeros((len(sample.size), len(LEVELS) + 1))
    for r in met:
        count[r["q"], r["levels"]] = r["links"]
    total = count.sum(axis=1)
    some = total > 0
    depth = len(LEVELS)
    while True:
        share, weight = count[some, depth:].sum(axis=1) / total[some], 1 / (total[some] + 1)
        recall = float((share * weight).sum() / weight.sum()) if some.any() else None
        if depth == 1 or ((recall is None or recall >= target) and (not len(planted) or (planted >= depth).mean() >= target)):
            return depth, recall
        depth -= 1


def linked(sets: list[np.ndarray], left: np.ndarray, within: bool, threshold: Fraction) -> np.ndarray:
    """The matrix of pairs at or over the threshold; left: rows of the first block."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    value = np.concatenate(sets)
    row = np.repeat(np.arange(m), size)
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    new = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    often = np.diff(np.append(new, len(value)))
    shared = np.repeat(often > 1, often)
    value, row = value[shared], row[shared]
    common = np.zeros((m, m), np.float32)
    if len(value):
        # shingles that the same rows hold are one column, weighted by their number
        start = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        salt = _text.mix(np.arange(1, m + 1, dtype=np.uint64))
        with np.errstate(over="ignore"):
            pattern = np.add.reduceat(salt[row], start)
            again = np.add.reduceat(_text.mix(salt)[row], start)
        both = np.stack([pattern, again], axis=1)
        _, which, weight = np.unique(both, axis=0, return_index=True, return_counts=True)
        stop = np.append(start[1:], len(row))
        step = max(1, 2_000_000 // m)
        for i in range(0, len(which), step):
            mine = which[i : i + step]
            held = np.zeros((m, len(mine)), np.float32)
            long = stop[mine] - start[mine]
            held[row[_text.take_spans(start[mine], long)], np.repeat(np.arange(len(mine)), long)] = 1
            common += (held * weight[i : i + step].astype(np.float32)) @ held.T
    inter = common.astype(np.int64)
    union = size[:, None] + size[None, :] - inter
    near = inter * threshold.denominator >= union * threshold.numerator
    np.fill_diagonal(near, False)
    if not within:
        near &= left[:, None] != left[None, :]
    return near


def shingle_join(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, target: float = TARGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, class_id, n_links, component_id, kept, class_key, recall."""
    return _joined(docs, n, threshold, target, id_col, text_col).drop("group_key")


def _joined(docs: DataFrame, n: int, threshold: float, target: float, id_col: str, text_col: str) -> DataFrame:
    """shingle_join, and group_key: one class of the row's component, the same for all its rows; null without words."""
    scratch = Scratch(docs.sparkSession, "shingles")
    exact = Fraction(str(threshold))
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.col(text_col).alias("text"))
    sample = _sample(plain, n, exact)
    rows = scratch.cut(_classes(plain, n, sample))
    depth, recall = _depth(rows, sample, target)
    classes = scratch.cut(
        rows.where("cls IS NOT NULL")
        .groupBy("cls")
        .agg(F.min(F.struct("id", "trees")).alias("x"), F.count("*").alias("mult"))
        .select("cls", F.col("x.id").alias("class_id"), F.transform("x.trees", lambda k: F.shiftrightunsigned(k, sum(LEVELS[depth:]))).alias("prefixes"), "mult")
    )

    # prefixes that two or more classes share
    keys = classes.select("cls", F.posexplode("prefixes").alias("tree", "prefix"))
    buckets = scratch.cut(keys.groupBy("tree", "prefix").agg(F.count("*").alias("size")).where("size > 1"))
    spots = scratch.cut(keys.join(buckets, ["tree", "prefix"]).join(classes.select("cls", "prefixes"), "cls"))
    # all members share a prefix in an earlier tree: all pairs of the bucket meet there
    same = [F.when(F.col("tree") > s, F.min(F.col("prefixes")[s]) == F.max(F.col("prefixes")[s])).otherwise(False) for s in range(TREES - 1)]
    first = scratch.cut(spots.groupBy("tree", "prefix").agg(F.first("size").alias("size"), reduce(Column.__or__, same).alias("again")).where("NOT again").select("tree", "prefix", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    members = scratch.cut(
        spots.drop("size", "prefixes").join(first, ["tree", "prefix"])
        .groupBy("cls").agg(F.collect_list(F.struct("tree", "prefix", "blocks")).alias("spots"))  # one for each tree at most
        .join(classes, "cls")
    )
    scratch.drop(spots, buckets)

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.pieces(batch, "text"):
                value, off = shingle_sets(part.column("text"), n)
                packed = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(value.view(np.int64)))
                names = ["cls", "mult", "prefixes", "spots"]
                some, cls = class_hash(value, off)
                own = np.zeros(len(part), bool)  # another row may have the id but not the text
                own[some] = cls.view(np.int64) == np.asarray(part.column("cls"))[some]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), packed], names=[*names, "shingles"]).filter(pa.array(own))

    # one strategy at every size: a broadcast of members would not hold at scale
    texts = plain.join(members.hint("shuffle_hash"), plain["id"] == members["class_id"]).select("cls", "mult", "prefixes", "spots", "text")
    held = texts.mapInArrow(with_sets, f"cls long, mult long, prefixes array<long>, spots {members.schema['spots'].dataType.simpleString()}, shingles array<long>")
    # blocks of a bucket: a member goes to every pair of blocks that its own is part of
    dealt = (
        held.withColumn("spot", F.explode("spots"))
        .withColumn("block", F.expr("cast(pmod(xxhash64(cls), spot.blocks) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, spot.blocks - 1)")))
        .select("spot.tree", "spot.prefix", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cls", "mult", "block", "prefixes", "shingles")
    )

    def verify(key: tuple, table: pa.Table) -> pa.Table:
        tree, _, i, j = (k.as_py() for k in key)
        cls, mult = np.asarray(table.column("cls")), np.asarray(table.column("mult"))
        _, only = np.unique(cls, return_index=True)  # rows of one id and class come twice
        packed = table.column("shingles").combine_chunks()
        off, value = np.asarray(packed.offsets), np.asarray(packed.values).view(np.uint64)
        sets = [value[off[k] : off[k + 1]] for k in only]
        prefixes = np.asarray(table.column("prefixes").combine_chunks().flatten()).reshape(-1, TREES)[only]
        cls, mult = cls[only], mult[only]
        near = linked(sets, np.asarray(table.column("block"))[only], i == j, exact)
        for s in range(tree):  # pairs that met before
            near &= prefixes[:, s, None] != prefixes[None, :, s]
        links, root = near @ mult, cls[local_roots(near)]
        some = near.any(axis=1)
        return pa.table({"cls": cls[some], "links": links[some], "least": root[some]}, schema=pa.schema([("cls", pa.int64()), ("links", pa.int64()), ("least", pa.int64())]))

    found = scratch.cut(dealt.groupBy("tree", "prefix", "i", "j").applyInArrow(verify, "cls long, links long, least long"))
    joined = components(found.select(F.col("cls").alias("a"), F.col("least").alias("b")), scratch)
    reach = scratch.cut(
        joined.join(classes.select(F.col("cls").alias("node"), "class_id"), "node").groupBy("root").agg(F.min("class_id").alias("component_id"))
    )
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    of_class = scratch.cut(
        classes.select("cls", "class_id", "mult")
        .join(joined.join(reach, "root").select(F.col("node").alias("cls"), "root", "component_id"), "cls", "left")
        .join(links, "cls", "left")
        .select("cls", "class_id", F.coalesce("root", "cls").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component_id", "class_id").alias("component_id"))
    )
    out = rows.select("id", "cls").join(of_class, "cls", "left")
    shown = lambda c: F.nullif(F.coalesce(c, F.col("id")), F.lit(_LAST))
    return out.select(
        F.nullif("id", F.lit(_LAST)).alias(id_col),
        shown(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        shown(F.col("component_id")).alias("component_id"),
        (F.col("id") == F.coalesce("component_id", "id")).alias("kept"),
        F.col("cls").alias("class_key"),
        F.lit(recall).cast("double").alias("recall"),
        F.col("root").alias("group_key"),
    )


def keep_one(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, target: float = TARGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near duplicates: of each group exactly one, that with the smallest id.

    A null id ranks after all others.  Of rows with that id the one with the
    smallest class stays, then that with the smallest digests of its text and
    of all its columns.  Rows without words are no group; of those that repeat
    id and text one stays.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    done = scratch.cut(_joined(docs, n, threshold, target, id_col, text_col).select(F.col(id_col).alias("_id"), F.col("class_key").alias("key"), "group_key"))
    first = done.where("group_key IS NOT NULL").groupBy("group_key").agg(F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "key")).alias("x"))
    wordless = done.where("group_key IS NULL").select("_id", "key").distinct()
    keep = scratch.cut(first.select("x._id", "x.key").union(wordless))  # an id and a class, once each
    counted = done.select("_id", F.lit(1).alias("r"), F.lit(0).alias("k")).union(keep.select("_id", F.lit(0), F.lit(1)))
    by_id = scratch.cut(counted.groupBy("_id").agg(F.sum("r").alias("_rows"), F.sum("k").alias("_kept")).where("_kept > 0"))

    def rows(which: str) -> DataFrame:
        chosen = by_id.where(which).hint("shuffle_hash")
        return docs.join(chosen, docs[id_col].eqNullSafe(chosen["_id"]), "left_semi")

    if by_id.where("_rows > 1").isEmpty():
        return rows("_rows = 1")

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.pieces(batch, "text"):
                some, cls = class_hash(*shingle_sets(part.column("text"), n))
                key, none = np.zeros(len(part), np.int64), np.ones(len(part), bool)
                key[some], none[some] = cls.view(np.int64), False
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), pa.array(key, mask=none)], names=["row", "text", "key"])

    # several rows share an id: its verdict goes by class, and one row of the class stays
    packed = rows("_rows > 1").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    keyed = packed.mapInArrow(with_key, f"row {packed.schema['row'].dataType.simpleString()}, text string, key long")
    chosen = keyed.join(keep, F.col(f"row.`{id_col}`").eqNullSafe(keep["_id"]) & keyed["key"].eqNullSafe(keep["key"]), "left_semi")
    rank = F.struct(F.sha2("text", 256), F.sha2(F.to_json("row"), 256))
    one = chosen.groupBy(F.col(f"row.`{id_col}`"), "key", F.when(F.col("key").isNull(), F.col("text"))).agg(F.min_by("row", rank).alias("row"))
    return rows("_rows = 1").union(one.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join(read_table(spark, sf_dir, "documents"))
