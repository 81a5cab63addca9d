"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with
A-Z lower-cased; keys under ``MIN_CHARS`` code points are left alone.  A key
that two or more documents hold stays only in the document with the smallest
id.

``LineIndex`` keeps, below one path:

* ``refs``: an append-only log of (digest, id, delta).  The pairs whose deltas
  sum to one or more are exactly the documents that hold a key now.
* ``filters``: for each shard of the digests a cuckoo filter with min(reference
  count, 2) copies of each fingerprint.  A lookup that finds fewer than two
  copies proves that a key is not repeated, and one that finds none proves that
  it is new, so the exact table is only read for the rest.  There is one shard
  for every ``KEYS`` keys; when the filters are filled up they are built anew
  from the exact counts, with more shards.  Keys and filters meet by a shuffle
  on the shard, at every size.

Inserting adds pairs and copies, deleting documents takes them away again, so
any sequence of both leaves what a fresh index of the live documents holds.  A
shard has one filter, and keys that share a fingerprint and a pair of buckets
are one to it, so taking away a key's copy never takes another's.

Null and empty texts are one empty line.  A null id ranks after every other.
Rows that share an id count as one document for references and are each
resolved.  Other columns, whatever their names, are passed on untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.llm import _text
from lanewright.llm._state import Scratch, read_table

MIN_CHARS = 10
#: Keys of a shard, and the least shards.
KEYS, SHARDS = 250_000, 8
_SPACE = b" \t\n\x0b\x0c\r"
_LAST = (1 << 63) - 1


def line_key(line: bytes) -> bytes | None:
    """A line's key; None if it is too short to count."""
    key = line.strip(_SPACE).lower()
    if len(key) < 4 * MIN_CHARS and (len(key) < MIN_CHARS or len(key.decode("utf-8", "replace")) < MIN_CHARS):
        return None
    return key


def digest(key: bytes) -> bytes:
    return hashlib.md5(key, usedforsecurity=False).digest()


def shard_of(shards: int, name: str = "digest"):
    return (F.conv(F.hex(F.substring(name, 1, 4)), 16, 10).cast("long") % shards).cast("int")


class CuckooFilter:
    """16-bit fingerprints, four to a bucket, two buckets for each key; whole batches at once.

    The few fingerprints that find no place are kept, with their buckets, in a
    sorted stash.
    """

    SLOTS, ROUNDS, LOAD = 4, 200, 0.8

    def __init__(self, buckets: int, cells: np.ndarray | None = None, stash: np.ndarray | None = None):
        self.buckets = buckets
        self.cells = np.zeros((buckets, self.SLOTS), np.uint16) if cells is None else cells
        self.stash = np.zeros(0, np.int64) if stash is None else stash

    @classmethod
    def for_copies(cls, n: int) -> CuckooFilter:
        return cls(1 << max(2, int(np.ceil(np.log2(n / cls.LOAD / cls.SLOTS + 1)))))

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        buckets, stash = (int(x) for x in np.frombuffer(data, np.int64, 2))
        cells = np.frombuffer(data, np.uint16, buckets * cls.SLOTS, 16).copy().reshape(-1, cls.SLOTS)
        return cls(buckets, cells, np.frombuffer(data, np.int64, stash, 16 + cells.nbytes))

    def dump(self) -> bytes:
        return np.array([self.buckets, len(self.stash)], np.int64).tobytes() + self.cells.tobytes() + self.stash.tobytes()

    def used(self) -> int:
        return int(np.count_nonzero(self.cells)) + len(self.stash)

    def split(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, bucket) from the last ten bytes of 16-byte digests."""
        raw = digests.reshape(-1, 16)
        mark = raw[:, 6:8].copy().view(np.uint16).ravel()
        place = raw[:, 8:16].copy().view(np.uint64).ravel()
        return np.where(mark == 0, np.uint16(1), mark), (place & np.uint64(self.buckets - 1)).astype(np.int64)

    def other(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ ((mark.astype(np.int64) * 0x5BD1E995 >> 3) & (self.buckets - 1))

    def code(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Fingerprint and pair of buckets as one number."""
        return np.minimum(bucket, self.other(mark, bucket)) << 16 | mark

    def copies(self, digests: np.ndarray) -> np.ndarray:
        mark, one = self.split(digests)
        two, code = self.other(mark, one), self.code(mark, one)
        found = (self.cells[one] == mark[:, None]).sum(1)
        found += np.where(one == two, 0, (self.cells[two] == mark[:, None]).sum(1))
        return found + np.searchsorted(self.stash, code, side="right") - np.searchsorted(self.stash, code)

    def change(self, digests: np.ndarray, by: np.ndarray) -> None:
        """Adds (or, below zero, removes) so many copies of each digest."""
        mark, bucket = self.split(digests)
        for sign, act in ((-1, self._remove), (1, self._add)):
            times = np.maximum(by * sign, 0)
            act(np.repeat(mark, times), np.repeat(bucket, times))

    def _fill(self, mark: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts fingerprints into free slots of their buckets; returns the others."""
        order = np.argsort(bucket, kind="stable")
        mark, bucket = mark[order], bucket[order]
        start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        rank = np.arange(len(bucket)) - np.repeat(start, np.diff(np.append(start, len(bucket))))
        free = self.cells[bucket] == 0
        fits = rank < free.sum(1)
        slot = (free & (np.cumsum(free, axis=1) == rank[:, None] + 1)).argmax(1)
        self.cells[bucket[fits], slot[fits]] = mark[fits]
        return mark[~fits], bucket[~fits]

    def _add(self, mark: np.ndarray, bucket: np.ndarray) -> None:
        rng = np.random.default_rng(len(mark))
        for _ in range(self.ROUNDS):
            for _ in range(2):
                if len(mark):
                    mark, bucket = self._fill(mark, bucket)
                    bucket = self.other(mark, bucket)
            if not len(mark):
                return
            # both buckets are full: one newcomer of each takes an older one's place, which moves on
            _, first = np.unique(bucket, return_index=True)
            slot = rng.integers(0, self.SLOTS, len(first))
            old = self.cells[bucket[first], slot]
            self.cells[bucket[first], slot] = mark[first]
            mark[first], bucket[first] = old, self.other(old, bucket[first])
        self.stash = np.sort(np.concatenate([self.stash, self.code(mark, bucket)]))

    def _remove(self, mark: np.ndarray, bucket: np.ndarray) -> None:
        codes, times = np.unique(self.code(mark, bucket), return_counts=True)
        while len(codes):  # one copy of each a round; two codes never share a slot
            mark, one = (codes & 0xFFFF).astype(np.uint16), codes >> 16
            took = np.zeros(len(codes), bool)
            for at in (one, self.other(mark, one)):
                hit = self.cells[at] == mark[:, None]
                mine = hit.any(1) & ~took
                self.cells[at[mine], hit[mine].argmax(1)] = 0
                took |= mine
            rest = codes[~took]
            at = np.searchsorted(self.stash, rest)
            if len(rest) and (at >= len(self.stash)).any() or (self.stash[at] != rest).any():
                raise ValueError("removing a key that the filter doesn't hold")
            self.stash = np.delete(self.stash, at)
            codes, times = codes[times > 1], times[times > 1] - 1


def _binary(column) -> np.ndarray:
    """A column of 16-byte values as one byte array."""
    return _text.flat(column)[0]


def keyed_lines(docs: DataFrame) -> DataFrame:
    """(digest, id) once for each document row and key; docs has id and text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.pieces(batch, "text"):
                out, ids = [], []
                for i, text in zip(part.column("id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    keys = {k for k in map(line_key, (text or b"").split(b"\n")) if k is not None}
                    out += map(digest, keys)
                    ids += [i] * len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(ids, pa.int64())], names=["digest", "id"])

    return docs.mapInArrow(work, "digest binary, id long")


class LineIndex:
    """The index; each change writes new files and swaps them in at its end."""

    def __init__(self, spark: SparkSession, keys: int = KEYS):
        self.spark, self.keys = spark, keys
        self.scratch = Scratch(spark, "lines")
        self.refs: DataFrame | None = None
        self.filters: DataFrame | None = None
        self.shards = self.room = self.used = 0
        self.mixed = False  # whether the log has more than one insertion's pairs

    @staticmethod
    def plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.col(text_col).alias("text"))

    def live(self) -> DataFrame:
        """The exact pairs (digest, id) that are held now."""
        if not self.mixed:
            return self.refs.select("digest", "id")
        return self.refs.groupBy("digest", "id").agg(F.sum("delta").alias("n")).where("n > 0").select("digest", "id")

    def counts(self, within: DataFrame | None = None) -> DataFrame:
        """(digest, n_docs, first_id): the exact reference counts."""
        pairs = self.live()
        if within is not None:
            pairs = pairs.join(within.select("digest"), "digest", "left_semi")
        return pairs.groupBy("digest").agg(F.count("*").alias("n_docs"), F.min("id").alias("first_id"))

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Adds all lines of docs; pairs that are there already stay once."""
        pairs = keyed_lines(self.plain(docs, id_col, text_col)).dropDuplicates(["digest", "id"])
        if self.refs is None:
            self.refs = self.scratch.cut(pairs.withColumn("delta", F.lit(1)))
            self._rebuild()
            return
        pairs = self.scratch.cut(pairs.join(self.live(), ["digest", "id"], "left_anti"))
        fresh = pairs.groupBy("digest").agg(F.count("*").alias("n"))
        held = self.counts(self._lookup(fresh).where("copies > 0"))
        now, new = F.coalesce("n_docs", F.lit(0)), F.col("n")
        change = self.scratch.cut(fresh.join(held, "digest", "left").select("digest", (F.least(now + new, F.lit(2)) - F.least(now, F.lit(2))).cast("int").alias("by")).where("by <> 0"))
        self.refs, self.mixed = self.refs.unionByName(pairs.withColumn("delta", F.lit(1))), True
        self._apply(change)
        self.scratch.drop(change)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Takes all lines of these documents out again."""
        gone = ids.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id")).distinct()
        pairs = self.scratch.cut(self.live().join(gone, "id", "left_semi"))
        fewer = pairs.groupBy("digest").agg(F.count("*").alias("n"))
        left = F.col("n_docs") - F.col("n")
        change = self.scratch.cut(fewer.join(self.counts(fewer), "digest").select("digest", (F.least(left, F.lit(2)) - F.least("n_docs", F.lit(2))).cast("int").alias("by")).where("by <> 0"))
        self.refs, self.mixed = self.refs.unionByName(pairs.withColumn("delta", F.lit(-1))), True
        self._apply(change)
        self.scratch.drop(change)

    def _stored(self) -> DataFrame:
        return self.filters if self.filters is not None else self.spark.createDataFrame([], "shard int, filter binary, room long, used long")

    def _lookup(self, keys: DataFrame) -> DataFrame:
        """(digest, copies) of these distinct digests."""

        def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            stored = right.column("filter").to_pylist()
            cuckoo = CuckooFilter.load(stored[0]) if stored else CuckooFilter(1)
            return pa.table({"digest": left.column("digest"), "copies": pa.array(cuckoo.copies(_binary(left.column("digest"))), pa.int64())})

        left = keys.select(shard_of(self.shards).alias("shard"), "digest")
        return left.groupBy("shard").cogroup(self._stored().groupBy("shard")).applyInArrow(work, "digest binary, copies long")

    def _rebuild(self) -> None:
        """Filters from the exact counts, with room for as many copies again."""
        old = self.filters
        counted = self.scratch.cut(self.counts().select("digest", F.least("n_docs", F.lit(2)).cast("int").alias("by")))
        self.filters, self.shards = None, max(SHARDS, -(-counted.count() // self.keys))
        self._update(counted)
        self.scratch.drop(counted, *([old] if old is not None else []))

    def _apply(self, change: DataFrame) -> None:
        """Updates the filters by (digest, by); if they'd be too full, they are built anew."""
        new = change.agg(F.coalesce(F.sum(F.greatest("by", F.lit(0))), F.lit(0))).first()[0]
        if self.used + new > CuckooFilter.LOAD * self.room:
            self._rebuild()
        else:
            old = self.filters
            self._update(change)
            self.scratch.drop(old)

    def _update(self, change: DataFrame) -> None:
        def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            stored, by = right.column("filter").to_pylist(), np.asarray(left.column("by"), dtype=np.int64)
            cuckoo = CuckooFilter.load(stored[0]) if stored else CuckooFilter.for_copies(2 * int(np.maximum(by, 0).sum()))
            cuckoo.change(_binary(left.column("digest")), by)
            held = {"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([cuckoo.dump()], pa.binary())}
            return pa.table({**held, "room": pa.array([cuckoo.cells.size], pa.int64()), "used": pa.array([cuckoo.used()], pa.int64())})

        left = change.select(shard_of(self.shards).alias("shard"), "digest", "by")
        self.filters = self.scratch.cut(left.groupBy("shard").cogroup(self._stored().groupBy("shard")).applyInArrow(work, "shard int, filter binary, room long, used long"))
        self.room, self.used = (x or 0 for x in self.filters.agg(F.sum("room"), F.sum("used")).first())

    def drops(self, lines: DataFrame) -> DataFrame:
        """(id, digests): the keys whose lines go from each document, given (digest, id) of all keyed lines."""
        maybe = self._lookup(lines.select("digest").distinct()).where("copies > 1")
        # written first, so that the join deals both sides anew and a hot key's rows can be split
        first = self.scratch.cut(self.counts(maybe).where("n_docs > 1").select("digest", "first_id"))
        return lines.join(first, "digest").where("id > first_id").groupBy("id").agg(F.collect_set("digest").alias("digests"))

    def resolve(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: DataFrame | None = None) -> DataFrame:
        """All columns of docs with the text that stays, and n_lines, n_dropped, kept_sha256.

        Columns of docs with these three names are replaced.  lines are the
        pairs (digest, id) of docs, if they are at hand.
        """
        extra = ["n_lines", "n_dropped", "kept_sha256"]
        drops = self.drops(self.scratch.cut(keyed_lines(self.plain(docs, id_col, text_col))) if lines is None else lines)
        rest = [c for c in docs.columns if c not in (*extra, text_col)]
        packed = docs.select(
            F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(text_col).alias("text")
        )

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _text.pieces(batch, "text"):
                    texts, total, dropped, sha = [], [], [], []
                    for text, gone in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("digests").to_pylist(), strict=True):
                        lines = (text or b"").split(b"\n")
                        total.append(len(lines))
                        if gone:
                            gone = set(gone)
                            lines = [x for x in lines if (k := line_key(x)) is None or digest(k) not in gone]
                        dropped.append(total[-1] - len(lines))
                        kept = b"\n".join(lines)
                        texts.append(kept)
                        sha.append(hashlib.sha256(kept).hexdigest())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("row"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha)],
                        names=["row", "text", *extra],
                    )

        schema = f"row {packed.schema['row'].dataType.simpleString()}, text string, n_lines long, n_dropped long, kept_sha256 string"
        done = packed.join(drops, "id", "left").select("row", "text", "digests").mapInArrow(work, schema)
        back = {text_col: F.col("text"), **{c: F.col(f"row.`{c}`") for c in rest}}
        return done.select(*[back[c].alias(c) for c in docs.columns if c in back], *extra)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """LineIndex.resolve of docs against an index of docs alone."""
    index = LineIndex(docs.sparkSession)
    index.insert(docs, id_col, text_col)
    return index.resolve(docs, id_col, text_col, index.live())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


SQL = r"""
WITH lines AS (
    SELECT doc_id, CAST(i AS BIGINT) AS i, parts[i] AS line FROM (
        SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
    ), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)
), keyed AS (
    SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
    SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE r.key IS NOT NULL AND k.doc_id > r.first_id) AS n_dropped,
    sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE r.key IS NULL OR k.doc_id = r.first_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN repeated r ON k.key = r.key GROUP BY k.doc_id
"""
