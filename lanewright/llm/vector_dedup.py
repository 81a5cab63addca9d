"""Near-duplicate vectors over a robust-pruned flat graph.

Equal vectors form a class and are searched once.  Shards come from splitting:
a cell of more than ``FULL`` classes is split by centroids fitted on a bounded
sample of it (``SAMPLE`` vectors of ``SAMPLE_BYTES`` at most), and every class
of it joins the cells of its nearest ones, so shards overlap; cells that are
still too large are split again, so the number of centroids grows with the data
though no fit does.  A cell that a split leaves at over half its size is dense
and stays.

Within a shard candidates are robust-pruned (a neighbour is dropped if a kept
one is closer to it by the factor ``ALPHA``), a few long edges are reserved, and
reverse edges are added.  A vector's adjacency lists from all its shards are
united.  The united lists are searched for every member of a shard: greedily
from the shard's medoids and from the query's own node, and from there outwards
over everything within range.  Only nodes that the search visits are compared;
a visited node in range is a link, verified by its cosine in double precision,
and counts for both of its ends, whichever of them found it.

A shard is dealt in blocks of ``BLOCK`` classes, each pair of blocks to a task
of its own, so no task grows with a dense group.  Links are counted at the
first shard that both ends share, never written out as pairs.

A pair without a shared shard is lost, so probes are chosen for it in each
split: as many as let ``MIN_RECALL`` of planted pairs, sampled vectors and
others at just the least cosine from them, share a cell.  Recall is then
measured against brute force, for as many vectors of ``AUDIT`` as it takes to
meet ``LINKED`` that have links (or for all, or for the most of ``AUDIT``).  It
counts classes, not copies, and a vector with n links weighs 1/(n + 1), so a
large group weighs as much as an isolated pair; below ``MIN_RECALL`` the search
is repeated with more probes.  Where no vector asked has a link, recall is
null: not measured.

Vectors that are null, empty, zero or hold null or non-finite components link
with nothing.  Vectors of different length never link.  A null id ranks after
all others; repeated ids are one row each.  Other columns are not read.
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
from lanewright.llm._graph import components, local_roots
from lanewright.llm._state import Scratch, read_table

COSINE = 0.95
#: Vectors, and bytes of them, that one split is fitted on, at most; centroids of a split; bytes that one task assigns.
SAMPLE, SAMPLE_BYTES, MOST_CENTROIDS, CHUNK_BYTES = 20_000, 32 << 20, 1_024, 16 << 20
#: Classes of a shard: aimed at, too many, in a block.
SHARD, FULL, BLOCK = 1_500, 6_000, 2_048
DEGREE, LONG_EDGES, CANDIDATES, ALPHA, BEAM, ENTRIES = 24, 4, 48, 1.2, 4, 4
#: Vectors that are asked in the audit, few first; bytes of them; those with links that are enough; planted pairs.
AUDIT, AUDIT_BYTES, LINKED, PLANTED, MIN_RECALL = (2_048, 16_384), 64 << 20, 200, 4_096, 0.99
_LAST = (1 << 63) - 1


def _unit(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision and of length one; None if it links with nothing."""
    out: list[np.ndarray | None] = []
    for x in column.to_pylist():
        v = None
        if x and None not in x:
            v = np.array(x, np.float64)
            most = np.abs(v).max()
            if np.isfinite(most) and most > 0:
                v = v / most
                v /= np.sqrt(v @ v)
            else:
                v = None
        out.append(v)
    return out


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spread starts; each dimension count apart."""
    centroids = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(rounds):
        best = np.concatenate([np.argmax(sample[i : i + 4096] @ centroids.T, axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, best, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centroids)
    return centroids


def probes_for(centroids: np.ndarray, sample: np.ndarray, cosine: float) -> int:
    """The least probes with which MIN_RECALL of planted pairs at the cosine share a cell."""
    x, rng, need = sample[:PLANTED], np.random.default_rng(1), []
    if x.shape[1] < 2 or len(centroids) < 2:
        return 1
    for i in range(0, len(x), 256):
        one = x[i : i + 256]
        off = rng.normal(size=one.shape)
        off -= (off * one).sum(axis=1, keepdims=True) * one
        off /= np.linalg.norm(off, axis=1, keepdims=True)
        two = cosine * one + np.sqrt(max(0.0, 1 - cosine**2)) * off
        ranks = [np.argsort(np.argsort(-(v @ centroids.T), axis=1), axis=1) for v in (one, two)]
        need.append(np.maximum(*ranks).min(axis=1) + 1)
    need = np.sort(np.concatenate(need))
    return int(need[int(np.ceil(MIN_RECALL * len(need))) - 1])


def nearest(units: np.ndarray, count: int) -> np.ndarray:
    """The nearest other rows of each row, nearest first."""
    out = np.empty((len(units), count), np.int64)
    step = max(1, 2_000_000 // len(units))
    for i in range(0, len(units), step):
        score = units[i : i + step] @ units.T
        score[np.arange(len(score)), np.arange(i, i + len(score))] = -2
        near = np.argpartition(-score, count - 1, axis=1)[:, :count]
        out[i : i + step] = np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, 1), axis=1, kind="stable"), 1)
    return out


def robust_prune(near: np.ndarray, units: np.ndarray, degree: int) -> np.ndarray:
    """Which of each row's candidates (nearest first) stay: those that no kept one hides."""
    kept = np.zeros(near.shape, bool)
    step = max(1, 2_000_000 // (near.shape[1] * max(units.shape[1], near.shape[1])))
    for i in range(0, len(near), step):
        these = units[near[i : i + step]]
        between = 1 - these @ these.transpose(0, 2, 1)
        away = 1 - np.einsum("rcd,rd->rc", these, units[i : i + step])
        alive, count = np.ones(away.shape, bool), np.zeros(len(away), np.int64)
        for c in range(near.shape[1]):
            take = alive[:, c] & (count < degree)
            kept[i : i + step, c] = take
            count += take
            alive &= ~take[:, None] | (ALPHA * between[:, c] > away)
    return kept


def build(units: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours, offsets): the pruned adjacency of one shard's vectors."""
    m = len(units)
    most = min(CANDIDATES, m - 1)
    if most <= 0:
        return np.zeros(0, np.int64), np.zeros(m + 1, np.int64)
    near = nearest(units, most)
    source, column = np.nonzero(robust_prune(near, units, DEGREE - LONG_EDGES))
    target = near[source, column]
    far = np.random.default_rng(seed).integers(0, m, (m, LONG_EDGES)).ravel()
    source, target = np.concatenate([source, np.repeat(np.arange(m), LONG_EDGES)]), np.concatenate([target, far])
    edges = np.unique(np.concatenate([source * m + target, target * m + source]))
    source, target = edges // m, edges % m
    source, target = source[source != target], target[source != target]
    return target, np.searchsorted(source, np.arange(m + 1))


def medoids(units: np.ndarray) -> np.ndarray:
    """The node nearest to the middle, then the nodes that the chosen ones cover least."""
    chosen = [int((units @ units.sum(axis=0)).argmax())]
    cover = units @ units[chosen[0]]
    while len(chosen) < min(ENTRIES, len(units)):
        chosen.append(int(cover.argmin()))
        cover = np.maximum(cover, units @ units[chosen[-1]])
    return np.unique(chosen)


class RangeSearch:
    """Finds, over a graph, for all of its nodes at once the others at or over a cosine.

    Only cosines of visited nodes are worked out; visited and found are bits of
    one pair of nodes each.
    """

    def __init__(self, units: np.ndarray, near: np.ndarray, off: np.ndarray, least: float):
        self.units, self.near, self.off, self.least = units, near, off, least
        self.visited, self.found = np.zeros((len(units), len(units)), bool), np.zeros((len(units), len(units)), bool)

    def run(self) -> np.ndarray:
        self.greedy(medoids(self.units))
        self.outwards()
        return self.found | self.found.T

    def visit(self, query: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The cosines of nodes that are visited now; those in range are found."""
        self.visited[query, node] = True
        score = np.empty(len(query))
        step = max(1, 2_000_000 // self.units.shape[1])
        for i in range(0, len(query), step):
            score[i : i + step] = np.einsum("ij,ij->i", self.units[query[i : i + step]], self.units[node[i : i + step]])
        hit = (score >= self.least) & (query != node)
        self.found[query[hit], node[hit]] = True
        return score

    def neighbours(self, query: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, neighbour) of these nodes, without those that the query visited before."""
        size = self.off[node + 1] - self.off[node]
        query, beside = np.repeat(query, size), self.near[_text.take_spans(self.off[node], size)]
        new = ~self.visited[query, beside]
        return query[new], beside[new]

    def greedy(self, entries: np.ndarray) -> None:
        """Every query expands the best open node of its beam until none is open."""
        m = len(self.units)
        beam = np.concatenate([np.tile(entries, (m, 1)), np.arange(m)[:, None], np.zeros((m, BEAM), np.int64)], axis=1)
        score = np.full(beam.shape, -np.inf)
        for c in range(len(entries) + 1):
            new = ~self.visited[np.arange(m), beam[:, c]]
            score[new, c] = self.visit(np.flatnonzero(new), beam[new, c])
        beam, score, open_ = self.best(beam, score, score > -np.inf)
        while open_.any():
            query = np.flatnonzero(open_.any(axis=1))
            at = np.where(open_[query], score[query], -np.inf).argmax(axis=1)
            open_[query, at] = False
            owner, node = self.neighbours(query, beam[query, at])
            if not len(owner):
                continue
            # the new nodes of each query beside its beam
            count = np.bincount(owner, minlength=m)
            column = BEAM + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)[: len(owner)]
            some = np.flatnonzero(count)
            row = np.searchsorted(some, owner)
            width = BEAM + int(count.max())
            wide = [np.zeros((len(some), width), np.int64), np.full((len(some), width), -np.inf), np.zeros((len(some), width), bool)]
            for old, all_ in zip((beam, score, open_), wide, strict=True):
                all_[:, :BEAM] = old[some]
            wide[0][row, column], wide[1][row, column], wide[2][row, column] = node, self.visit(owner, node), True
            beam[some], score[some], open_[some] = self.best(*wide)

    @staticmethod
    def best(beam: np.ndarray, score: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, ...]:
        at = np.argsort(-score, axis=1, kind="stable")[:, :BEAM]
        return tuple(np.take_along_axis(x, at, axis=1) for x in (beam, score, open_))

    def outwards(self) -> None:
        """Range expansion: everything beside something in range is visited."""
        done = np.eye(len(self.units), dtype=bool)
        step = max(1, 500_000 // max(1, int(np.diff(self.off).max(initial=1))))
        while True:
            waiting = self.found & ~done
            waiting[self.visited.all(axis=1)] = False
            rank = np.cumsum(waiting, axis=1, dtype=np.int32)
            query, node = np.nonzero(waiting & (rank <= 8))  # a few at a time: dense groups are soon seen whole
            if not len(query):
                return
            done[query, node] = True
            for i in range(0, len(query), step):
                owner, beside = self.neighbours(query[i : i + step], node[i : i + step])
                pair = np.unique(owner * len(self.units) + beside)
                self.visit(pair // len(self.units), pair % len(self.units))


def vector_dedup(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", probes: int = 3) -> DataFrame:
    """One row for each row: id, n_links, component_id, kept, and recall as measured (null if it is not).

    probes is the least number of shards that a vector joins.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    plain = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.col(vector_col).alias("v"))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _unit(batch.column("v"))
            key = [None if u is None else hashlib.md5(u.tobytes(), usedforsecurity=False).digest() for u in units]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(key, pa.binary()), pa.array([None if u is None else u.tobytes() for u in units], pa.binary())],
                names=["id", "key", "unit"],
            )

    rows = scratch.cut(plain.mapInArrow(prepare, "id long, key binary, unit binary"))
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("id", "unit")).alias("x"), F.count("*").alias("mult"))
    classes = scratch.cut(
        classes.select("key", F.xxhash64("key").alias("cls"), F.col("x.id").alias("first_id"), F.col("x.unit").alias("unit"), "mult", (F.octet_length("x.unit") / 8).cast("int").alias("dims"))
    )
    sizes = {r["dims"]: r["n"] for r in classes.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    truth = _truth(classes, sizes, cosine)
    while True:
        cells = _cells(classes, probes, cosine, scratch)
        found = _links(classes, cells, cosine, scratch)
        recall = _audit(truth, found)
        if recall is None or recall >= MIN_RECALL or probes >= MOST_CENTROIDS:
            break
        scratch.drop(found)
        probes = 4 * probes
    joined = components(found.where("least <> cls").select(F.col("cls").alias("a"), F.col("least").alias("b")), scratch)
    reach = scratch.cut(joined.join(classes.select(F.col("cls").alias("node"), "first_id"), "node").groupBy("root").agg(F.min("first_id").alias("component_id")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    of_class = scratch.cut(
        classes.select("key", "cls", "first_id", "mult")
        .join(joined.join(reach, "root").select(F.col("node").alias("cls"), "component_id"), "cls", "left")
        .join(links, "cls", "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id"))
    )
    return (
        rows.select("id", "key")
        .join(of_class, "key", "left")
        .select(
            F.nullif("id", F.lit(_LAST)).alias(id_col),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.nullif(F.coalesce("component_id", "id"), F.lit(_LAST)).alias("component_id"),
            (F.col("id") == F.coalesce("component_id", "id")).alias("kept"),
            F.lit(recall).cast("double").alias("recall"),
        )
    )


def _units(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([np.frombuffer(x) for x in column.to_pylist()])


def _cells(classes: DataFrame, probes: int, cosine: float, scratch: Scratch) -> DataFrame:
    """(cls, cells): the shards of each class."""

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        cell, n, chunks = (k.as_py() for k in key)
        sample = _units(table.sort_by("cls").column("unit"))
        centroids = fit_centroids(sample, max(1, min(MOST_CENTROIDS, -(-n // SHARD), len(sample))))
        most = min(len(centroids), max(probes, probes_for(centroids, sample, cosine)))
        return pa.table({"cell": [cell], "n": [n], "chunks": [chunks], "most": [most], "centroids": [centroids.tobytes()]})

    def assign(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["cls", "unit", "dims"]
        if not right.num_rows:  # no sample: the cell stays
            return left.select([*names, "cell"]).append_column("above", left.column("n"))
        units, most = _units(left.column("unit")), right.column("most")[0].as_py()
        centroids = np.frombuffer(right.column("centroids")[0].as_py()).reshape(-1, units.shape[1])
        step = max(1, 4_000_000 // len(centroids))
        best = np.concatenate([np.argpartition(-(units[i : i + step] @ centroids.T), most - 1, axis=1)[:, :most] for i in range(0, len(units), step)])
        cell = _text.mix(_text.mix(best.ravel().astype(np.uint64) + np.uint64(1)) ^ np.uint64(key[0].as_py() & (1 << 64) - 1)).view(np.int64)
        rows = left.select(names).take(pa.array(np.repeat(np.arange(len(units)), most)))
        return rows.append_column("cell", pa.array(cell)).append_column("above", left.column("n").take(pa.array(np.repeat(np.arange(len(units)), most))))

    here = classes.select("cls", "unit", "dims", F.xxhash64("dims").alias("cell"), F.lit(None).cast("long").alias("above"))
    shards: list[DataFrame] = []
    chunks = F.expr(f"ceil(n * dims * 8 / {CHUNK_BYTES})")
    while True:
        sizes = here.groupBy("cell").agg(F.count("*").alias("n"), F.first("above").alias("above"), F.first("dims").alias("dims"))
        over = scratch.cut(sizes.where(f"n > {FULL} AND (above IS NULL OR 2 * n <= above)").select("cell", "n", chunks.alias("chunks")))
        if over.isEmpty():
            break
        shards.append(here.join(over, "cell", "left_anti").select("cls", "cell"))
        full = here.join(over, "cell").withColumn("chunk", F.expr("pmod(xxhash64(cls), chunks)"))
        picked = full.where(f"pmod(xxhash64(cls, 'fit'), n) < least({SAMPLE}, {SAMPLE_BYTES} / (8 * dims))")
        fitted = picked.select("cell", "n", "chunks", "cls", "unit").groupBy("cell", "n", "chunks").applyInArrow(fit, "cell long, n long, chunks long, most long, centroids binary")
        fitted = scratch.cut(fitted).withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)")))
        both = full.select("cell", "chunk", "cls", "unit", "dims", "n").groupBy("cell", "chunk").cogroup(fitted.select("cell", "chunk", "most", "centroids").groupBy("cell", "chunk"))
        here = scratch.cut(both.applyInArrow(assign, "cls long, unit binary, dims int, cell long, above long"))
    shards.append(here.select("cls", "cell"))
    return scratch.cut(reduce(DataFrame.union, shards).groupBy("cls").agg(F.collect_list("cell").alias("cells")))


def _links(classes: DataFrame, cells: DataFrame, cosine: float, scratch: Scratch) -> DataFrame:
    """(cls, links, n, least) partial sums: links found, classes linked, and a smaller class that is reached."""
    in_cell = classes.select("cls", "unit", "mult").join(cells, "cls").withColumn("cell", F.explode("cells"))
    blocks = scratch.cut(cells.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    dealt = (
        in_cell.join(blocks, "cell")
        .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "mult", "cells", "unit")
    )

    def build_lists(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("cls")
        cls = np.asarray(table.column("cls"))
        near, off = build(_units(table.column("unit")), sum(k.as_py() for k in key) % (1 << 31))
        return pa.table({"cls": pa.array(cls, pa.int64()), "near": pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(cls[near], pa.int64()))})

    lists = dealt.select("cell", "i", "j", "cls", "unit").groupBy("cell", "i", "j").applyInArrow(build_lists, "cls long, near array<long>")
    united = scratch.cut(lists.groupBy("cls").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))

    def search(key: tuple, table: pa.Table) -> pa.Table:
        cell, i, j = (k.as_py() for k in key)
        table = table.sort_by("cls").combine_chunks()
        cls, mult, block = (np.asarray(table.column(c)) for c in ("cls", "mult", "block"))
        near = table.column("near").combine_chunks()
        ids, size = np.asarray(near.flatten()), np.asarray(near.value_lengths(), dtype=np.int64)
        at = np.minimum(np.searchsorted(cls, ids), len(cls) - 1)
        here = cls[at] == ids
        off = np.concatenate([[0], np.cumsum(here)])[np.concatenate([[0], np.cumsum(size)])]
        pairs = RangeSearch(_units(table.column("unit")), at[here], off, cosine).run()
        if i != j:
            pairs &= block[:, None] != block[None, :]
        # pairs that share an earlier shard count there
        shared = table.column("cells").combine_chunks()
        owner = np.repeat(np.arange(len(cls)), np.asarray(shared.value_lengths(), dtype=np.int64))
        value = np.asarray(shared.flatten())
        owner, value = owner[value < cell], value[value < cell]
        owner = owner[np.argsort(value, kind="stable")]
        for same in np.split(owner, np.cumsum(np.unique(value, return_counts=True)[1])[:-1]):
            pairs[np.ix_(same, same)] = False
        links, n = pairs @ mult, pairs.sum(axis=1)
        some, least = pairs.any(axis=1), cls[local_roots(pairs)]
        return pa.table({"cls": cls[some], "links": links[some], "n": n[some], "least": least[some]}, schema=pa.schema([(c, pa.int64()) for c in ("cls", "links", "n", "least")]))

    return scratch.cut(dealt.join(united, "cls").groupBy("cell", "i", "j").applyInArrow(search, "cls long, links long, n long, least long"))


def _truth(classes: DataFrame, sizes: dict[int, int], cosine: float) -> DataFrame | None:
    """(cls, truth): the number of linked classes, by brute force, of the audit's vectors that have any; None without such."""
    spark, rows = classes.sparkSession, []
    for most in AUDIT if sizes else ():
        most = min(most, AUDIT_BYTES // (8 * max(sizes)) + 1)
        picked = classes.orderBy(F.xxhash64("cls", F.lit("audit")), "cls").limit(most).select("cls", "unit", "dims").collect()  # bounded
        asked = {d: ([r["cls"] for r in picked if r["dims"] == d], np.array([np.frombuffer(r["unit"]) for r in picked if r["dims"] == d])) for d in {r["dims"] for r in picked}}
        sent = spark.sparkContext.broadcast({d: (np.array(names, np.int64), units) for d, (names, units) in asked.items()})

        def brute(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = {d: np.zeros(len(names), np.int64) for d, (names, _) in sent.value.items()}
            for batch in batches:
                dims, cls, units = np.asarray(batch.column("dims")), np.asarray(batch.column("cls")), batch.column("unit").to_pylist()
                for d in np.unique(dims).tolist():
                    if d in total:
                        names, queries = sent.value[d]
                        mine = np.flatnonzero(dims == d)
                        against = np.array([np.frombuffer(units[x]) for x in mine]).T
                        for i in range(0, len(names), 512):
                            near = (queries[i : i + 512] @ against >= cosine) & (names[i : i + 512, None] != cls[mine][None, :])
                            total[d][i : i + 512] += near.sum(axis=1)
            for d, n in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(sent.value[d][0][n > 0], pa.int64()), pa.array(n[n > 0], pa.int64())], names=["cls", "truth"])

        rows = classes.select("cls", "unit", "dims").mapInArrow(brute, "cls long, truth long").groupBy("cls").agg(F.sum("truth").alias("truth")).collect()  # of those asked
        if len(rows) >= LINKED or len(picked) < most:
            break
    return spark.createDataFrame([tuple(r) for r in rows], "cls long, truth long") if rows else None


def _audit(truth: DataFrame | None, found: DataFrame) -> float | None:
    """The share of a vector's links that was found, on average over groups; None if no vector asked has a link."""
    if truth is None:
        return None
    got = F.broadcast(truth).join(found.groupBy("cls").agg(F.sum("n").alias("n")), "cls", "left")
    weight, share = 1 / (F.col("truth") + 1), F.least(F.coalesce("n", F.lit(0)), "truth") / F.col("truth")
    sums = got.agg(F.sum(weight * share).alias("g"), F.sum(weight).alias("t")).first()
    return float(sums["g"]) / float(sums["t"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(read_table(spark, sf_dir, "embeddings"))
