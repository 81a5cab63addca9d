r"""Substring dedup by hashing of lines, paragraphs and sentences.

A text is cut into units that join up to the text again.  A unit is normalised
(lower case, runs of white space as one space, ends stripped); its digest is
grouped over all documents; the occurrence of lowest rank (document id, then
offset) stays and all others are removed, with their offsets in the original
text retained.

Cuts are ``line`` (after each line feed), ``paragraph`` (after each run of
blank lines) or ``sentence`` (a line's sentences, so that a passage that is
pasted into a line is found by its inner sentences).  A cut has a least number
of words: short phrases recur in sound text.  Several cuts are hashed together:
a unit is removed if a unit of any cut came before it with the same digest, and
what several cuts delimit alike is one unit.  ``EVERY``, which the registered
query takes, has all lines and paragraphs that hold a word, and sentences of
``MIN_WORDS`` words or more besides.  Whatever is removed stays at a place of
lower rank, as rank falls with every step from a copy to what it repeats.

Not found: the first and last sentence of a passage that is pasted into a line,
as they run into their neighbours (suffix dedup removes these).

Null and empty texts have no units and stay empty.  A null id ranks after all
others.  Rows that share an id are told apart by their text's digest.  Other
columns are not read; names may clash, as only the id and the text are used.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.llm import _text
from lanewright.llm._state import Scratch, read_table

#: Where a unit ends.
CUTS = {
    "line": re.compile(r"\n"),
    "paragraph": re.compile(r"\n(?:[\x20\t\r]*\n)+"),
    "sentence": re.compile(r"[.!?][\x20\t]+|\n"),
}
MIN_WORDS = 5
#: The least number of words of each cut's units, cuts in descending size.
EVERY = {"paragraph": 1, "line": 1, "sentence": MIN_WORDS}
_LAST = (1 << 63) - 1


def units(text: str, cut: re.Pattern[str], min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of each unit with enough words, in code points."""
    at = 0
    for end in [*(m.end() for m in cut.finditer(text)), len(text)]:
        if end > at:
            words = text[at:end].lower().split()
            if len(words) >= min_words:
                yield at, end, hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
        at = end


def all_units(text: str, cuts: Mapping[str, int]) -> list[tuple[int, int, bytes]]:
    """The units of all cuts by place, the longer first; what has one text at one place is one unit."""
    if len(cuts) == 1:
        return [u for name, least in cuts.items() for u in units(text, CUTS[name], least)]
    out: list[tuple[int, int, bytes]] = []
    spans: set[tuple[int, int]] = set()
    known: set[tuple[int, bytes]] = set()  # where a unit's first word is, and its digest
    for name, least in cuts.items():
        at = 0
        for end in [*(m.end() for m in CUTS[name].finditer(text)), len(text)]:
            if end > at and (at, end) not in spans:
                unit = text[at:end]
                words = unit.lower().split()
                if words and len(words) >= least:
                    digest = hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
                    place = (at + len(unit) - len(unit.lstrip()), digest)
                    if place not in known:
                        known.add(place)
                        out.append((at, end, digest))
                    spans.add((at, end))
            at = end
    return sorted(out, key=lambda u: (u[0], -u[1]))


def _row_key(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()[:7])


def unit_dedup(docs: DataFrame, cut: str | Mapping[str, int] = "sentence", min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_units, n_removed, removed, kept_text.

    cut is one cut, with units of min_words words or more, or several with the
    least number of words of each; n_units and n_removed count units of all.
    removed is an array of (start, end) offsets into the original text, in
    code points; neighbours are merged.
    """
    scratch = Scratch(docs.sparkSession, "units")
    cuts = {cut: min_words} if isinstance(cut, str) else {c: cut[c] for c in EVERY if c in cut}
    plain = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.col(text_col).alias("text"))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.pieces(batch, "text"):
                rows: list[tuple[bytes, int, int, int]] = []
                for i, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if text:
                        key, count = _row_key(text), {}
                        for _, _, digest in all_units(text, cuts):
                            count[digest] = count.get(digest, 0) + 1
                        rows += [(d, i, key, n) for d, n in count.items()]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["digest", "id", "row", "n"]
                )

    found = scratch.cut(plain.select("id", "text").mapInArrow(occurrences, "digest binary, id long, row long, n long"))
    owners = (
        found.groupBy("digest")
        .agg(F.min(F.struct("id", "row")).alias("owner"), F.sum("n").alias("total"))
        .where("total > 1")
        .select("digest", F.col("owner.id").alias("own_id"), F.col("owner.row").alias("own_row"))
    )
    # for each document the digests to remove; one that the document owns keeps its first occurrence
    gone = (
        found.join(owners, "digest")
        .select("id", "row", F.struct("digest", ((F.col("id") == F.col("own_id")) & (F.col("row") == F.col("own_row"))).alias("own"), "n").alias("unit"))
        .where("NOT unit.own OR unit.n > 1")
        .groupBy("id", "row")
        .agg(F.collect_set(F.struct("unit.digest", "unit.own")).alias("units"))
    )

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.pieces(batch, "text"):
                total, removed, spans, kept = [], [], [], []
                for text, drop in zip(part.column("text").to_pylist(), part.column("units").to_pylist(), strict=True):
                    text, gaps, count, size = text or "", [], 0, 0
                    marks = {u["digest"]: u["own"] for u in drop or ()}
                    for start, end, digest in all_units(text, cuts):
                        size += 1
                        own = marks.get(digest)
                        if own:
                            marks[digest] = False  # the first occurrence stays, later ones go
                        elif own is not None:
                            count += 1
                            if gaps and gaps[-1][1] >= start:
                                gaps[-1] = (gaps[-1][0], max(gaps[-1][1], end))
                            else:
                                gaps.append((start, end))
                    borders = [0, *(x for g in gaps for x in g), len(text)]
                    kept.append("".join(text[a:b] for a, b in list(pairwise(borders))[::2]))
                    total.append(size)
                    removed.append(count)
                    spans.append([{"start": a, "end": b} for a, b in gaps])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc"),
                        pa.array(total, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array(kept, pa.string()),
                    ],
                    names=[id_col, "n_units", "n_removed", "removed", "kept_text"],
                )

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_row_key(t) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, "row"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = plain.mapInArrow(keyed, f"doc {kind}, id long, text string, row long")
    return (
        rows.join(gone, ["id", "row"], "left")
        .select("doc", "text", "units")
        .mapInArrow(rebuild, f"`{id_col}` {kind}, n_units long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = unit_dedup(read_table(spark, sf_dir, "documents"), EVERY)
    return done.select("doc_id", "n_units", "n_removed", "removed", F.sha2("kept_text", 256).alias("kept_sha256"))
