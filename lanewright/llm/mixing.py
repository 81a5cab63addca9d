"""Mixing to target weights with soft domain membership.

A classifier is trained on a labelled table (the values of its label columns
are the domains) and predicts for each document a posterior over the domains.
Document i has n_i tokens (words) and posterior p_i.  Nonnegative rates r_i are
fitted so that the expected tokens of each domain, sum r_i n_i p_i, match the
targets b, and rates stay near 1 where that leaves a choice:

    min over r >= 0 of  e' M^+ e / 2 + RIDGE/2 sum (n_i/N) (r_i - 1)^2
    with  e = (sum r_i n_i p_i - b) / N  and  M = sum (n_i/N) p_i p_i'

by projected gradient with momentum.  M makes the problem well scaled however
small a domain is; without it a ridge and a number of steps that suit a large
domain leave a small one far from its target.  Targets that rates can meet are
met in any scale; of others M decides how the rest is shared out.  Steps end
when each domain is within ``TOLERANCE`` of its target, relative to it, or when
totals no longer move.

The gradient for document i depends on the others only through the K domain
totals, so one step is one distributed sum of 2K numbers; a document's rate
follows from its posterior and the totals of all steps so far, and is never
stored or sent.

The classifier is fitted on at most ``SAMPLE_DOCS`` labelled documents (those
with the smallest hash of their id; of rows that share an id the one with the
smallest text digest), at most ``SAMPLE_WORDS`` distinct words of each (those
with the smallest hash) and at most ``VOCABULARY`` words in all; prediction,
totals and rates cover all documents, whole.

Null and empty texts have no tokens: they get the classifier's prior and do not
count in totals.  Labels with a null in any column are not used.  Without any
usable label there is one domain and every rate is the target over the total.
A null id stays null.  Repeated rows count each.  Columns other than id and
text are passed on where documents are returned, and not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.llm import _text
from lanewright.llm._state import Scratch, read_table

#: Bounds of the classifier's training data.
SAMPLE_DOCS, SAMPLE_WORDS, VOCABULARY, MIN_DOCS = 4_000, 4_096, 4_096, 4
#: Weight of staying near a rate of 1, most steps, largest relative error of a domain, least move of the totals.
RIDGE, STEPS, TOLERANCE, STILL = 1e-5, 120, 1e-3, 1e-8
#: Share of all tokens that each domain should have; the labels' values name a domain.
TARGETS = {"quality=1,toxic=0": 0.96, "quality=0,toxic=0": 0.02, "quality=1,toxic=1": 0.015, "quality=0,toxic=1": 0.005}


class Features:
    """Words of texts as 64-bit hashes, with the number of the text."""

    def __init__(self, texts: pa.Array):
        raw, off = _text.flat(texts)
        start, end, self.doc = _text.word_bounds(raw, off)
        # punctuation at a word's end is not part of it here
        tail = (raw[end - 1] < 128) & ~((raw[end - 1] | 32) - 97 < 26) & (end - start > 1) if len(end) else np.zeros(0, bool)
        self.word = _text.span_hash(raw, start, end - tail)
        self.count = np.bincount(self.doc, minlength=len(texts))
        symbols = np.bincount(self.doc[tail], minlength=len(texts))
        same = np.zeros(len(self.word), bool)
        same[1:] = (self.word[1:] == self.word[:-1]) & (self.doc[1:] == self.doc[:-1])
        some = np.maximum(self.count, 1)
        echo = np.bincount(self.doc[same], minlength=len(texts))
        upper = np.bincount(self.doc[(raw[start] >= 65) & (raw[start] <= 90)], minlength=len(texts)) if len(start) else np.zeros(len(texts))
        self.dense = np.stack([np.ones(len(texts)), symbols / some, echo / some, upper / some, np.log1p(self.count) / 10], axis=1)

    def known(self, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, number of a vocabulary word), once for each word of a text."""
        if not len(vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(vocabulary, self.word), len(vocabulary) - 1)
        there = np.flatnonzero(vocabulary[at] == self.word)
        seen = np.zeros(len(self.count) * len(vocabulary), bool)
        seen[self.doc[there] * len(vocabulary) + at[there]] = True
        pair = np.flatnonzero(seen)
        return pair // len(vocabulary), pair % len(vocabulary)


class DomainModel:
    """Multinomial logistic regression on word presence and a few shares."""

    def __init__(self, domains: list[str], vocabulary: np.ndarray, words: np.ndarray, dense: np.ndarray):
        self.domains, self.vocabulary, self.words, self.dense = domains, vocabulary, words, dense

    def posterior(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, posteriors) of texts."""
        out, count = np.zeros((len(texts), len(self.domains))), np.zeros(len(texts), np.int64)
        step = max(1, 32_000_000 // max(1, len(self.vocabulary)))
        for i in range(0, len(texts), step):
            f = Features(texts.slice(i, step))
            doc, word = f.known(self.vocabulary)
            score = f.dense @ self.dense
            for k in range(len(self.domains)):
                score[:, k] += np.bincount(doc, weights=self.words[word, k], minlength=len(f.count))
            score = np.exp(score - score.max(axis=1, keepdims=True))
            out[i : i + step], count[i : i + step] = score / score.sum(axis=1, keepdims=True), f.count
        return count, out


def _domain(labels: DataFrame, columns: Sequence[str]) -> Column:
    return F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.col(f"`{c}`").cast("string")) for c in columns])


def train(docs: DataFrame, labels: DataFrame, columns: Sequence[str], id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DomainModel:
    """A model of the domains that the label columns name."""
    usable = labels.dropna(subset=[id_col, *columns]).select(F.col(id_col).alias("id"), _domain(labels, columns).alias("domain"))
    chosen = usable.orderBy(F.xxhash64("id"), "id", "domain").limit(sample_docs)  # a bounded table
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.pieces(batch, "text"):
                f = Features(part.column("text"))
                at = np.searchsorted(f.doc, np.arange(len(f.count) + 1))
                found = [np.unique(f.word[a:b])[:SAMPLE_WORDS].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("domain"), pa.array(found, pa.binary()), pa.array([x.tobytes() for x in f.dense], pa.binary())],
                    names=["id", "domain", "words", "dense"],
                )

    # ids may repeat in docs, and labels in labels: one text for each chosen row
    known = texts.join(F.broadcast(chosen.distinct()), "id").groupBy("id", "domain").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))
    rows = known.mapInArrow(words, "id long, domain string, words binary, dense binary").collect()
    rows.sort(key=lambda r: (r["id"], r["domain"], bytes(r["words"])))
    if not rows:
        return DomainModel([""], np.zeros(0, np.uint64), np.zeros((0, 1)), np.zeros((5, 1)))
    domains = sorted({r["domain"] for r in rows})
    sets = [np.frombuffer(r["words"], np.uint64) for r in rows]
    word, seen = np.unique(np.concatenate(sets), return_counts=True)
    often = np.lexsort((word, -seen))[:VOCABULARY]
    vocabulary = np.sort(word[often[seen[often] >= MIN_DOCS]])
    doc = np.repeat(np.arange(len(rows)), [len(x) for x in sets])
    value = np.concatenate(sets)
    if len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, value), len(vocabulary) - 1)
        there = vocabulary[at] == value
        doc, at = doc[there], at[there]
    else:
        doc, at = doc[:0], doc[:0]
    dense = np.array([np.frombuffer(r["dense"]) for r in rows])
    truth = np.array([[r["domain"] == d for d in domains] for r in rows], float)
    return DomainModel(domains, vocabulary, *_fit(doc, at, dense, truth, len(vocabulary)))


def _fit(doc: np.ndarray, word: np.ndarray, dense: np.ndarray, truth: np.ndarray, n_words: int, steps: int = 150, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    m, k = truth.shape
    theta = np.zeros((n_words + dense.shape[1], k))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        score = dense @ theta[n_words:]
        for j in range(k):
            score[:, j] += np.bincount(doc, weights=theta[word, j], minlength=m)
        score = np.exp(score - score.max(axis=1, keepdims=True))
        wrong = (truth - score / score.sum(axis=1, keepdims=True)) / m
        grad = np.concatenate([np.stack([np.bincount(word, weights=wrong[doc, j], minlength=n_words) for j in range(k)], axis=1), dense.T @ wrong]) - ridge * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-10)
    return theta[:n_words], theta[n_words:]


def rates(posterior: np.ndarray, history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rate, point where the next gradient is taken) after the steps so far."""
    rate = point = np.ones(len(posterior))
    eta = 1 / (1 + RIDGE)
    for step, excess in enumerate(history, 1):
        before, rate = rate, np.maximum(0, point - eta * (posterior @ excess + RIDGE * (point - 1)))
        point = rate + (step - 1) / (step + 2) * (rate - before)
    return rate, point


def solve(members: DataFrame, targets: np.ndarray, total: float) -> list[np.ndarray]:
    """The steps' excess of the domain totals, scaled by M^+; members has n_tokens and posterior."""
    k, history = len(targets), []
    if not total:
        return history

    def sums(steps: list[np.ndarray] | None) -> np.ndarray:
        """Shares of the domains at the rates and at the points after these steps; M for none."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = np.zeros((k if steps is None else 2, k))
            for batch in batches:
                p = np.asarray(batch.column("posterior").flatten()).reshape(-1, k)
                at = p if steps is None else np.stack(rates(p, steps), axis=1)
                got += (at * np.asarray(batch.column("n_tokens"))[:, None]).T @ p
            yield pa.RecordBatch.from_arrays([pa.array([got.ravel().tolist()], pa.list_(pa.float64()))], names=["s"])

        parts = members.select("n_tokens", "posterior").mapInArrow(work, "s array<double>")
        n = k * (k if steps is None else 2)
        return np.array(parts.agg(*[F.sum(F.col("s")[i]) for i in range(n)]).first(), float).reshape(-1, k) / total

    scale = np.linalg.pinv(sums(None), rcond=1e-9, hermitian=True)
    wanted, before = targets / total, None
    least = np.maximum(wanted, 1e-3 * max(wanted.sum(), 1e-300))  # for domains that should have no tokens
    for _ in range(STEPS):
        now, point = sums(list(history))
        met = (np.abs(now - wanted) / least).max() < TOLERANCE
        if met or (before is not None and len(history) > 1 and np.abs(now - before).max() < STILL):
            break
        history.append(scale @ (point - wanted))
        before = now
    return history


def domain_shares(mixed_: DataFrame, model: DomainModel) -> DataFrame:
    """(domain, before, after): each domain's expected share of the tokens of mix's rows, and of those at their rates."""
    part = lambda i, by: F.sum(F.col("n_tokens") * F.col("posterior")[i] * by)
    each = [F.struct(F.lit(d).alias("domain"), part(i, F.lit(1.0)).alias("a"), part(i, F.col("rate")).alias("b")) for i, d in enumerate(model.domains)]
    one = mixed_.agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("rate")).alias("m"), F.array(*each).alias("each"))
    return one.select("n", "m", F.explode("each").alias("x")).select("x.domain", (F.col("x.a") / F.col("n")).alias("before"), (F.col("x.b") / F.col("m")).alias("after"))


def mix(docs: DataFrame, model: DomainModel, targets: dict[str, float], budget: float | None = None, id_col: str = "doc_id", text_col: str = "text", columns: Sequence[str] | None = None) -> DataFrame:
    """The given columns of docs (default: all), and n_tokens, posterior, rate and n_copies (columns of these names are replaced).

    targets are the domains' shares of budget tokens (default: as many as docs
    have).  n_copies is the rate rounded up or down by a hash of the id, so
    that its expectation over ids is the rate.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    k, domains = len(model.domains), model.domains
    new = ["n_tokens", "posterior", "rate", "n_copies"]
    rest = [c for c in (docs.columns if columns is None else columns) if c not in new]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.pieces(batch, "text"):
                count, posterior = model.posterior(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(count) + 1) * k, pa.int32()), pa.array(posterior.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), pa.array(count, pa.int64()), lists], names=["row", "id", "n_tokens", "posterior"])

    kinds = f"row {packed.schema['row'].dataType.simpleString()}, id {packed.schema['id'].dataType.simpleString()}, n_tokens long, posterior array<double>"
    members = scratch.cut(packed.mapInArrow(predict, kinds))
    total = float(members.agg(F.sum("n_tokens")).first()[0] or 0)
    wanted = np.array([targets.get(d, 0.0) if len(domains) > 1 or d else sum(targets.values()) for d in domains]) * (total if budget is None else budget)
    history = solve(members, wanted, total)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.asarray(batch.column("posterior").flatten()).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates(p, history)[0], pa.float64())], names=[*batch.schema.names, "rate"])

    chance = F.pmod(F.xxhash64("id", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    done = members.mapInArrow(rate, f"{kinds}, rate double").withColumn("n_copies", F.floor(F.col("rate") + chance).cast("int"))
    return done.select(*[F.col(f"row.`{c}`") for c in rest], *new)


def mixed(docs: DataFrame, model: DomainModel, targets: dict[str, float], budget: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, each as often as its rate says, with their own columns."""
    return mix(docs, model, targets, budget, id_col, text_col).where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "n_copies"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels"), ["quality", "toxic"])
    return mix(docs, model, TARGETS, columns=["doc_id"]).select("doc_id", "n_tokens", "posterior", "rate", "n_copies")
