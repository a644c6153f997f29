"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's inputs are its words hashed to ``2**WORD_BITS`` slots (log counts, scaled to length
one), statistics of its structure (length, repetition, symbols, line shape), each as a value
and as a one-hot of ten ranges, and any numeric metadata columns asked for.  The score is

    sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2))

so all pairwise interactions cost time linear in the inputs present.

Training takes at most ``TRAIN_ROWS`` labelled rows, those with the smallest hashed ids, and
runs on the driver on their hashed inputs; scoring reads every whole text, on executors,
with the model (a few MB, fixed by the parameters) broadcast.

Defined results: null and empty texts have no words and are scored by structure alone.  A
document labelled several times counts as 1 if any label is.  Without labels of both
kinds every score is the share of label 1, or 1 if there are no labels.  Rows with a
repeated or null doc_id are scored like any other; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import crc_remainder, fresh, ship

WORD_BITS = 14
TRAIN_ROWS = 8_000
RANGES = 10
RANK = 8
THRESHOLD = 0.7
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_ALNUM_SPACE = _LETTERS + b"0123456789 \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
STATISTICS = ("chars", "words", "word_length", "distinct", "top_word", "symbols", "odd_ends", "digits", "capitals", "lines", "line_copies", "bars", "short_words", "stops")


class _Slots(dict):
    """Word to slot, remembered; bounded by the caller."""

    def __missing__(self, word: bytes) -> int:
        slot = self[word] = zlib.crc32(word) & ((1 << WORD_BITS) - 1)
        return slot


_SLOTS = _Slots()


def structure(text: bytes, words: list[bytes], counts: Counter) -> list[float]:
    n, m = max(1, len(text)), max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        min(30.0, sum(map(len, words)) / m),
        len(counts) / m,
        max(counts.values(), default=0) / m,
        len(text.translate(None, _ALNUM_SPACE)) / n,
        sum(c for w, c in counts.items() if len(w) > 1 and w[-1] == w[-2] and not w[-1:].isalnum() and w[-1] < 128) / m,
        (n - len(text.translate(None, b"0123456789"))) / n,
        (n - len(text.translate(None, _UPPER))) / n,
        np.log1p(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        counts[b"|"] / m,
        sum(c for w, c in counts.items() if len(w) < 3) / m,
        (text.count(b". ") + text.count(b".\n") + text.endswith(b".")) / m,
    ]


def word_inputs(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    if len(_SLOTS) > 500_000:
        _SLOTS.clear()
    slots = np.fromiter(map(_SLOTS.__getitem__, words), np.int32, len(words))
    seen, where = np.unique(slots, return_inverse=True)
    x = np.log1p(np.bincount(where, np.fromiter(words.values(), float, len(words))))
    return seen.astype(np.int32), (x / np.sqrt((x * x).sum())).astype(np.float32)


def raw_inputs(text: bytes | None, more: list[float]) -> tuple[np.ndarray, np.ndarray, list[float]]:
    text = text or b""
    counts = Counter(text.lower().split())
    words = list(counts.elements())
    return *word_inputs(counts), structure(text, words, counts) + more


@dataclass
class Machine:
    """The fitted model; slots 0 to 2**WORD_BITS-1 are words, then values, then ranges of each statistic."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    edges: np.ndarray
    constant: float | None = None

    def dense(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots and values of the statistics, for each row as many."""
        base, k = 1 << WORD_BITS, stats.shape[1]
        value = np.clip((stats - self.mean) / self.spread, -4, 4) / 4
        nth = (stats[:, :, None] > self.edges[None]).sum(axis=2)
        slots = np.concatenate([np.broadcast_to(base + np.arange(k), stats.shape), base + k + np.arange(k) * RANGES + nth], axis=1)
        return slots, np.concatenate([value, np.full(stats.shape, 0.5)], axis=1)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray, list[float]]]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        if not rows:
            return np.empty(0)
        idx, val, first = self.pack(rows)
        return 1 / (1 + np.exp(-self.margin(idx, val, first)[0]))

    def pack(self, rows):
        slots, values = self.dense(np.array([r[2] for r in rows], float))
        idx = np.concatenate([x for r, s in zip(rows, slots) for x in (r[0], s)])
        val = np.concatenate([x for r, v in zip(rows, values) for x in (r[1], v)])
        sizes = np.array([len(r[0]) for r in rows]) + slots.shape[1]
        return idx, val, np.concatenate(([0], np.cumsum(sizes)[:-1]))

    def margin(self, idx, val, first):
        xv = self.factors[idx] * val[:, None]
        total = np.add.reduceat(xv, first)
        pairs = (total * total - np.add.reduceat(xv * xv, first)).sum(axis=1) / 2
        return self.bias + np.add.reduceat(self.weights[idx] * val, first) + pairs, total


def train(rows: list[tuple[np.ndarray, np.ndarray, list[float]]], labels: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss."""
    stats = np.array([r[2] for r in rows], float).reshape(len(rows), len(rows[0][2]) if rows else 0)
    k = stats.shape[1]
    slots, rng = (1 << WORD_BITS) + k * (1 + RANGES), np.random.default_rng(seed)
    if len(set(labels.tolist())) < 2:
        return Machine(0.0, np.zeros(0), np.zeros((0, RANK)), np.zeros(k), np.ones(k), np.zeros((k, RANGES - 1)), float(labels.mean()) if len(labels) else 1.0)
    edges = np.quantile(stats, np.linspace(0, 1, RANGES + 1)[1:-1], axis=0).T
    share = labels.mean()
    m = Machine(float(np.log(share / (1 - share))), np.zeros(slots), rng.normal(0, 0.02, (slots, RANK)), stats.mean(axis=0), stats.std(axis=0) + 1e-6, edges)
    gw, gv, gb = np.full(slots, 1e-4), np.full((slots, RANK), 1e-4), 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            idx, val, first = m.pack([rows[i] for i in some])
            z, total = m.margin(idx, val, first)
            err = (1 / (1 + np.exp(-z)) - labels[some]) / len(some)
            of = np.repeat(np.arange(len(some)), np.diff(np.append(first, len(idx))))
            e = err[of] * val
            by = np.argsort(idx, kind="stable")
            s = idx[by]
            start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            u = s[start]
            dw = np.add.reduceat(e[by], start) + decay * m.weights[u]
            dv = np.add.reduceat((e[:, None] * (total[of] - m.factors[idx] * val[:, None]))[by], start) + decay * m.factors[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            m.weights[u] -= rate * dw / np.sqrt(gw[u])
            m.factors[u] -= rate * 0.5 * dv / np.sqrt(gv[u])
            db = err.sum()
            gb += db * db
            m.bias -= rate * db / np.sqrt(gb)
    return m


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, metadata: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """The bounded sample, as (label, slots, values, statistics)."""
    ship(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("label"))
    chosen = known.where(crc_remainder("doc_id", 4) != 2).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = chosen.select(F.col("doc_id").alias("label_id"), F.col("label").cast("double").alias("label"))
    take = [c for c in metadata if c in docs.columns]
    found = docs.select("doc_id", "text", *(F.col(c).cast("double").alias(f"meta_{c}") for c in take)).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    # Of rows that share an id, one: the sample is bounded whatever the ids are.
    one = Window.partitionBy("label_id").orderBy(F.xxhash64("text"), "text")
    found = found.withColumn("label_nth", F.row_number().over(one)).where("label_nth = 1")

    def inputs(batches):
        for b in batches:
            out = [raw_inputs(t, [meta_value(b.column(2 + k)[i].as_py()) for k in range(len(take))]) for i, t in enumerate(b.column(1).cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("label"), pa.array([r[0].tobytes() for r in out], pa.binary()), pa.array([r[1].tobytes() for r in out], pa.binary()), pa.array([list(map(float, r[2])) for r in out], pa.list_(pa.float64()))],
                names=["label", "slots", "vals", "stats"],
            )

    return found.select("doc_id", "text", *(f"meta_{c}" for c in take), "label").mapInArrow(inputs, "label double, slots binary, vals binary, stats array<double>")


def meta_value(x: float | None) -> float:
    return float(np.log1p(max(0.0, x))) if x is not None and np.isfinite(x) else 0.0


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, metadata: tuple[str, ...] = ("n_chars",)) -> Machine:
    found = training_rows(docs, labels, rows, metadata).toArrow()
    order = sorted(range(found.num_rows), key=lambda i: (found["slots"][i].as_py(), found["label"][i].as_py()))
    got = [(np.frombuffer(found["slots"][i].as_py(), np.int32), np.frombuffer(found["vals"][i].as_py(), np.float32), found["stats"][i].as_py()) for i in order]
    return train(got, np.array([found["label"][i].as_py() for i in order], float))


def with_score(docs: DataFrame, model: Machine, name: str = "score", metadata: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """The docs with a column of scores from 0 to 1."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    take = [c for c in metadata if c in docs.columns]

    @F.arrow_udf("double")
    def scores(texts: pa.Array, *more: pa.Array) -> pa.Array:
        m, out = shared.value, []
        texts, more = texts.cast(pa.binary()), [c.to_pylist() for c in more]
        for at in range(0, len(texts), 256):
            part = texts.slice(at, 256).to_pylist()
            out.append(m.score([raw_inputs(t, [meta_value(c[at + i]) for c in more]) for i, t in enumerate(part)]))
        return pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    return docs.withColumn(name, scores(F.col("text"), *(F.col(c).cast("double") for c in take)))


def quality_stage(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of at least ``threshold``; columns unchanged."""
    (name,) = fresh(docs, "quality_score")
    return with_score(docs, fit(docs, labels), name).where(F.col(name) >= threshold).drop(name)
