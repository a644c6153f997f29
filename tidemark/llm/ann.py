"""Approximate nearest neighbours by additive quantisation.

A vector's direction is approximated by a sum of one entry from each of several full-dimensional
codebooks (one for about two dimensions), fitted one after the other to what the earlier
ones leave (k-means on a bounded sample); its norm is stored.  Encoding keeps the ``BEAM`` best partial
sums at each book.  A query's inner products with all entries form a lookup table; a candidate's approximate
score is the sum of its codes' places there, with its stored norm as the measure has it.

1. Codes, norms and vectors meet queries in a grid of hashed blocks; a vector travels once for each block of queries.
2. In a block a query scores its share of k log2(n) candidates exactly, those best by approximate score.
3. What else can belong to its nearest is scored exactly, too: a candidate stays out only if its approximate score lies below what
   these have come to by more than ``SURE`` times the usual error.  The error follows from the angle between the candidate and its
   code, which is stored, and is measured on the sample and on the query's own list.  So lists are as long as the rows ask
   for: a crowd of rows nearer to each other than their codes can tell is scored whole.

Every row is encoded and searched, and neither candidates nor queries are broadcast.

Defined results: rows with null ids and vectors that are null, empty, zero or hold null or
non-finite components take no part; vectors of another length than most are left out too.
Rows with the same vec_id are all candidates, but not for a query with that id; queries with the same vec_id are
each answered.  Equal scores rank the smaller vec_id first.  Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, ship
from tidemark.llm.vectors import BLOCKS, best_pairs, block_of, blocks_for, every, matrix, usable

ENTRIES, BEAM = 256, 3
#: Codebooks for each dimension, and how many at least and at most.
BOOKS_EACH, BOOKS_LEAST, BOOKS_MOST = 7 / 16, 8, 64
#: Vectors that codebooks are fitted to, at most, and rounds of k-means.
SAMPLE, ROUNDS = 8_192, 5
#: Components and queries in a block, about, and query-candidate pairs in memory at once.
COMPONENTS, QUERY_ROWS, PAIRS = 1 << 23, 16_384, 1 << 21
#: Usual errors that an approximate score is taken to be wrong by at most, and what rounding adds to a cosine.
SURE, ROUNDING = 3.5, 4e-6
BIG = float(np.finfo(np.float32).max)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as floats, and the norms; scaled by the largest component, so that no square overflows."""
    most = np.abs(x).max(axis=1, keepdims=True, initial=0)
    scaled = x / np.where(most > 0, most, 1)
    size = np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    with np.errstate(over="ignore"):
        return (scaled / np.where(size > 0, size, 1)).astype(np.float32), np.minimum((size * most)[:, 0], np.finfo(float).max)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=k)
        member = np.zeros((len(x), k), np.float32)
        member[np.arange(len(x)), near] = 1
        centres[n > 0] = (member.T @ x)[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)


@dataclass
class Codebooks:
    """books: (books, entries, dimensions); error: the usual error of a cosine for a candidate at 45 degrees to its code and a query square to it."""

    books: np.ndarray
    error: float = 0.0

    @staticmethod
    def fitted(x: np.ndarray, books: int | None = None, entries: int = ENTRIES, seed: int = 3) -> Codebooks:
        left, _ = directions(x)
        rng, out = np.random.default_rng(seed), []
        for _ in range(books or min(BOOKS_MOST, max(BOOKS_LEAST, round(BOOKS_EACH * x.shape[1])))):
            c = kmeans(left, entries, ROUNDS, rng)
            left = left - c[nearest(left, c)]
            out.append(np.concatenate([c, np.zeros((entries - len(c), c.shape[1]), np.float32)]))
        model = Codebooks(np.array(out, np.float32))
        model.error = model.usual_error(x[rng.choice(len(x), min(len(x), 2048), replace=False)])
        return model

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the directions by beam search, and the norms."""
        unit, norms = directions(x)
        (m, k, d), n = self.books.shape, len(x)
        left, codes, errors = unit[:, None, :], np.zeros((n, 1, 0), np.uint8), (unit * unit).sum(axis=1)[:, None]
        rows = np.arange(n)
        for c in self.books:
            # |left - entry|^2 of all partial sums with all entries; the smallest few one after the other.
            tried = (errors[:, :, None] - 2 * (left.reshape(-1, d) @ c.T).reshape(n, -1, k) + (c * c).sum(axis=1)).reshape(n, -1)
            chosen = np.empty((n, min(beam, tried.shape[1])), np.int64)
            errors = np.empty(chosen.shape, np.float32)
            for j in range(chosen.shape[1]):
                chosen[:, j] = tried.argmin(axis=1)
                errors[:, j] = tried[rows, chosen[:, j]]
                tried[rows, chosen[:, j]] = np.inf
            parent, entry = chosen // k, chosen % k
            left = left[rows[:, None], parent] - c[entry]
            codes = np.concatenate([codes[rows[:, None], parent], entry[:, :, None].astype(np.uint8)], axis=2)
        return codes[rows, errors.argmin(axis=1)], norms


    def angles(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a code's inner product with a unit query is multiplied by to give the candidate's cosine without bias, and the tangent of the angle between both.

        Codes that point elsewhere say nothing: nought, and no bound.
        """
        scaled = x / np.abs(x).max(axis=1, keepdims=True)
        unit, sums = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True)), np.zeros(x.shape)
        for b, c in enumerate(self.books):
            sums += c[codes[:, b]]
        along, square = np.einsum("nd,nd->n", unit, sums), np.einsum("nd,nd->n", sums, sums)
        told = along > 0.1 * np.maximum(np.sqrt(square), 0.1)
        # What of the candidate is square to its code, not one less the cosine, which rounding makes nought for the nearest.
        square_to = unit - sums * np.divide(along, square, out=np.zeros(len(x)), where=told)[:, None]
        tangent = np.divide(np.sqrt(np.einsum("nd,nd->n", square_to, square_to) * square), along, out=np.full(len(x), np.inf), where=told)
        return np.divide(1.0, along, out=np.zeros(len(x)), where=told), tangent

    def usual_error(self, x: np.ndarray, queries: int = 256, near: int = 20) -> float:
        """Of pairs of a sample, all or the nearest to each query, or of directions without any order, whichever is largest."""
        unit, _ = directions(x)
        codes = np.concatenate([self.encode(x[i : i + 512])[0] for i in range(0, len(x), 512)])
        factor, tangent = self.angles(x, codes)
        sums = sum(c[codes[:, b]] for b, c in enumerate(self.books))
        true = unit[:queries].astype(float) @ unit.T
        off = off_by(true, unit[:queries] @ sums.T * factor, tangent)
        np.fill_diagonal(off, np.nan)
        nearest_ = np.argsort(-np.where(np.isnan(off), -np.inf, true), axis=1)[:, :near]
        return max(x.shape[1] ** -0.5, root_mean_square(off.ravel()), root_mean_square(np.take_along_axis(off, nearest_, axis=1).ravel()))


def off_by(true: np.ndarray, found: np.ndarray, tangent: np.ndarray) -> np.ndarray:
    """Errors of cosines in units of what the candidates' angles make of them; NaN where rounding is all there is."""
    unit = tangent * np.sqrt(np.maximum(0.0, 1 - true * true))
    return np.divide(true - found, unit, out=np.full(np.shape(true), np.nan), where=(unit > 100 * ROUNDING) & np.isfinite(unit))


def root_mean_square(x: np.ndarray) -> float:
    x = x[~np.isnan(x)]
    return float(np.sqrt((x * x).mean())) if len(x) else 0.0


def fit(vectors: DataFrame, sample: int = SAMPLE) -> Codebooks | None:
    """Codebooks for the sample of vectors with the smallest hashed ids."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec").toArrow()["vec"]
    return Codebooks.fitted(matrix(rows)) if len(rows) else None


def encoded(vectors: DataFrame, model: Codebooks) -> DataFrame:
    """vec_id, vec, codes, norm, factor, tangent of every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    kind = vectors.schema["vec"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = matrix(part.column(1))
                codes, norms = shared.value.encode(x)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), *map(pa.array, shared.value.angles(x, codes))], names=["vec_id", "vec", "codes", "norm", "factor", "tangent"])

    return vectors.select("vec_id", "vec").mapInArrow(run, f"vec_id bigint, vec {kind}, codes binary, norm double, factor double, tangent double")


def measured(q: np.ndarray, x: np.ndarray, measure: str) -> np.ndarray:
    """Exact scores of query rows with the candidates in the same rows of x, higher is nearer."""
    dot = np.einsum("nd,nd->n", q, x)
    if measure == "ip":
        return dot
    if measure == "l2":
        return -((q - x) ** 2).sum(axis=1)
    return dot / np.sqrt((q * q).sum(axis=1) * (x * x).sum(axis=1))


def list_length(k: int, n: int) -> int:
    """Candidates scored exactly for each query at least, of n in the table."""
    return k * max(8, math.ceil(math.log2(max(2, n))))


def block_share(length: int, blocks: int) -> int:
    """What a block gives to a list: its share, and three standard deviations of it, as candidates are dealt by hash."""
    mean = length / blocks
    return min(length, math.ceil(mean + 3 * math.sqrt(mean) + 3))


def rough_scores(model: Codebooks, q: np.ndarray, codes: np.ndarray, norms: np.ndarray, measure: str = "ip") -> Iterator[tuple[int, np.ndarray]]:
    """(first query, scores by query and candidate) by lookup tables, some queries at a time."""
    m, entries, d = model.books.shape
    flat = model.books.reshape(m * entries, d)
    unit, sizes = directions(q)
    step = max(8, min(256, PAIRS // max(1, len(codes))))
    for at in range(0, len(q), step):
        # Lookup tables with entries as rows: a candidate's score adds a row for each of its codes.
        look = flat @ unit[at : at + step].T
        rough = look[codes[:, 0]]
        for b in range(1, m):
            rough += look[b * entries + codes[:, b].astype(np.int64)]
        with np.errstate(over="ignore"):
            if measure == "ip":
                rough *= np.minimum(norms, BIG)[:, None].astype(np.float32)
            elif measure == "l2":
                rough = (2 * rough * norms[:, None] * sizes[None, at : at + step] - (norms * norms)[:, None]).astype(np.float32)
        yield at, np.ascontiguousarray(np.nan_to_num(np.clip(rough, -BIG, BIG, out=rough), copy=False, nan=-BIG).T)


def exact_nearest(model: Codebooks, q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray, factor: np.ndarray, tangent: np.ndarray, k: int, first: int, kth: int, measure: str = "ip") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(queries, places of their k nearest candidates in order, the exact scores, how many were scored), some queries at a time; ids rise, and a query isn't its own candidate.

    ``first`` candidates are scored at once, and then those that can still be as near as the ``kth`` of them.
    A score is size * (reach * cosine) - base, but for what is the same for all of a query's candidates.
    """
    first, kth = min(first, len(x)), min(kth, k)
    reach = {"ip": norms, "l2": 2 * norms, "cosine": np.ones(len(norms))}[measure]
    base = norms * norms if measure == "l2" else np.zeros(len(norms))
    sizes = np.sqrt((q * q).sum(axis=1))
    size, bias = (sizes, sizes * sizes) if measure == "l2" else (np.ones(len(q)), np.zeros(len(q)))
    ratio = 1 / directions(q)[1] if measure == "ip" else np.ones(len(q))
    steep = SURE * np.minimum(tangent, 1 / ROUNDING)
    exact = lambda a, b: np.concatenate([measured(q[a[i : i + 16_384]], x[b[i : i + 16_384]], measure) for i in range(0, len(a), 16_384)] or [np.empty(0)])
    for at, cosines in rough_scores(model, q, codes, factor):
        n = len(cosines)
        mine = slice(at, at + n)
        other = q_ids[mine, None] != ids
        value = np.where(other, cosines * reach * size[mine, None] - base, -np.inf)
        some = np.argpartition(value, len(x) - first, axis=1)[:, len(x) - first :]
        listed = np.zeros(value.shape, bool)
        np.put_along_axis(listed, some, True, axis=1)
        scores = exact(np.repeat(np.arange(at, at + n), first), some.ravel()).reshape(some.shape) * ratio[mine, None] + bias[mine, None]
        scores[~np.take_along_axis(other, some, axis=1)] = -np.inf
        bound = np.partition(scores, first - kth, axis=1)[:, first - kth] if first >= kth else np.full(n, -np.inf)
        # What the first list's scores tell of the errors.
        true = np.clip((scores + base[some]) / np.maximum(size[mine, None] * reach[some], np.finfo(float).tiny), -1, 1)
        off = off_by(true, np.take_along_axis(cosines, some, axis=1), tangent[some])
        known = np.count_nonzero(~np.isnan(off), axis=1)
        error = np.maximum(model.error, np.sqrt(np.nansum(off * off, axis=1) / np.maximum(known, 1)))
        a, b = np.nonzero(value >= bound[:, None] - size[mine, None] * (error[:, None] * (steep * reach) + ROUNDING * reach))
        # The largest cosine u with u - rough = most * sqrt(1 - u * u).
        most, rough = error[a] * steep[b], cosines[a, b].astype(float)
        u = np.minimum(1.0, (rough + most * np.sqrt(np.maximum(0.0, most * most + 1 - rough * rough))) / (1 + most * most)) + ROUNDING
        able = (size[at + a] * reach[b] * u - base[b] >= bound[a]) | np.isinf(tangent[b])
        listed[a[able], b[able]] = True
        a, b = np.nonzero(listed & other)
        scores = exact(at + a, b)
        best = np.lexsort((b, -scores, a))
        n_scored, a, b, scores = len(a), a[best], b[best], scores[best]
        top = np.arange(len(a)) - np.searchsorted(a, a) < k
        yield at + a[top], b[top], scores[top], n_scored


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, measure: str = "ip", column: str = "embedding", length: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, from all vectors."""
    spark = vectors.sparkSession
    ship(spark)
    work = Workspace(spark, "ann")
    base = usable(vectors, column, False)
    wide = base.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if wide is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    # Floats stay floats, which halves what travels and loses nothing.
    kind = "array<float>" if vectors.schema[column].dataType.simpleString() == queries.schema[column].dataType.simpleString() == "array<float>" else "array<double>"
    ready = lambda df: df.where(F.size("vec") == wide["d"]).select("vec_id", F.col("vec").cast(kind).alias("vec"))
    base, asked = ready(base), ready(usable(queries, column, False))
    model = fit(base)
    index = work.stage(encoded(base, model).withColumn("row", F.monotonically_increasing_id()), "index")
    asked = work.stage(asked.withColumn("row", F.monotonically_increasing_id()), "asked")
    n_queries, length = asked.count(), length or list_length(k, wide["n"])
    blocks, asks = blocks_for(wide["n"], max(4_096, COMPONENTS // wide["d"]), BLOCKS), blocks_for(n_queries, QUERY_ROWS, 1)
    first, kth = block_share(length, blocks), block_share(k, blocks)
    shared = spark.sparkContext.broadcast(model)
    left = asked.select("vec_id", "row", "vec", block_of(asks, 1).alias("qb"), every(blocks).alias("cb"))
    right = index.select("vec_id", "row", "vec", "codes", "norm", "factor", "tangent", block_of(blocks, 2).alias("cb"), every(asks).alias("qb"))

    def cell(q: pa.Table, c: pa.Table) -> pa.Table:
        kinds = {"query_row": pa.int64(), "query_id": pa.int64(), "row": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        found = []
        if q.num_rows and c.num_rows:
            order = np.lexsort((c["row"].to_numpy(), c["vec_id"].to_numpy()))
            cid, crow, norms, factor, tangent = (c[x].to_numpy()[order] for x in ("vec_id", "row", "norm", "factor", "tangent"))
            codes = np.frombuffer(b"".join(c["codes"].to_pylist()), np.uint8).reshape(len(cid), -1)[order]
            qid, qrow = q["vec_id"].to_numpy(), q["row"].to_numpy()
            for a, b, scores, _ in exact_nearest(shared.value, matrix(q["vec"]), qid, matrix(c["vec"])[order], cid, codes, norms, factor, tangent, k, first, kth, measure):
                found.append((qrow[a], qid[a], crow[b], cid[b], scores))
        cols = [np.concatenate(x) for x in zip(*found)] or [[]] * 5
        return pa.table([pa.array(x, t) for x, t in zip(cols, kinds.values())], names=list(kinds))

    scored = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(cell, "query_row bigint, query_id bigint, row bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
