"""What the two vector searches share: clean vectors, a grid of query and candidate blocks, exact scores of pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidate blocks at least, for parallelism.
BLOCKS = 12
#: Pairs scored on their vectors in one cell, about.
CELL_PAIRS = 65_536


def usable(vectors: DataFrame, column: str = "embedding", zero: bool = True) -> DataFrame:
    """(vec_id, vec array<double>) of the vectors that take part.

    Null ids, null or empty vectors, vectors with null or non-finite components, and with
    ``zero=False`` also all-zero ones, take no part.
    """
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(column).cast("array<double>").alias("vec")).where("vec_id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = v.where(F.coalesce(fine, F.lit(False)))
    return v if zero else v.where(F.exists("vec", lambda x: x != 0))


def block_of(n: int, salt: int, column: str = "row") -> Column:
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(n)).cast("int")


def blocks_for(rows: int, most: int, least: int) -> int:
    return max(least, -(-rows // most))


def every(n: int) -> Column:
    """The numbers of all blocks, one row each."""
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float) if len(column) else np.empty((0, 0))


def best_pairs(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest scores, ties to the smaller column, in order; -inf marks what can't be taken."""
    k = min(k, scores.shape[1])
    cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    a, b = np.nonzero((scores >= cut) & ~np.isneginf(scores))
    s = scores[a, b]
    order = np.lexsort((b, -s, a))
    a, b = a[order], b[order]
    nth = np.arange(len(a)) - np.searchsorted(a, a)
    return a[nth < k], b[nth < k]


def resolved(pairs: DataFrame, asked: DataFrame, index: DataFrame, asks: int, cells: int, score: Callable, kind: str) -> DataFrame:
    """Pairs (query_row, row, vec_id) with their score: ``score`` gets the vectors of many pairs side by side.

    Pairs are dealt to ``asks`` times ``cells`` groups by query block and candidate, and each group fetches the vectors
    it needs once: a vector travels at most once for each query block, however many queries want it.
    """
    keyed = pairs.select("query_row", "row", "vec_id", block_of(asks, 1, "query_row").alias("qb"), block_of(cells, 5).alias("cell"))
    wanted = keyed.select("qb", "cell", "row").distinct().join(index.select("row", "vec"), "row").select("qb", "cell", F.lit(False), "row", "vec").toDF("qb", "cell", "is_query", "row", "vec")
    asking = asked.select(block_of(asks, 1).alias("qb"), every(cells).alias("cell"), F.lit(True).alias("is_query"), "row", "vec")
    of = {"double": pa.float64(), "bigint": pa.int64()}[kind]

    def cell(p: pa.Table, v: pa.Table) -> pa.Table:
        if not p.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), of)], names=["query_row", "row", "vec_id", "score"])
        is_query, rows, vec, found = v["is_query"].to_numpy(), v["row"].to_numpy(), matrix(v["vec"]), []
        sides = []
        for name, mine in (("query_row", np.flatnonzero(is_query)), ("row", np.flatnonzero(~is_query))):
            mine = mine[np.argsort(rows[mine])]
            sides.append(mine[np.searchsorted(rows[mine], p[name].to_numpy())])
        for at in range(0, p.num_rows, 16_384):
            found.append(score(vec[sides[0][at : at + 16_384]], vec[sides[1][at : at + 16_384]]))
        return pa.table([p["query_row"], p["row"], p["vec_id"], pa.array(np.concatenate(found), of)], names=["query_row", "row", "vec_id", "score"])

    return keyed.groupBy("qb", "cell").cogroup(wanted.unionByName(asking).groupBy("qb", "cell")).applyInArrow(cell, f"query_row bigint, row bigint, vec_id bigint, score {kind}")
