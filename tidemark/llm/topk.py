"""Exact top-k by the three-phase uniform threshold.

A score is a sum over ``PARTS`` nodes, each of which holds one range of a vector's
components and can list its candidates by their local share of the score (nodes are split
further into blocks of candidates).

1. Every node gives each query the candidates with its highest local shares.  Their exact
   scores are resolved; the k-th highest is a score that k candidates reach: the cutoff.
2. The cutoff goes to all nodes.  Each gives every candidate whose local share is at least
   cutoff / PARTS.  A candidate that no node gives has a score below the cutoff.
3. Candidates given by all nodes have their score by addition; the others are resolved
   on their vectors.  The k highest are exact.

Candidates are the distinct vectors, so that copies of one vector are compared once; a vector found brings in the
rows with the smallest ids that hold it.  A vector that only rows of the query's own id hold is no candidate for it, in any
list; one that others hold too counts by the smallest id of theirs.  So k lists k, however many rows share an id.

Scores are integer inner products of floor(256 x), whatever the components: in doubles where these are exact, else in
Python's integers.  Scores beyond 62 bits are given as the nearest long that is not (both ways).

Defined results: null ids and vectors that are null, empty or hold null or non-finite
components take no part, nor do vectors of another length than most.  Rows with the same
vec_id are all candidates, but not for a query with that id; queries with the same vec_id are each answered.
Equal scores rank the smaller vec_id first.  Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, ship
from tidemark.llm.vectors import BLOCKS, CELL_PAIRS, best_pairs, block_of, blocks_for, every, matrix, resolved, usable

PARTS = 2
SCALE = 256
#: Candidates and queries in a block, about, and query-candidate pairs in memory at once.
BLOCK_ROWS, QUERY_ROWS, PAIRS = 65_536, 8_192, 1 << 23
#: Doubles are exact below this; scores and shares end at ``MOST``.
EXACT, MOST = 2.0**53, 2**62 - 1


def whole_numbers(vec: str = "vec"):
    """floor(256 x) of every component as doubles: from 2**53 on they are whole already."""
    big = F.lit(float(np.finfo(float).max))
    return F.transform(vec, lambda x: F.when(F.abs(x) < EXACT / SCALE, F.floor(x * SCALE).cast("double")).otherwise(F.least(big, F.greatest(-big, x * SCALE))))


def _python_dot(a: np.ndarray, b: np.ndarray) -> int:
    return max(-MOST, min(MOST, sum(int(x) * int(y) for x, y in zip(a, b))))


def sizes(x: np.ndarray) -> np.ndarray:
    return np.abs(x).max(axis=1, initial=0)


def inner(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of all rows of q with all of c, as longs."""
    with np.errstate(over="ignore", invalid="ignore"):
        s, bound = q @ c.T, sizes(q)[:, None] * sizes(c)[None] * q.shape[1]
    loose = bound >= EXACT
    out = np.where(loose, 0, s).astype(np.int64)
    for i, j in zip(*np.nonzero(loose)):
        out[i, j] = _python_dot(q[i], c[j])
    return out


def dots(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows side by side, as longs."""
    with np.errstate(over="ignore", invalid="ignore"):
        s, loose = np.einsum("nd,nd->n", q, c), sizes(q) * sizes(c) * q.shape[1] >= EXACT
    out = np.where(loose, 0, s).astype(np.int64)
    for i in np.flatnonzero(loose):
        out[i] = _python_dot(q[i], c[i])
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, column: str = "embedding", parts: int = PARTS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores among all vectors."""
    spark = vectors.sparkSession
    ship(spark)
    work = Workspace(spark, "topk")
    clean = usable(vectors, column)
    wide = clean.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("vec", F.abs))).alias("most")).orderBy(F.desc("n"), "d").first()
    if wide is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    d, own = wide["d"], usable(queries, column).where(F.size("vec") == wide["d"])
    most = max(wide["most"], own.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0] or 0.0)
    # The narrowest numbers that hold all components: they travel once for each block of queries.
    kind = "array<smallint>" if most < 100 else "array<int>" if most < 2**22 else "array<double>"
    ready = lambda df: df.select("vec_id", whole_numbers().cast(kind).alias("vec")).withColumn("row", F.monotonically_increasing_id())
    base, asked = work.stage(ready(clean.where(F.size("vec") == d)), "base"), work.stage(ready(own), "asked")
    # Of each vector the first ids, one more than places, with as many copies as any query can need: the k first rows without
    # those of one id, which is the query's own.
    ids = base.groupBy("vec", "vec_id").agg(F.count("*").alias("copies"), F.min("row").alias("row"))
    in_order = Window.partitionBy("vec").orderBy("vec_id")
    ids = ids.withColumn("nth", F.row_number().over(in_order)).where(F.col("nth") <= k + 1)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    spare = F.coalesce(F.max("copies").over(before) - F.sum("copies").over(before), F.lit(0)) + k
    first = F.first("row").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    members = work.stage(ids.select("vec", "vec_id", "row", "nth", first.alias("class"), F.lead("vec_id").over(in_order).alias("second"), F.least("copies", spare).alias("copies")), "members")
    index = members.where("nth = 1").select("vec", "vec_id", "row", "second")
    blocks, asks = blocks_for(index.count(), BLOCK_ROWS, BLOCKS), blocks_for(asked.count(), QUERY_ROWS, 1)
    edges = [round(d * i / parts) for i in range(parts + 1)]
    split = F.array(*(F.struct(F.lit(i).alias("part"), F.slice("vec", a + 1, b - a).alias("vec")) for i, (a, b) in enumerate(zip(edges, edges[1:]))))
    cut = lambda df: df.withColumn("x", F.explode(split)).withColumn("part", F.col("x.part")).withColumn("vec", F.col("x.vec")).drop("x")
    nodes = cut(index.withColumn("cb", block_of(blocks, 2)).withColumn("qb", every(asks)))
    asking = asked.withColumnRenamed("vec_id", "own").withColumn("qb", block_of(asks, 1)).withColumn("cb", every(blocks))
    names, shape = ["query_row", "row", "vec_id", "share"], "query_row bigint, row bigint, vec_id bigint, share bigint"

    def shares(ask: bool):
        def cell(q: pa.Table, c: pa.Table) -> pa.Table:
            found = []
            if q.num_rows and c.num_rows:
                order = np.lexsort((c["row"].to_numpy(), c["vec_id"].to_numpy()))
                cid, crow, cv = c["vec_id"].to_numpy()[order], c["row"].to_numpy()[order], matrix(c["vec"])[order]
                others, second = c["second"].is_valid().to_numpy()[order], c["second"].fill_null(0).to_numpy()[order]
                qrow, qid, qv = q["row"].to_numpy(), q["own"].to_numpy(), matrix(q["vec"])
                step = max(8, PAIRS // len(cid))
                for at in range(0, len(qrow), step):
                    s, mine = inner(qv[at : at + step], cv), qid[at : at + step, None] == cid
                    closed = mine & ~others
                    if ask:
                        low = q["cutoff"].slice(at, step).fill_null(-(2**63)).to_numpy()
                        a, b = np.nonzero((s >= (low // parts + (low % parts > 0))[:, None]) & ~closed)
                    else:
                        a, b = best_pairs(np.where(closed, -np.inf, s.astype(float)), k)
                    found.append((qrow[at + a], crow[b], np.where(mine[a, b], second[b], cid[b]), s[a, b]))
            cols = [np.concatenate(x) for x in zip(*found)] or [[]] * 4
            # A share at the end of the range may be cut off there: no addition is right with it.
            share = pa.array(cols[3], pa.int64(), mask=np.abs(np.asarray(cols[3], np.int64)) >= MOST)
            return pa.table([*(pa.array(x, pa.int64()) for x in cols[:3]), share], names=names)

        return cell

    def exactly(pairs: DataFrame) -> DataFrame:
        pairs = work.stage(pairs, "pairs")
        cells = max(1, -(-pairs.count() // (asks * CELL_PAIRS)))
        return resolved(pairs, asked, index, asks, cells, dots, "bigint")

    keys = ["qb", "cb", "part"]
    first = cut(asking).groupBy(*keys).cogroup(nodes.groupBy(*keys)).applyInArrow(shares(False), shape)
    known = exactly(first.select("query_row", "row", "vec_id").distinct())
    nth = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "row"))
    cutoffs = work.stage(known.withColumn("nth", nth).where(F.col("nth") == k).select(F.col("query_row").alias("row"), F.col("score").alias("cutoff")), "cutoffs")
    told = cut(asking.join(cutoffs, "row", "left"))
    given = told.groupBy(*keys).cogroup(nodes.groupBy(*keys)).applyInArrow(shares(True), shape)
    seen = given.groupBy("query_row", "row", "vec_id").agg(F.sum("share").alias("score"), F.count("share").alias("n"))
    seen = work.stage(seen, "seen")
    pair = ["query_row", "row", "vec_id"]
    scored = seen.where(F.col("n") == parts).select(*pair, "score").unionByName(exactly(seen.where(F.col("n") < parts).select(*pair)))
    high = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    found = scored.withColumn("nth", F.row_number().over(high)).where(F.col("nth") <= k).select("query_row", F.col("row").alias("class"), "score")
    whose = asked.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    rows = found.join(members.where("copies > 0").select("class", "vec_id", "copies"), "class").join(whose, "query_row").where("vec_id <> query_id")
    rows = rows.select("query_row", "query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
