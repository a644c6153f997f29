"""SimHash near-duplicates: tiled exact comparison with exclusive-or and bit counts.

Fingerprints that differ in at most r bits have bit counts that differ by at most r, in all
and summed over any parts.  Distinct fingerprints are split by bit count, large counts into
blocks of bounded size, and each block meets the blocks of its own and the next r counts in
one cell.  A cell sorts both sides by the bit counts of their sixteen-bit parts, cuts them
into tiles, and compares only tile pairs whose bounds allow r differing bits in all.
So every pair within the radius is found and no other work is done.

A cell answers with a spanning forest of its links, at most one row for each fingerprint,
whatever the number of linked pairs.  Forests are joined by contracting stars over written
tables, O(log n) rounds.  Fingerprints, links and components stay in Spark; the driver
sees 65 counts.

Defined results: null and empty texts, and texts without words, have fingerprint zero and are
linked like any other.  Rows with the same doc_id each have their fingerprint and the component of that
fingerprint: rows of one doc_id whose fingerprints aren't linked are in different components, though both
may be called by that id.  Rows with a null doc_id are returned with a null component and link
nothing.  Of each component the stage keeps the row with the smallest doc_id, then fingerprint, then hash of its text.  An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, fresh, ship

RADIUS = 3
WORDS = 3
SEED = 42
#: Fingerprints in a block at most (about; blocks are dealt by hash).
BLOCK = 1 << 15
TILE = 512
#: Fingerprints that a task compares with others, about.
TASK_PRINTS = 1 << 15


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint of a text's word shingles, repeats included."""
    import xxhash

    split = (text or b"").lower().split()
    if not split:
        return 0
    if len(split) <= words:
        return xxhash.xxh64_intdigest(b" ".join(split), SEED)
    whole = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(split) - words + 1].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(whole[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())])
    n, votes = len(starts), np.zeros(64, np.int64)
    view = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for k in range(0, n, 16_384):
        votes += np.unpackbits(view[k : k + 16_384], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, name: str = "fp", words: int = WORDS) -> DataFrame:
    """The docs with a signed 64-bit fingerprint column of that name."""
    ship(docs.sparkSession)

    @F.arrow_udf("bigint")
    def prints(texts: pa.Array) -> pa.Array:
        found = [fingerprint(t.as_py(), words) for t in texts.cast(pa.binary())]
        return pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())

    return docs.withColumn(name, prints(F.col("text")))


def _parts(fps: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count((fps >> np.uint64(s)) & np.uint64(0xFFFF)).astype(np.int16) for s in (48, 32, 16, 0)], axis=1)


def _tiles(fps: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by part counts; the tiles' first rows and lowest and highest part counts."""
    parts = _parts(fps)
    order = np.lexsort(parts.T[::-1])
    parts = parts[order]
    first = np.arange(0, len(fps), tile)
    return order, first, np.minimum.reduceat(parts, first), np.maximum.reduceat(parts, first)


class _Forest:
    """Union-find over the rows of a cell, smallest row as root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if np.array_equal(r, s):
                return r
            r = s

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            if not apart.any():
                return
            lo, hi = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.up, hi, lo)
            a, b = lo, hi


def link_cell(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within the radius: of left's own, or of left and right."""
    own = right is None
    fps = left if own else np.concatenate([left, right])
    shift = 0 if own else len(left)
    right = left if own else right
    lo, lf, llow, lhigh = _tiles(left, tile)
    ro, rf, rlow, rhigh = (lo, lf, llow, lhigh) if own else _tiles(right, tile)
    ls, rs = left[lo], right[ro]
    forest = _Forest(len(fps))
    for i, a in enumerate(lf):
        gap = np.maximum(0, np.maximum(llow[i] - rhigh, rlow - lhigh[i])).sum(axis=1)
        for j in np.flatnonzero(gap <= radius):
            if own and j < i:
                continue
            b = rf[j]
            x, y = np.nonzero(np.bitwise_count(ls[a : a + tile, None] ^ rs[None, b : b + tile]) <= radius)
            if own and i == j:
                x, y = x[x < y], y[x < y]
            if len(x):
                forest.link(lo[a + x], ro[b + y] + shift)
    root = forest.roots(np.arange(len(fps)))
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def links(prints: DataFrame, work: Workspace, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): edges that connect just what distinct fingerprints within the radius connect.

    ``prints`` has the distinct fingerprints as column fp.
    """
    sized = prints.withColumn("ones", F.bit_count("fp").cast("int"))
    counts = {r["ones"]: r["n"] for r in sized.groupBy("ones").agg(F.count("*").alias("n")).collect()}
    blocks = {p: -(-n // block) for p, n in counts.items()}
    # By a block's own count: the other count, the blocks of either, whether this side is left.
    spark = prints.sparkSession
    plan = [(p, q, blocks[q], blocks[p], True) for p in blocks for q in range(p, p + radius + 1) if q in blocks]
    plan += [(q, p, blocks[p], blocks[q], False) for p in blocks for q in range(p, p + radius + 1) if q in blocks]
    meets = spark.createDataFrame(plan or [(0, 0, 1, 1, True)], "ones int, other int, other_blocks int, own_blocks int, is_left boolean")
    dealt = (
        sized.join(F.broadcast(meets), "ones")  # at most 65 * (2 * radius + 2) rows
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("own_blocks")).cast("int"))
        .withColumn("across", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
        # Within one count, the cell of blocks s <= t has s on the left; the cell of s and s has it once.
        .where((F.col("ones") != F.col("other")) | F.when(F.col("is_left"), F.col("own") <= F.col("across")).otherwise(F.col("across") < F.col("own")))
        .select(
            F.least("ones", "other").alias("p"), F.greatest("ones", "other").alias("q"),
            F.when(F.col("is_left"), F.col("own")).otherwise(F.col("across")).alias("s"), F.when(F.col("is_left"), F.col("across")).otherwise(F.col("own")).alias("t"),
            "is_left", "fp",
        )
    )

    # So many tasks as the comparisons need; Spark would judge by their few bytes.
    dealt_rows = sum(counts[p] * sum(blocks[q] for q in range(p - radius, p + radius + 1) if q in blocks) for p in counts)
    dealt = dealt.repartition(max(1, -(-dealt_rows // TASK_PRINTS)), "p", "q", "s", "t")

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        same = False
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            is_left = batch.column("is_left").to_numpy(zero_copy_only=False).astype(bool)
            sides[0].append(fp[is_left])
            sides[1].append(fp[~is_left])
            same = bool(batch.num_rows) and all(batch.column(x)[0].as_py() == batch.column(y)[0].as_py() for x, y in (("p", "q"), ("s", "t")))
        left, right = (np.sort(np.concatenate(s)) if s else np.empty(0, np.uint64) for s in sides)
        if not len(left) or not (same or len(right)):
            return
        a, b = link_cell(left, None if same else right, radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return work.stage(dealt.groupBy("p", "q", "s", "t").applyInArrow(cell, "a bigint, b bigint"), "links")


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, root): every node of the edges (a, b) with the smallest of its component.

    Each round ties all neighbours of a node, and the node, to the smallest of them.
    When nothing changes any more every component is one star.
    """
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = work.stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("low")), "low")
        tied = both.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        new = work.stage(tied.where("a <> b").distinct(), "edges")
        work.drop(low, edges)
        edges, after = new, mark(new)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """doc_id, fp (signed 64-bit), root_fp (the component's smallest fingerprint), component_id: the smallest doc_id reachable by links."""
    work = Workspace(docs.sparkSession, "simhash")
    prints = work.stage(with_fingerprint(docs.select("doc_id", "text"), "fp", words).select("doc_id", "fp"), "prints")
    known = prints.where("doc_id IS NOT NULL")
    firsts = work.stage(known.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "firsts")
    roots = components(links(firsts.select("fp"), work, radius, block), work)
    rooted = work.stage(firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_doc"), "rooted")
    smallest = work.stage(rooted.groupBy("root").agg(F.min("first_doc").alias("component_id")), "smallest")
    classes = work.stage(rooted.select("fp", "root").join(smallest, "root").select(F.col("fp").alias("class_fp"), F.col("root").alias("root_fp"), "component_id"), "classes")
    found = prints.join(classes, F.col("fp") == F.col("class_fp"), "left")
    known_id = F.col("doc_id").isNotNull()
    return found.select("doc_id", "fp", F.when(known_id, F.col("root_fp")).alias("root_fp"), F.when(known_id, F.col("component_id")).alias("component_id"))


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def simhash_stage(docs: DataFrame, **options) -> DataFrame:
    """One document of each group stays, as the module says; rows without a doc_id stay.

    Ids mostly have one row, and are kept by id.  Only rows of repeated ids are told apart by fingerprint and text.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "simhash-keep")
    groups = work.stage(near_duplicates(docs, **options).where("doc_id IS NOT NULL").select("doc_id", "fp", "root_fp"), "groups")
    keep = work.stage(groups.groupBy("root_fp").agg(F.min(F.struct("doc_id", "fp")).alias("k")).select(F.col("k.doc_id").alias("keep_id"), F.col("k.fp").alias("keep_fp")), "keep")
    repeated = work.stage(groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("repeated_id")), "repeated")
    once = keep.join(repeated, F.col("keep_id") == F.col("repeated_id"), "left_anti")
    stay = docs.join(once, F.col("doc_id") == F.col("keep_id"), "left_semi")
    fp, nth = fresh(docs, "stage_fp", "stage_nth")
    several = with_fingerprint(docs.join(repeated, F.col("doc_id") == F.col("repeated_id"), "left_semi"), fp)
    several = several.join(keep, (F.col("doc_id") == F.col("keep_id")) & (F.col(fp) == F.col("keep_fp")), "left_semi")
    alike = Window.partitionBy("doc_id", fp).orderBy(F.xxhash64("text"), "text")
    several = several.withColumn(nth, F.row_number().over(alike)).where(F.col(nth) == 1).drop(fp, nth)
    return stay.unionByName(several).unionByName(docs.where("doc_id IS NULL"))
