"""Line deduplication against levelled, sorted runs of line hashes.

The index is a set of *runs*: tables of (line hash, first document), bucketed and sorted by hash,
no hash in two of them.  Documents come in batches of ascending doc_id.  A batch first
groups its own hashes, in the runs' buckets, and merge-joins every run: what none of them has (the anti-join) becomes a run of
level 0.  When a level holds ``fanout`` runs they are merged into one of the next level, so
there are O(log batches) runs to join at any time.  As a bucket is one sorted file, buckets are merged with buckets as they
are read: no run is ever shuffled or sorted again, be it to be joined or to be compacted (only the compacted rows, which
come merged, pass the sort of the table's writer).
Hashes that two documents have, in a batch or across runs, become *repeats* with their first document; only they are
joined with all occurrences, and a line goes if its document comes after the first.
Only 16-byte hashes and ids are shuffled for this; each text
is shuffled once, to meet its document's list of lines to drop.

One hash may stand in a third of all documents.  First documents are found by a partial
aggregate, one row for each task and hash; the join of all occurrences with the repeats is a
join of two scans, which Spark splits where a key is heavy.

Defined results: doc_id is a number.  Null and empty texts are one empty line.  Rows of the same doc_id count as
one document, and keep or lose a line together.  Rows with a null doc_id neither give nor
lose lines.  Lines with keys under ``min_points`` code points stay.  An empty table gives
no rows.  Columns of the documents keep their names and values, whatever they are called; ours get
another name where it is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, fresh, ship

MIN_POINTS = 10
#: Batches at least, and documents of a batch beyond that.
BATCHES, BATCH_DOCS = 4, 50_000_000
FANOUT = 2
#: Whether the order of a bucketed table's files is used, if each bucket is one file; Spark asks for it by this name only.
SORTED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"
_BLANK = b" \t\n\x0b\x0c\r"


def line_hash(line: bytes, min_points: int) -> bytes | None:
    """The 16-byte hash of a line's key; none if the key is too short."""
    key = line.strip(_BLANK).lower()
    n = len(key)
    if n < min_points or (n < 4 * min_points and len(key.decode("utf-8", "replace")) < min_points):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def line_hashes(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(doc_id, line_hash), once for each distinct key of a row."""
    ship(docs.sparkSession)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            which: list[int] = []
            found: list[bytes] = []
            for i, text in enumerate(texts):
                text = text.as_py()
                own = {h for line in set((text or b"").split(b"\n")) if (h := line_hash(line, min_points))}
                which += [i] * len(own)
                found += own
                if len(found) > 200_000:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), pa.array(found, pa.binary())], names=["doc_id", "line_hash"])
                    which, found = [], []
            if found:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), pa.array(found, pa.binary())], names=["doc_id", "line_hash"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(hashes, f"doc_id {kind}, line_hash binary")


@contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """What is planned herein reads buckets as sorted files."""
    before = spark.conf.get(SORTED_BUCKETS, None)
    spark.conf.set(SORTED_BUCKETS, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SORTED_BUCKETS)
        else:
            spark.conf.set(SORTED_BUCKETS, before)


def merged_runs(runs: list[DataFrame]) -> DataFrame:
    """Runs, which share no hash, as one: bucket by bucket, both sides read in order."""
    out = runs[0]
    for other in runs[1:]:
        other = other.select(F.col("line_hash").alias("other_hash"), F.col("first_doc").alias("other_doc"))
        out = out.hint("merge").join(other, F.col("line_hash") == F.col("other_hash"), "full")
        out = out.select(F.coalesce("line_hash", "other_hash").alias("line_hash"), F.coalesce("first_doc", "other_doc").alias("first_doc"))
    return out


class LineRuns:
    """The levelled runs; ``add`` takes the next batch, whose doc_ids follow all earlier ones, and returns its repeats."""

    def __init__(self, work: Workspace, fanout: int = FANOUT):
        self.work, self.fanout = work, fanout
        self.levels: list[list[DataFrame]] = []
        self.tables: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        with sorted_buckets(self.work.spark):
            self.tables.append(self.work.bucketed(df, name, "line_hash"))
        return self.tables[-1]

    def add(self, pairs: DataFrame) -> DataFrame:
        """(line_hash, first_doc) of the batch's hashes that two documents have, counting the earlier batches."""
        own = pairs.groupBy("line_hash").agg(F.min("doc_id").alias("first_doc"), (F.min("doc_id") < F.max("doc_id")).alias("again"))
        known = [F.lit(None)]
        for k, run in enumerate(self.runs()):
            own = own.hint("merge").join(run.select("line_hash", F.col("first_doc").alias(f"known_{k}")), "line_hash", "left")
            known.append(F.col(f"known_{k}"))
        batch = self._write(own.select("line_hash", "first_doc", "again", F.coalesce(*known).cast(pairs.schema["doc_id"].dataType).alias("known")), "batch")
        self._put(0, batch.where("known IS NULL").select("line_hash", "first_doc"))
        return batch.where("again OR known IS NOT NULL").select("line_hash", F.coalesce("known", "first_doc").alias("first_doc"))

    def _put(self, level: int, run: DataFrame) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._write(merged_runs(full), f"run-{level + 1}"))


def dropped_lines(docs: DataFrame, work: Workspace, min_points: int = MIN_POINTS, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, lines): the hashes that each document loses; documents that lose none have no row."""
    pairs = line_hashes(docs, min_points)
    if batches is None:
        batches = max(BATCHES, docs.count() // BATCH_DOCS)
    edges = docs.where("doc_id IS NOT NULL").approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = sorted(set(edges))
    nth = F.lit(0)
    for e in edges:
        nth = nth + (F.col("doc_id") > e).cast("int")
    pairs = work.stage(pairs.withColumn("batch", nth), "pairs", ["batch"])
    index, repeats = LineRuns(work, fanout), None
    for k in range(len(edges) + 1):
        found = index.add(pairs.where(F.col("batch") == k).select("doc_id", "line_hash"))
        repeats = found if repeats is None else repeats.unionByName(found)
    # A hash that came again in several batches has the same first document each time.
    repeats = repeats.groupBy("line_hash").agg(F.min("first_doc").alias("first_doc"))
    gone = pairs.select("doc_id", "line_hash").join(repeats, "line_hash").where("first_doc < doc_id")
    out = work.stage(gone.groupBy("doc_id").agg(F.collect_set("line_hash").alias("lines")), "drops")
    work.drop(pairs, *index.tables)
    return out


def _lines_kept(text: bytes | None, gone: set[bytes], min_points: int) -> tuple[int, list[bytes]]:
    lines = (text or b"").split(b"\n")
    return len(lines), [x for x in lines if line_hash(x, min_points) not in gone] if gone else lines


def _with_kept(docs: DataFrame, name: str, min_points: int, batches: int | None, fanout: int) -> DataFrame:
    """The docs with a column of (text, n_lines, n_dropped, kept_sha256)."""
    spark = docs.sparkSession
    ship(spark)
    drops = dropped_lines(docs.select("doc_id", "text"), Workspace(spark, "lines"), min_points, batches, fanout)
    key, lines = fresh(docs, "drop_doc_id", "drop_lines")

    @F.arrow_udf("struct<text: string, n_lines: bigint, n_dropped: bigint, kept_sha256: string>")
    def keep(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for text, hashes in zip(texts.cast(pa.binary()).to_pylist(), gone.to_pylist(), strict=True):
            n, kept = _lines_kept(text, set(hashes or ()), min_points)
            whole = b"\n".join(kept)
            out.append((whole.decode(), n, n - len(kept), hashlib.sha256(whole).hexdigest()))
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.StructArray.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names=["text", "n_lines", "n_dropped", "kept_sha256"])

    joined = docs.join(drops.select(F.col("doc_id").alias(key), F.col("lines").alias(lines)), F.col("doc_id") == F.col(key), "left")
    return joined.withColumn(name, keep(F.col("text"), F.col(lines))).drop(key, lines)


def dedup_lines(docs: DataFrame, min_points: int = MIN_POINTS, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """All columns of ``docs`` with the kept lines as text, plus n_lines, n_dropped and kept_sha256."""
    (new,) = fresh(docs, "kept")
    done = _with_kept(docs, new, min_points, batches, fanout)
    stats = ("n_lines", "n_dropped", "kept_sha256")
    return done.select(*[F.col(f"{new}.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], *(F.col(f"{new}.{c}").alias(a) for c, a in zip(stats, fresh(docs, *stats))))


def line_dedup_stage(docs: DataFrame, min_points: int = MIN_POINTS, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """The columns of ``docs``, with duplicate lines gone from text and n_chars brought up to date."""
    (new,) = fresh(docs, "kept")
    done = _with_kept(docs, new, min_points, batches, fanout)
    ours = {"text": F.col(f"{new}.text")}
    if "n_chars" in docs.columns:
        ours["n_chars"] = F.length(f"{new}.text").cast(docs.schema["n_chars"].dataType)
    return done.select(*(ours[c].alias(c) if c in ours else F.col(f"`{c}`") for c in docs.columns))
