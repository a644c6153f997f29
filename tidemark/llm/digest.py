"""Fingerprints of improbable features, compared by the bits that they share.

Every window of 32 bytes of a text has an entropy; how rare that entropy is among all windows of the corpus is its
rank (``fit_rarity``: one pass, one histogram).  Of each 64 windows in a row the rarest, the first of equals, gets a
vote, and windows with 16 votes are the text's features.  Windows under one bit of entropy say nothing and are never features.
A feature sets five bits of a Bloom filter of 2,048; after 160 features the next filter of the chain begins.  The
fingerprint is the number of features and the filters in base 64.

Two chains are compared from the one with fewer features: each of its filters takes the best of the other chain's, by the shared
bits beyond what chance gives (two deviations above the mean) over the most that they could share; filters count by their
features.  Equal fingerprints have likeness 1.

The successor of each document in an order, whose beginning replaces the end of the edited text, stands in the row after it: documents
are dealt by range of the order and each task reads its own in turn.  Only the first and the last row of a task meet
rows of other tasks; they are written with their texts, two a task, and are joined by task.

Defined results: a null text is empty.  A text without features (empty texts have none, nor has a text whose windows are all weak)
has one, the text itself, unless it is empty.  Rows of one id, and of a null id, which come last, follow each
other by hash of the text and then the text; the row after the last is the first.  A text is held by one task, but its windows
in pieces.  An empty table gives no rows.  Only the id and the text are read; other columns go.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, ship

WINDOW = 32
#: Windows that vote for one of them, and the votes of a feature.
AROUND, VOTES = 64, 16
#: Steps of a bit of entropy, and the least entropy of a feature in bits.
STEPS, LEAST_BITS = 200, 1
#: Bits of a filter, of a feature in it, features of a full filter.
BITS, HASHES, FULL = 2048, 5, 160
#: Windows of a piece of a long text, bytes in work at once, and windows side by side in a lane.
PIECE, WORK, LANE = 1 << 19, 1 << 20, 512
_ONE = 1 << 16
#: c log2 c in whole numbers, so that entropies don't depend on how texts are cut.
_LOGS = np.array([0] + [round(c * np.log2(c) * _ONE) for c in range(1, WINDOW + 1)], np.int32)
_UP = np.append(_LOGS[1:] - _LOGS[:-1], 0).astype(np.int32)
_TOP = WINDOW.bit_length() - 1
BINS = _TOP * STEPS + 1


def entropy_bins(data: np.ndarray) -> np.ndarray:
    """The binned entropy of each window of the bytes, from the window before by the byte that goes and the one that comes.

    Many stretches of the bytes are taken side by side.
    """
    n = len(data) - WINDOW + 1
    if n < 1:
        return np.empty(0, np.int16)
    lanes = -(-n // LANE)
    padded = np.zeros((lanes + 1) * LANE + WINDOW, np.uint8)
    padded[: len(data)] = data
    side = np.lib.stride_tricks.as_strided(padded, (lanes, LANE + WINDOW), (LANE, 1))
    table = np.ascontiguousarray(side.T).astype(np.int32) + np.arange(0, lanes * 256, 256, dtype=np.int32)
    counts, sums, out = np.zeros(lanes * 256, np.uint8), np.zeros(lanes, np.int32), np.empty((LANE, lanes), np.int32)
    for k in range(LANE + WINDOW - 1):
        if k >= WINDOW:
            gone = table[k - WINDOW]
            left = counts[gone] - np.uint8(1)
            counts[gone] = left
            sums -= _UP[left]
        come = table[k]
        c = counts[come]
        counts[come] = c + np.uint8(1)
        sums += _UP[c]
        if k >= WINDOW - 1:
            out[k - WINDOW + 1] = sums
    sums = np.ascontiguousarray(out.T).ravel()[:n].astype(np.int64)
    return ((_TOP * WINDOW * _ONE - sums) * STEPS // (WINDOW * _ONE)).clip(0).astype(np.int16)


def fit_rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The rank of each entropy bin, 0 for the rarest among the windows of all texts; weak bins have none (-1)."""
    ship(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            for texts in _groups(t.as_py() or b"" for t in batch.column(0).cast(pa.binary())):
                for _, bins in _binned(texts, 0):
                    total += np.bincount(np.concatenate(bins), minlength=BINS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there])], names=["bin", "n"])

    counts = docs.select(text).mapInArrow(counted, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))
    seen = np.zeros(BINS, np.int64)
    for r in counts.collect():  # at most BINS rows
        seen[r["bin"]] = r["n"]
    ranks = np.empty(BINS, np.int16)
    ranks[np.lexsort((np.arange(BINS), seen))] = np.arange(BINS)
    ranks[: LEAST_BITS * STEPS] = -1
    return ranks


def _binned(texts: list[bytes], beside: int) -> Iterator[tuple[list[tuple], list[np.ndarray]]]:
    """Pieces (text, first window, end, first window measured) and the bins of each, with so many windows beside it as the text has."""
    pieces = []
    for k, t in enumerate(texts):
        n = len(t) - WINDOW + 1
        pieces += [(k, at, min(n, at + PIECE), max(0, at - beside), min(n, at + PIECE + beside)) for at in range(0, max(0, n), PIECE)]
    done = 0
    while done < len(pieces):
        some, size = [], 0
        while done < len(pieces) and (not some or size + pieces[done][4] - pieces[done][3] <= WORK):
            some.append(pieces[done])
            size += pieces[done][4] - pieces[done][3] + WINDOW - 1
            done += 1
        found = entropy_bins(np.frombuffer(b"".join(texts[k][a : b + WINDOW - 1] for k, _, _, a, b in some), np.uint8))
        bins, at = [], 0
        for _, _, _, a, b in some:
            bins.append(found[at : at + b - a])
            at += b - a + WINDOW - 1
        yield [p[:4] for p in some], bins


def features(texts: list[bytes], ranks: np.ndarray) -> list[list[bytes]]:
    """The hashes of each text's features, in order, each once."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    found: list[list[bytes]] = [[] for _ in texts]
    gap, worst = AROUND - 1, np.int64(1) << 62
    for some, bins in _binned(texts, gap):
        starts, at = [], gap
        keys = np.full(sum(len(b) + gap for b in bins) + gap, worst)
        for b in bins:
            own = ranks[b].astype(np.int64)
            keys[at : at + len(b)] = np.where(own < 0, worst, own << 32 | np.arange(at, at + len(b)))
            starts.append(at)
            at += len(b) + gap
        best, wide = keys, 1
        while wide < AROUND:
            best = np.minimum(best[:-wide], best[wide:])
            wide *= 2
        votes = np.bincount(best[best < worst] & 0xFFFFFFFF, minlength=1)
        chosen = np.flatnonzero(votes >= VOTES)
        of = np.searchsorted(starts, chosen, "right") - 1
        windows = chosen - np.array(starts)[of] + np.array([p[3] for p in some])[of]
        for p, w in zip(of.tolist(), windows.tolist()):
            k, first, end = some[p][:3]
            if first <= w < end:
                found[k].append(digest(texts[k][w : w + WINDOW]))
    return [list(dict.fromkeys(f)) or ([digest(t)] if t else []) for f, t in zip(found, texts)]


def filters(hashes: list[bytes]) -> np.ndarray:
    """The chain of filters, a row of bytes each."""
    if not hashes:
        return np.empty((0, BITS // 8), np.uint8)
    spots = np.frombuffer(b"".join(hashes), "<u2").reshape(len(hashes), 8)[:, :HASHES] & np.uint16(BITS - 1)
    chain = np.zeros((-(-len(hashes) // FULL), BITS), bool)
    chain[np.repeat(np.arange(len(hashes)) // FULL, HASHES), spots.ravel()] = True
    return np.packbits(chain, axis=1)


def written(count: int, chain: np.ndarray) -> str:
    return f"{count}:{base64.b64encode(chain.tobytes()).decode()}"


def read(fingerprint: str) -> tuple[int, np.ndarray]:
    count, _, rest = fingerprint.partition(":")
    return int(count), np.frombuffer(base64.b64decode(rest), np.uint8).reshape(-1, BITS // 8)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """0 to 1 for two (features, chain)."""
    if a[0] == b[0] and np.array_equal(a[1], b[1]):
        return 1.0
    if not a[0] or not b[0]:
        return 0.0
    few, many = (a, b) if a[0] <= b[0] else (b, a)
    left, right = (np.ascontiguousarray(x[1]).view(np.uint64) for x in (few, many))
    there = np.bitwise_count(right).sum(axis=1, dtype=np.int64)
    total = 0.0
    for k, row in enumerate(left):
        own = int(np.bitwise_count(row).sum())
        mean = own * there / BITS
        chance = mean + 2 * np.sqrt(mean * (BITS - own) * (BITS - there) / (BITS * (BITS - 1)))
        most = np.minimum(own, there)
        shared = np.bitwise_count(row & right).sum(axis=1, dtype=np.int64)
        score = np.where(most > chance, (shared - chance) / np.maximum(most - chance, 1e-9), shared >= most)
        total += min(1.0, max(0.0, float(score.max()))) * min(FULL, few[0] - k * FULL)
    return min(total / few[0], 1.0)


def with_fingerprint(docs: DataFrame, ranks: np.ndarray, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """The docs with a fingerprint column of that name."""
    ship(docs.sparkSession)

    @F.arrow_udf("string")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([written(len(h), filters(h)) for some in _groups(t.as_py() or b"" for t in texts.cast(pa.binary())) for h in features(some, ranks)], pa.string())

    return docs.withColumn(name, prints(F.col(text)))


def with_likeness(pairs: DataFrame, left: str, right: str, name: str = "likeness") -> DataFrame:
    """The likeness of two fingerprint columns; null where one is null."""
    ship(pairs.sparkSession)

    @F.arrow_udf("double")
    def compared(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else likeness(read(x), read(y)) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

    return pairs.withColumn(name, compared(F.col(left), F.col(right)))


def _groups(texts) -> Iterator[list[bytes]]:
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > WORK:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def edited(text: str, after: str) -> str:
    """The text whose last third is replaced by as many code points of the next text's beginning."""
    gone = len(text) // 3
    return text[: len(text) - gone] + after[:gone]


def _measured(texts: list[str], ranks: np.ndarray) -> list[tuple]:
    """(n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each text but the last, which only follows."""
    changed = [edited(t, u).encode() for t, u in zip(texts, texts[1:])]
    found = features([t.encode() for t in texts] + changed, ranks)
    chains = [(len(h), filters(h)) for h in found]
    out = []
    for k, (t, c) in enumerate(zip(texts, changed)):
        own, new = chains[k], chains[len(texts) + k]
        out.append((len(t), hashlib.sha256(c).hexdigest(), written(*own), written(*new), likeness(own, new), likeness(own, chains[k + 1])))
    return out


RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def successor_digests(docs: DataFrame, ranks: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document, by falling id, with its fingerprint, that of its text edited by the next one's, and what is alike."""
    spark = docs.sparkSession
    ship(spark)
    work, id_type = Workspace(spark, "digest"), docs.schema[doc_id].dataType.simpleString()
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    ranged = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    ranged = ranged.repartitionByRange(*order).sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id())

    def in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of all rows but the last, whose row has its text instead, as has the first's."""
        ids, texts, size, first = [], [], 0, True
        part = id_kind = None

        def results(last: bool) -> pa.RecordBatch:
            nonlocal first
            found = _measured(texts, ranks) + [(None,) * len(_NAMES)] * last
            edge = [(1 if first and k == 0 else 0) + (2 if last and k == len(found) - 1 else 0) for k in range(len(found))]
            first = False
            columns = [pa.array([r[c] for r in found], kind) for c, kind in enumerate(_TYPES)]
            kept = pa.array([t if e else None for t, e in zip(texts, edge)], pa.string())
            return pa.RecordBatch.from_arrays([pa.array(ids[: len(found)], id_kind), *columns, pa.array([part] * len(found), pa.int32()), pa.array(edge, pa.int32()), kept], names=["doc_id", *_NAMES, "part", "edge", "text"])

        for batch in batches:
            id_kind = batch.column("doc_id").type
            for i, t, p in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("part").to_pylist()):
                part, t = p, t.as_py()
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size > WORK and len(texts) > 1:
                    yield results(False)
                    ids, texts, size = ids[-1:], texts[-1:], len(t)
        if texts:
            yield results(True)

    found = work.stage(ranged.mapInArrow(in_turn, f"doc_id {id_type}, {RESULT}, part int, edge int, text string"), "found")
    edges = found.where("edge > 0")
    parts = sorted(r["part"] for r in edges.where("edge IN (1, 3)").select("part").collect())  # one a task
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    firsts = edges.where("edge IN (1, 3)").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    lasts = edges.where("edge IN (2, 3)").select("doc_id", "text", "part").join(following, "part").join(firsts, "next_part").select("doc_id", "text", "next_text")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t, u in zip(batch.column("doc_id"), batch.column("text"), batch.column("next_text")):
                row = _measured([t.as_py(), u.as_py()], ranks)[0]
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], i.type), *(pa.array([x], kind) for x, kind in zip(row, _TYPES))], names=["doc_id", *_NAMES])

    last = lasts.mapInArrow(pairs, f"doc_id {id_type}, {RESULT}")
    return found.where("edge < 2").select("doc_id", *_NAMES).unionByName(last)
