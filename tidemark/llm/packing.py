"""Best-fit packing of tokenised documents into fixed-length training sequences.

Lengths are integers from 1 to the capacity, so the packing of any corpus is decided by
its length histogram alone: at most ``capacity`` numbers, however many documents there
are.  The histogram is packed on the driver into *runs* ("the next 812 pieces of length
700 go, one each, at offset 1348 of sequences 5,000 to 5,811").  Pieces then get a rank
among those of their length, in parallel, and a range lookup in the runs gives each its
sequence and offset.  No document or token passes through the driver.

Method: pieces above a third of the capacity fit at most twice into a sequence, and are
matched greedily, the longest first, each with the longest partner that still fits.
Shorter pieces then go, longest first, into the tightest gap that holds them, and into
new sequences only where no gap does.

Ids are those of the vocabulary's ``tokenizers`` file: texts are cut at its added tokens, which have ids
of their own, and the rest is encoded by byte-pair ranks.

Defined results: a null text is the empty text and gives the end id alone; rows with the
same doc_id (also null) are packed each on their own; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Workspace, ship

CAPACITY = 2048
#: Pieces of one length are ranked in groups of about so many, so that a very common length is spread however often it comes.
GROUP_ROWS = 16_384

_RUN = T.StructType(
    [
        T.StructField("run_length", T.LongType()),
        T.StructField("run_from", T.LongType()),
        T.StructField("run_to", T.LongType()),
        T.StructField("run_per", T.LongType()),
        T.StructField("run_sequence", T.LongType()),
        T.StructField("run_offset", T.LongType()),
    ]
)


def byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


#: Signs of white space in a row that the pattern is given, at most.
LONGEST_SPACE = 50_000
LONG_SPACE = re.compile(f"[\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONGEST_SPACE + 1},}}")


class TextTokenizer:
    """Ids as little-endian uint32 bytes, the same as ``tokenizers`` gives without special tokens added.

    Read from the ``tokenizers`` file of a byte-level vocabulary, whose ids are the ranks of its merges, and encoded
    by ranks, which takes a quarter of the time (tests compare the ids).  The file's added tokens are found in
    texts as they stand, before all else, as there.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        signs = byte_signs()
        ranks = {bytes(map(signs.__getitem__, word)): i for word, i in file["model"]["vocab"].items() if word not in added}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

        self.added = tuple(added)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        ids, at = [], 0
        # The pattern fails on very long white space.  Such a stretch is one word of it, but for its last sign where another follows in
        # the same segment, as added tokens end one; so texts are cut there.
        for run in LONG_SPACE.finditer(text) if len(text) > LONGEST_SPACE else ():
            end = run.end()
            if end < len(text) and not text.startswith(self.added, end):
                end -= 1
            ids += self.encoding.encode(text[at : run.start()], allowed_special="all")
            ids += self.encoding._encode_single_piece(text[run.start() : end].encode())
            at = end
        ids += self.encoding.encode(text[at:], allowed_special="all")
        return np.array(ids, "<u4").tobytes()


_TOKENIZERS: dict[str, TextTokenizer] = {}


def tokenizer_of(path: str) -> TextTokenizer:
    """The worker's tokenizer, kept from task to task."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = TextTokenizer(path)
    return _TOKENIZERS[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Documents as token pieces of at most ``capacity``: doc_id, piece, start, length, ids_crc32[, ids].

    Only documents with more tokens are cut, and all their pieces but the first are full.
    ``vocabulary`` is a path that is the same on every executor; by default each looks
    up its own copy of the public one.
    """
    ship(docs.sparkSession)
    fields = ["piece int", "start long", "length long", "ids_crc32 long", *["ids array<int>"] * keep_ids]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = [f.split()[0] for f in fields]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end, most = tokenizer_of(vocabulary or vocabulary_path()), end_id.to_bytes(4, "little"), 1 << 22
        for batch in batches:
            ids = batch.column(0)
            texts = batch.column(1)
            step = max(1, min(len(ids), most * len(ids) // max(1, texts.nbytes)))
            for at in range(0, len(ids), step):
                rows = []
                which = []
                for i, text in enumerate(texts.slice(at, step).to_pylist(), at):
                    code = tok.encode(text or "") + end
                    n = len(code) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        part = code[4 * a : 4 * b]
                        which.append(i)
                        rows.append((k, a, b - a, zlib.crc32(part), *([part] if keep_ids else ())))
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
                arrays = [ids.take(pa.array(which, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4])]
                if keep_ids:
                    sizes = [0]
                    for c in cols[4]:
                        sizes.append(sizes[-1] + len(c) // 4)
                    arrays.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.Array.from_buffers(pa.int32(), sizes[-1], [None, pa.py_buffer(b"".join(cols[4]))])))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(pieces, f"doc_id {id_type}, " + ", ".join(fields))


def match_large(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Pair lengths above a third of the capacity, longest first, each with the longest that fits: (lengths, how many)."""
    left = {n: c for n, c in counts.items() if 3 * n > capacity and c}
    order = sorted(left)
    found = []
    while order:
        a = order[-1]
        if not left[a]:
            order.pop()
            continue
        k = bisect.bisect_right(order, capacity - a) - 1
        while k >= 0 and (not left[order[k]] or (order[k] == a and left[a] < 2)):
            if not left[order[k]]:
                order.pop(k)
            k -= 1
        if k < 0:
            found.append(((a,), left[a]))
            left[a] = 0
            continue
        b = order[k]
        n = left[a] // 2 if a == b else min(left[a], left[b])
        left[a] -= n
        left[b] -= n
        found.append(((a, b), n))
    return found


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Pack a length histogram: runs (length, from, to, per, sequence, offset).

    The pieces of that length with ranks from..to-1 go ``per`` to a sequence, side by side
    from ``offset``, into consecutive sequences from ``sequence``.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, how many)
    open_gaps: list[int] = []
    bins = 0

    def put(length: int, per: int, first: int, n: int, offset: int) -> None:
        runs.append((length, used[length], used[length] + per * n, per, first, offset))
        used[length] += per * n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                bisect.insort(open_gaps, gap)
            gaps[gap].append((first, n))

    for lengths, n in match_large(counts, capacity):
        at = 0
        for length in lengths:
            put(length, 1, bins, n, at)
            at += length
        leave(capacity - at, bins, n)
        bins += n
    for length in sorted((x for x in counts if 3 * x <= capacity and counts[x]), reverse=True):
        left = counts[length]
        while left:
            k = bisect.bisect_left(open_gaps, length)
            if k == len(open_gaps):
                per = capacity // length
                whole = left // per
                if whole:
                    put(length, per, bins, whole, 0)
                    leave(capacity - per * length, bins, whole)
                    bins += whole
                if left % per:
                    put(length, left % per, bins, 1, 0)
                    leave(capacity - (left % per) * length, bins, 1)
                    bins += 1
                break
            gap = open_gaps[k]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps.pop(k)
            per = gap // length
            whole = min(n, left // per)
            if whole:
                put(length, per, first, whole, capacity - gap)
                leave(gap - per * length, first, whole)
                left -= per * whole
                first, n = first + whole, n - whole
            if n and left and left < per:
                put(length, left, first, 1, capacity - gap)
                leave(gap - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            leave(gap, first, n)
    return runs


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pack documents: the columns of ``token_pieces`` plus sequence_id and offset.

    Shuffles: one of the small piece rows, by (length, group).  A length has as many groups as
    its pieces need, so no sort grows with the corpus.  The tables that are broadcast depend on the
    histogram alone, of at most ``capacity`` entries.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    pieces = work.stage(token_pieces(docs, vocabulary, capacity, end_id, keep_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    groups = spark.createDataFrame([(n, -(-c // group_rows)) for n, c in counts.items()], "g_length long, groups long")
    pieces = pieces.join(F.broadcast(groups), F.col("length") == F.col("g_length")).withColumn("rank_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("groups"))).drop("g_length", "groups")
    sizes = work.stage(pieces.groupBy("length", "rank_group").agg(F.count("*").alias("n")), "sizes")
    runs = spark.createDataFrame(plan_runs(counts, capacity), _RUN)
    before = Window.partitionBy("length").orderBy("rank_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("length").alias("s_length"), F.col("rank_group").alias("s_group"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_start"))
    within = Window.partitionBy("length", "rank_group").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        pieces.withColumn("rank", F.row_number().over(within) - 1)
        .join(starts, (F.col("length") == F.col("s_length")) & (F.col("rank_group") == F.col("s_group")))
        .withColumn("rank", F.col("rank") + F.col("rank_start"))
    )
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("run_from")) & (F.col("rank") < F.col("run_to")))
    nth = F.col("rank") - F.col("run_from")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run_sequence") + F.expr("(rank - run_from) div run_per")).alias("sequence_id"),
        (F.col("run_offset") + nth % F.col("run_per") * F.col("length")).alias("offset"),
        *(["ids"] if keep_ids else []),
    )


__all__ = ["CAPACITY", "TextTokenizer", "match_large", "pack", "plan_runs", "token_pieces", "vocabulary_path"]
