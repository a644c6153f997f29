"""Language-model scoring: a log-bilinear model trained in numpy by noise-contrastive estimation.

Words are counted over all training documents.  The model has two levels.  The commonest ``TOP`` words are classes of
their own, all others share ``SHARED`` classes by the hash of their endings; the class of a token follows from the two before it:

    s(c | h1, h2) = (r_h1 * p1 + r_h2 * p2) . q_c + b_c

Within a shared class, every word seen ``OWN`` times or more is a member with a vector of its own, so their number grows with the
corpus, and all rarer words are one member more; the member follows from the token before:

    s(m | c, h1) = u_h1 . v_m + b_m

A rare word has its add-one share of the rare words' tokens, with one place for unseen words.  So the probabilities of a
document's continuations add up to one.  Normalisers come from matrix products over all contexts at once, as exp(s) of a class
is a product of a row that depends on h1 and one that depends on h2.

Texts become ids once.  The training documents are dealt by hash to ``ROUNDS``, and in each to shards of about ``SHARD_TOKENS``
over all rounds, some shards a lane.  A lane's texts reach one task in order, a row each, and are trained on as they come, so no task
holds a shard.  Every shard trains from the parameters all begin with, a lane adds up its shards, and Spark averages the lanes'
parameters, each row by its uses.  So scores depend on the documents alone, not on tasks.
Counts of words beyond the ``HEAD`` commonest never leave the executors: scoring keeps them as
(document, word, times) and joins them with the count table.

Defined results: null and empty texts are one end token.  Null doc_ids count as
training documents; rows of one doc_id are scored each on their own.  With no training
tokens at all, every token counts as unseen.  An empty table gives no rows.
"""

from __future__ import annotations

import copy
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, crc_remainder, ship

TOP, SHARED, WIDTH = 1024, 1024, 16
CLASSES = TOP + SHARED
#: Words whose counts executors hold in memory, at most; of them, those seen so often have vectors of their own.
HEAD, OWN = 1 << 18, 8
#: Tokens of a shard, about, the shares of the texts that the rounds train on, and the shards of a lane.
SHARD_TOKENS, ROUNDS, LANE = 2_000_000, (0.25, 0.75), 4
#: Tokens in memory and shuffled at once, about.
CHUNK = 1 << 19
#: Shards at least, so that a small corpus trains side by side, too.
LEAST_SHARDS = 4
#: Contexts whose normalisers are made at once, lanes whose sums are added before all are, and parameter rows that travel as one.
TILE, TOGETHER, PIECE = 256, 32, 2048
NOISE, MEMBER_NOISE, BATCH, RATE, FIRST_SQUARE = 32, 4, 4096, 0.2, 1e-3
END = b""


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def shared_class(word: bytes) -> int:
    """By the last two code points."""
    end = word[-2:] if word[-2:].isascii() else word.decode("utf-8", "replace")[-2:].encode()
    return TOP + zlib.crc32(end) % SHARED


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, cls, n) over all the docs; cls is the class shared by words that aren't among the commonest."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(c.values(), pa.int64())], names=["word", "n"])
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                seen.update(tokens(text.as_py()))
                if len(seen) > 400_000:
                    yield out(seen)
                    seen = Counter()
        if seen:
            yield out(seen)

    # The class of each distinct word once, as ``shared_class`` has it.
    cls = F.lit(TOP) + F.crc32(F.right(F.col("word").cast("string"), F.lit(2)).cast("binary")) % SHARED
    return docs.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).select("word", cls.cast("int").alias("cls"), "n")


@dataclass
class Vocabulary:
    """The commonest words with their counts, what the count table adds up to, and the members of the shared classes.

    Members are in order of class; the first of a class is its rare words.  ``member`` has the member of each word in the
    list (-1 for the commonest, which are classes), ``rare`` the log10 of what a rare word's count plus one is a share of.
    """

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    class_tokens: np.ndarray
    class_words: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self):
        n, top = len(self.words), min(TOP, len(self.words))
        self.cls = np.array([i if i < top else shared_class(w) for i, w in enumerate(self.words)], np.int32)
        own = np.flatnonzero((np.arange(n) >= top) & (self.counts >= OWN))
        of = self.cls[own] - TOP
        rare_tokens = self.class_tokens[TOP:] - np.bincount(of, self.counts[own], SHARED)
        rare_words = self.class_words[TOP:] - np.bincount(of, minlength=SHARED)
        self.rare = np.log10(rare_tokens + rare_words + 1)
        by = np.argsort(of, kind="stable")
        self.first = np.arange(SHARED) + np.concatenate(([0], np.cumsum(np.bincount(of, minlength=SHARED))[:-1]))
        self.member = np.full(n, -1, np.int32)
        shared = np.arange(n) >= top
        self.member[shared] = self.first[self.cls[shared] - TOP]
        self.member[own[by]] = np.arange(len(own)) + of[by] + 1
        self.members = SHARED + len(own)
        self.member_class = np.repeat(np.arange(SHARED), np.diff(np.append(self.first, self.members)))
        weight = np.empty(self.members)
        weight[self.first] = rare_tokens + 1
        weight[self.member[own]] = self.counts[own]
        self.member_share = weight / np.add.reduceat(weight, self.first)[self.member_class]

    def lean(self) -> Vocabulary:
        """The same without the words themselves, which only encoding needs."""
        out = copy.copy(self)
        out.words = range(len(self.words))
        return out

    def places_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and member (-1 for the commonest) of encoded tokens."""
        if not len(self.words):
            cls = -1 - ids
            return cls, self.first[cls - TOP].astype(np.int32)
        known, at = ids >= 0, np.maximum(ids, 0)
        cls = np.where(known, self.cls[at], -1 - ids)
        return cls, np.where(known, self.member[at], self.first[np.maximum(cls - TOP, 0)]).astype(np.int32)


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    # Counts in steps of an eighth of a power of two: a few hundred rows tell which count the head ends at.
    step = F.floor(F.log2("n") * 8).cast("int")
    steps = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("v")).collect(), reverse=True)
    held, least = 0, None
    for s, v in steps:
        if held + v > head:
            break
        held, least = held + v, s
    rows = counts.where(step >= least).select("word", "n").toArrow() if least is not None else pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
    rows = rows.sort_by([("n", "descending"), ("word", "ascending")])
    words, of_words = rows["word"].to_pylist(), rows["n"].to_numpy().astype(float)
    in_class = {r["cls"]: (r["n"], r["v"]) for r in counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    t, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for c, (a, b) in in_class.items():
        t[c], v[c] = a, b
    for i, (w, n) in enumerate(zip(words[:TOP], of_words.tolist())):
        t[i] = n
        t[shared_class(w)] -= n
        v[shared_class(w)] -= 1
    return Vocabulary(words, of_words, total["n"] or 0, total["v"] or 0, t, v)


#: Parameter rows: contexts (the last is the text's start), positions, classes, contexts of the second level, members.
CONTEXT, PLACE, CLASS, BEFORE, MEMBER = 0, CLASSES + 1, CLASSES + 3, 2 * CLASSES + 3, 3 * CLASSES + 4
START = CLASSES


@dataclass
class LogBilinear:
    """All parameters as rows of one matrix, a bias last."""

    rows: np.ndarray

    @staticmethod
    def start(v: Vocabulary, seed: int = 5) -> LogBilinear:
        rng, rows = np.random.default_rng(seed), np.zeros((MEMBER + v.members, WIDTH + 1), np.float32)
        rows[:, :WIDTH] = rng.normal(0, 0.1, (len(rows), WIDTH))
        rows[PLACE:CLASS, :WIDTH] = 1.0
        share = (v.class_tokens + 0.5) / (v.class_tokens + 0.5).sum()
        rows[CLASS:BEFORE, WIDTH], rows[MEMBER:, WIDTH] = np.log(share), np.log(v.member_share)
        return LogBilinear(rows)

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """a[h1, c] and b[h2, c], which add up to the score of a class."""
        r, p, q = self.rows[CONTEXT:PLACE, :WIDTH], self.rows[PLACE:CLASS, :WIDTH], self.rows[CLASS:BEFORE]
        return (r * p[0]) @ q[:, :WIDTH].T + q[:, WIDTH], (r * p[1]) @ q[:, :WIDTH].T

    def normaliser(self) -> np.ndarray:
        """z[h1, h2] of log P(c | h1, h2) = a + b - z; of the first half, only a tile of contexts is there at once."""
        r, p, q = self.rows[CONTEXT:PLACE, :WIDTH], self.rows[PLACE:CLASS, :WIDTH], self.rows[CLASS:BEFORE]
        b = (r * p[1]) @ q[:, :WIDTH].T
        top_b = b.max(axis=1, keepdims=True)
        b -= top_b
        right, z = np.exp(b, out=b).T, np.empty((len(r), len(r)), np.float32)
        for at in range(0, len(r), TILE):
            a = (r[at : at + TILE] * p[0]) @ q[:, :WIDTH].T
            a += q[:, WIDTH]
            top_a = a.max(axis=1, keepdims=True)
            a -= top_a
            z[at : at + TILE] = np.log(np.exp(a, out=a) @ right)
            z[at : at + TILE] += top_a
        z += top_b.T
        return z

    def classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The halves and their log normaliser."""
        return *self.halves(), self.normaliser()

    def members(self, v: Vocabulary) -> np.ndarray:
        """The log normaliser of the members of each shared class in each context, a tile of contexts and a few classes at a time."""
        u, m = self.rows[BEFORE:MEMBER, :WIDTH], self.rows[MEMBER:]
        out = np.empty((len(u), SHARED), np.float32)
        edges = [*range(0, SHARED, 8), SHARED]
        for a, b in zip(edges, edges[1:]):
            lo, hi = v.first[a], v.first[b] if b < SHARED else v.members
            for at in range(0, len(u), TILE):
                s = u[at : at + TILE] @ m[lo:hi, :WIDTH].T
                s += m[lo:hi, WIDTH]
                out[at : at + TILE, a:b] = np.add.reduceat(np.exp(s, out=s), v.first[a:b] - lo, axis=1)
        return np.log(out, out=out)


class Trainer:
    """Stochastic noise-contrastive training of both levels; a batch shares its noise classes, a token has noise members of its class."""

    def __init__(self, model: LogBilinear, v: Vocabulary, seed: int, rate: float = RATE):
        self.x, self.v, self.rng, self.rate = model.rows.astype(np.float32).copy(), v, np.random.default_rng(seed), rate
        p = (v.class_tokens + 0.5) / (v.class_tokens + 0.5).sum()
        self.log_noise, self.cum = np.log(NOISE * p).astype(np.float32), np.cumsum(p)
        self.log_member, self.member_cum = np.log(MEMBER_NOISE * v.member_share).astype(np.float32), np.cumsum(v.member_share)
        self.squares = np.full(self.x.shape, FIRST_SQUARE, np.float32)
        self.uses = np.zeros(len(self.x))
        self.scale = np.float32(1 / BATCH)
        self.ends = np.append(v.first[1:], v.members) - 1

    def _move(self, base: int, ids: np.ndarray, moves: np.ndarray) -> None:
        """Adagrad on the rows of ids, counted from a base; where ids are few, they are short integers, which sort by radix."""
        by = np.argsort(ids, kind="stable" if ids.dtype.itemsize == 2 else None)
        s = ids[by]
        start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        u = base + s[start].astype(np.int64)
        self.uses[u] += np.diff(np.append(start, len(s)))
        g = stretch_sums(np.take(moves, by, axis=0), start)
        g *= self.scale
        squares = np.take(self.squares, u, axis=0)
        squares += g * g
        self.squares[u] = squares
        g *= np.float32(self.rate)
        g /= np.sqrt(squares, out=squares)
        g += np.take(self.x, u, axis=0)
        self.x[u] = g

    def step(self, h1: np.ndarray, h2: np.ndarray, c: np.ndarray, m: np.ndarray) -> None:
        x, p, short, wide = self.x, self.x[PLACE:CLASS, :WIDTH].copy(), np.uint16, WIDTH + 1
        n = len(c)
        rows = lambda base, ids: np.take(x, base + ids, axis=0)
        r1, r2, q = rows(CONTEXT, h1)[:, :WIDTH], rows(CONTEXT, h2)[:, :WIDTH], rows(CLASS, c)
        h = r1 * p[0]
        h += r2 * p[1]
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), CLASSES - 1)
        qn = rows(CLASS, noise)
        up = 1 / (1 + np.exp(np.einsum("nd,nd->n", h, q[:, :WIDTH]) + q[:, WIDTH] - self.log_noise[c]))
        down = h @ qn[:, :WIDTH].T
        down += qn[:, WIDTH] - self.log_noise[noise]
        down = 1 / (1 + np.exp(-down))
        dh = up[:, None] * q[:, :WIDTH]
        dh -= down @ qn[:, :WIDTH]
        some = np.flatnonzero(m >= 0)
        if len(some):
            g1, own = h1[some], m[some]
            u, v = rows(BEFORE, g1)[:, :WIDTH], rows(MEMBER, own)
            low = self.v.member_class[own]
            other = np.searchsorted(self.member_cum, low[:, None] + self.rng.random((len(some), MEMBER_NOISE)))
            other = np.clip(other, self.v.first[low][:, None], self.ends[low][:, None])
            vn = rows(MEMBER, other)
            lift = 1 / (1 + np.exp(np.einsum("nd,nd->n", u, v[:, :WIDTH]) + v[:, WIDTH] - self.log_member[own]))
            sink = 1 / (1 + np.exp(-(np.einsum("nd,nkd->nk", u, vn[:, :, :WIDTH]) + vn[:, :, WIDTH] - self.log_member[other])))
            du = np.zeros((len(some), wide), np.float32)
            np.einsum("nk,nkd->nd", sink, vn[:, :, :WIDTH], out=du[:, :WIDTH])
            np.subtract(lift[:, None] * v[:, :WIDTH], du[:, :WIDTH], out=du[:, :WIDTH])
            # The token's own member goes up and the noise down, along the context and, for the bias, one.
            signs = np.concatenate([lift[:, None], -sink], axis=1)
            moves = np.empty((len(some), 1 + MEMBER_NOISE, wide), np.float32)
            np.multiply(signs[:, :, None], u[:, None], out=moves[:, :, :WIDTH])
            moves[:, :, WIDTH] = signs
            self._move(BEFORE, g1.astype(short), du)
            self._move(MEMBER, np.concatenate([own[:, None], other], axis=1).ravel().astype(np.int32), moves.reshape(-1, wide))
        places = np.zeros((2, wide), np.float32)
        places[:, :WIDTH] = np.einsum("nd,nd->d", dh, r1), np.einsum("nd,nd->d", dh, r2)
        classes = np.empty((n + NOISE, wide), np.float32)
        np.multiply(up[:, None], h, out=classes[:n, :WIDTH])
        classes[:n, WIDTH] = up
        np.negative(down.T @ h, out=classes[n:, :WIDTH])
        classes[n:, WIDTH] = -down.sum(axis=0)
        contexts_ = np.zeros((2 * n, wide), np.float32)
        np.multiply(dh, p[0], out=contexts_[:n, :WIDTH])
        np.multiply(dh, p[1], out=contexts_[n:, :WIDTH])
        self._move(CLASS, np.concatenate([c, noise]).astype(short), classes)
        self._move(CONTEXT, np.concatenate([h1, h2]).astype(short), contexts_)
        self._move(PLACE, np.array([0, 1], short), places)

    def run(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Over texts of so many tokens each, side by side in ids, in batches from all of them; a batch is in order of members, which lie side by side in memory."""
        cls, member = self.v.places_of(ids)
        h1, h2 = contexts(cls, sizes)
        order = self.rng.permutation(len(ids))
        for at in range(0, len(ids), BATCH):
            some = order[at : at + BATCH]
            some = some[np.argsort(member[some], kind="stable")]
            self.step(h1[some], h2[some], cls[some], member[some])


def stretch_sums(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The sum of the rows from each start to the next; where most are single rows, only the others are added up."""
    if 2 * len(start) < len(rows):
        return np.add.reduceat(rows, start)
    out, size = np.take(rows, start, axis=0), np.diff(np.append(start, len(rows)))
    two, more = np.flatnonzero(size == 2), np.flatnonzero(size > 2)
    out[two] += np.take(rows, start[two] + 1, axis=0)
    if len(more):
        edges = np.column_stack([start[more], start[more] + size[more]]).ravel()
        out[more] = np.add.reduceat(rows, edges[:-1] if edges[-1] == len(rows) else edges)[::2]
    return out


def contexts(cls: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two before each token; the start's where a text has none."""
    first = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    h1, h2 = np.empty_like(cls), np.empty_like(cls)
    h1[1:], h2[2:] = cls[:-1], cls[:-2]
    h1[first] = h2[first] = START
    h2[first[sizes > 1] + 1] = START
    return h1, h2


class _Kept:
    """What a worker keeps from task to task, of the latest vocabulary or model."""

    held: dict[str, object] = {}

    @classmethod
    def of(cls, key: str, make):
        if key not in cls.held:
            cls.held.clear()
            cls.held[key] = make()
        return cls.held[key]


def encoded(docs: DataFrame, v: Vocabulary, extra: list[str]) -> DataFrame:
    """A row for each doc: its tokens as places among the commonest words (or less than 0: the class of another), and the other words with their times."""
    shared = docs.sparkSession.sparkContext.broadcast((v.key, v.words))
    kinds = {c: docs.schema[c].dataType.simpleString() for c in extra}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words = shared.value
        get = _Kept.of(key, lambda: {w: i for i, w in enumerate(words)}).get
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(len(extra)).cast(pa.binary())
            for at in range(0, len(texts), 1000):
                part, out = texts.slice(at, 1000), []
                for text in part:
                    split = tokens(text.as_py())
                    ids = np.fromiter(map(get, split, repeat(-1)), np.int32, len(split))
                    tail = Counter([split[i] for i in np.flatnonzero(ids < 0).tolist()])
                    if tail:
                        cls = {w: -1 - shared_class(w) for w in tail}
                        for i in np.flatnonzero(ids < 0).tolist():
                            ids[i] = cls[split[i]]
                    out.append((row, ids, list(tail), list(tail.values())))
                    row += 1
                sizes = np.concatenate(([0], np.cumsum([len(x[1]) for x in out]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([x[1] for x in out])))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, 1000) for k in range(len(extra))), pa.array([x[0] for x in out], pa.int64()), ids, pa.array([x[2] for x in out], pa.list_(pa.binary())), pa.array([x[3] for x in out], pa.list_(pa.int32()))], names=[*extra, "row", "ids", "words", "times"])

    return docs.select(*extra, "text").mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), "row bigint, ids array<int>, words array<binary>, times array<int>"]))


def dealt(rows: DataFrame, shards: int, part: tuple[float, float]) -> DataFrame:
    """(lane, shard, ids): the rows (key, ids) of a part of the keys, dealt by key; each lane is a task, in order of shard, key and ids."""
    lanes, turns = max(LEAST_SHARDS, -(-shards // LANE)), 1 << 20
    turn, shard = F.pmod(F.xxhash64("key"), F.lit(turns)), F.pmod("key", F.lit(shards)).cast("int")
    own = rows.where((turn >= round(part[0] * turns)) & (turn < round(part[1] * turns)))
    own = own.select((shard % lanes).alias("lane"), shard.alias("shard"), "key", "ids")
    return own.repartitionById(lanes, "lane").sortWithinPartitions("lane", "shard", "key", "ids").select("lane", "shard", "ids")


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lane, shard, ids, sizes): consecutive texts of a shard, as many as reach ``CHUNK`` tokens."""
    at, held, size = None, [], 0
    whole = lambda: (*at, np.concatenate(held), np.array([len(x) for x in held]))
    for batch in batches:
        ids = batch.column(2)
        flat, sizes = ids.flatten().to_numpy(), ids.value_lengths().to_numpy(zero_copy_only=False)
        for lane, shard, n, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sizes.tolist(), np.cumsum(sizes, dtype=np.int64).tolist()):
            if held and ((lane, shard) != at or size >= CHUNK):
                yield whole()
                held, size = [], 0
            at, size = (lane, shard), size + n
            held.append(flat[end - n : end].copy())
    if held:
        yield whole()


def trained(rows: DataFrame, shards: int, v: Vocabulary, model: LogBilinear, part: tuple[float, float], seed: int) -> LogBilinear:
    """The mean of the parameters that the shards come to over a part of the texts, each row by its uses.

    A lane adds up its shards before anything is shuffled; parameters travel in pieces, which are summed apart, first those of
    some of the lanes and then all.
    """
    shared = rows.sparkSession.sparkContext.broadcast((v.lean(), model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _Kept.held.clear()
        v, model = shared.value
        for lane, of_lane in groupby(chunks(batches), lambda x: x[0]):
            moved = uses = None
            for shard, of_shard in groupby(of_lane, lambda x: x[1]):
                trainer = Trainer(model, v, seed * 1_000_003 + shard)
                for _, _, ids, sizes in of_shard:
                    trainer.run(ids, sizes)
                trainer.squares, x = None, trainer.x
                x -= model.rows
                x *= trainer.uses.astype(np.float32)[:, None]
                if uses is None:
                    moved, uses = x, trainer.uses
                else:
                    moved += x
                    uses += trainer.uses
                del trainer, x
            # How far the used rows moved, times their uses: floats will do for that.
            for at in range(0, len(uses), PIECE):
                some = np.flatnonzero(uses[at : at + PIECE])
                if len(some):
                    yield piece_row(at, lane // TOGETHER, some, moved[at + some], uses[at + some])

    def piece_row(at: int, lane: int, some: np.ndarray, moved: np.ndarray, uses: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([lane], pa.int32()), *(pa.array([x.tobytes()]) for x in (some.astype(np.uint16), moved, uses.astype(np.int64)))], names=names)

    def summed(batches: Iterator[pa.RecordBatch]) -> tuple:
        at, lane, sums, uses = 0, 0, np.zeros((PIECE, WIDTH + 1)), np.zeros(PIECE, np.int64)
        for batch in batches:
            for at, lane, some, moved, used in zip(*(c.to_pylist() for c in batch.columns)):
                some = np.frombuffer(some, np.uint16)
                sums[some] += np.frombuffer(moved, np.float32).reshape(-1, WIDTH + 1)
                uses[some] += np.frombuffer(used, np.int64)
        some = np.flatnonzero(uses)
        return at, lane, some, sums[some], uses[some]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lane, some, sums, uses = summed(batches)
        yield piece_row(at, lane, some, sums.astype(np.float32), uses)

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lane, some, sums, uses = summed(batches)
        yield piece_row(at, lane, some, (sums / uses[:, None]).astype(np.float32), uses)

    shape, names = "at int, lane int, some binary, moved binary, uses binary", ["at", "lane", "some", "moved", "uses"]
    parts = dealt(rows, shards, part).mapInArrow(run, shape)
    out = model.rows  # in place, as what trained has a copy
    for r in parts.groupBy("at", "lane").applyInArrow(add, shape).groupBy("at").applyInArrow(mean, shape).select("at", "some", "moved").collect():
        out[r["at"] + np.frombuffer(r["some"], np.uint16).astype(int)] += np.frombuffer(r["moved"], np.float32).reshape(-1, WIDTH + 1)
    shared.destroy()
    return LogBilinear(out)


def fit(rows: DataFrame, v: Vocabulary, rounds: tuple[float, ...] = ROUNDS) -> LogBilinear:
    """Train on all rows (key, ids), once."""
    model, at, shards = LogBilinear.start(v), 0.0, max(LEAST_SHARDS, round(v.total / SHARD_TOKENS))
    for k, share in enumerate(rounds):
        model = trained(rows, shards, v, model, (at, at + share), 11 + k)
        at += share
    return model


def log_probabilities(v: Vocabulary, tables, model: LogBilinear, ids: np.ndarray, sizes: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """log10 P of every token given those before it in its text; rare words' own counts (log10 of count plus one) come from logs."""
    (a, b, z), zm = tables
    cls, member = v.places_of(ids)
    h1, h2 = contexts(cls, sizes)
    out = (a[h1, cls].astype(float) + b[h2, cls] - z[h1, h2]) / np.log(10)
    some = np.flatnonzero(member >= 0)
    m, before = member[some], h1[some]
    low = v.member_class[m]
    s = np.einsum("nd,nd->n", model.rows[BEFORE + before, :WIDTH], model.rows[MEMBER + m, :WIDTH]) + model.rows[MEMBER + m, WIDTH] - zm[before, low]
    rare = m == v.first[low]
    out[some] += s.astype(float) / np.log(10) + np.where(rare, logs[some] - v.rare[low], 0.0)
    return out


def scored(rows: DataFrame, v: Vocabulary, model: LogBilinear, extra: list[str]) -> DataFrame:
    """The encoded rows with n_tokens, known, logs (of known words' counts) and lm, what the model gives but for the other words' counts."""
    # The normalisers are made once; their size is that of classes and contexts, whatever the corpus.  The halves are made by each worker.
    shared = rows.sparkSession.sparkContext.broadcast((v.lean(), model, model.normaliser(), model.members(v)))
    kinds, key = {c: rows.schema[c].dataType.simpleString() for c in [*extra, "row"]}, uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model, z, zm = shared.value
        tables = _Kept.of(key, lambda: ((*model.halves(), z), zm))
        counts = np.append(np.log10(v.counts + 1), 0.0)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = part.column(part.num_columns - 1)
                sizes, flat = ids.value_lengths().to_numpy(zero_copy_only=False), ids.flatten().to_numpy()
                logs, first = counts[np.where(flat >= 0, flat, len(counts) - 1)], np.concatenate(([0], np.cumsum(sizes)[:-1]))
                lm = log_probabilities(v, tables, model, flat, sizes, logs)
                sums = [sizes.astype(np.int64), *(np.add.reduceat(x, first) for x in ((flat >= 0).astype(np.int64), logs, lm))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, sums)], names=[*kinds, "n_tokens", "known", "logs", "lm"])

    return rows.select(*kinds, "ids").mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), "n_tokens bigint, known bigint, logs double, lm double"]))


def score(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    ship(docs.sparkSession)
    work = Workspace(docs.sparkSession, "lm")
    held = crc_remainder("doc_id", 7) == 2
    own = docs.select("doc_id", "text", held.alias("held_out"), F.xxhash64("doc_id", "text").alias("key"))
    counts = work.stage(word_counts(own.where(~F.col("held_out"))), "counts")
    v = vocabulary(counts, head)
    rows = work.stage(encoded(own, v, ["doc_id", "held_out", "key"]), "encoded")
    v = v.lean()
    model = fit(rows.where(~F.col("held_out")).select("key", "ids"), v)
    found = scored(rows, v, model, ["doc_id", "held_out"])
    # Words beyond the head: all occurrences meet the count table by a shuffle.
    pairs = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    met = pairs.join(counts.select("word", "n"), "word")
    tail = met.groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("more_logs"))
    whole = float(np.log10(v.total + v.distinct + 1))
    found = found.join(tail, "row", "left")
    logs = F.coalesce("more_logs", F.lit(0.0))
    return found.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("bigint").alias("train_tokens"),
        (F.col("logs") + logs - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("lm") + logs).alias("score"),
    )
