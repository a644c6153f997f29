"""The prefix trie of conversations, with subtree totals by time-forward processing.

A prefix is known by the exclusive-or of 64-bit hashes, two of them, of its turns and their places; running and total values of it
need no order of tasks, so a conversation of any length is cut into blocks of ``BLOCK`` turns.  Nodes are the distinct prefixes.

Totals go up in two phases.  A node with more than ``limit`` members is heavy; there are at most rows / limit = 2^17 of them
by the choice of the limit, whatever the data, and their keys are broadcast.  The other nodes hang in light subtrees of at most ``limit``
conversations, and a shard has whole ones, by hash of the topmost node.  Within a shard Spark sorts the nodes, on
disk where needed, by falling depth; each node takes the messages addressed to it from a priority queue and sends its totals
on to its parent (``SpillingQueue``: a heap in memory, sorted runs in a file beyond that).  Then the shards'
topmost nodes send theirs, summed by parent, to the heavy nodes, which are one such queue more.  Light subtrees deeper than a block
are done block by block, the deepest first, so that one long conversation is no task of its own.

Defined results: rows without conv_id belong to no conversation.  Null roles and texts are empty.  Turns come by turn, null first,
then role, then hash of the turn.  conv_id is a whole number (for negative ones c % 100 is negative, as in SQL).  An empty
table has no nodes, not even a root.  Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, ship
from tidemark.operators.scan import numbered

#: Conversations of a family, which share up to so many first turns less one.
FAMILY, SHARED = 100, 6
#: Turns of a block of a long conversation.
BLOCK = 1 << 16
#: Heavy nodes at most, and the least number of members that makes one.
HEAVY, LEAST = 1 << 17, 256
#: Messages of a queue in memory, and ends of one node that are joined at once.
MESSAGES, ENDS = 1 << 17, 8192
EMPTY = hashlib.sha256(b"").hexdigest()


class SpillingQueue:
    """Messages (place, values) by place; beyond a number in memory the heap becomes a sorted run on disk."""

    def __init__(self, most: int = MESSAGES):
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []  # (next message, number of the run, its reader), a heap
        self.most, self.spilled = most, 0

    def push(self, place: tuple, values: tuple) -> None:
        heapq.heappush(self.heap, (place, values))
        if len(self.heap) >= self.most:
            run = tempfile.TemporaryFile()  # nameless: gone with the task
            for k in range(0, self.most, 4096):
                pickle.dump([heapq.heappop(self.heap) for _ in range(min(4096, len(self.heap)))], run, pickle.HIGHEST_PROTOCOL)
            run.seek(0)
            self.spilled += 1
            self._next(self.spilled, self._read(run))

    @staticmethod
    def _read(run) -> Iterator[tuple]:
        with run:
            while True:
                try:
                    yield from pickle.load(run)
                except EOFError:
                    return

    def _next(self, number: int, reader: Iterator[tuple]) -> None:
        message = next(reader, None)
        if message is not None:
            heapq.heappush(self.runs, (message, number, reader))

    def pop(self, place: tuple) -> tuple[int, int, int]:
        """The sums of the messages at a place, which no later place comes before."""
        children = leaves = saved = 0
        while self.heap and self.heap[0][0] == place:
            _, (c, n, s) = heapq.heappop(self.heap)
            children, leaves, saved = children + c, leaves + n, saved + s
        while self.runs and self.runs[0][0][0] == place:
            (_, (c, n, s)), number, reader = heapq.heappop(self.runs)
            children, leaves, saved = children + c, leaves + n, saved + s
            self._next(number, reader)
        return children, leaves, saved

    def __len__(self) -> int:
        return len(self.heap) + len(self.runs)


TOTALS = "n_children bigint, n_leaves bigint, saved_tokens bigint"
_FLOW = ["up", "k1", "k2", "is_node", "is_top", "p1", "p2", "n_convs", "chars", "children", "leaves", "saved"]


def sent_up(most: int = MESSAGES):
    """Rows by (up, k1, k2, is_node), up rising as depth falls: messages to a node stand before it.  Gives (k1, k2, totals) of the nodes."""

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(most)
        for batch in batches:
            out = []
            for up, k1, k2, is_node, is_top, p1, p2, n_convs, chars, children, leaves, saved in zip(*(batch.column(c).to_pylist() for c in _FLOW)):
                if not is_node:
                    queue.push((up, k1, k2), (children, leaves, saved))
                    continue
                children, leaves, saved = queue.pop((up, k1, k2))
                leaves, saved = leaves or 1, saved + (n_convs - 1) * chars
                out.append((k1, k2, children, leaves, saved))
                if not is_top:
                    queue.push((up + 1, p1, p2), (1, leaves, saved))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], names=["k1", "k2", "n_children", "n_leaves", "saved_tokens"])
        if len(queue):
            raise ValueError("messages for nodes that aren't there")

    return forward


def _flow(df: DataFrame, is_node: bool) -> DataFrame:
    """The columns of ``sent_up``: of nodes, or of messages to nodes (k1, k2, depth)."""
    zero = F.lit(0).cast("bigint")
    if is_node:
        return df.select((-F.col("depth")).alias("up"), "k1", "k2", F.lit(True).alias("is_node"), "is_top", "p1", "p2", "n_convs", "chars", zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), "l1", "l2")
    return df.select((-F.col("depth")).alias("up"), "k1", "k2", F.lit(False).alias("is_node"), F.lit(False).alias("is_top"), *(zero.alias(c) for c in ("p1", "p2", "n_convs", "chars")), "children", "leaves", "saved", "l1", "l2")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, turn_key, chars): all turns by conversation and in order; texts end here, as 16 bytes and a length."""
    given = conversations.where("conv_id IS NOT NULL")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    keyed = given.select("conv_id", "turn", role.alias("role"), F.substring(F.unhex(F.sha2(told, 256)), 1, 16).alias("turn_key"), F.length(text).cast("bigint").alias("chars"))
    return numbered(keyed, ["conv_id", F.asc_nulls_first("turn"), "role", "turn_key"], "seq").select("conv_id", "seq", "turn_key", "chars")


def rebuilt(turns: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, turn_key, chars) from depth 1, and (conv_id, length): each conversation with the first turns of its family's first."""
    convs = work.stage(turns.groupBy("conv_id").agg(F.min("seq").alias("first"), F.count("*").alias("n")), "convs")
    heads = turns.where(F.col("conv_id") % FAMILY == 0).join(convs.where(F.col("conv_id") % FAMILY == 0), "conv_id").where(F.col("seq") - F.col("first") < SHARED - 1)
    heads = heads.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "turn_key", "chars"))).alias("heads"))  # at most five turns
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED)).cast("int")
    plan = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    plan = plan.withColumn("h", shared).withColumn("heads", F.coalesce(F.slice("heads", F.lit(1), F.col("h")), F.array().cast("array<struct<seq: bigint, turn_key: binary, chars: bigint>>")))
    plan = work.stage(plan.select("conv_id", "first", "n", "h", "heads"), "plan")
    given = F.size("heads")
    place = F.col("seq") - F.col("first")
    own = turns.join(plan.select("conv_id", "first", "h", given.alias("given")), "conv_id").where(place >= F.col("h"))
    own = own.select("conv_id", (place - F.col("h") + F.col("given") + 1).alias("depth"), "turn_key", "chars")
    lent = plan.select("conv_id", F.posexplode("heads").alias("place", "turn")).select("conv_id", (F.col("place") + 1).cast("bigint").alias("depth"), "turn.turn_key", "turn.chars")
    return own.unionByName(lent), plan.select("conv_id", (given + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length"))


def _half(n: int) -> Column:
    return F.xxhash64(F.lit(n), "depth", "turn_key")


def prefixes(turns: DataFrame, work: Workspace, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, chars, k1, k2, p1, p2): the key of each prefix and of the one before."""
    at = F.floor(F.col("depth") / block)
    w = Window.partitionBy("conv_id", "at").orderBy("depth")
    halves = turns.withColumn("at", at).withColumn("x1", _half(1)).withColumn("x2", _half(2))
    keyed = halves.withColumn("k1", F.bit_xor("x1").over(w)).withColumn("k2", F.bit_xor("x2").over(w))
    keyed = work.stage(keyed.select("conv_id", "depth", "at", "chars", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2")), "prefixes")
    # What the full blocks before a later block come to.
    ends = keyed.where(F.col("depth") % block == block - 1).select("conv_id", (F.col("at") + 1).alias("at"), "k1", "k2")
    before = Window.partitionBy("conv_id").orderBy("at")
    ends = ends.select("conv_id", "at", F.bit_xor("k1").over(before).alias("b1"), F.bit_xor("k2").over(before).alias("b2"))
    later = keyed.where("at > 0").join(ends, ["conv_id", "at"])
    later = later.select("conv_id", "depth", "chars", *(F.col(f"{k}{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"{k}{i}") for k in "kp" for i in (1, 2)))
    return keyed.where("at = 0").select(later.columns).unionByName(later)


def _ends_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's chunks in a row, which come by node and then in order."""
    key, state = None, None
    for batch in batches:
        out = []
        for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
            if (k1, k2) != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256()
            else:
                text = f",{text}"
            state.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_pydict({"k1": [key[0]], "k2": [key[1]], "ends_sha256": [state.hexdigest()]})


def ends_of(ends: DataFrame, chunk: int = ENDS) -> DataFrame:
    """(k1, k2, ends_sha256) of (k1, k2, conv_id): ids are joined in chunks by many tasks; only the chunks of a node meet."""
    placed = numbered(ends, ["k1", "k2", "conv_id"], "seq").withColumn("chunk", F.floor(F.col("seq") / chunk))
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    joined = placed.groupBy("k1", "k2", "chunk").agg(ids.alias("ids"))
    return joined.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "chunk").mapInArrow(_ends_hash, "k1 bigint, k2 bigint, ends_sha256 string")


def subtree_totals(nodes: DataFrame, paths: DataFrame, work: Workspace, limit: int, block: int = BLOCK, messages: int = MESSAGES) -> DataFrame:
    """(k1, k2, n_children, n_leaves, saved_tokens) of nodes (k1, k2, p1, p2, depth, n_convs, chars, conv_id); paths are the prefixes of all conversations."""
    output = f"k1 bigint, k2 bigint, {TOTALS}"
    is_heavy = (F.col("n_convs") > limit) | (F.col("depth") == 0)
    heavy = work.stage(nodes.where(is_heavy), "heavy")  # at most HEAVY and the root
    keys = heavy.select(F.col("k1").alias("h1"), F.col("k2").alias("h2"))
    is_key = lambda a, b: (F.col(a) == F.col("h1")) & (F.col(b) == F.col("h2"))
    # Where each conversation leaves the heavy nodes, if it does.
    tops = paths.join(F.broadcast(keys), is_key("p1", "p2"), "left_semi").join(F.broadcast(keys), is_key("k1", "k2"), "left_anti")
    tops = tops.select("conv_id", F.col("k1").alias("l1"), F.col("k2").alias("l2"))
    light = nodes.where(~is_heavy).join(tops, "conv_id").withColumn("at", F.floor(F.col("depth") / block))
    light = light.withColumn("is_root", (F.col("k1") == F.col("l1")) & (F.col("k2") == F.col("l2"))).withColumn("is_top", F.col("is_root") | (F.col("depth") % block == 0))
    light = work.stage(light, "light")
    deepest = light.agg(F.max("at")).first()[0]
    done, down = [], None
    for at in range(deepest if deepest is not None else -1, -1, -1):
        flow = _flow(light.where(F.col("at") == at), True)
        if down is not None:
            flow = flow.unionByName(_flow(down, False))
        sharded = flow.repartition("l1", "l2").sortWithinPartitions("up", "k1", "k2", "is_node")
        totals = work.stage(sharded.select(_FLOW).mapInArrow(sent_up(messages), output), "totals")
        done.append(totals)
        if at:
            cut = light.where((F.col("at") == at) & F.col("is_top") & ~F.col("is_root")).join(totals, ["k1", "k2"])
            down = cut.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth"), F.lit(1).cast("bigint").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), "l1", "l2")
    top = _flow(heavy.withColumns({"is_top": F.col("depth") == 0, "l1": F.lit(0), "l2": F.lit(0)}), True)
    if done:
        below = done[0]
        for more in done[1:]:
            below = below.unionByName(more)
        roots = light.where("is_root").select("k1", "k2", "p1", "p2", "depth").join(below, ["k1", "k2"])
        roots = roots.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        top = top.unionByName(_flow(roots.withColumns({"l1": F.lit(0), "l2": F.lit(0)}), False))
    # The heavy nodes and a message for each of them at most: bounded by HEAVY, so one queue has them all.
    above = top.select(_FLOW).repartition(1).sortWithinPartitions("up", "k1", "k2", "is_node").mapInArrow(sent_up(messages), output)
    done.append(work.stage(above, "totals"))
    all_totals = done[0]
    for more in done[1:]:
        all_totals = all_totals.unionByName(more)
    return all_totals


def prefix_trie(conversations: DataFrame, limit: int | None = None, block: int = BLOCK, messages: int = MESSAGES, chunk: int = ENDS) -> DataFrame:
    """Every node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and its key k1, k2."""
    spark = conversations.sparkSession
    ship(spark)
    work = Workspace(spark, "trie")
    turns, lengths = rebuilt(turns_of(conversations), work)
    paths = prefixes(turns, work, block)
    if limit is None:
        limit = max(LEAST, -(-paths.count() // HEAVY))
    counted = paths.groupBy("k1", "k2").agg(F.first("depth").alias("depth"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("chars").alias("chars"))
    none = F.lit(0).cast("bigint")
    root = lengths.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(none.alias("k1"), none.alias("k2"), none.alias("depth"), none.alias("p1"), none.alias("p2"), "n_convs", "conv_id", none.alias("chars"))
    nodes = work.stage(counted.unionByName(root), "nodes")
    totals = subtree_totals(nodes, paths, work, limit, block, messages)
    last = paths.join(lengths, (paths.conv_id == lengths.conv_id) & (F.col("depth") == F.col("length"))).select("k1", "k2", paths.conv_id)
    last = last.unionByName(lengths.where("length = 0").select(none.alias("k1"), none.alias("k2"), "conv_id"))
    ends = ends_of(last, chunk)
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.where("depth > 0").join(parents, ["p1", "p2"]).unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint")))
    return (
        found.join(totals, ["k1", "k2"]).join(ends, ["k1", "k2"], "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "k1", "k2")
    )
