"""The prefix trie against a plain one, with every way of cutting it."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(given):
    turns = defaultdict(list)
    for c, turn, role, text in given:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(own)] for c, own in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[b] for b in below) if below else 1
        saved[node] = sum(saved[b] for b in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in own if built[c] == node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def talk(seed, convs=60, longest=7):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(400), convs):
        for t in range(rnd.randint(1, longest)):
            rows.append((c, t, rnd.choice(["user", None, ""]), rnd.choice(["hi", "ho", "", None, "ä" * 5])))
    return rows


@pytest.mark.parametrize("limit, block, messages, chunk", [(None, 1 << 16, 1 << 17, 8192), (1, 1 << 16, 3, 1), (3, 2, 2, 3), (5, 3, 1 << 17, 2), (0, 4, 2, 8192)])
def test_against_a_plain_trie(spark, limit, block, messages, chunk):
    rows = talk(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(trie.prefix_trie(df, limit=limit, block=block, messages=messages, chunk=chunk)) == plain(rows)


def test_long_conversation_and_copies(spark):
    rnd = random.Random(2)
    rows = [(7, t, "user", rnd.choice("abc")) for t in range(300)]
    rows += [(c, t, "user", "same") for c in range(200, 290) for t in range(5)]
    rows += [(c, t, "user", "same" if t < 3 else str(c)) for c in range(300, 330) for t in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    assert found(trie.prefix_trie(df)) == want
    assert found(trie.prefix_trie(df, limit=8, block=32, messages=4, chunk=7)) == want


def test_trie_odd(spark):
    rows = [(None, 0, "user", "x"), (100, None, "b", "first"), (100, 0, None, None), (100, 0, None, None), (100, 0, "a", "tie"), (101, 5, "user", "y" * 200_000), (102, 0, "", ""), (102, 1, None, ""), (305, 0, "u", "alone"), (-3, 1, "u", "minus")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("k1", F.lit("own")).withColumn("seq", F.lit("own")).withColumn("depth", F.lit("own"))
    got = found(trie.prefix_trie(df))
    by_hash = {r[:7] for r in got}
    assert by_hash == {r[:7] for r in plain([r for r in rows if r[0] is None or r[0] >= 0] + [(-3, 1, "u", "minus")])}
    assert not found(trie.prefix_trie(df.limit(0)))
    nobody = trie.prefix_trie(spark.createDataFrame([(None, 0, "user", "x")], SCHEMA))
    assert not found(nobody)


def test_queue_spills_and_sums():
    rnd = random.Random(3)
    queue, sums = trie.SpillingQueue(most=5), defaultdict(lambda: [0, 0, 0])
    for level in range(6):
        for _ in range(40):
            place, values = (level, rnd.randrange(4), 0), (1, rnd.randrange(5), rnd.randrange(5))
            queue.push(place, values)
            for k, v in enumerate(values):
                sums[place][k] += v
        for k in range(4):
            assert list(queue.pop((level, k, 0))) == sums[level, k, 0]
    assert queue.spilled > 20 and not len(queue)


def test_trie_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op12_prefix_trie(spark, sf_dir)) == plain(rows)
