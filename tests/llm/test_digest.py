"""Fingerprints of improbable features against a plain version, window by window."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import digest, queries

W, AROUND, VOTES = 32, 64, 16


def rows(df):
    return [r.asDict() for r in df.collect()]


def brute_bin(window):
    logs = sum(round(c * math.log2(c) * 65536) for c in Counter(window).values())
    return (5 * 32 * 65536 - logs) * 200 // (32 * 65536)


def brute_rarity(texts):
    seen = Counter(brute_bin(t[i : i + W]) for t in texts for i in range(len(t) - W + 1))
    order = sorted(range(1001), key=lambda b: (seen[b], b))
    ranks = np.empty(1001, np.int16)
    for r, b in enumerate(order):
        ranks[b] = r if b >= 200 else -1
    return ranks


def brute_features(text, ranks):
    """Votes of every stretch of 64 windows that touches the text, also beyond its ends."""
    keys = [(int(ranks[brute_bin(text[i : i + W])]), i) for i in range(len(text) - W + 1)]
    votes = Counter()
    for a in range(-AROUND + 1, len(keys)):
        some = [k for k in keys[max(0, a) : a + AROUND] if k[0] >= 0]
        if some:
            votes[min(some)[1]] += 1
    found = [xxhash.xxh3_128_digest(text[i : i + W]) for i in sorted(votes) if votes[i] >= VOTES]
    return list(dict.fromkeys(found)) or ([xxhash.xxh3_128_digest(text)] if text else [])


def brute_chain(hashes):
    chain = []
    for k in range(0, len(hashes), 160):
        bits = set()
        for h in hashes[k : k + 160]:
            bits |= {int.from_bytes(h[2 * j : 2 * j + 2], "little") % 2048 for j in range(5)}
        chain.append(bits)
    return len(hashes), chain


def brute_likeness(a, b):
    if a == b:
        return 1.0
    few, many = (a, b) if a[0] <= b[0] else (b, a)
    if not few[0]:
        return 0.0
    total = 0
    for k, x in enumerate(few[1]):
        best = 0.0
        for y in many[1]:
            mean = len(x) * len(y) / 2048
            chance = mean + 2 * math.sqrt(mean * (2048 - len(x)) * (2048 - len(y)) / (2048 * 2047))
            most = min(len(x), len(y))
            best = max(best, (len(x & y) - chance) / (most - chance) if most > chance else float(len(x & y) >= most))
        total += min(1.0, best) * min(160, few[0] - 160 * k)
    return min(1.0, total / few[0])


def chain_of(fingerprint):
    n, chain = digest.read(fingerprint)
    return n, [set(np.flatnonzero(np.unpackbits(f)).tolist()) for f in chain]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    some = [" ".join(rnd.choice(words) for _ in range(n)) for n in (0, 1, 5, 6, 8, 30, 200, 1500)]
    return [t.encode() for t in [*some, "a" * 300, "ab" * 40, "ä" * 31, some[6][:700] + some[5], "x" * 31, "y" * 32]]


def test_features_against_every_window(texts, monkeypatch):
    ranks = brute_rarity(texts)
    want = [brute_features(t, ranks) for t in texts]
    assert digest.features(texts, ranks) == want
    assert len(want[7]) > 160  # more than a filter holds
    for piece, work, lane in ((97, 150, 7), (64, 1 << 20, 512)):
        monkeypatch.setattr(digest, "PIECE", piece)
        monkeypatch.setattr(digest, "WORK", work)
        monkeypatch.setattr(digest, "LANE", lane)
        assert digest.features(texts, ranks) == want
    chains = [(len(h), digest.filters(h)) for h in want]
    for h, c in zip(want, chains):
        assert chain_of(digest.written(*c)) == brute_chain(h)
    for a, x in zip(want, chains):
        for b, y in zip(want, chains):
            assert digest.likeness(x, y) == pytest.approx(brute_likeness(brute_chain(a), brute_chain(b)), abs=1e-9)
            assert digest.likeness(x, y) == digest.likeness(y, x) or len(a) == len(b)


def test_rarity_counts_all_windows(spark, texts):
    df = spark.createDataFrame([(t.decode(),) for t in [*texts, *texts[:3]]] + [(None,)], "text string").repartition(3)
    assert np.array_equal(digest.fit_rarity(df), brute_rarity([*texts, *texts[:3]]))


def plain_rows(documents, ranks):
    """(doc_id, n_chars, sha, fingerprints and likenesses) of (doc_id, text) in their order."""
    out = []
    for k, (i, t) in enumerate(documents):
        u = documents[(k + 1) % len(documents)][1]
        new = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        a, b, c = (brute_chain(brute_features(x.encode(), ranks)) for x in (t, new, u))
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), a, b, round(brute_likeness(a, b), 9), round(brute_likeness(a, c), 9)))
    return sorted(out, key=repr)


def found_rows(df):
    return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], chain_of(r["fingerprint"]), chain_of(r["edited_fingerprint"]), round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows(df)), key=repr)


@pytest.mark.parametrize("tasks", [1, 5, 40])
def test_successors_over_any_tasks(spark, texts, tasks):
    documents = sorted(enumerate([t.decode() for t in texts] * 2), reverse=True)
    df = spark.createDataFrame(random.Random(1).sample(documents, len(documents)), "doc_id bigint, text string")
    ranks = brute_rarity(texts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert found_rows(digest.successor_digests(df, ranks)) == plain_rows(documents, ranks)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_digests_odd(spark, odd):
    ranks = digest.fit_rarity(odd)
    found = rows(digest.successor_digests(odd, ranks))
    assert len(found) == odd.count()
    empty = [r for r in found if not r["n_chars"]]
    assert len(empty) == 2 and all(r["fingerprint"] == "0:" and r["edited_sha256"] == hashlib.sha256(b"").hexdigest() and r["near_edited"] == 1.0 for r in empty)
    assert {r["doc_id"] for r in found} == {None, *range(1, 11)}
    assert len({r["fingerprint"] for r in found if r["doc_id"] in (None, 7)}) == 1
    assert not rows(digest.successor_digests(odd.limit(0), ranks))
    alone = rows(digest.successor_digests(odd.where("doc_id = 7"), ranks))
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_columns_of_fingerprints(spark, odd, texts):
    ranks = brute_rarity(texts)
    df = digest.with_fingerprint(spark.createDataFrame([(t.decode(),) for t in texts], "text string"), ranks)
    df = digest.with_likeness(df.withColumn("other", F.lit(digest.written(0, digest.filters([])))), "fingerprint", "other")
    for r in rows(df):
        assert chain_of(r["fingerprint"]) == brute_chain(brute_features(r["text"].encode(), ranks))
        assert r["likeness"] == (0.0 if r["text"] else 1.0)


def test_digest_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    order = sorted(texts, reverse=True)
    found = {r["doc_id"]: r for r in rows(queries.op13_improbable_features(spark, sf_dir))}
    assert found.keys() == texts.keys()
    prints = {i: digest.read(found[i]["fingerprint"]) for i in order}
    for i, j in zip(order, order[1:] + order[:1]):
        n = len(texts[i]) // 3
        new = texts[i][: len(texts[i]) - n] + texts[j][:n]
        assert found[i]["n_chars"] == len(texts[i]) and found[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert found[i]["near_next"] == digest.likeness(prints[i], prints[j])
    long = [i for i in order if len(texts[i]) > 300]
    near, far = np.array([found[i]["near_edited"] for i in long]), np.array([found[i]["near_next"] for i in long])
    assert (near > 0.25).mean() > 0.99 and np.median(near) > 0.55
    assert (near > far).mean() > 0.97 and np.median(far) == 0
    by_text = {}
    for i in order:
        assert by_text.setdefault(texts[i], found[i]["fingerprint"]) == found[i]["fingerprint"]
