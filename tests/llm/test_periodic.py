"""Periodic runs against every period tried by itself."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import periodic, queries


def rows(df):
    return [r.asDict() for r in df.collect()]


def brute_runs(words, least=12):
    """Every stretch of equal words q apart, for every q; the smallest q of each stretch."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        start = None
        for i in range(n - q + 1):
            same = i < n - q and words[i] == words[i + q]
            if same and start is None:
                start = i
            if not same and start is not None:
                if i + q - start >= max(least, 2 * q):
                    best.setdefault((start, i + q), q)
                start = None
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_words(seed):
    rnd = random.Random(seed)
    texts = []
    for _ in range(60):
        n, letters = rnd.choice([0, 1, 11, 12, 13, 40, 90, 200]), rnd.choice([1, 2, 3, 40])
        words = [rnd.randrange(letters) for _ in range(n)]
        if n and rnd.random() < 0.5:
            at, p = rnd.randrange(n), rnd.randint(1, max(1, n // 3))
            words = words[:at] + [words[at + (i - at) % p] if at + (i - at) % p < n else 0 for i in range(at, n)]
        texts.append(words)
    fibonacci, last = [0, 1], [0]
    while len(fibonacci) < 600:
        fibonacci, last = fibonacci + last, fibonacci
    texts.append(fibonacci)
    for words, found in zip(texts, periodic.runs_of(texts)):
        assert [tuple(map(int, r)) for r in found] == brute_runs(words)
    for least in (2, 5, 20):
        for words, found in zip(texts[:20], periodic.runs_of(texts[:20], least)):
            assert [tuple(map(int, r)) for r in found] == brute_runs(words, least)


def test_grammar_keeps_the_text_and_its_extensions():
    rnd = np.random.default_rng(5)
    text = rnd.integers(0, 2, 500).astype(np.int32)
    text[100:180] = text[300:380]
    symbols = np.concatenate([[-1], text, [-2]]).astype(np.int32)
    levels = periodic.grammar(symbols, 1)
    assert np.array_equal(levels[0].symbols, symbols) and len(np.unique(levels[-1].parent)) == 3
    x, y = np.array([(a, b) for a in range(1, 501, 7) for b in range(a + 1, 501, 5)]).T
    forth, back = periodic.extend(levels, x, y), periodic.extend(levels, x, y, -1)
    for a, b, f, g in zip(x, y, forth, back):
        assert (symbols[a : a + f] == symbols[b : b + f]).all() and symbols[a + f] != symbols[b + f]
        assert (symbols[a - g + 1 : a + 1] == symbols[b - g + 1 : b + 1]).all() and symbols[a - g] != symbols[b - g]


def test_points_in_pieces(monkeypatch):
    rnd = random.Random(3)
    texts = [[rnd.randrange(2) for _ in range(150)], [1] * 400, [rnd.randrange(3) for _ in range(99)]]
    whole = periodic.runs_of(texts)
    monkeypatch.setattr(periodic, "POINTS", 50)
    assert all(np.array_equal(a, b) for a, b in zip(whole, periodic.runs_of(texts)))


def test_runs_odd(spark, odd):
    found = rows(periodic.with_runs(odd.withColumn("runs", F.lit("own"))))
    assert len(found) == odd.count() and {r["runs"] for r in found} == {"own"}
    for r in found:
        words, p = (r["text"] or "").encode().split(), r["periodic"]
        assert p["n_words"] == len(words)
        if len(words) < 5_000:
            assert [tuple(x) for x in p["runs"]] == brute_runs(words)
            assert p["collapsed"].encode() == b" ".join(w for i, w in enumerate(words) if i not in {k for s, n, q in p["runs"] for k in range(s + q, s + n)})
        else:
            assert [tuple(x) for x in p["runs"]] == [(0, 30_000, 1)] and p["collapsed"] == "word"
    assert not rows(periodic.with_runs(odd.limit(0)))


def test_periodic_query(spark, sf_dir, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {r["doc_id"]: r for r in rows(queries.op11_periodic_runs(spark, sf_dir))}
    assert found.keys() == texts.keys()
    changed = 0
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            changed += 1
        r = found[i]
        if n > 1_500:
            continue
        runs = brute_runs(words)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert r["n_runs"] == len(runs) and (r["start"], r["length"], r["period"]) == (top or (None,) * 3)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if top else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest()
    assert changed > 5
