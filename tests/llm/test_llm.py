"""The operators against brute-force versions, and on awkward input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import ann, licenses, line_dedup, lm, mixing, packing, pii, quality, queries, simhash, topk
from tidemark.llm.common import Workspace

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts, extra=()):
    return spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in texts], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    line = "The very same line of text stands here"
    texts = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, line), (4, f"{line}\n{line}\n short \nanother line, only once"), (5, f"  {line.upper()}\t\nown words of five\n"), (6, "word " * 30_000), (7, line), (8, " \n\t"), (9, "ä" * 9 + "\n" + "ä" * 9), (10, "ä" * 9)]
    df = docs_of(spark, texts)
    # Columns whose names the operators use themselves.
    for c in ("kept", "score", "rate", "fp", "piece", "length", "n_lines", "quality_score", "mixing_words", "tokens", "line_hash"):
        df = df.withColumn(c, F.lit("own"))
    return df


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- packing ---


def check_packing(found, texts, capacity=2048):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in texts:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r["length"] for r in found)


def test_packing(spark, docs, odd):
    n, total = check_packing(rows(packing.pack(docs)), [(r.doc_id, r.text) for r in docs.collect()])
    assert n <= 1.02 * total / 2048 + 2
    check_packing(rows(packing.pack(odd)), [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.pack(docs.limit(0)).count() == 0


def test_tokenizer_on_odd_space(spark):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice(["a", "Bc", " ", "  ", "\n", "\t", "é", "'s", "12", "!?", " ", " ", "<|endoftext|>", "日本", "😀"]) for _ in range(40))) for i in range(200)]
    check_packing(rows(packing.pack(docs_of(spark, texts))), texts)


def test_added_token_is_one_id(spark):
    got = rows(packing.pack(docs_of(spark, [(1, "hello <|endoftext|> world"), (2, "<|endoftext|")]), keep_ids=True))
    assert {r["doc_id"]: r["ids"] for r in got}[1] == [31373, 220, 50256, 995, 0]


def test_one_common_length_in_many_groups(spark):
    texts = [(i, "the same words") for i in range(300)]
    n, total = check_packing(rows(packing.pack(docs_of(spark, texts), group_rows=7)), texts)
    assert n == 1


def test_kept_ids(spark):
    got = rows(packing.pack(docs_of(spark, [(1, "hello world"), (2, None)]), keep_ids=True))
    assert {r["doc_id"]: len(r["ids"]) for r in got} == {1: 3, 2: 1}


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randint(1, 100), rng.randint(30, 68), 100, 34, 33]) for _ in range(5000))
    used, place = Counter(), defaultdict(list)
    for length, a, b, per, seq, offset in packing.plan_runs(counts, 100):
        assert a == used[length]
        used[length] = b
        for k in range(b - a):
            place[seq + k // per].append((offset + k % per * length, length))
    assert used == counts
    for parts in place.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length
        assert at <= 100
    # Not worse than first-fit decreasing.
    bins = []
    for x in sorted(counts.elements(), reverse=True):
        for i, room in enumerate(bins):
            if room >= x:
                bins[i] -= x
                break
        else:
            bins.append(100 - x)
    assert len(place) <= len(bins) + 1


# --- language model ---


def test_lm_against_brute_force(spark, docs):
    got = rows(lm.score(docs, head=500))
    texts = {r.doc_id: r.text for r in docs.collect()}
    train = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(lm.tokens(t.encode()))
    n, v = sum(train.values()), len(train)
    for r in got:
        words = lm.tokens(texts[r["doc_id"]].encode())
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in train for w in words), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((train[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    # A head of another size changes where counts are looked up, not the result's base.
    again = {r["doc_id"]: r["base_score"] for r in rows(lm.score(docs))}
    assert all(again[r["doc_id"]] == pytest.approx(r["base_score"], rel=1e-9) for r in got)


def small_model(docs):
    """A vocabulary of some texts, counted here, and a model with random parameters."""
    counts = Counter(w for r in docs.collect() for w in lm.tokens(r.text.encode()) * 3)
    pairs = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    t, k = np.zeros(lm.CLASSES), np.zeros(lm.CLASSES)
    for i, (w, n) in enumerate(pairs):
        c = i if i < lm.TOP else lm.shared_class(w)
        t[c], k[c] = t[c] + n, k[c] + (i >= lm.TOP)
    v = lm.Vocabulary([w for w, _ in pairs], np.array([n for _, n in pairs], float), sum(counts.values()), len(counts), t, k)
    model = lm.LogBilinear.start(v)
    model.rows += np.random.default_rng(1).normal(0, 0.3, model.rows.shape).astype(np.float32)
    return v, model


def test_lm_words_add_up_to_one(docs):
    """All words of the vocabulary, and an unseen one of each class, after two words; each against a plain softmax."""
    v, model = small_model(docs)
    assert v.members > lm.SHARED
    tables, n = (model.classes(), model.members(v)), len(v.words)
    last = np.concatenate([np.arange(n), -1 - np.arange(lm.TOP, lm.CLASSES)]).astype(np.int32)
    for first in ([5, n - 1], [-1 - lm.TOP, 3], [n // 2, n - 7]):
        ids = np.column_stack([np.full((len(last), 2), first, np.int32), last]).ravel()
        logs = np.append(np.log10(v.counts + 1), 0.0)[np.where(ids >= 0, ids, n)]
        p = 10 ** lm.log_probabilities(v, tables, model, ids, np.full(len(last), 3), logs)[2::3]
        assert p.sum() == pytest.approx(1, abs=1e-4)
        h = [first[1], first[0]]
        h = [v.cls[x] if x >= 0 else -1 - x for x in h]
        r, pl, q = model.rows[lm.CONTEXT :][:lm.START], model.rows[lm.PLACE : lm.CLASS], model.rows[lm.CLASS : lm.BEFORE]
        s = np.array([(r[h[0], :-1] * pl[0, :-1] + r[h[1], :-1] * pl[1, :-1]) @ q[c, :-1] + q[c, -1] for c in range(lm.CLASSES)], float)
        of_class = np.exp(s) / np.exp(s).sum()
        for i in random.Random(2).sample(range(len(last)), 40):
            c = v.cls[i] if i < n else lm.TOP + i - n
            want = of_class[c]
            if c >= lm.TOP:
                own = [j for j in range(lm.TOP, n) if v.cls[j] == c and v.counts[j] >= lm.OWN]
                rare = [j for j in range(lm.TOP, n) if v.cls[j] == c and v.counts[j] < lm.OWN]
                score = {j: model.rows[lm.BEFORE + h[0], :-1] @ model.rows[lm.MEMBER + v.member[j], :-1] + model.rows[lm.MEMBER + v.member[j], -1] for j in own}
                m = v.first[c - lm.TOP]
                score["rare"] = model.rows[lm.BEFORE + h[0], :-1] @ model.rows[lm.MEMBER + m, :-1] + model.rows[lm.MEMBER + m, -1]
                total = sum(np.exp(x) for x in score.values())
                count = v.counts[i] if i < n else 0
                want *= np.exp(score[i]) / total if i in own else np.exp(score["rare"]) / total * (count + 1) / (sum(v.counts[j] for j in rare) + len(rare) + 1)
            assert p[i] == pytest.approx(want, rel=2e-3)


def test_lm_steps_go_down_the_gradient(docs):
    """One training step moves parameters along the gradient of the noise-contrastive objective, taken numerically."""
    v, model = small_model(docs)
    rng = np.random.default_rng(3)
    ids = rng.integers(0, len(v.words), 64).astype(np.int32)
    cls, member = v.places_of(ids)
    h1, h2 = lm.contexts(cls, np.array([40, 24]))

    def objective(rows):
        t = lm.Trainer(lm.LogBilinear(rows), v, 9)
        x, up = t.x.astype(float), lambda z: -np.log1p(np.exp(-z))
        p = x[lm.PLACE : lm.CLASS, :-1]
        noise = np.minimum(np.searchsorted(t.cum, t.rng.random(lm.NOISE)), lm.CLASSES - 1)
        h = x[h1, :-1] * p[0] + x[h2, :-1] * p[1]
        q = lambda c: x[lm.CLASS + c]
        total = up((h * q(cls)[:, :-1]).sum(axis=1) + q(cls)[:, -1] - t.log_noise[cls]).sum() + up(-(h @ q(noise)[:, :-1].T + q(noise)[:, -1] - t.log_noise[noise])).sum()
        some = np.flatnonzero(member >= 0)
        u, own, low = x[lm.BEFORE + h1[some], :-1], member[some], v.member_class[member[some]]
        other = np.clip(np.searchsorted(t.member_cum, low[:, None] + t.rng.random((len(some), lm.MEMBER_NOISE))), v.first[low][:, None], t.ends[low][:, None])
        m = lambda k: x[lm.MEMBER + k]
        total += up((u * m(own)[:, :-1]).sum(axis=1) + m(own)[:, -1] - t.log_member[own]).sum()
        return total + up(-(np.einsum("nd,nkd->nk", u, m(other)[:, :, :-1]) + m(other)[:, :, -1] - t.log_member[other])).sum()

    t, start = lm.Trainer(model, v, 9), model.rows.copy()
    t.squares[:] = 1  # so that a step is the gradient times a constant
    t.step(h1, h2, cls, member)
    moved = t.x.astype(float) - start
    shared = np.flatnonzero(member >= 0)[0]
    for row, col in ((lm.CLASS + cls[5], 3), (lm.CLASS + cls[9], lm.WIDTH), (lm.CONTEXT + h1[7], 2), (lm.PLACE, 1), (lm.BEFORE + h1[shared], 4), (lm.MEMBER + member[shared], 5), (lm.MEMBER + member[shared], lm.WIDTH)):
        up, down = start.copy(), start.copy()
        up[row, col] += 0.02
        down[row, col] -= 0.02
        slope = (objective(up) - objective(down)) / 0.04
        assert moved[row, col] == pytest.approx(slope * lm.RATE / lm.BATCH, rel=0.05, abs=5e-7)


def test_lm_is_the_same_on_any_tasks(spark, docs):
    one, many = ({r["doc_id"]: r["score"] for r in rows(lm.score(docs.repartition(n)))} for n in (1, 9))
    assert one.keys() == many.keys() and all(many[i] == pytest.approx(s, rel=1e-6) for i, s in one.items())


def test_lm_trains_on_texts_as_they_come(spark, monkeypatch):
    """A row that reaches training is a text, not a shard; each lane is a task of its own, and every text has its turn once."""
    rng = random.Random(4)
    texts = [(rng.randrange(-(1 << 62), 1 << 62), [rng.randrange(99) for _ in range(rng.randint(1, 30))]) for _ in range(400)]
    df = spark.createDataFrame(texts, "key bigint, ids array<int>").repartition(7)
    monkeypatch.setattr(lm, "CHUNK", 50)
    seen = []
    for part in ((0.0, 0.25), (0.25, 1.0)):
        got = lm.dealt(df, 9, part).withColumn("task", F.spark_partition_id()).collect()
        at = {}
        assert all(at.setdefault(r["lane"], r["task"]) == r["task"] for r in got) and len(set(at.values())) == len(at) == lm.LEAST_SHARDS
        assert all({r["lane"] for r in got if r["shard"] == s} <= {s % lm.LEAST_SHARDS} for s in range(9))
        seen += [tuple(r["ids"]) for r in got]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in got[i : i + 60]], t) for c, t in (("lane", pa.int32()), ("shard", pa.int32()), ("ids", pa.list_(pa.int32())))], names=["lane", "shard", "ids"]) for i in range(0, len(got), 60)]
        parts = list(lm.chunks(iter(batches)))
        assert [t for _, _, ids, _ in parts for t in ids.tolist()] == [t for r in got for t in r["ids"]]
        assert [(a, b) for a, b, _, sizes in parts for _ in sizes] == [(r["lane"], r["shard"]) for r in got]
        assert all(len(ids) == sum(sizes) < 50 + 30 for _, _, ids, sizes in parts)
    assert Counter(seen) == Counter(tuple(t) for _, t in texts)


@pytest.mark.parametrize("most", [3, 400])
def test_lm_sums_of_stretches(most):
    rng = np.random.default_rng(most)
    ids, rows = np.sort(rng.integers(0, most, 300)), rng.normal(size=(300, 5))
    start = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    want = [rows[ids == i].sum(axis=0) for i in np.unique(ids)]
    assert np.allclose(lm.stretch_sums(rows, start), want)


def test_lm_classes_of_words(spark):
    words = ["", "a", "ab", "abé", "éab", "漢字", "x漢", "😀", "a😀", "été", "naïve", "ß"]
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    assert {bytes(r["word"]): r["cls"] for r in rows(lm.word_counts(df))} == {w: lm.shared_class(w) for w in lm.tokens(" ".join(words).encode())}


def test_lm_odd(spark, odd):
    got = rows(lm.score(odd))
    assert len(got) == 12 and all(np.isfinite(r["score"]) and r["n_tokens"] >= 1 for r in got)
    assert lm.score(odd.limit(0)).count() == 0


# --- quality ---


def test_quality_held_out(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    r = queries.op3_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([x.predicted == x.quality for x in r]) > 0.95


def test_quality_score_against_brute_force(spark, sf_dir, docs):
    """Scores of texts from the model's parameters: inputs made here, all pairs added up one by one."""
    m = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    some = docs.where("doc_id < 12")
    got = {r.doc_id: r.score for r in quality.with_score(some, m).collect()}
    base = 1 << quality.WORD_BITS
    for r in some.collect():
        text = r.text.encode()
        words = Counter(text.lower().split())
        slots = Counter()
        for w, n in words.items():
            slots[zlib.crc32(w) % base] += n
        length = np.sqrt(sum(np.log1p(n) ** 2 for n in slots.values()))
        x = {k: np.log1p(n) / length for k, n in slots.items()}
        stats = quality.structure(text, list(words.elements()), words) + [np.log1p(r.n_chars)]
        for k, value in enumerate(stats):
            x[base + k] = np.clip((value - m.mean[k]) / m.spread[k], -4, 4) / 4
            x[base + len(stats) + k * quality.RANGES + sum(value > e for e in m.edges[k])] = 0.5
        ids = list(x)
        z = m.bias + sum(m.weights[i] * x[i] for i in ids)
        vx = np.array([m.factors[i] * x[i] for i in ids])
        z += sum(vx[a] @ vx[b] for a in range(len(ids)) for b in range(a)) if len(ids) < 400 else ((vx @ vx.T).sum() - (vx * vx).sum()) / 2
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4, abs=1e-7)


def test_quality_odd(spark, odd, sf_dir):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (5, 1, None), (None, 1, 1), (7, None, 0)], "doc_id bigint, quality int, toxic int")
    m = quality.fit(odd, labels)
    got = rows(quality.with_score(odd, m, "s"))
    assert len(got) == 12 and all(0 <= r["s"] <= 1 for r in got)
    none = quality.fit(odd, labels.limit(0))
    assert {r["s"] for r in rows(quality.with_score(odd, none, "s"))} == {1.0}
    assert quality.quality_stage(odd, labels.limit(0)).columns == odd.columns
    assert quality.with_score(odd.limit(0), m, "s").count() == 0


def test_machine_is_linear_time_identity():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.1, rng.normal(size=50), rng.normal(size=(50, 4)), None, None, None)
    i, x = np.array([3, 8, 20, 41]), rng.normal(size=4)
    want = 0.1 + (m.weights[i] * x).sum() + sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(4) for b in range(a))
    assert m.margin(i, x, np.array([0]))[0][0] == pytest.approx(want)


# --- line dedup ---


def brute_lines(texts):
    first = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, t in texts:
        if i is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 10:
                    first[key(x)] = min(i, first.get(key(x), i))
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or first.get(key(x), i) >= i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (4, 3)])
def test_line_dedup(spark, docs, odd, batches, fanout):
    for df in (docs, odd):
        got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in rows(line_dedup.dedup_lines(df.drop("n_lines"), batches=batches, fanout=fanout)))
        assert got == brute_lines([(r.doc_id, r.text) for r in df.collect()])


def test_line_stage(spark, odd):
    out = line_dedup.line_dedup_stage(odd)
    assert out.columns == odd.columns and out.schema["n_lines"].dataType == odd.schema["n_lines"].dataType
    want, got = brute_lines([(r.doc_id, r.text) for r in odd.collect()]), out.collect()
    assert Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in got) == Counter((i, sha) for i, _, _, sha in want.elements())
    for r in got:
        # Columns named like ours keep what they held.
        assert r.n_chars == len(r.text) and {r[c] for c in ("kept", "score", "n_lines", "tokens", "line_hash")} == {"own"}
    named = line_dedup.dedup_lines(odd)
    assert {r.n_lines for r in named.collect()} == {"own"} and min(r._n_lines for r in named.collect()) == 1
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_runs_are_merged_as_they_lie(spark, docs, capsys):
    """Buckets meet buckets in order: neither an exchange nor a sort, for the anti-join of a batch and for compaction."""
    work = Workspace(spark, "test-runs")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b, c = (work.bucketed(docs.groupBy(F.md5(F.concat("doc_id", F.lit(f"/{k}"))).cast("binary").alias("line_hash")).agg(F.min("doc_id").alias("first_doc")), "t", "line_hash") for k in (1, 2, 3))
        with line_dedup.sorted_buckets(spark):
            for joined in (a.join(b.select("line_hash", F.col("first_doc").alias("known")), "line_hash", "left"), line_dedup.merged_runs([a, b])):
                joined.explain()
                plan = capsys.readouterr().out
                assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort " not in plan and "Bucketed: true" in plan
        a.join(b.select("line_hash", F.col("first_doc").alias("known")), "line_hash", "left").explain()
        assert "Sort " in capsys.readouterr().out  # so the test can fail
        merged = line_dedup.merged_runs([a, b, c])
        assert Counter(merged.collect()) == Counter(a.unionByName(b).unionByName(c).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        work.drop(a, b, c)


# --- vectors ---


def vectors_of(spark, n=700, d=16, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, d)).round(2)
    x[5], x[6] = x[4], x[4]
    data = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    return x, spark.createDataFrame([*data, (1000, None), (1001, []), (1002, [None] * d), (1003, [float("nan")] * d), (1004, [1.0]), (None, [1.0] * d), (1005, [0.0] * d)], "vec_id bigint, embedding array<double>")


def test_topk(spark):
    x, v = vectors_of(spark)
    q = np.floor(256 * np.vstack([x, np.zeros(x.shape[1])])).astype(int)
    ids = [*range(len(x)), 1005]
    got = defaultdict(list)
    for r in rows(topk.search(v, v.where("vec_id % 50 = 0"), 5)):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = {}
    for a, i in enumerate(ids):
        if i % 50 == 0:
            s = sorted((-int(q[a] @ q[b]), j) for b, j in enumerate(ids) if j != i)[:5]
            want[i] = [(k + 1, j, -p) for k, (p, j) in enumerate(s)]
    assert {k: sorted(p) for k, p in got.items()} == want
    assert topk.search(v.limit(0), v, 5).count() == 0
    few = v.where("vec_id < 3")
    assert topk.search(few, few, 5).count() == 6


def brute_top(ids, score, k):
    return [(n + 1, j, s) for n, (s, j) in enumerate(sorted(((s, j) for j, s in zip(ids, score)), key=lambda x: (-x[0], x[1]))[:k])]


def test_topk_of_large_and_common_vectors(spark):
    """Components beyond what doubles hold exactly, a third of all rows equal, repeated ids, clashing columns."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 6)).round(2)
    x[:40] = x[0]
    x[50], x[51], x[52] = x[50] * 1e6, x[51] * 1e9 + 0.25, -x[52] * 1e12
    x[60, 2] = 1e300
    ids = [*range(119), 118]
    v = spark.createDataFrame([(i, [float(y) for y in r], 1, 2) for i, r in zip(ids, x)], "vec_id bigint, embedding array<double>, row int, vec int")
    w = [[int(np.floor(y * 256)) if abs(y) < 1e15 else int(y * 256) for y in r] for r in x]
    cap = lambda s: max(-topk.MOST, min(topk.MOST, s))
    got = defaultdict(list)
    for r in rows(topk.search(v, v.where("vec_id % 10 = 0"), 5)):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for i in range(0, 119, 10):
        other = [j for j in range(120) if ids[j] != i]
        want = brute_top([ids[j] for j in other], [cap(sum(a * b for a, b in zip(w[i], w[j]))) for j in other], 5)
        assert sorted(got[i]) == want, i


def test_topk_where_half_the_rows_share_an_id(spark):
    """The query's own rows take no places: alone with a vector, among others that hold it, and as the most of its copies."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 5)).round(1)
    ids = np.array([0] * 120 + list(range(1, 121)))
    x[30:60] = x[150]  # rows of id 0 with a vector that id 31 holds, too
    x[60:70] = x[160:170] = x[200]
    ids[170:175] = 50
    v = spark.createDataFrame([(int(i), [float(y) for y in r]) for i, r in zip(ids, x)], "vec_id bigint, embedding array<double>")
    w = np.floor(256 * x).astype(int)
    got = defaultdict(list)
    for r in rows(topk.search(v, v.where("vec_id IN (0, 31, 50, 77)").dropDuplicates(["vec_id"]), 5)):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    asked = {r["vec_id"]: np.floor(256 * np.array(r["embedding"])).astype(int) for r in rows(v.where("vec_id IN (31, 77)"))}
    assert set(got) == {0, 31, 50, 77} and all(len(p) == 5 for p in got.values())
    for i, q in asked.items():
        other = [j for j in range(240) if ids[j] != i]
        assert sorted(got[i]) == brute_top([int(ids[j]) for j in other], [int(q @ w[j]) for j in other], 5), i
    every = defaultdict(list)
    for r in rows(topk.search(v, v.where("vec_id = 0"), 5)):
        every[r["rank"]].append((r["vec_id"], r["score"]))
    want = [brute_top([int(ids[j]) for j in range(120, 240)], [int(w[a] @ w[j]) for j in range(120, 240)], 5) for a in range(120)]
    assert {r: Counter(p) for r, p in every.items()} == {k + 1: Counter((t[k][1], t[k][2]) for t in want) for k in range(5)}


def near_of(x, i, measure):
    s = x @ x[i] if measure == "ip" else -((x - x[i]) ** 2).sum(axis=1) if measure == "l2" else x @ x[i] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[i])
    s[i] = -np.inf
    return s


@pytest.mark.parametrize("measure", ["ip", "l2", "cosine"])
def test_ann(spark, measure):
    x, v = vectors_of(spark, 3000)
    got = defaultdict(list)
    for r in rows(ann.search(v, v.where("vec_id % 100 = 0"), 10, measure)):
        assert r["query_id"] != r["vec_id"]
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for i in range(0, 3000, 100):
        s, found = near_of(x, i, measure), sorted(got[i])
        hit += len(set(np.argsort(-s, kind="stable")[:10].tolist()) & {j for _, j, _ in found})
        # Ranks, scores and ties of what is found are exact.
        assert [n for n, _, _ in found] == list(range(1, 11)) and [p for _, _, p in found] == pytest.approx([s[j] for _, j, _ in found])
        assert [(j, p) for _, j, p in found] == sorted(((j, p) for _, j, p in found), key=lambda y: (-y[1], y[0]))
    assert hit / 300 >= 0.9
    assert ann.search(v.limit(0), v, 5).count() == 0


def test_ann_of_a_small_table_is_brute_force(spark):
    """Fewer rows than a list holds: all are scored exactly; equal rows, repeated ids, huge norms, clashing columns."""
    x = np.random.default_rng(9).normal(size=(90, 5)).round(1)
    x[10:30] = x[10]
    x[40] *= 1e30
    ids = [*range(89), 88]
    v = spark.createDataFrame([(i, [float(y) for y in r], "a", 1) for i, r in zip(ids, x)], "vec_id bigint, embedding array<double>, row string, codes int")
    got = defaultdict(list)
    for r in rows(ann.search(v, v.where("vec_id % 20 = 0"), 20)):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for i in range(0, 89, 20):
        other = [j for j in range(90) if ids[j] != i]
        want = brute_top([ids[j] for j in other], [float(np.einsum("nd,nd->n", x[i : i + 1], x[j : j + 1])[0]) for j in other], 20)
        assert [(n, j) for n, j, _ in sorted(got[i])] == [(n, j) for n, j, _ in want]


def test_ann_finds_the_nearest_in_crowds(spark):
    """Most rows stand nearer to each other than codes made for the rest can tell; queries in the crowd and outside, rows of all lengths."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6000, 64))
    x[:1000] = 3 * rng.normal(size=(1, 64)) + 1e-3 * rng.normal(size=(1000, 64))
    x[5900:] *= np.exp(rng.normal(size=(100, 1)))
    x = rng.permutation(x)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = defaultdict(set)
    for r in rows(ann.search(v, v.where("vec_id % 20 = 0"), 20)):
        got[r["query_id"]].add(r["vec_id"])
    assert len(got) == 300 and np.mean([len(set(np.argsort(-near_of(x, i, "ip"), kind="stable")[:20].tolist()) & l) / 20 for i, l in got.items()]) >= 0.99


def lists_of(x, asked, k=20):
    """The lists as the query makes them, in one block, and their length."""
    model = ann.Codebooks.fitted(x[np.random.default_rng(5).choice(len(x), min(len(x), ann.SAMPLE), replace=False)])
    codes, norms = (np.concatenate(p) for p in zip(*(model.encode(x[i : i + 512]) for i in range(0, len(x), 512))))
    n, got = ann.list_length(k, len(x)), []
    for at, rough in ann.rough_scores(model, x[asked], codes, norms):
        rough[np.arange(len(rough)), asked[at : at + len(rough)]] = -np.inf
        a, b = ann.best_pairs(rough, n)
        got += [b[a == i] for i in range(len(rough))]
    return got, n


@pytest.mark.parametrize("rows_of", [12_000, 60_000])
def test_ann_recall_with_few_scored_exactly(rows_of):
    x = np.random.default_rng(6).normal(size=(rows_of, 64))
    asked = np.arange(0, len(x), len(x) // 50)
    got, n = lists_of(x, asked)
    assert n < 0.05 * len(x)
    assert np.mean([len(set(np.argsort(-near_of(x, i, "ip"))[:20]) & set(l)) / 20 for i, l in zip(asked, got)]) >= 0.9


def test_ann_many_equal_candidates():
    x = np.random.default_rng(7).normal(size=(3000, 16))
    x[1000:] = 3 * x[0]
    got, n = lists_of(x, np.array([0]))
    assert got[0].tolist() == list(range(1000, 1000 + n))


# --- simhash ---


def brute_fingerprint(text, words=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, radius=3):
    up = {}

    def find(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    fps = sorted({f for _, f in pairs})
    arr = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(arr[:i] ^ arr[i]) <= radius):
            up[find(f)] = find(fps[j])
    low = {}
    for i, f in pairs:
        low[find(f)] = min(i, low.get(find(f), i))
    return {(i, f): low[find(f)] for i, f in pairs}


def test_simhash(spark, docs, odd):
    for df, block in ((docs, 1 << 17), (docs, 7), (odd, 2)):
        got = rows(simhash.near_duplicates(df, block=block))
        pairs = [(r.doc_id, brute_fingerprint(r.text)) for r in df.collect()]
        assert Counter((r["doc_id"], r["fp"] % 2**64) for r in got) == Counter(pairs)
        want = brute_components([p for p in pairs if p[0] is not None])
        assert all(r["component_id"] == want.get((r["doc_id"], r["fp"] % 2**64)) for r in got)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    stage = simhash.simhash_stage(odd)
    assert stage.columns == odd.columns and stage.where("doc_id = 3").count() == 1 and stage.where("doc_id IS NULL").count() == 1


def test_stage_keeps_unrelated_texts_of_one_id(spark):
    a, b, c = ("".join(random.Random(k).choice("abcdefgh ") for _ in range(900)) for k in (1, 2, 3))
    df = docs_of(spark, [(7, a), (7, b), (7, b), (8, a), (9, c), (9, a), (None, a), (None, a)]).withColumn("fp", F.lit("own")).withColumn("stage_fp", F.lit("own"))
    got = Counter((r.doc_id, r.text, r.fp, r.stage_fp) for r in simhash.simhash_stage(df).collect())
    assert got == Counter({(7, a, "own", "own"): 1, (7, b, "own", "own"): 1, (9, c, "own", "own"): 1, (None, a, "own", "own"): 2})


def test_link_cell_finds_all():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, k, replace=False))) for b in base for k in (0, 1, 2, 3, 4)]
    fps = np.unique(np.array(near, np.uint64))
    a, b = simhash.link_cell(fps, None, tile=16)
    got = brute_components([(int(x), int(x)) for x in fps])
    up = {int(x): int(x) for x in fps} | {int(x): int(y) for x, y in zip(a, b)}
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert groups(up) == groups({k[0]: v for k, v in got.items()})


def test_components_of_long_paths(spark):
    n = 300
    order = random.Random(1).sample(range(n), n)
    work = Workspace(spark, "test")
    e = work.stage(spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)], "a bigint, b bigint"), "e")
    got = {r.node: r.root for r in simhash.components(e, work).collect()}
    assert all(got[i] == 0 for i in range(1, n)) and got[1001] == 1000


# --- personal data ---


def brute_base(text):
    import regex

    out = []
    for m in regex.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in regex.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in regex.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        odd = d[-1::-2]
        even = [sum(divmod(2 * x, 10)) for x in d[-2::-2]]
        if 14 <= len(d) <= 19 and (sum(odd) + sum(even)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in regex.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(a, b, pii.KINDS[k]) for a, k, b in sorted(out)]


def test_base_spans(docs):
    rng = random.Random(5)
    for r in docs.collect():
        assert pii.base_spans(r.text) == brute_base(r.text)
    bits = ["a@b.co", "@", "x.y", ".", "1.2.3.4", "256", "255", "+1 (202) 555-0143", "4111 1111 1111 1111", "4111111111111111", " ", "-", "+", "9", "é", "\n", "a@b@c.d", "1.2.3.4.5.6.7.8.9"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(t) == brute_base(t), t


def test_field_adds_what_patterns_miss(spark, docs):
    f = pii.fit(docs)
    base, spans, _ = pii.find("please call (212) 555-0187 or write to jane.doe (at) example.org about order 2024-05-06", f)
    assert base == [] and [k for _, _, k in spans] == ["phone", "email"]
    clean = 0
    for r in docs.collect():
        base, spans, secrets = pii.find(r.text, f)
        assert set(base) <= set(spans)
        clean += len(spans) - len(base)
        keys = re.findall(r'(?i)token = "([0-9a-f]{40})"', r.text)
        assert [r.text[a:b] for a, b, _ in secrets if b - a == 40] == keys and len(secrets) <= len(keys) + 1
    assert clean <= 3
    # A span of any length is a candidate.
    long = "jane" + "e" * 200 + " (at) example.org"
    assert [(a, b) for a, b, _ in pii.find(f"write to {long} now", f)[1]] == [(9, 9 + len(long))]


def test_field_against_enumeration():
    """Decoding and marginals against all labellings of short runs."""
    rng = random.Random(6)
    for text in ("call 212 555 0187 now", "(212) 555-0187 12 a1", "x1 (at) y2.org 5 6"):
        f, run = pii.Field(), max(pii.islands(text), key=len)
        by_start = f.lattice(text, run)
        for segs in by_start.values():
            for *_, feats, _ in segs:
                for k in pii.FIELD_KINDS:
                    for y in feats:
                        f.w[k, y] = rng.uniform(-1, 1.2)
        by_start, n = f.lattice(text, run), len(run)

        def labellings(i):
            if i == n:
                yield 0.0, ()
                return
            for s, rest in labellings(i + 1):
                yield s, rest
            for j, a, b, kind, _, x in by_start[i]:
                for s, rest in labellings(j):
                    yield s + x, ((a, b, kind), *rest)

        every = list(labellings(0))
        total = sum(np.exp(s) for s, _ in every)
        top = max(every, key=lambda x: x[0])
        got = f.decode(text, run)
        assert tuple(x[:3] for x in got) == top[1]
        for a, b, kind, p in got:
            assert p == pytest.approx(sum(np.exp(s) for s, segs in every if (a, b, kind) in segs) / total, rel=1e-9)


def test_long_list_of_numbers():
    f = pii.Field()
    f.learn(pii.examples([]))
    text = "Phones:\n" + "\n".join(f"(212) 555-{n:04d}" for n in range(187, 387))
    want = [(8 + 15 * n, 22 + 15 * n, "phone") for n in range(200)]
    assert pii.find(text, f)[:2] == ([], want)


def test_pii_odd(spark, odd, docs):
    f = pii.fit(docs)
    long = docs_of(spark, [(1, "1" * 100_000), (2, "a" * 50_000 + "@"), (3, "1." * 30_000), (4, "+1" + " " * 50_000), (5, "😀 mail a@b.co")])
    got = {r["doc_id"]: r for r in rows(pii.detect(long, f))}
    assert got[5]["base"][0]["start"] == 7
    assert pii.detect(odd, f).count() == 12 and pii.detect(odd.limit(0), f).count() == 0


# --- licenses ---


def test_licenses(spark):
    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.txt", "plain"), ("a/b/c/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/c/d/y.txt", "words"), ("z/q.txt", "first\nLicensed under the Apache License, Version 2.0.\nlast"), ("z/r.txt", None), ("", ""), (None, "All rights reserved."), ("a/own.txt", "# Licensed under CC BY-NC 4.0."),
        ("a/b2/z.txt", "A licence is a long matter that has been talked over many times and without end in many places."),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "doc_id int, path string, text string")
    got = {r["doc_id"]: (r["license"], r["origin"], r["license_dir"]) for r in rows(licenses.scan(df, F.col("path")))}
    assert got == {
        0: ("MIT", "file", None), 1: ("MIT", "inherited", "a"), 2: ("GPL-3.0", "file", None), 3: ("GPL-3.0", "inherited", "a/b/c"), 4: ("Apache-2.0", "header", None),
        5: (None, None, None), 6: (None, None, None), 7: ("Proprietary", "header", None), 8: ("CC-BY-NC-4.0", "header", None), 9: ("MIT", "inherited", "a"),
    }
    # The user's columns stay as they are under names that are ours, too; repeated rows and long texts are files like others.
    odd = df
    for c in ("lines", "best", "dir", "license", "nr", "path_", "near", "origin", "whole", "own", "folder"):
        odd = odd.withColumn(c, F.lit("own"))
    long = df.where("doc_id = 4").withColumn("text", F.concat(F.repeat(F.lit("many words\n"), 30_000), F.lit("SPDX-License-Identifier: MIT"))).withColumn("doc_id", F.lit(100))
    odd = odd.unionByName(df.where("doc_id IN (4, 5)").unionByName(long), allowMissingColumns=True)
    again = licenses.scan(odd, F.col("path"))
    assert again.columns[:2] == ["doc_id", "path"] and "text" not in again.columns
    seen = defaultdict(list)
    for r in again.collect():
        seen[r.doc_id].append((r._license, r._origin, r.license_dir))
        assert {r.license, r.best, r.dir, r.own} in ({"own"}, {None})
    assert seen[4] == [got[4]] * 2 and seen[5] == [got[5]] * 2 and seen[100] == [("MIT", "header", None)] and seen[1] == [got[1]]
    assert licenses.scan(df.limit(0), F.col("path")).count() == 0


def test_license_query(spark, sf_dir, docs):
    found = rows(queries.op9_license_scan(spark, sf_dir.replace("0.001", "0.01")))
    assert {"file", "header", "inherited", None} == {r["origin"] for r in found}
    found = rows(queries.op9_license_scan(spark, sf_dir))
    got = {r["doc_id"]: r["license"] for r in found if r["origin"] in ("file", "header")}
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "Proprietary"}
    for r in docs.collect():
        own = {lines[x] for x in r.text.split("\n") if x in lines}
        assert got[r.doc_id] in own if own else r.doc_id not in got
    given = {r["license_path"].rsplit("/", 1)[0] for r in found if r["origin"] == "file"}
    for r in found:
        if r["doc_id"] not in got:
            assert (r["origin"] == "inherited") == (r["license_path"].rsplit("/", 2)[0] in given)


@pytest.mark.parametrize("copies", [2, 100])
def test_license_header_with_a_name_at_any_size(spark, copies):
    bodies = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(licenses.TEMPLATES)], "nth int, text string")
    corpus = bodies.crossJoin(spark.range(copies)).select((F.col("id") * 100 + F.col("nth")).alias("doc_id"), "text")
    own = spark.createDataFrame([(-1, "Licensed under the Apache License, Version 2.0. Acme"), (-2, "Acme 2024. Released under the MIT License."), (-3, "no licence for prose, not even with many rights")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["license"] for r in rows(licenses.scan(corpus.unionByName(own), F.lit("a/b").alias("p")).where("doc_id < 0"))}
    assert got == {-1: "Apache-2.0", -2: "MIT", -3: None}


def test_license_markers_hold_for_every_template():
    import re

    assert all(re.search(licenses.WRAPPED, body) for _, body in licenses.TEMPLATES)


def test_license_headers_over_lines(spark):
    mit = """MIT License

Copyright (c) 2024 Acme

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software."""
    files = [
        ("a/x.py", "\n".join(f"# {line}" for line in mit.split("\n")[4:])), ("b/LICENSE", mit), ("b/y.py", "code"),
        ("c/x.c", "/*\n * Redistribution and use in source and binary forms,\n * with or without modification, are permitted.\n */\nint x;"),
        ("d/x.c", "// This work is licensed under the\n// GNU General Public License,\n// version 3."), ("e/x", "All\nrights\nreserved."),
        ("f/x", next(b for i, b in licenses.TEMPLATES if b.endswith("obtaining a copy of this software."))), ("g/x", "a person is free\nof charge\nto walk in a park that is hereby granted to the town"),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "doc_id int, path string, text string")
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in rows(licenses.scan(df, F.col("path")))}
    assert got == {0: ("MIT", "header"), 1: ("MIT", "file"), 2: ("MIT", "inherited"), 3: ("BSD-2-Clause", "header"), 4: ("GPL-3.0", "header"), 5: ("Proprietary", "header"), 6: ("MIT", "header"), 7: (None, None)}


def test_license_headers_as_they_are_written(spark):
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU {} as published by\n# the Free Software Foundation, either version {} of the License, or\n# (at your option) any later version."
    bsd = "Copyright (c) 2020, Acme Inc.\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n"
    third = "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
    texts = {
        "GPL-3.0": "#!/bin/sh\n# Copyright (C) 2021 Jane Roe\n" + gpl.format("General Public License", 3), "GPL-2.0": gpl.format("General Public License", 2),
        "LGPL-3.0": gpl.format("Lesser General Public License", 3), "AGPL-3.0": gpl.format("Affero General Public License", 3),
        "MIT": "/* SPDX-License-Identifier: MIT */", "BSD-3-Clause": "// SPDX-License-Identifier: BSD-3-Clause", "ISC": "# SPDX-License-Identifier: ISC", "BSD-2-Clause": bsd,
        "Apache-2.0": '// Copyright 2019 The Acme Authors\n//\n// Licensed under the Apache License, Version 2.0 (the "License");\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\n//     http://www.apache.org/licenses/LICENSE-2.0',
        "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */", "Proprietary": "Copyright 2022 Acme.\nAll rights reserved.",
    }
    files = [*texts.items(), ("BSD-3-Clause", bsd + "1. Keep this notice.\n2. Also in binaries.\n" + third), ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS"), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n"), (None, "SPDX-License-Identifier: Zlib"), (None, "the licence of the shop was taken away")]
    df = spark.createDataFrame([(i, f"d{i}/x", t) for i, (_, t) in enumerate(files)], "doc_id int, path string, text string")
    got = {r["doc_id"]: r["license"] for r in rows(licenses.scan(df, F.col("path")))}
    assert got == {i: want for i, (want, _) in enumerate(files)}


#: What the versions, clauses and expressions of a declaration ask for.
SAID = [
    ("Licensed under CC BY 3.0.", None), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", None),
    ("Licensed under the BSD 4-Clause License.", None), ("Licensed under the BSD 3-Clause License.", "BSD-3-Clause"), ("Licensed under the Apache License, Version 1.1.", None), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("Licensed under CC BY-NC-ND 4.0.", None), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("SPDX-License-Identifier: CC-BY-3.0", None), ("// SPDX-License-Identifier: MPL-1.1", None), ("SPDX-License-Identifier: BSD-4-Clause", None), ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
    ("SPDX-License-Identifier: MIT-0", None), ("SPDX-License-Identifier:  MIT OR  Apache-2.0 */", "MIT OR Apache-2.0"), ("spdx-license-identifier: Apache-2.0 WITH LLVM-exception.", "Apache-2.0 WITH LLVM-exception"), ("SPDX-License-Identifier: (MIT AND ISC) OR GPL-2.0+", "(MIT AND ISC) OR GPL-2.0+"),
    ("This program is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"), ("This program is licensed under the GNU General Public License, version 1.", None),
]


def test_license_declarations(spark):
    df = spark.createDataFrame([(k, f"first line\n{said}\nlast line") for k, (said, _) in enumerate(SAID)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(df, F.concat(F.lit("src/"), F.col("doc_id"))).collect()}
    assert [got[k] for k in range(len(SAID))] == [want for _, want in SAID]


# --- mixing ---


def test_rates_against_brute_force(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    n = rng.integers(1, 50, 400)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "tokens bigint, posterior array<double>")
    targets = np.array([0.7, 0.2, 0.1]) * n.sum()
    steps, got = mixing.fit_rates(df, targets, rounds=80)
    r = np.ones(400)
    for g in steps:
        r = np.maximum(0, r - p @ g)
    assert (r >= 0).all() and ((r * n) @ p) == pytest.approx(got) and got == pytest.approx(targets, rel=1e-4)


def test_posteriors_against_brute_force(spark, sf_dir, docs):
    """The classifier step by step over the labelled documents, and the posterior of every document."""
    labelled = {r.doc_id: r.domain for r in mixing.domain_of(spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    domains = list(queries.MIX_WEIGHTS)
    signed = lambda h: h - 2**64 if h >= 2**63 else h

    def shown(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
        n, kinds = max(1, len(words)), set(words)
        ends = len(re.findall(r"[!-/:-@\[-`{-~]{2}(?=[ \t\n\x0b\f\r]|$)", text))
        marks = ((len(kinds) * 10 // n, b"distinct"), (min(10, -(-ends * 10 // n)), b"signs"))
        return {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in kinds} | {signed(xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42))) for k, b in marks}

    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = {i: shown(t) for i, t in texts.items()}
    sizes = Counter(labelled[i] for i in texts if i in labelled)
    total = sum(sizes.values())
    counts = {d: Counter(h for i in texts if labelled.get(i) == d for h in seen[i]) for d in domains}
    slots = {}
    found = []
    for h in {h for c in counts.values() for h in c}:
        n = sum(c[h] for c in counts.values())
        if n >= mixing.LEAST_DOCS:
            r = np.array([np.log((counts[d][h] + n / total) / (sizes[d] + 1)) - np.log(n / total) for d in domains]) * n / (n + 2 * mixing.LEAST_DOCS)
            if np.abs(r).max() >= mixing.LEAST_RATIO:
                found.append((-np.abs(r).max() * np.sqrt(n), h, r))
    for _, h, r in sorted(found, key=lambda x: x[:2]):
        slots.setdefault(h % mixing.SLOTS, (h, r))
    priors = np.log([(sizes[d] + 1) / (total + len(domains)) for d in domains])
    got = mixing.mix(docs, mixing.domain_of(spark.read.parquet(f"{sf_dir}/labels.parquet")), queries.MIX_WEIGHTS, "good")
    for row in got.collect():
        z = priors + sum((r for h in seen[row.doc_id] for held, r in [slots.get(h % mixing.SLOTS, (None, 0))] if held == h), np.zeros(len(domains)))
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert row.posterior == pytest.approx(want, rel=1e-3, abs=1e-6), row.doc_id
        assert row.tokens == len([w for w in re.split(r"[\x20\x09-\x0D]+", texts[row.doc_id].lower()) if w])


def test_mixing_query(spark, sf_dir):
    got = rows(queries.op10_soft_mixing(spark, sf_dir.replace("0.001", "0.01")))
    e = {d: sum(r["rate"] * r["tokens"] * r[f"p_{d}"] for r in got) for d in queries.MIX_WEIGHTS}
    for d, w in queries.MIX_WEIGHTS.items():
        assert e[d] / sum(e.values()) == pytest.approx(w, abs=0.005)


def test_mixing_odd(spark, odd):
    labels = spark.createDataFrame([(4, "good"), (6, "low")], "doc_id bigint, domain string")
    out = mixing.mixing_stage(odd, labels, queries.MIX_WEIGHTS, "good")
    assert out.columns == odd.columns
    # As many copies as the rate says, and every row as it was.
    rates = Counter()
    for r in rows(mixing.mix(odd, labels, queries.MIX_WEIGHTS, "good", odd.columns, names=("m_tokens", "m_posterior", "m_rate"))):
        rates[r["doc_id"], r["text"], r["rate"], r["tokens"]] += r["m_rate"]
        rates["n", r["doc_id"], r["text"]] += 1
    for k, n in Counter((r.doc_id, r.text, r.rate, r.tokens) for r in out.collect()).items():
        assert k in rates and abs(n - rates[k]) < rates["n", k[0], k[1]] + 1e-9
    none = rows(mixing.mix(odd, labels.limit(0), {"good": 1, "low": 1}))
    assert all(r["posterior"] == [0.5, 0.5] for r in none) and len(none) == 12
    assert mixing.mix(odd.limit(0), labels, queries.MIX_WEIGHTS).count() == 0


# --- pipeline ---


def test_pipeline(spark, sf_dir, docs):
    """Each stage against a plain version of it, on what the stage before it kept."""
    import corpus_pipeline

    df, work, kept = docs, Workspace(spark, "test-pipeline"), []
    texts = lambda d: [(r.doc_id, r.text) for r in d.collect()]
    for name, stage in corpus_pipeline.STAGES:
        before, df = df, work.stage(stage(spark, df, sf_dir), name)
        assert name == "packing" or df.columns == docs.columns
        was, now = texts(before), texts(df) if name != "packing" else rows(df)
        if name == "quality":
            score = {r.doc_id: r.score for r in quality.with_score(before, quality.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))).collect()}
            assert Counter(now) == Counter(x for x in was if score[x[0]] >= quality.THRESHOLD)
        if name == "line_dedup":
            assert Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in now) == Counter((i, h) for i, _, _, h in brute_lines(was).elements())
            assert all(r.n_chars == len(r.text) for r in df.collect())
        if name == "simhash":
            group = brute_components([(i, brute_fingerprint(t)) for i, t in was])
            assert Counter(now) == Counter((i, t) for i, t in was if group[i, brute_fingerprint(t)] == i)
        if name == "mixing":
            rate = {r["doc_id"]: r["rate"] for r in rows(mixing.mix(before, mixing.domain_of(spark.read.parquet(f"{sf_dir}/labels.parquet")), queries.MIX_WEIGHTS, "good"))}
            times = Counter(now)
            assert set(times) <= set(was) and all(int(rate[x[0]]) <= times[x] <= int(rate[x[0]]) + 1 for x in was)
        if name == "packing":
            check_packing(now, was)
        kept.append(len(now))
    assert corpus_pipeline.run(spark, sf_dir).count() == kept[-1]


# --- queries with SQL ---


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_as_sql(spark, sf_dir, name):
    import duckdb

    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir).toArrow(), duck.sql(queries.SQL[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    put = lambda t: sorted(tuple(map(repr, r)) for r in zip(*(t[n].to_pylist() for n in names)))
    assert put(got) == put(want)
