"""Operators over rows in an order against plain loops, with many tasks, null and tied orders, and one group of most rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import gates, intervals, pages, scan, substrings
from tidemark.streaming import desk_state


@pytest.fixture(params=[1, 7])
def tasks(spark, request):
    """So many tasks after a shuffle, none merged."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def given(seed=1, n=400):
    """(id, grp, ord, move): most rows in one group, orders null and tied."""
    rnd = random.Random(seed)
    return [(i, rnd.choice(["hot"] * 8 + ["a", "b", None]), rnd.choice([None, *range(30)]), rnd.choice([None, -24, -8, 8, 24, 40])) for i in rnd.sample(range(5000), n)]


SCHEMA = "id bigint, grp string, ord bigint, move bigint"
KEY = lambda r: (r[1] is not None, r[1] or "", r[2] is not None, r[2] or 0, r[0])


def groups_of(rows):
    out = {}
    for r in sorted(rows, key=KEY):
        out.setdefault(r[1], []).append(r)
    return out


def test_numbers(spark, tasks):
    rows = given()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r["seq"] for r in scan.numbered(df, ["grp", "ord", "id"]).collect()}
    assert got == {r[0]: k for k, r in enumerate(sorted(rows, key=KEY), 1)}
    falling = {r["id"]: r["n"] for r in scan.numbered(df, [F.desc("ord"), F.desc("id")], "n").collect()}
    assert falling == {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]), reverse=True), 1)}
    nth = {r["id"]: r["nth"] for r in scan.numbered_within(df, ["grp"], ["ord", "id"]).collect()}
    assert nth == {r[0]: k for own in groups_of(rows).values() for k, r in enumerate(own, 1)}


def test_numbering_has_no_single_task(spark):
    df = spark.range(1000).withColumn("part", F.lit(0)).withColumn("before", F.lit("own"))
    out = scan.numbered(df, ["id"])
    assert out.columns == ["id", "part", "before", "seq"] and out.where("seq = id + 1 AND before = 'own'").count() == 1000
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    assert not scan.numbered(df.limit(0), ["id"]).collect()


@pytest.mark.parametrize("block", [2, 5, 1 << 16])
def test_neighbours(spark, tasks, block):
    rows = given(2, 150)
    got = {r["id"]: (r["previous"], r["next"]) for r in scan.neighbours(spark.createDataFrame(rows, SCHEMA), "id", "ord", "grp", block).collect()}
    want = {}
    for own in groups_of(rows).values():
        ids = [r[0] for r in own]
        want |= {i: (a, b) for i, a, b in zip(ids, [None, *ids], [*ids[1:], None])}
    assert got == want and len(got) == len(rows)


def test_levels(spark, tasks):
    rows = given(3)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("move", F.col("move") / 64.0).withColumn("floor", F.lit("own"))
    out = scan.clamped_levels(df, "grp", ["ord", "id"], "move")
    assert out.columns == [*df.columns, "level"]
    want = {}
    for own in groups_of(rows).values():
        x = 0.5
        for i, _, _, move in own:
            x = min(1.0, max(0.0, x + (move or 0) / 64))
            want[i] = x
    assert {r["id"]: r["level"] for r in out.collect()} == want
    narrow = scan.clamped_levels(df, "grp", ["ord", "id"], "move", 0.25, 0.375, 0.25).agg(F.min("level"), F.max("level")).first()
    assert tuple(narrow) == (0.25, 0.375)
    assert not scan.clamped_levels(df.limit(0), "grp", ["ord", "id"], "move").collect()


def machine(events):
    now, out = "bench", []
    for e in events:
        to = desk_state.MOVES.get(e, {}).get(now, now)
        out.append((to, to != now))
        now = to
    return out


def desk_events(seed, n=300):
    rnd = random.Random(seed)
    return [(k, rnd.choice([1, 1, 1, 1, 2, 3]), f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}", rnd.choice(["click", "click", "view", "purchase", "error", None])) for k in range(n)]


def test_states(spark, tasks):
    rows = desk_events(4)
    df = desk_state.as_desk_events(spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts string, event_type string"))
    out = scan.machine_states(df, "user_id", ["ts", "event_id"], "event", desk_state.STATES, desk_state.MOVES)
    want = {}
    for user in (1, 2, 3):
        own = [r for r in rows if r[1] == user]
        want |= dict(zip((r[0] for r in own), machine([desk_state.EVENTS.get(r[3]) for r in own])))
    assert {r["event_id"]: (r["state"], r["moved"]) for r in out.collect()} == want


def test_stream_of_states_is_the_batch(spark, tmp_path):
    """The stream takes the same events in five files; a commission at work is ignored in both."""
    df = spark.createDataFrame(desk_events(5), "event_id bigint, user_id bigint, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    for k in range(5):
        df.where((F.col("event_id") >= 60 * k) & (F.col("event_id") < 60 * k + 60)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        read = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream = desk_state.desk_stream(desk_state.as_desk_events(read))
        run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination(120)
        got = {r["event_id"]: (r["state"], r["moved"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    finally:
        spark.conf.unset(key)
    batch = scan.machine_states(desk_state.as_desk_events(df), "user_id", ["ts", "event_id"], "event", desk_state.STATES, desk_state.MOVES)
    want = {r["event_id"]: (r["state"], r["moved"]) for r in batch.collect()}
    assert got == want and any(moved for _, moved in want.values())


def test_points_in_spans(spark):
    rnd = random.Random(6)
    spans = [(k, rnd.choice([1, 1, 1, 2, None]), a := rnd.randrange(-5000, 5000), a + rnd.choice([0, 0, 1, 7, 300, 9000, -1])) for k in range(150)] + [(900, 1, None, 5), (901, 1, 5, None), (902, 1, -(2**60), 2**60)]
    points = [(k, rnd.choice([1, 2, None]), rnd.choice([None, rnd.randrange(-5000, 5000), spans[k % 150][2], spans[k % 150][3]])) for k in range(300)]
    s = spark.createDataFrame(spans, "span bigint, g int, lo bigint, hi bigint")
    p = spark.createDataFrame(points, "point bigint, g int, at bigint").withColumn("bin", F.lit("own"))
    want = sorted((i, j) for i, g, lo, hi in spans for j, h, at in points if g is not None and g == h and None not in (lo, hi, at) and lo <= at <= hi)
    for finest in (1, 4, 10):
        got = intervals.interval_join(s, p, ["g"], "lo", "hi", "at", finest)
        assert got.columns == ["g", "span", "lo", "hi", "point", "at", "bin"]
        assert sorted((r["span"], r["point"]) for r in got.collect()) == want
    assert not intervals.interval_join(s.limit(0), p, ["g"], "lo", "hi", "at").collect() and not intervals.interval_join(s, p.limit(0), ["g"], "lo", "hi", "at").collect()


def test_points_of_many_widths_are_not_broadcast(spark):
    """Points stand in a bin of every width, which no estimate of their size knows; widths are every second power of two."""
    s = spark.range(40).selectExpr("id AS span", "id % 2 AS g", "id AS lo", "id + (bigint(1) << id) AS hi")
    p = spark.range(1000).selectExpr("id AS point", "id % 2 AS g", "id * 7 AS at")
    got = intervals.interval_join(s, p, ["g"], "lo", "hi", "at", 4)
    want = sum(k % 2 == j % 2 and k <= 7 * j <= k + (1 << k) for k in range(40) for j in range(1000))
    assert got.count() == want and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_pages_reach_every_record(spark, tasks):
    rows = [(i, g, o or 0, m) for i, g, o, m in given(7, 230)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = pages.page_index(df, ["grp"], ["ord", "id"], 20).collect()
    for group, own in groups_of(rows).items():
        newest = sorted(((r[2], r[0]) for r in own), reverse=True)
        cuts = sorted((r for r in index if r["grp"] == group), key=lambda r: r["page"])
        assert [r["page"] for r in cuts] == list(range(1, len(cuts) + 1)) and sum(r["n"] for r in cuts) == len(own)
        assert all(tuple(r["first"]) == newest[20 * k] and tuple(r["last"]) == newest[20 * k + r["n"] - 1] for k, r in enumerate(cuts))
    hot, seen, cursor = df.where("grp = 'hot'"), [], None
    while page := pages.page_of(hot, ["ord", "id"], 50, cursor).collect():
        seen += [(r["ord"], r["id"]) for r in page]
        cursor = seen[-1]
    assert seen == sorted(((r[2], r[0]) for r in rows if r[1] == "hot"), reverse=True)


def test_needles_are_the_scan(spark):
    rnd = random.Random(8)
    rows = [(k, "".join(rnd.choice("aBc ") for _ in range(rnd.randint(0, 9))), rnd.choice([None, "Straße 100%", "x_y", "ÄÖ", ""])) for k in range(120)]
    df = spark.createDataFrame(rows, "id bigint, one string, two string").withColumn("value", F.lit("own"))
    needles = ["a", "B", "ab", "abc", " abca ", "aB cA", "STRASSE", "straße", "0%", "_", "äö", "zzz", "", "  ", None, "c c c", "100%"]
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    index = substrings.build(df, "id", ["one", "two"])
    got = sorted(tuple(r) for r in substrings.lookup(index, asked).collect())
    want = sorted({(n.strip(" ").lower(), k) for n in needles if n and n.strip(" ") for k, a, b in rows if any(f is not None and n.strip(" ").lower() in f.lower() for f in (a, b))})
    assert got == want
    values = len({(f, (r[i] or "").lower()) for r in rows for i, f in ((1, "one"), (2, "two"))})
    assert 0 < substrings.candidates(index, asked.where("needle = 'abc'")).count() < values / 3


def test_needles_in_values_of_many_rows(spark, monkeypatch):
    """Common values go to all tasks and others are dealt; long needles are verified, records of one key stay records, and nothing is made distinct before it is dealt."""
    monkeypatch.setattr(substrings, "COMMON", 3)
    rows = [(k // 2, "north" if k % 3 else f"north {k}", f"a long name that ends in {k % 7}") for k in range(60)]
    asked = ["nor", "1", "a long name that ends in 3", "a long name that ends on 3", "north 27", "12"]
    index = substrings.build(spark.createDataFrame(rows, "id bigint, row string, two string"), "id", ["row", "two"])
    found = substrings.met(index, spark.createDataFrame([(n,) for n in asked], "needle string"))
    want = {n: [i for i, *fields in rows if any(n in f for f in fields)] for n in asked}
    got = {r["needle"]: sorted(r["keys"]) for r in found.groupBy("needle").agg(F.collect_list("key").alias("keys")).collect()}
    assert got == {n: ids for n, ids in want.items() if ids}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Aggregate") and "Aggregate" not in plan[plan.index("REPARTITION_BY_COL") :]


def test_gates_count_what_they_write(spark):
    rows = [(k, None if k % 7 == 0 else k % 5) for k in range(100)]
    df = spark.createDataFrame(rows, "id int, x int").withColumn("gate", F.lit("own")).repartition(3)
    routed = gates.route(df, {"known": F.col("x").isNotNull(), "small": F.col("x") < 3, "odd": F.col("x") != 1})
    why = lambda x: "known" if x is None else "small" if x >= 3 else "odd" if x == 1 else None
    assert {r["id"]: r["reason"] for r in routed.rejected.collect()} == {k: why(x) for k, x in rows if why(x)}
    assert sorted(r["id"] for r in routed.accepted.collect()) == [k for k, x in rows if not why(x)]
    assert routed.accepted.columns == df.columns and routed.rejected.columns == [*df.columns, "reason"]
    assert routed.total == 100 and routed.passed + sum(routed.reasons.values()) == 100
    assert routed.reasons == {g: sum(why(x) == g for _, x in rows) for g in ("known", "small", "odd")}
    none = gates.route(df.limit(0), {"any": F.col("x") > 0})
    assert (none.total, none.passed, none.accepted.count()) == (0, 0, 0)
