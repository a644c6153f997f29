"""Functions against known values and small rules."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import quotes
from tidemark.functions import seeded as S
from tidemark.functions import text as X
from tidemark.operators import adjudication, archive, scan
from tidemark.sources import tables
from tidemark.streaming import rollup


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_fnv_vectors(spark):
    r = one(spark, a=S.fnv1a(F.lit("")), b=S.fnv1a(F.lit("a")), c=S.fnv1a(F.lit("foobar")), d=S.fnv1a(F.lit(None).cast("string")), e=S.name_seed(F.lit(None).cast("string")), f=S.fnv1a(F.lit("untitled")), g=S.text_seed(F.lit("")), h=S.fnv1a(F.lit("empty")))
    assert (r.a, r.b, r.c, r.d) == (0x811C9DC5, 0xE40C292C, 0xBF9CF968, None)
    assert r.e == r.f and r.g == r.h


def test_fnv_of_long_and_odd_texts(spark):
    texts = ["é" * 3000 + "x", "a😀b" * 500, " ", "\u2028", "😀", "a\x00b", "", *("x" * (n % 37) for n in range(600))]
    d = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select("t", S.fnv1a(F.col("t")).alias("h"))
    for r in d.collect():
        h, raw = 0x811C9DC5, r.t.encode("utf-16-be")
        for k in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[k : k + 2], "big")) * 0x01000193) & 0xFFFFFFFF
        assert r.h == h, r.t[:10]


def fnv(text):
    h, raw = 0x811C9DC5, text.encode("utf-16-le")
    for k in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[k : k + 2], "little")) * 0x01000193) & 0xFFFFFFFF
    return h


def test_fnv_in_bounded_memory(monkeypatch):
    """One text of five million signs among short ones takes some tens of MB; texts cut anywhere give the same hashes."""
    import tracemalloc

    import numpy as np

    units = lambda texts: [np.frombuffer(t.encode("utf-16-le"), "<u2") for t in texts]
    long = units(["x" * 5_000_000, *("ab" * (k % 50) for k in range(1023))])
    tracemalloc.start()
    got = S._hashes(long)
    assert tracemalloc.get_traced_memory()[1] < 120_000_000
    tracemalloc.stop()
    assert got[0] == fnv("x" * 5_000_000) and list(map(int, got[1:])) == [fnv("ab" * (k % 50)) for k in range(1023)]
    texts = ["é😀" * (k * 7 % 90) for k in range(300)]
    want = [fnv(t) for t in texts]
    for side, cells, few in ((64, 100, 3), (1024, 1000, 0), (7, 10, 5)):
        monkeypatch.setattr(S, "TEXTS", side)
        monkeypatch.setattr(S, "CELLS", cells)
        monkeypatch.setattr(S, "FEW", few)
        assert list(map(int, S._hashes(units(texts)))) == want


def test_white_space_of_unicode(spark):
    """What a trim and a split take for white space: Unicode's separators and the byte order mark, too."""
    wide = ["\u00a0", "\u3000", "\u2003", "\u2028", "\ufeff", "\u202f", "\x0b", " "]
    text = "".join(wide) + "One\u00a0two\u3000three." + "\ufeff".join(wide)
    r = one(spark, t=X.trimmed(F.lit(text)), n=X.word_count(F.lit(text)), s=X.sentences(F.lit("A first sentence of some length.\u2003\u00a0A second one of the same length!\u3000no")), z=X.trimmed(F.lit("a\u200bb\u200b")))
    assert r.t == "One\u00a0two\u3000three." and r.n == 3 and len(r.t) == 14
    assert r.s == ["A first sentence of some length.", "A second one of the same length!"] and r.z == "a\u200bb\u200b"


def mulberry(seed):
    while True:
        seed = (seed + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((seed ^ (seed >> 15)) * (seed | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ (t >> 7)) * (t | 61))) & 0xFFFFFFFF
        yield (t ^ (t >> 14)) / 4294967296


def test_draws(spark):
    g = mulberry(12345)
    r = one(spark, **{f"d{i}": S.draw(F.lit(12345).cast("bigint"), i) for i in range(1, 6)})
    assert list(r) == [next(g) for _ in range(5)]


def test_envelope(spark):
    seeds = [1, 12345, None, 4294967295]
    d = spark.createDataFrame([(x,) for x in seeds], "seed bigint").select("seed", S.envelope(F.col("seed"), 40).alias("e"))
    for r in d.collect():
        if r.seed is None:
            assert r.e is None
            continue
        g, level, want = mulberry(r.seed), 0.5, []
        for i in range(40):
            level = min(1, max(0, level + (next(g) - 0.5) * 0.55))
            want.append(0.12 + 0.88 * level * (0.35 + 0.65 * math.sin(math.pi * (i + 0.5) / 40)))
        assert r.e == pytest.approx(want, abs=1e-12)


def test_text(spark):
    t = F.lit("A first sentence that is long enough. Short. Is this one also long enough to stay? A first sentence that is long enough.")
    q = F.slice(X.sentences(t), 1, 4)
    r = one(spark, s=X.sentences(t), p=X.marked_pieces(t, q), n=X.padded(F.lit(112)), b=X.badge(F.lit("under Review")), k=X.readable_size(F.lit(1536)), c=X.timecode(F.lit(87.36)), z=X.sentences(F.lit("")), f=X.shortened(F.lit("x" * 23)))
    assert len(r.s) == 3 and "".join(p.piece for p in r.p) == "A first sentence that is long enough. Short. Is this one also long enough to stay? A first sentence that is long enough."
    assert [p.nth for p in r.p] == [0, None, 1, None]
    assert (r.n, r.b, r.k, r.c, r.z, r.f) == ("112", "review", "2 KB", "01:27", [], "x" * 20 + "…")


#: The filings, written out: id, label, weight, determination.
FILINGS = [("text", "Text", 24, "REQUIRES VERIFICATION"), ("image", "Image", 16, "SYNTHETIC"), ("audio", "Audio", 18, "SYNTHETIC"), ("video", "Video", 21, "SYNTHETIC"), ("fact-check", "Fact-check", 21, "CONTRADICTED")]


def decided(roster):
    """Contributions in hundredths, ruling and confidence, step by step."""
    filed = [f for f in FILINGS if f[0] in roster] or FILINGS
    total = sum(f[2] for f in filed)
    parts = [math.floor(f[2] / total * 100 + 0.5) for f in filed]
    parts[parts.index(max(parts))] += 100 - sum(parts)
    ruling = next(d for d in ("CONTRADICTED", "SYNTHETIC", "REQUIRES VERIFICATION") if any(f[3] == d for f in filed))
    return [(f[1], p, f[3]) for f, p in zip(filed, parts)], ruling, f"{89 + len(filed)}%"


def test_decision_of_every_roster(spark):
    """All 31 sets of desks, in any order, the empty list and an unknown desk."""
    ids = [f[0] for f in FILINGS]
    rosters = [list(reversed(c)) for n in range(1, 6) for c in itertools.combinations(ids, n)] + [[], ["weather"], ["weather", "audio"]]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rosters)], "i int, roster array<string>")
    for r in d.select("i", adjudication.decision(F.col("roster")).alias("d")).collect():
        contributions, ruling, sure = decided(rosters[r.i])
        assert [(c.desk, round(c.share * 100), c.determination) for c in r.d.contributions] == contributions
        assert (r.d.verdict.determination, r.d.verdict.confidence) == (ruling, sure)
        n, synthetic = len(contributions), sum(c[2] == "SYNTHETIC" for c in contributions)
        assert ("found synthetic media" in r.d.verdict.rationale) == (synthetic >= 2)
        assert ("contradict the claim" in r.d.verdict.rationale) == any(c[0] == "Fact-check" for c in contributions)
        assert ("alone" in r.d.verdict.rationale) == (n == 1) and [a.ref for a in r.d.annotations] == list(range(1, n + 1))
        assert {e.key: e.value for e in r.d.ledger}["Desks reporting"] == f"0{n}"


def test_shares_and_rulings(spark):
    """The same as rows: rosters, the fallback, shares and rulings."""
    cases = {"all": "text image audio video fact-check", "some": "image audio video fact-check", "one": "audio", "none": "weather"}
    filings = spark.createDataFrame([(c, i, f[0], f[2], f[3]) for c in [*cases, "unasked"] for i, f in enumerate(FILINGS)], "case_id string, seq int, desk string, weight int, det string")
    rosters = spark.createDataFrame([(c, d) for c, ds in cases.items() for d in ds.split()], "case_id string, desk string")
    f = adjudication.reporting(filings, rosters, "case_id", "desk")
    got = {(r.case_id, r.seq): r.share for r in adjudication.shares(f, "case_id", "weight", "seq").collect()}
    for c in ("all", "none", "unasked"):
        assert [got[c, i] for i in range(5)] == [0.24, 0.16, 0.18, 0.21, 0.21]
    assert [got["some", i] for i in range(1, 5)] == [0.21, 0.24, 0.27, 0.28] and ("some", 0) not in got
    assert got["one", 2] == 1.0
    rule = {r.case_id: (r.ruling, r.confidence) for r in adjudication.rulings(f, "case_id", "det").collect()}
    assert rule["all"] == rule["none"] == ("CONTRADICTED", "94%") and rule["some"] == ("CONTRADICTED", "93%") and rule["one"] == ("SYNTHETIC", "90%")


def test_unknown_determinations_never_win(spark):
    f = spark.createDataFrame([("a", "CLEAR"), ("a", "MADE UP"), ("b", "MADE UP"), ("b", None)], "case_id string, det string")
    assert {r.case_id: r.ruling for r in adjudication.rulings(f, "case_id", "det").collect()} == {"a": "CLEAR", "b": "INSUFFICIENT"}


def test_order_of_results(spark, sf_dir):
    from tidemark.plans import registry

    got = [(r.n, r.region) for r in registry.QUERIES["region_rollup"](spark, sf_dir).collect()]
    assert got == sorted(got, key=lambda x: (-x[0], x[1]))
    facets = registry.QUERIES["archive_facets"](spark, sf_dir).collect()
    of = lambda name: [r for r in facets if r.facet == name]
    assert [r.value for r in of("year")] == sorted((r.value for r in of("year")), reverse=True)
    assert [r.first_seq for r in of("desk")] == sorted(r.first_seq for r in of("desk"))
    assert [r.value for r in of("determination")] == sorted(r.value for r in of("determination"))
    page = registry.QUERIES["archive_page"](spark, sf_dir).collect()
    assert [(r.place, r.page) for r in page] == sorted((r.place, r.page) for r in page) and {r.place for r in page} == set(range(1, page[-1].place + 1))
    ids = [i for r in page for i in r.ids.split(",")]
    assert len(ids) == len(set(ids)) == page[0].shown < page[0].total and max(r.page for r in page) > 1


def test_facets_reach_the_scan(spark, sf_dir, capsys):
    from tidemark.plans import registry

    registry.QUERIES["archive_facet_filter"](spark, sf_dir).explain("formatted")
    pushed = next(x for x in capsys.readouterr().out.split("\n") if "PushedFilters" in x)
    assert "GreaterThanOrEqual(o_orderdate,1998" in pushed and "LessThan(o_orderdate,1999" in pushed and "EqualTo(o_orderpriority,2-HIGH)" in pushed


@pytest.mark.parametrize("block", [7, 1000])
def test_neighbours_across_blocks(spark, block):
    rows = [(i * 7 % 101, i % 3) for i in range(100)] + [(500, 9)]
    d = spark.createDataFrame(rows, "k bigint, g int")
    got = {r.k: (r.previous, r.next) for r in scan.neighbours(d, "k", "k", "g", block).collect()}
    for g in {x[1] for x in rows}:
        keys = sorted(k for k, h in rows if h == g)
        for a, k, b in zip([None, *keys], keys, [*keys[1:], None]):
            assert got[k] == (a, b)


def test_media_files(spark, tmp_path):
    for name, size in (("a.jpg", 10), ("b.PDF", 5), ("deep/c.webp", 7), ("d.mp3", 3), ("E.JPeG", 2)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    got = {m: {(r.file_name, r.bytes) for r in tables.media_files(spark, str(tmp_path), m).collect()} for m in ("image", "audio")}
    assert got == {"image": {("a.jpg", 10), ("c.webp", 7), ("E.JPeG", 2)}, "audio": {("d.mp3", 3)}}
    picked = tables.picked_file(tables.media_files(spark, str(tmp_path), "image").withColumn("drop", F.length("file_name") > 5).withColumn("modified", F.lit(None).cast("timestamp")), ["drop"]).collect()
    assert {(r["drop"], r["file_name"]) for r in picked} == {(True, "E.JPeG"), (False, "a.jpg")}


def test_names_as_people_order_them(spark):
    names = ["Zürich", "zebra", "Öl", "Eclair", "éclair", "apfel", "Ärger", "Apfel", "Azur"]
    d = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in d.orderBy(X.by_name(F.col("n"))).collect()] == ["apfel", "Apfel", "Ärger", "Azur", "Eclair", "éclair", "Öl", "zebra", "Zürich"]
    assert d.where(X.by_name(F.col("n"), True) == "APFEL").count() == 2 and d.where(X.by_name(F.col("n"), True) == "arger").count() == 0


def test_many_quotes_are_the_few(spark):
    import random
    import time

    rnd = random.Random(9)
    rows = [("".join(rnd.choice("ab .é😀") for _ in range(rnd.randint(0, 60))), [rnd.choice([None, "", "a", "b ", "ab", "é", "😀a", "zz", "a", "aab"]) for _ in range(rnd.randint(0, 6))]) for _ in range(150)] + [(None, ["a"]), ("a", None)]
    d = spark.createDataFrame([(t, None if q is None else [x for x in q if x is not None]) for t, q in rows], "t string, q array<string>")
    r = d.select(X.marked_pieces(F.col("t"), F.col("q")).alias("few"), quotes.marked_pieces_of(F.col("t"), F.col("q")).alias("many")).collect()
    assert [x.many for x in r[:150]] == [x.few for x in r[:150]] and [x.many for x in r[150:]] == [None, None]
    assert quotes.pieces("abc", ["b", None, "c"]) == [("a", None), ("b", 0), ("c", 2)]
    words = [f"word{k:05d}." for k in range(10_000)]
    began = time.time()
    cut = quotes.pieces(" ".join(words), words)
    assert [n for _, n in cut if n is not None] == list(range(10_000)) and "".join(p for p, _ in cut) == " ".join(words) and time.time() - began < 5


def test_search_is_literal(spark):
    d = spark.createDataFrame([("a_b", None), ("axb", "50%")], "x string, y string")
    assert [r.x for r in archive.search(d, ["x", "y"], "A_B").collect()] == ["a_b"]
    assert [r.x for r in archive.search(d, ["x", "y"], "%").collect()] == ["axb"]
    assert archive.search(d, ["x"], "  ").count() == 2


def test_stream(spark, sf_dir, tmp_path):
    """The stream's windows are the batch's; a row later than the watermark allows is left out."""
    spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(str(tmp_path / "in"))
    events = rollup.read_events(spark, str(tmp_path / "in"))

    def run(name, mode):
        q = rollup.windowed(events, late="3650 days" if mode == "complete" else "2 hours").writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).format("memory").queryName(name).start()
        q.processAllAvailable()
        return q

    run("rolled", "complete").stop()
    batch = spark.read.parquet(str(tmp_path / "in")).groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    put = lambda d: sorted((r.start, r.event_type, r.n, round(r.total, 6)) for r in d.collect())
    assert put(spark.table("rolled")) == put(batch)
    q = run("late", "append")
    before = spark.table("late").count()
    old = spark.read.parquet(str(tmp_path / "in")).orderBy("ts").limit(1).withColumn("event_type", F.lit("too late"))
    new = old.withColumn("ts", F.timestamp_add("DAY", F.lit(400), F.lit("2030-01-01").cast("timestamp"))).withColumn("event_type", F.lit("new"))
    for d in (new, old):
        d.write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    assert before > 0 and spark.table("late").where("event_type = 'too late'").count() == 0


def test_cases_without_an_id(spark):
    """A null case is a case of its own for shares; for rosters it names nobody, so its filings stay."""
    filings = spark.createDataFrame([(None, 1, 24), (None, 2, 16), (7, 1, 24), (7, 2, 16)], "c int, d int, w int")
    got = {(r.c, r.d): r.share for r in adjudication.shares(filings, "c", "w", "d").collect()}
    assert got == {(None, 1): 0.6, (None, 2): 0.4, (7, 1): 0.6, (7, 2): 0.4}
    rosters = spark.createDataFrame([(None, 1), (7, 2)], "c int, d int")
    kept = sorted(((r.c, r.d) for r in adjudication.reporting(filings, rosters, "c", "d").collect()), key=repr)
    assert kept == [(7, 2), (None, 1), (None, 2)]


def test_archive_page_reads_its_records_once(spark, sf_dir):
    """One scan of orders gives hits, shown and total; what pages are made of is written in that pass."""
    from tidemark.operators import gates
    from tidemark.plans import archive as plans

    read = []
    route = gates.route
    gates.route = lambda rows, *a: read.append(rows) or route(rows, *a)
    try:
        page = plans.archive_page(spark, sf_dir)
    finally:
        gates.route = route
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert len(read) == 1 and "o_orderkey" not in plan and page.count() > 0
