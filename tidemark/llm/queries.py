"""The queries of this subpackage, each over the whole of its tables, and the SQL for those that have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, digest, licenses, line_dedup, lm, mixing, packing, periodic, pii, quality, simhash, topk, trie
from tidemark.llm.common import SPACE, crc_remainder, table

#: Characters of a document that is a folder's licence file, at most.
NOTICE = 1_000
#: Shares of the expected tokens by domain; the good keep what they have.
MIX_WEIGHTS = {"good": 0.98, "low": 0.01, "toxic": 0.01}


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_score(docs.select("doc_id", "text", "n_chars"), model)
    return scored.select("doc_id", (crc_remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op5_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(pii.count_of(k).alias(f"n_{k}") for k in pii.KINDS), F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"), F.size("secrets").cast("bigint").alias("n_secret"), (F.size("spans") + F.size("secrets")).cast("bigint").alias("n_found"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/n/doc_id``; those of at most ``NOTICE`` characters that end in a marked line are their folder's licence files ``source/lang/LICENSE-doc_id``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    is_notice = (F.length("text") <= NOTICE) & F.element_at(F.split("text", "\n"), -1).rlike(licenses.MARKERS)
    name = F.when(is_notice, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat((F.col("doc_id") % 10).cast("string"), F.lit("/"), F.col("doc_id")))
    return licenses.scan(docs, F.concat_ws("/", "source", "lang", name)).select("doc_id", "license_path", "license", "similarity", "origin", "license_dir")


def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mixing.domain_of(table(spark, sf_dir, "labels")), MIX_WEIGHTS, "good")
    return mixed.select("doc_id", "tokens", *(F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(MIX_WEIGHTS)), "rate")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a tenth of the documents, by hash of doc_id, the words from a on repeat their first p, as the contract has it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    docs = docs.withColumn("w", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", f"{SPACE}+"), lambda x: x != "")))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    docs = docs.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")).cast("int"))
    docs = docs.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    repeated = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))))
    docs = docs.withColumn("text", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text"))).select("doc_id", "text")
    found = periodic.with_runs(docs).select("doc_id", "periodic.runs", "periodic.collapsed")
    # The greatest struct is the longest run, the first of these, and of these the one of the smallest period.
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    printed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.select("doc_id", "runs", "collapsed", top.alias("top"))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("top.start")).alias("start"), "top.length", (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div (-top.period)").alias("exponent_milli"), F.sha2(printed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("k1", "k2")


def op13_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest.successor_digests(docs, digest.fit_rarity(docs))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_lm_scoring, op3_quality_classifier, op4_line_dedup, op5_additive_quantisation, op6_exact_topk, op7_simhash, op8_pii, op9_license_scan, op10_soft_mixing, op11_periodic_runs, op12_prefix_trie, op13_improbable_features)}

SQL = {
    "op4_line_dedup": r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nth
    FROM documents
), keyed AS (
    SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), firsts AS (
    SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)
), kept AS (
    SELECT k.*, f.first_doc IS NULL OR f.first_doc >= k.doc_id AS stays FROM keyed k LEFT JOIN firsts f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE stays), '')) AS kept_sha256
FROM kept GROUP BY doc_id
""",
    "op12_prefix_trie": """
WITH RECURSIVE given AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
           length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said, length(coalesce(text, '')) AS chars
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, conv_id - conv_id % 100 AS base, 4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)), lambda r, b:
        list_reduce(list_prepend(xor(r, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
    FROM (SELECT DISTINCT conv_id FROM given)
), rebuilt AS (
    SELECT c.conv_id, g.pos, g.said, g.chars FROM convs c JOIN given g ON g.conv_id = c.base WHERE g.pos < c.crc % 6
    UNION ALL SELECT c.conv_id, g.pos, g.said, g.chars FROM convs c JOIN given g USING (conv_id) WHERE g.pos >= c.crc % 6
), placed AS (
    SELECT conv_id, chars, said, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM rebuilt
), chains AS (
    SELECT conv_id, 0::BIGINT AS depth, '' AS key, '' AS up, 0::BIGINT AS chars FROM convs
    UNION ALL SELECT c.conv_id, p.depth, md5(c.key || '/' || md5(p.said)), c.key, p.chars FROM chains c JOIN placed p ON p.conv_id = c.conv_id AND p.depth = c.depth + 1
), nodes AS (
    SELECT key, any_value(up) AS up, any_value(depth) AS depth, any_value(chars) AS chars, count(*) AS n_convs, min(conv_id) AS conv_id FROM chains GROUP BY key
), own AS (
    SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.up = n.key AND c.depth > 0) AS n_children FROM nodes n
), totals AS (
    SELECT a.key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * o.chars)::BIGINT AS saved_tokens
    FROM own o JOIN chains a ON a.conv_id = o.conv_id AND a.depth <= o.depth GROUP BY a.key
), ends AS (
    SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
    FROM chains JOIN (SELECT conv_id, max(depth) AS depth FROM chains GROUP BY conv_id) USING (conv_id, depth) GROUP BY key
)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM own o JOIN totals USING (key) LEFT JOIN ends USING (key) LEFT JOIN nodes p ON p.key = o.up AND o.depth > 0
""",
    "op6_exact_topk": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.vec, c.vec), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
) WHERE rank <= 5
""",
}


def _license_sql() -> str:
    """The scan of ``op9_license_scan`` for DuckDB: templates and patterns are the operator's, the steps its own."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(a)}, {level}, {quoted(b)})" for i, ((a, b), level) in enumerate(zip(licenses.TEMPLATES, licenses.LEVELS)))
    terms = r"unnest(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+(?:\.[0-9]+)*'))"
    wrapped = quoted(licenses.WRAPPED)
    parts = lambda x, pattern, n: f"regexp_extract_all(lower({x}), {quoted(pattern)}, {n})"
    numbers = lambda x: f"list_distinct(list_concat(list_transform({parts(x, licenses.VERSIONS, 1)}, lambda v: regexp_replace(v, '[.]0$', '')), list_transform({parts(x, licenses.CLAUSES, 1)}, lambda c: c || 'c')))"
    some = lambda x, alike: f"CASE WHEN list_has_any({parts(x, r'[\p{L}\p{N}]+(?:\.[0-9]+)*', 0)}, [{', '.join(map(quoted, alike))}]) THEN {quoted(alike[0])} END"
    words = lambda x: f"concat_ws(' ', {', '.join(some(x, alike) for alike in licenses.APART)})"
    known = ", ".join(map(quoted, licenses.SPDX))
    return rf"""
WITH templates(template, license, level, body) AS (VALUES {rows}), files AS (
    SELECT row_number() OVER () AS nr, doc_id, text, concat_ws('/', source, lang, CASE WHEN length(text) <= {NOTICE} AND regexp_matches(string_split(text, chr(10))[-1], {quoted(licenses.MARKERS)})
        THEN 'LICENSE-' || doc_id ELSE doc_id % 10 || '/' || doc_id END) AS path FROM documents
), named AS (
    SELECT *, regexp_matches(path, {quoted(licenses.FILE_NAMES)}) AS is_file FROM files
), lines AS (
    SELECT nr, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM named WHERE regexp_matches(text, {wrapped})
), solid AS (
    SELECT nr, line, row_number() OVER (PARTITION BY nr ORDER BY nth) AS pos FROM lines WHERE regexp_matches(line, '[\p{{L}}\p{{N}}]')
), runs AS (
    SELECT a.nr, k, a.pos, string_agg(b.line, chr(10) ORDER BY b.pos) AS passage FROM solid a, (SELECT unnest(range(2, {licenses.WINDOW} + 1)) AS k), solid b
    WHERE b.nr = a.nr AND b.pos >= a.pos AND b.pos < a.pos + k GROUP BY a.nr, k, a.pos HAVING count(*) = k
), passages AS (
    SELECT row_number() OVER () AS p, * FROM (
        SELECT nr, true AS alone, line AS passage FROM lines WHERE regexp_matches(line, {wrapped})
        UNION ALL SELECT nr, false, passage FROM runs WHERE regexp_matches(passage, {wrapped})
        UNION ALL SELECT nr, true, text FROM named WHERE is_file AND text IS NOT NULL)
), counts AS (
    SELECT nr, p, alone, term, count(*) AS tf FROM (SELECT nr, p, alone, {terms.format(x="passage")} AS term FROM passages) GROUP BY ALL
), own AS (
    SELECT template, license, level, term, count(*) AS tf FROM (SELECT template, license, level, {terms.format(x="body")} AS term FROM templates) GROUP BY ALL
), size AS (
    SELECT (SELECT count(*) FROM passages WHERE alone) + {len(licenses.TEMPLATES)} AS n
), frequency AS (
    SELECT term, count(*) FILTER (WHERE alone) AS df, 0 AS t_df FROM counts GROUP BY term UNION ALL SELECT term, 0, count(*) FROM own GROUP BY term
), idf AS (
    SELECT term, CASE WHEN sum(t_df) > 0 THEN ln((1.0 + any_value(n)) / (1 + sum(df) + sum(t_df))) + 1
        ELSE least({licenses.UNKNOWN!r}, ln((1.0 + any_value(n)) / (1 + sum(df))) + 1) END AS idf FROM frequency, size GROUP BY term
), weights AS (
    SELECT template, license, level, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS norm FROM own JOIN idf USING (term)
), mine AS (
    SELECT nr, p, term, tf * idf AS w FROM counts JOIN idf USING (term)
), lengths AS (
    SELECT p, sqrt(sum(w * w)) AS norm FROM mine GROUP BY ALL
), dots AS (
    SELECT nr, p, template, license, level, sum(m.w * t.w / t.norm) AS dot FROM mine m JOIN weights t USING (term) GROUP BY ALL
), scored AS (
    SELECT nr, template, d.license, d.level, round(dot / norm, 9) AS similarity FROM dots d JOIN lengths USING (p) JOIN passages USING (p, nr) JOIN templates USING (template)
    WHERE dot / norm >= {licenses.THRESHOLD} - 1e-6 AND list_has_all({numbers("passage")}, {numbers("body")}) AND {words("passage")} = {words("body")}
), best AS (
    SELECT nr, license, similarity FROM (SELECT *, row_number() OVER (PARTITION BY nr ORDER BY level, similarity DESC, template) AS place FROM scored WHERE similarity >= {licenses.THRESHOLD}) WHERE place = 1
), found AS (
    SELECT named.* EXCLUDE spdx, coalesce(spdx, license) AS license, CASE WHEN spdx IS NOT NULL THEN 1.0 ELSE similarity END AS similarity FROM (SELECT *, CASE WHEN len(list_filter(string_split_regex(regexp_replace(said, ' WITH [^ ]+|[()+]', '', 'g'), ' (AND|OR) '), lambda i: i NOT IN ({known}))) = 0 THEN said END AS spdx
        FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_extract(text, {quoted(licenses.SPDX_LINE)}, 1), '[ \t]+', ' ', 'g'), '[.]+$', ''), '-(only|or-later)\b', '', 'g') AS said FROM named)) named LEFT JOIN best USING (nr)
), ups AS (
    SELECT nr, far, array_to_string(parts[1:len(parts) - far], '/') AS up FROM (SELECT nr, parts, unnest(range(1, len(parts) + 1)) AS far FROM (SELECT nr, string_split(path, '/') AS parts FROM found))
), given AS (
    SELECT up, arg_max(row(license, similarity), row(similarity, path)) AS lic FROM found JOIN ups USING (nr) WHERE is_file AND license IS NOT NULL AND far = 1 GROUP BY up
), near AS (
    SELECT nr, arg_min(row(up, lic[1], lic[2]), far) AS near FROM ups JOIN given USING (up) GROUP BY nr
)
SELECT doc_id, path AS license_path, coalesce(license, near[2]) AS license, coalesce(similarity, near[3]) AS similarity,
       CASE WHEN license IS NOT NULL THEN CASE WHEN is_file THEN 'file' ELSE 'header' END WHEN near IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN license IS NULL THEN near[1] END AS license_dir
FROM found LEFT JOIN near USING (nr)
"""


SQL["op9_license_scan"] = _license_sql()
