"""Mixing sources to target weights, by soft membership.

Native: DataFrame functions only.

1. Classifier.  A labelled table gives some documents a domain.  On at most ``TRAIN_ROWS`` of
   them, the documents of each domain that show a word, a rate of repetition or of odd endings are counted;
   evidence that tells the domains apart enters a naive Bayes table of at most ``SLOTS`` hashes.  Every document
   gets a posterior over domains from all its words.
2. Rates.  Nonnegative rates r_d are fitted so that the expected tokens of each domain,
   E_k = sum_d r_d n_d p_dk, match the targets in least squares.  Projected gradient from
   r = 1, with tokens as the metric and residuals weighted by the inverse Gram matrix of the
   posteriors, for which a step of one is safe:  r_d <- max(0, r_d - p_d . G^-1 (E - T)).
   A step needs K sums over all documents; these K numbers are all that the driver sees.

Posteriors are written once, narrow; all rounds read that table and none joins or shuffles
more than K sums.

Defined results: null and empty texts have no words, no tokens and the prior as posterior.
Repeated and null doc_ids are rows of their own.  Without labelled documents all
posteriors are even.  Targets of a domain that no document can have are missed by as much as they ask.
An empty table gives no rows.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, Workspace, fresh

SLOTS = 1 << 14
TRAIN_ROWS = 8_000
#: Evidence must be in so many labelled documents, and have a log-likelihood ratio of so much for some domain.
LEAST_DOCS, LEAST_RATIO = 8, 1.2
ROUNDS = 24
CLOSE = 1e-6


def words_of(text: Column) -> Column:
    """Words in lower case, an empty string at either end perhaps."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), f"{SPACE}+")


def with_evidence(docs: DataFrame, tokens: str, evidence: str) -> DataFrame:
    """The docs with the number of their words, and what their text shows as distinct hashes.

    Evidence: the words, how much they repeat, and how many end in two signs.
    Words and hashes have columns of their own on the way, so that each is made once.
    """
    words, signs = fresh(docs, "mixing_words", "mixing_signs")
    odd = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[!-/:-@\[-`{-~]{2}(?=\s|$)"))
    out = docs.withColumn(words, F.array_remove(words_of(F.col("text")), "")).withColumn(tokens, F.size(words).cast("bigint")).withColumn(signs, odd)
    out = out.withColumn(evidence, F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))
    most = F.greatest(F.col(tokens), F.lit(1))
    share = F.floor(F.size(evidence) * 10 / most).cast("int")
    ends = F.least(F.lit(10), F.ceil(F.col(signs) * 10 / most)).cast("int")
    return out.drop(words).withColumn(evidence, F.concat(evidence, F.array(F.xxhash64(share, F.lit("distinct")), F.xxhash64(ends, F.lit("signs"))))).drop(signs)


def domain_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a labels table: toxic, else low or good by quality."""
    known = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return known.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("good").alias("domain"))


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log priors, the hash in each slot (or 0), and log-likelihood ratios (domains, slots), from the labelled documents with the smallest hashed ids."""
    k = len(domains)
    chosen = labelled.where(F.col("domain").isin(domains)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("labelled_id"), "domain")
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"))
    shown = with_evidence(known.select("domain", "text"), "n", "shown").select("domain", F.explode("shown").alias("hash"))
    counted = shown.groupBy("hash").agg(*(F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)), F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS).collect()
    sizes = np.zeros(k)
    for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect():
        sizes[domains.index(r["domain"])] = r["n"]
    priors = np.log((sizes + 1) / (sizes.sum() + k))
    held, ratios = np.zeros(SLOTS, np.int64), np.zeros((k, SLOTS))
    if not counted:
        return priors, held, ratios
    n = np.array([[r[f"n{i}"] for i in range(k)] for r in counted], float).T
    hashes = np.array([r["hash"] for r in counted], np.int64)
    all_n = n.sum(axis=0)
    overall = all_n / sizes.sum()
    ratio = np.log((n + overall) / (sizes[:, None] + 1)) - np.log(overall)
    ratio *= all_n / (all_n + 2 * LEAST_DOCS)
    strength = np.abs(ratio).max(axis=0)
    # The strongest have their slots first; a slot tells one hash only, which lookups compare.
    for i in np.lexsort((hashes, -strength * np.sqrt(all_n))):
        if strength[i] >= LEAST_RATIO and not held[slot := hashes[i] % SLOTS]:
            held[slot], ratios[:, slot] = hashes[i], ratio[:, i]
    return priors, held, ratios


def _literal(values: np.ndarray, kind: str) -> Column:
    """A constant array, folded into the plan once."""
    return F.split(F.lit(",".join(f"{x:.6g}" if kind == "double" else str(x) for x in values)), ",").cast(f"array<{kind}>")


def _sum_of(slots: str, table: Column) -> Column:
    return F.aggregate(slots, F.lit(0.0), lambda a, s: a + F.get(table, s))


def with_posteriors(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], tokens: str, posterior: str) -> DataFrame:
    """The docs with a token count and an array of posteriors."""
    priors, held, ratios = model
    slots, logits = fresh(docs, "mixing_slots", "mixing_logits")
    place = lambda h: F.pmod(h, F.lit(SLOTS)).cast("int")
    hashes = _literal(held, "bigint")
    told = F.transform(F.filter(slots, lambda h: F.get(hashes, place(h)) == h), place)
    # All domains' evidence against that of the last one.
    sums = [_sum_of(slots, _literal(ratios[i] - ratios[-1], "double")) for i in range(len(priors) - 1)]
    logs = F.array(*(F.lit(float(priors[i] - priors[-1])) + s for i, s in enumerate(sums)), F.lit(0.0))
    counted = with_evidence(docs, tokens, slots).withColumn(slots, told).withColumn(logits, logs).drop(slots)
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return counted.withColumn(posterior, F.transform(powers, lambda x: x / total)).drop(logits)


def _expected(rows: DataFrame, rate: Column, k: int) -> np.ndarray:
    r = rows.agg(*(F.sum(rate * F.col("tokens") * F.col("posterior")[i]).alias(f"e{i}") for i in range(k))).first()
    return np.array([r[i] or 0.0 for i in range(k)])


def stepped(rate: Column, gradient: np.ndarray) -> Column:
    """One projected step of a document's rate."""
    move = None
    for i, g in enumerate(gradient):
        part = F.col("posterior")[i] * F.lit(float(g))
        move = part if move is None else move + part
    return F.greatest(F.lit(0.0), rate - move)


def fit_rates(rows: DataFrame, targets: np.ndarray, rounds: int = ROUNDS) -> tuple[list[np.ndarray], np.ndarray]:
    """The steps to take, in order, and the expected tokens they lead to; rows has tokens and posterior."""
    k = len(targets)
    products = rows.agg(*(F.sum(F.col("tokens") * F.col("posterior")[i] * F.col("posterior")[j]) for i in range(k) for j in range(k))).first()
    gram = np.array([x or 0.0 for x in products]).reshape(k, k)
    inverse = np.linalg.pinv(gram + 1e-9 * np.trace(gram) * np.eye(k))
    steps: list[np.ndarray] = []
    rate, got = F.lit(1.0), _expected(rows, F.lit(1.0), k)
    total = max(1.0, float(targets.sum()))
    for _ in range(rounds):
        if np.abs(got - targets).sum() <= CLOSE * total:
            break
        steps.append(inverse @ (got - targets))
        rate = stepped(rate, steps[-1])
        got = _expected(rows, rate, k)
    return steps, got


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], anchor: str | None = None, keep: list[str] | None = None, work: Workspace | None = None, names: tuple[str, str, str] = ("tokens", "posterior", "rate")) -> DataFrame:
    """doc_id (or the columns ``keep``) with tokens, posterior (in the order of ``weights``) and rate.

    ``weights`` are the domains' shares of the expected tokens.  The whole is as many tokens as
    the docs have; with an ``anchor`` it is such that this domain keeps the tokens it expects.
    """
    work = work or Workspace(docs.sparkSession, "mixing")
    domains = list(weights)
    share = np.array([max(0.0, float(weights[d])) for d in domains])
    share = share / share.sum()
    model = fit_domains(docs, labelled, domains)
    kept = keep or ["doc_id"]
    rows = with_posteriors(docs.select(*dict.fromkeys([*kept, "text"])), model, names[0], names[1])
    rows = work.stage(rows.select(*kept, names[0], names[1]), "posteriors")
    plain = rows.select(F.col(names[0]).alias("tokens"), F.col(names[1]).alias("posterior"))
    now = _expected(plain, F.lit(1.0), len(domains))
    whole = now[domains.index(anchor)] / share[domains.index(anchor)] if anchor and share[domains.index(anchor)] > 0 else now.sum()
    steps, _ = fit_rates(plain, share * whole)
    rate = F.lit(1.0)
    for g in steps:
        part = None
        for i, x in enumerate(g):
            one = F.col(names[1])[i] * F.lit(float(x))
            part = one if part is None else part + one
        rate = F.greatest(F.lit(0.0), rate - part)
    return rows.withColumn(names[2], rate)


def mixing_stage(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], anchor: str | None = None) -> DataFrame:
    """The docs at their rates: each row floor(rate + u) times, u uniform by a hash of its id and text."""
    tokens, posterior, rate = fresh(docs, "mixing_tokens", "mixing_posterior", "mixing_rate")
    mixed = mix(docs, labelled, weights, anchor, docs.columns, names=(tokens, posterior, rate))
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit("mixing")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    times = F.floor(F.col(rate) + u).cast("int")
    (copy,) = fresh(docs, "mixing_copy")
    once = mixed.where(times == 1)
    more = mixed.where(times > 1).withColumn(copy, F.explode(F.sequence(F.lit(1), times)))
    return once.select(*docs.columns).unionByName(more.select(*docs.columns))


__all__ = ["domain_of", "fit_domains", "fit_rates", "mix", "mixing_stage", "with_posteriors"]
