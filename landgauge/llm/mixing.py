"""Mixing to target weights with soft domain membership, in DataFrame operations only.

Method: a naive Bayes classifier over hashed words, fitted on a table of
labelled documents, gives every text a posterior over the domains (tempered, so
a long text isn't taken for certain). Document rates are then fitted by
projected gradient on the least-squares distance between the expected token
totals of the domains, sum of rate x tokens x posterior, and their targets:
each round sums totals and the domains' Gram matrix over the table of different
texts, takes a step from those few numbers, and clips the rates to their bounds.
Equal texts have equal posteriors, so they share a rate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgauge.llm.scratch import cut

BUCKETS, SMOOTHING = 1 << 16, 0.5
# the classifier is fitted on about this many labelled documents of each domain at most
SAMPLE_PER_DOMAIN = 4000
# how many words' worth of evidence the mean log-likelihood of a text counts for
EVIDENCE_WORDS = 30.0
# the fit ends when the squared distance is below TOLERANCE (of the total, squared) or falls by less than SETTLED in a round
TOLERANCE, SETTLED = 1e-6, 0.02


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def words_of(text: Column) -> Column:
    """Lower-cased words between white space, with empty strings where it repeats."""
    spaced = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    for mark in "\n\t\r":  # three passes over plain bytes cost less than one translate, which looks up every character
        spaced = F.replace(spaced, F.lit(mark), F.lit(" "))
    return F.split(spaced, " ")  # one plain character is split at without a regular expression


def bucket_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def unit_hash(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> tuple[DataFrame, list[float]]:
    """(bucket, ll_0 .. ll_k, one row per bucket; log priors) of naive Bayes over `labelled` (doc_id, domain).

    The priors cover all labelled ids, the word counts a bounded sample of them.
    """
    given = cut(labelled.filter(F.col("doc_id").isNotNull() & F.col("domain").isin(*domains)).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("domain").alias("_domain")))
    sizes = {r["_domain"]: r["count"] for r in given.groupBy("_domain").count().collect()}  # one row per domain
    per_domain = F.coalesce(*[F.when(F.col("_domain") == d, F.lit(float(sizes.get(d, 0)))) for d in domains])
    chosen = given.filter(unit_hash(F.col("_id"), F.lit("mix")) * per_domain < SAMPLE_PER_DOMAIN)
    # at most about domains x SAMPLE_PER_DOMAIN rows, so it can be held by every task
    sample = docs.join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("_id")).select("_domain", F.explode(words_of(F.col("text"))).alias("w")).filter("w <> ''")
    found = cut(
        sample.groupBy(bucket_of(F.col("w")).alias("bucket")).agg(*[F.count(F.when(F.col("_domain") == d, 1)).alias(f"c_{i}") for i, d in enumerate(domains)])
    )
    totals = found.agg(*[F.coalesce(F.sum(f"c_{i}"), F.lit(0)) for i in range(len(domains))]).first()
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(found, "bucket", "left")
    table = cut(
        every.select(
            "bucket", *[F.log((F.coalesce(f"c_{i}", F.lit(0)) + SMOOTHING) / F.lit(totals[i] + SMOOTHING * BUCKETS)).alias(f"ll_{i}") for i in range(len(domains))]
        )
    )
    everyone = sum(sizes.values()) + len(domains)
    return table, [float(np.log((sizes.get(d, 0) + 1) / everyone)) for d in domains]


def memberships(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """key, rows, tokens, p_0 .. p_k: each different text with its posterior over `domains`; a text without words has the priors.

    The posterior needs only how much likelier each word is in a domain than in the first one, so that is what is summed.
    """
    table, priors = classifier(docs, labelled, domains)
    k = range(1, len(domains))
    ratios = cut(table.select("bucket", *[(F.col(f"ll_{i}") - F.col("ll_0")).alias(f"d_{i}") for i in k]))
    # the key is worked out below the explode, once per text and not once per word
    keyed = docs.select(text_key(F.col("text")).alias("key"), "text")
    words = keyed.select("key", F.explode(words_of(F.col("text"))).alias("w")).filter("w <> ''")
    sums = (
        words.select("key", bucket_of(F.col("w")).alias("bucket"))
        .join(F.broadcast(ratios), "bucket")  # BUCKETS rows
        .groupBy("key").agg(F.count(F.lit(1)).alias("words"), *[F.sum(F.coalesce(f"d_{i}", F.lit(0.0))).alias(f"s_{i}") for i in k])
    )
    texts = docs.groupBy(text_key(F.col("text")).alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    both = texts.join(sums, "key", "left")
    tokens = F.round(F.coalesce("words", F.lit(0)) / F.col("rows")).cast("long")  # equal texts have equally many
    logits = [F.lit(0.0), *[F.lit(priors[i] - priors[0]) + EVIDENCE_WORDS * F.coalesce(F.col(f"s_{i}") / F.col("words"), F.lit(0.0)) for i in k]]
    told = both.select("key", "rows", tokens.alias("tokens"), *[x.alias(f"l_{i}") for i, x in enumerate(logits)])
    top = F.greatest(*[F.col(f"l_{i}") for i in range(len(domains))]) if len(domains) > 1 else F.col("l_0")
    raised = told.select("key", "rows", "tokens", *[F.exp(F.col(f"l_{i}") - top).alias(f"e_{i}") for i in range(len(domains))])
    total = sum((F.col(f"e_{i}") for i in range(len(domains))), F.lit(0.0))
    return raised.select("key", "rows", "tokens", *[(F.col(f"e_{i}") / total).alias(f"p_{i}") for i in range(len(domains))])


def fit_rates(members: DataFrame, shares: list[float], low: float, high: float, keep_all: bool) -> tuple[DataFrame, list[float], list[float]]:
    """(members with rate, targets, expected totals) after projected gradient.

    The targets are the shares of the token total. With keep_all the budget is
    the smallest in which no domain has to shrink, for a `low` of 1.
    """
    k = range(len(shares))
    weight = (F.col("rows") * F.col("tokens")).cast("double")

    def sums(at: DataFrame, free: Column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected totals, and the Gram matrices of all texts and of the free ones."""
        cross = [(i, j) for i in k for j in k if i <= j]
        row = at.agg(
            *[F.sum(weight * F.col("rate") * F.col(f"p_{i}")) for i in k],
            *[F.sum(weight * F.col(f"p_{i}") * F.col(f"p_{j}")) for i, j in cross],
            *[F.sum(F.when(free, weight * F.col(f"p_{i}") * F.col(f"p_{j}"))) for i, j in cross],
        ).first()
        values = [float(v or 0.0) for v in row]
        grams = []
        for part in (values[len(shares) : len(shares) + len(cross)], values[len(shares) + len(cross) :]):
            g = np.zeros((len(shares), len(shares)))
            for (i, j), v in zip(cross, part):
                g[i, j] = g[j, i] = v
            grams.append(g)
        return np.array(values[: len(shares)]), *grams

    def free_of(step: np.ndarray) -> Column:
        """Not at a bound that the step would push it beyond."""
        push = sum((F.lit(float(step[i])) * F.col(f"p_{i}") for i in k), F.lit(0.0))
        return ((F.col("rate") > low) | (push > 0)) & ((F.col("rate") < high) | (push < 0))

    def moved(at: DataFrame, step: np.ndarray) -> DataFrame:
        push = sum((F.lit(float(step[i])) * F.col(f"p_{i}") for i in k), F.lit(0.0))
        return cut(at.withColumn("rate", F.least(F.greatest(F.col("rate") + push, F.lit(low)), F.lit(high))))

    now = cut(members.withColumn("rate", F.lit(min(max(1.0, low), high))))
    totals, gram, _ = sums(now, F.lit(True))
    share = np.array(shares) / sum(shares)
    budget = totals.sum()
    if keep_all:
        budget = max([budget, *(totals[i] / share[i] for i in k if share[i] > 0)])
    target = share * budget
    steepest = 1.0 / max(float(np.linalg.eigvalsh(gram)[-1]), 1e-12)
    while True:
        gap = target - totals
        distance = float(gap @ gap)
        if distance <= (TOLERANCE * max(budget, 1.0)) ** 2:
            break
        _, _, free = sums(now, free_of(gap))
        # the Gram matrix of the texts that can move scales the gradient
        tried = moved(now, np.linalg.solve(free + np.eye(len(shares)) * 1e-9 * max(float(np.trace(gram)), 1e-9), gap))
        new, _, _ = sums(tried, F.lit(True))
        if float(((target - new) ** 2).sum()) > 0.5 * distance:  # too many bounds were met: the plain step never does harm
            plain = moved(now, gap * steepest)
            other, _, _ = sums(plain, F.lit(True))
            if float(((target - other) ** 2).sum()) < float(((target - new) ** 2).sum()):
                tried, new = plain, other
        left = float(((target - new) ** 2).sum())
        if left < distance:
            now, totals = tried, new
        if left > distance * (1 - SETTLED):  # hardly any progress: the targets are out of reach
            break
    return now, target.tolist(), totals.tolist()


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], low: float = 0.0, high: float = 4.0, keep_all: bool = False) -> DataFrame:
    """key, rows, tokens, rate, p_0 .. p_k, targets, expected per different text of `docs` (doc_id, text); domains in the order of `targets`.

    `targets` and `expected` are the domains' token totals, wanted and reached, the same in every row: where the bounds on the
    rates keep a target out of reach, they differ.

    `labelled` (doc_id, domain) teaches the classifier; domains that `targets`
    lacks and null ids teach nothing, and of several domains of one id the
    first by name counts. `targets` gives each domain's weight. Rates lie in
    low .. high; where no rates meet the targets, they are those at which the
    least-squares distance stops falling. Null texts count as empty, with no
    tokens and a rate of 1 clipped to the bounds; empty tables give no rows.
    """
    domains = list(targets)
    members = cut(memberships(docs, labelled, domains))
    rated, wanted, reached = fit_rates(members, [float(targets[d]) for d in domains], low, high, keep_all)
    return rated.withColumns({"targets": F.array(*map(F.lit, wanted)), "expected": F.array(*map(F.lit, reached))})


def copies_of(rate: Column, *identity: Column) -> Column:
    """A whole number of copies whose expectation over documents is the rate, fixed by the identity's hash."""
    whole = F.floor(rate)
    return (whole + F.when(unit_hash(*identity) < rate - whole, 1).otherwise(0)).cast("int")


def per_document(docs: DataFrame, rated: DataFrame) -> DataFrame:
    """doc_id, tokens, posterior (array), rate, copies, targets, expected of every row of `docs`.

    Null and repeated ids are rows like any other; equal rows have equally many copies; other columns are not read.
    """
    posterior = F.array(*[c for c in rated.columns if c.startswith("p_")])
    rates = cut(rated.select("key", "tokens", posterior.alias("posterior"), "rate", "targets", "expected"))
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key")))
    copies = copies_of(F.col("rate"), F.col("doc_id"), F.col("key")).alias("copies")
    return rows.join(rates, "key").select("doc_id", "tokens", "posterior", "rate", copies, "targets", "expected")


def apply_copies(docs: DataFrame, rated: DataFrame) -> DataFrame:
    """Every row of `docs`, whatever its columns are called, as many times as its copies say; an empty table stays empty."""
    rates = cut(rated.select("key", "rate"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), text_key(F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("id")).join(rates, "key")
    wanted = rows.select("row", copies_of(F.col("rate"), F.col("id"), F.col("key")).alias("copies")).filter("copies > 0")
    return wanted.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
