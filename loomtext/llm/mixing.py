"""Mixing to target weights with soft membership.

A multinomial classifier over hashed words is fitted on labelled documents,
calibrated on held-out ones, and gives every document a posterior for each
domain. Then a rate (expected number
of copies) is fitted for every document: rates are nonnegative and the expected
tokens of each domain, the sum of rate * tokens * posterior, meet the targets
in the least-squares sense. The fit is projected gradient descent: each step is
one sum per domain over all documents, and every document moves along its own
posteriors and is cut off at zero. Steps are scaled by the Gram matrix of the
posteriors (a few numbers, summed once), so that a handful of them suffices.

Only built-in functions are used. No shuffle carries more than sums by domain
or by bucket. The labelled sample is bounded by ``max_labelled``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import forget, materialise
from loomtext.llm.quality import words_of

BUCKETS = 4096
MAX_LABELLED = 20_000
#: One of so many labelled documents is held out from the fit to calibrate the posteriors.
HELD = 5


class Classifier(NamedTuple):
    """Log priors (domains), log word probabilities (domains x buckets), and the calibration: evidence is divided by
    ``length ** power`` and multiplied by ``factor``. ``loss`` is the log-loss on the held-out documents, ``plain`` that without calibration."""

    prior: np.ndarray
    weights: np.ndarray
    power: float = 0.0
    factor: float = 1.0
    loss: float | None = None
    plain: float | None = None


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, max_labelled: int = MAX_LABELLED) -> Classifier:
    """A multinomial classifier (counts plus one), calibrated on held-out documents.

    ``labelled`` has (key, domain); rows with other domains or null ids are not
    used, and of the rest at most ``max_labelled``, the first by hash of the id.
    A document with several labels counts for each. One document of HELD is
    held out, by another hash.
    """
    ids = labelled.where(F.col(key).isNotNull() & F.col("domain").isin(domains)).select(F.col(key).alias("__id"), F.col("domain").alias("__domain")).distinct()
    ids = ids.orderBy(F.xxhash64("__id"), "__id", "__domain").limit(max_labelled)
    ids = materialise(ids.withColumn("__held", F.pmod(F.xxhash64("__id", F.lit("held")), F.lit(HELD)) == 0), "labelled")
    of = lambda held: docs.join(F.broadcast(ids.where(F.col("__held") == held)), docs[key] == F.col("__id")).select("__domain", F.coalesce(docs[text], F.lit("")).alias("__text"))
    words = of(False).select("__domain", F.explode_outer(words_of(F.col("__text"))).alias("w")).where(F.col("w").isNotNull()).select("__domain", _bucket(F.col("w"), buckets).alias("b"))
    counts, n = np.zeros((len(domains), buckets)), np.zeros(len(domains))
    for d, b, c in words.groupBy("__domain", "b").count().collect():  # domains x buckets rows at most
        counts[domains.index(d), b] = c
    for d, c in ids.groupBy("__domain").count().collect():
        n[domains.index(d)] = c
    prior = np.log((n + 1) / (n.sum() + len(domains)))
    found = calibrate(of(True), domains, Classifier(prior, np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) + buckets))))
    forget(ids)
    return found


def calibrate(held: DataFrame, domains: list[str], model: Classifier) -> Classifier:
    """The power and factor with the least log-loss on ``held`` (``__domain, __text``).

    Targets are smoothed as in Platt scaling, so posteriors are no surer than
    that many documents can show. All choices are summed in one pass; nothing
    but the sums comes to the driver. Without held-out documents: no calibration.
    """
    k = len(domains)
    choices = [(0.0, 1.0)] + [(power, 2 ** (i / 2)) for power in (0.0, 0.5, 1.0) for i in range(-16, 17) if (power, i) != (0.0, 0)]
    truth = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("__domain")).cast("int") - 1
    rows = evidence(held, model.weights, "__text").select(truth.alias("truth"), "__n", "__total")
    many = rows.withColumn("choice", F.explode(F.array(*[F.struct(F.lit(p).alias("power"), F.lit(f).alias("factor")) for p, f in choices])))
    z = many.withColumn("z", logits(model.prior, F.col("choice.power"), F.col("choice.factor"))).withColumn("top", F.array_max("z"))
    norm = F.col("top") + F.log(F.aggregate(F.transform("z", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x))
    logs = z.select("choice", (F.get("z", F.col("truth")) - norm).alias("own"), (F.aggregate("z", F.lit(0.0), lambda a, x: a + x) / k - norm).alias("mean"))
    sums = {(r["power"], r["factor"]): r for r in logs.groupBy("choice.power", "choice.factor").agg(F.sum("own").alias("own"), F.sum("mean").alias("mean"), F.count("*").alias("n")).collect()}
    if not sums:
        return model
    n = next(iter(sums.values()))["n"]
    smooth = k / (n + k)
    loss = {c: -((1 - smooth) * sums[c]["own"] + smooth * sums[c]["mean"]) / n for c in choices}
    best = min(choices, key=lambda c: loss[c])
    return model._replace(power=best[0], factor=best[1], loss=-sums[best]["own"] / n, plain=-sums[choices[0]]["own"] / n)


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets).cast("long")).cast("int")


def _summed(table: Column):
    return lambda acc, b: acc + F.get(table, b)


def evidence(docs: DataFrame, weights: np.ndarray, text: str) -> DataFrame:
    """``docs`` with ``__n`` (words) and ``__total`` (array: log-likelihood of all words in each domain). ``text`` must not be null."""
    k, buckets = weights.shape
    a = docs.withColumn("__b", F.transform(words_of(F.col(text)), lambda w: _bucket(w, buckets)))
    totals = [F.aggregate("__b", F.lit(0.0), _summed(F.lit(weights[j]))) for j in range(k)]
    return a.withColumns({"__n": F.size("__b"), "__total": F.array(*totals)}).drop("__b")


def logits(prior: np.ndarray, power: Column, factor: Column) -> Column:
    scale = factor / F.pow(F.greatest(F.col("__n"), F.lit(1)).cast("double"), power)
    return F.array(*[F.lit(float(prior[j])) + F.get("__total", F.lit(j)) * scale for j in range(len(prior))])


def posteriors(docs: DataFrame, model: Classifier, text: str) -> DataFrame:
    """``docs`` with ``n_tokens`` (words) and ``posterior`` (array, sums to 1). ``text`` must not be null. No words: the prior."""
    a = evidence(docs, model.weights, text)
    b = a.withColumns({"n_tokens": F.col("__n").cast("long"), "__z": logits(model.prior, F.lit(model.power), F.lit(model.factor))}).drop("__n", "__total")
    c = b.withColumn("__e", F.transform("__z", lambda z: F.exp(z - F.array_max("__z")))).drop("__z")
    total = F.aggregate("__e", F.lit(0.0), lambda acc, x: acc + x)
    return c.withColumn("__sum", total).withColumn("posterior", F.transform("__e", lambda x: x / F.col("__sum"))).drop("__e", "__sum")


def _rate(steps: list[np.ndarray]) -> Column:
    """A document's rate after these steps, from 1. The steps are data of the expression, so that its size stays the same."""
    if not steps:
        return F.lit(1.0)
    moves = F.array(*[F.array(*[F.lit(float(c)) for c in step]) for step in steps])

    def move(rate: Column, step: Column) -> Column:
        along = sum((F.get("posterior", F.lit(j)) * F.get(step, F.lit(j)) for j in range(len(steps[0]))), F.lit(0.0))
        return F.greatest(F.lit(0.0), rate - along)

    return F.aggregate(moves, F.lit(1.0), move)


def fit_rates(features: DataFrame, targets: np.ndarray, total: float | None = None, tolerance: float = 1e-9, max_steps: int = 40) -> list[np.ndarray]:
    """The steps of the projected gradient descent; :func:`_rate` applies them to a document.

    ``features`` has ``n_tokens`` and ``posterior``. ``targets`` are shares of
    the domains. ``total`` is the expected number of tokens of the mixture; by
    default the least total at which no domain is cut below what it has. A
    domain without any tokens can't meet its target; the others still do.
    """
    k = len(targets)
    token = F.col("n_tokens").cast("double")
    p = [F.get("posterior", F.lit(j)) for j in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = features.agg(*[F.sum(token * p[i] * p[j]).alias(f"g{n}") for n, (i, j) in enumerate(pairs)], *[F.sum(token * p[j]).alias(f"s{j}") for j in range(k)]).first()
    gram, has = np.zeros((k, k)), np.array([sums[f"s{j}"] or 0.0 for j in range(k)])
    for n, (i, j) in enumerate(pairs):
        gram[i, j] = gram[j, i] = sums[f"g{n}"] or 0.0
    if not has.sum():
        return []
    shares = np.asarray(targets, float) / np.sum(targets)
    if total is None:
        total = max(has[j] / shares[j] for j in range(k) if shares[j] > 0)
    want, inverse, steps = shares * total, np.linalg.pinv(gram, rcond=1e-9, hermitian=True), []
    before = np.inf
    for _ in range(max_steps):
        rate = _rate(steps)
        got = has if not steps else np.array(features.agg(*[F.sum(token * p[j] * rate).alias(f"x{j}") for j in range(k)]).first(), float)
        step = inverse @ (got - want)
        off = float((got - want) @ step)
        if np.abs(got - want).max() <= tolerance * total or before - off <= 1e-9 * abs(before) and steps:
            break
        before = off
        steps.append(step)
    return steps


def fit(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", total: float | None = None, **sample) -> tuple[DataFrame, list[np.ndarray], Classifier]:
    """Posteriors of all documents (a written table of key, n_tokens, posterior), the steps, and the classifier."""
    domains = sorted(targets)
    model = fit_domains(docs, labelled, domains, key, text, **sample)
    rows = docs.select(docs[key].alias("__key"), F.coalesce(docs[text], F.lit("")).alias("__text"))
    features = materialise(posteriors(rows, model, "__text").drop("__text"), "posteriors")
    return features, fit_rates(features, np.array([targets[d] for d in domains]), total), model


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", total: float | None = None, **sample) -> DataFrame:
    """One row per row: ``key, n_tokens, p_<domain>..., rate``.

    Null texts are empty: no tokens, the prior as posterior, no part in the
    sums. Repeated and null ids are rows of their own. Columns besides ``key``
    and ``text`` are not read. An empty table gives no rows.
    """
    features, steps, _ = fit(docs, labelled, targets, key, text, total, **sample)
    shown = [F.get("posterior", F.lit(j)).alias(f"p_{d}") for j, d in enumerate(sorted(targets))]
    return features.select(F.col("__key").alias(key), "n_tokens", *shown, _rate(steps).alias("rate"))


def resample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", least: int = 0, **how) -> DataFrame:
    """``docs`` with every row repeated as its rate says; columns as they are.

    The fraction of a rate is rounded by a hash of key and text, so that the
    expected number of copies is the rate and a rerun gives the same rows. No
    row gets fewer than ``least`` copies.
    """
    names = docs.columns
    features, steps, model = fit(docs, labelled, targets, key, text, **how)
    forget(features)
    rows = docs.select(F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)]).alias("__row"), F.xxhash64(docs[key], docs[text]).alias("__u"), F.coalesce(docs[text], F.lit("")).alias("__text"))
    rated = posteriors(rows, model, "__text").withColumn("rate", _rate(steps))
    draw = F.shiftrightunsigned("__u", 11) / float(1 << 53)
    copies = F.greatest(F.lit(least).cast("long"), F.floor(F.col("rate") + draw).cast("long"))
    # The outer kind and a filter on what it makes: a plain explode would have the rates computed twice.
    many = rated.select("__row", F.explode_outer(F.array_repeat(F.lit(True), copies.cast("int"))).alias("__one")).where("__one")
    return many.select(*[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(names)])
