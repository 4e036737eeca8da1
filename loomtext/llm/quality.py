"""Quality rules: a hashed n-gram log-likelihood ratio between trusted and raw text.

Tokens are runs of letters and digits and runs of other characters; runs of
one and two tokens are hashed into ``buckets`` buckets. Two multinomials over
the buckets, one of the trusted documents and one of the raw corpus, give each
bucket a weight log(p_trusted / p_raw). A document's score is the mean weight
of its n-grams, so length plays no part, and documents below ``threshold`` are
rejected. The raw counts cover every document. The trusted side is fitted on at
most ``max_trusted`` labelled documents (the first by hash of their id), which
bounds the list of their ids that goes to every executor.

Only built-in functions are used. Nothing is shuffled but bucket counts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import SPACE

BUCKETS = 8192
MAX_TRUSTED = 20_000
#: Mean log-likelihood ratio, in nats per n-gram, below which a document is rejected.
THRESHOLD = -0.1
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"
#: Up to so many repeated windows, each window is looked up in their list; beyond, windows are sorted.
FEW = 64
COMPUTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def words_of(text: Column) -> Column:
    """The words of a text: runs of characters that are not ASCII white space."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def base_counts(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long). ``text`` must not be null."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    a = docs.withColumns({"__w": words_of(F.col(text)), "__l": lines})
    window = lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))
    n = F.size("__w")
    b = a.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_symbols": F.regexp_count(F.col(text), F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "__t": F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(F.array().cast("array<bigint>")),
        }
    ).drop("__w", "__l")
    c = b.withColumn("__s", F.when(F.size(F.array_distinct("__t")) < F.size("__t"), F.sort_array("__t")))
    d = c.withColumn("__r", F.array_distinct(F.filter("__s", lambda x, i: (i > 0) & (F.get("__s", i - 1) == x)))).drop("__s")
    many = F.size("__r") > FEW
    ordered = F.array_sort(F.transform("__t", lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
    e = d.withColumn("__o", F.when(many, ordered))
    same = lambda x, j: F.coalesce(F.get("__o", j)["t"] == x["t"], F.lit(False))
    by_sort = F.array_sort(F.transform(F.filter("__o", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
    by_list = F.filter(F.sequence(F.lit(0), F.size("__t") - 1), lambda i: F.array_contains(F.col("__r"), F.get("__t", i)))
    f = e.withColumn("__p", F.when(F.col("__r").isNull(), F.lit(None)).when(many, by_sort).otherwise(by_list)).drop("__o", "__t", "__r")
    cover = F.aggregate(
        "__p", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + i + 3 - F.greatest(acc["end"], i)).alias("n"), (i + 3).alias("end")),
    )
    return f.withColumn("n_repeat_words", F.coalesce(cover["n"], F.lit(0)).cast("long")).drop("__p")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_buckets(docs: DataFrame, text: str, buckets: int, to: str) -> DataFrame:
    """``docs`` with the buckets of the text's runs of one and two tokens, as an array ``to``."""
    hashed = docs.withColumn("__h", F.transform(F.regexp_extract_all(F.col(text), F.lit(TOKEN), 0), lambda t: F.xxhash64(t)))
    bucket = lambda h: F.pmod(h, F.lit(buckets).cast("long")).cast("int")
    later = F.slice("__h", F.lit(2), F.greatest(F.size("__h") - 1, F.lit(0)))
    pairs = F.transform(later, lambda x, i: bucket(F.xxhash64(F.get("__h", i), x)))
    return hashed.withColumn(to, F.concat(F.transform("__h", bucket), pairs)).drop("__h")


def fit_weights(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> np.ndarray:
    """A weight for each bucket: log(p_trusted / p_raw), each count plus one.

    ``trusted`` has the ids of trusted documents in ``key``; at most
    ``max_trusted`` of them are used. Every row of ``docs`` counts in the raw
    corpus. Without trusted text all weights are 0.
    """
    ids = trusted.where(F.col(key).isNotNull()).select(F.col(key).alias("__id")).distinct()
    ids = ids.orderBy(F.xxhash64("__id"), "__id").limit(max_trusted)
    rows = docs.select(docs[key].alias("__key"), F.coalesce(docs[text], F.lit("")).alias("__text"))
    marked = rows.join(F.broadcast(ids), F.col("__key") == F.col("__id"), "left")
    marked = marked.select(F.when(F.col("__id").isNotNull(), 1).otherwise(0).cast("long").alias("trusted"), "__text")
    # The outer kind, as for a plain explode the optimizer would compute each array twice to drop empty ones first.
    grams = with_buckets(marked, "__text", buckets, "__b").select("trusted", F.explode_outer("__b").alias("b")).where(F.col("b").isNotNull())
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("trusted").alias("trusted"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for b, r, t in counts.collect():  # one row a bucket at most
        raw[b], target[b] = r, t
    if not target.sum():
        return np.zeros(buckets)
    return np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))


def score_documents(docs: DataFrame, weights: np.ndarray, text: str = "__text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the base counts, ``base_failed, score, kept``. ``text`` must not be null.

    A text without tokens scores 0. Long texts are read whole.
    """
    table = F.lit(weights)
    a = with_buckets(base_counts(docs, text), text, len(weights), "__b")
    total = F.aggregate("__b", F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    b = a.withColumns({"base_failed": base_failed(), "score": F.when(F.size("__b") > 0, total / F.size("__b")).otherwise(F.lit(0.0))})
    c = b.drop("__b").withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    # The row number is always there, but an expression with it isn't moved: a caller's filter on a score,
    # pushed below the scores, would have each of them computed again, nested in one another.
    here = F.monotonically_increasing_id() >= 0
    return c.withColumns({name: F.when(here, F.col(name)) for name in COMPUTED})


def judge(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **fit) -> DataFrame:
    """One row per row: ``key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept``.

    Null texts count as empty (no words: base_failed). Repeated and null ids are
    rows of their own. Columns besides ``key`` and ``text`` are not read. An
    empty table gives no rows.
    """
    weights = fit_weights(docs, trusted, key, text, **fit)
    rows = docs.select(docs[key], F.coalesce(docs[text], F.lit("")).alias("__text"))
    return score_documents(rows, weights, threshold=threshold).drop("__text")


def keep_good(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **fit) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with their columns as they are."""
    names = docs.columns
    weights = fit_weights(docs, trusted, key, text, **fit)
    rows = docs.select(F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)]).alias("__row"), F.coalesce(docs[text], F.lit("")).alias("__text"))
    kept = score_documents(rows, weights, threshold=threshold).where("kept")
    return kept.select(*[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(names)])
