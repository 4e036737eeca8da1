"""Prose rhythm: sentences, breath groups, noun stacks, passives and reading time, per text and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import values as v
from loomtext.functions.text import once, strip

#: A blank before a word and one after it bound it already.
BREATH = v.BREATH.replace(r"\b", "")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(v.SENTENCE), F.lit(0)), strip), lambda s: s != "")


def nominal_run(words: Column) -> Column:
    """The longest run of words over six characters that end like nominalisations."""
    hit = lambda w: (F.length(w) > 6) & w.rlike(v.NOMINAL)
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(a: Column, w: Column) -> Column:
        on = lambda run: F.struct(run.alias("run"), F.greatest(a["most"], run).alias("most"))
        return once(F.when(hit(w), a["run"] + 1).otherwise(0), on)

    return F.aggregate(words, zero, step, lambda a: a["most"])


def measure(s: Column) -> Column:
    """A sentence's measures; its words and breath groups are found once."""
    found = F.struct(s.alias("s"), F.regexp_extract_all(s, F.lit(v.WORD), F.lit(0)).alias("w"), (F.regexp_count(s, F.lit(BREATH)) + 1).alias("g"))

    def told(x: Column) -> Column:
        n = F.size(x["w"])
        return F.struct(
            x["s"].alias("text"), n.cast("long").alias("words"), x["g"].cast("long").alias("breath_groups"), (n / x["g"]).alias("words_per_group"),
            nominal_run(x["w"]).cast("long").alias("nominal_run"), x["s"].rlike(v.bounded(v.PASSIVE)).alias("passive"),
        )

    return once(found, told)


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def _spread(xs: Column) -> Column:
    """The population standard deviation by updates of mean and sum of squares, from the last value to the first: the order and rounding of a database's aggregate, where a limit is met exactly."""
    part = lambda n, mean, squares: F.struct(n.alias("n"), mean.alias("mean"), squares.alias("squares"))

    def step(a: Column, x: Column) -> Column:
        n = a["n"] + 1.0
        return once(a["mean"] + (x - a["mean"]) / n, lambda mean: part(n, mean, a["squares"] + (x - mean) * (x - a["mean"])))

    return F.aggregate(F.reverse(xs), part(F.lit(0.0), F.lit(0.0), F.lit(0.0)), step, lambda a: F.sqrt(a["squares"] / a["n"]))


def _median(xs: Column) -> Column:
    s, n = F.sort_array(xs), F.size(xs)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return (F.get(s, low) + F.get(s, high)) / 2.0


def analyze(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of each text; a text without sentences has zeros."""
    a = docs.withColumn("per_sentence", F.transform(sentences(F.coalesce(F.col(text), F.lit(""))), measure))
    a = a.withColumn("__n", F.transform("per_sentence", lambda s: s["words"].cast("double")))
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(v.WORD)).cast("long")
    some = F.size("__n") > 0
    a = a.withColumns(
        {
            "words": words,
            "sentences": F.size("__n").cast("long"),
            "mean_sentence_words": F.when(some, _mean(F.col("__n"))).otherwise(0.0),
            "median_sentence_words": F.when(some, _median(F.col("__n"))).otherwise(0.0),
            "longest_sentence_words": F.coalesce(F.array_max("__n"), F.lit(0.0)).cast("long"),
            "breath_groups": F.aggregate("per_sentence", F.lit(0).cast("long"), lambda t, s: t + s["breath_groups"]),
            "passive_sentences": F.size(F.filter("per_sentence", lambda s: s["passive"])).cast("long"),
            "longest_nominal_run": F.coalesce(F.array_max(F.transform("per_sentence", lambda s: s["nominal_run"])), F.lit(0)).cast("long"),
            "filler_phrases": F.filter(F.array(*[F.lit(f) for f in v.FILLERS]), lambda f: F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), f)),
        }
    )
    spread = F.when(F.col("sentences") > 1, _spread(F.col("__n"))).otherwise(0.0)
    a = a.withColumn("sentence_length_variation", spread)
    per_group = F.when(F.col("breath_groups") > 0, F.col("words") / F.col("breath_groups")).otherwise(0.0)
    a = a.withColumn("mean_words_per_breath_group", per_group).drop("__n")
    return a.withColumns({"flags": flags(), "estimated_seconds": seconds(F.col("words"))})


def flags() -> Column:
    """Codes of what makes a text hard to read aloud."""
    n = F.col("sentences")
    return F.array_compact(
        F.array(
            F.when(F.col("longest_sentence_words") > 30, "long_sentence"),
            F.when(F.col("mean_words_per_breath_group") > 14, "long_breath"),
            F.when((n > 2) & (F.col("sentence_length_variation") < 3), "monotone"),
            F.when(F.col("longest_nominal_run") >= 3, "noun_stack"),
            F.when((n > 0) & (F.col("passive_sentences") >= F.greatest(F.lit(1), F.floor(n / 2))), "passive"),
            F.when(F.size("filler_phrases") > 0, "filler"),
        )
    )


def seconds(words: Column) -> Column:
    """For each register the least and greatest reading time."""
    pairs = [x for name, (low, high) in v.PACES.items() for x in (F.lit(name), F.array(words / high * 60.0, words / low * 60.0))]
    return F.create_map(*pairs)
