"""Does a rewrite keep what its original says? One row per pair, all rules as expressions over the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as tx
from loomtext.functions import values as v


def more_often(a: Column, b: Column) -> Column:
    """Distinct values that ``a`` has more often than ``b``."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.filter(F.array_distinct(a), lambda x: times(a, x) > times(b, x))


def absent(a: Column, b: Column) -> Column:
    """Values of ``a``, repeated ones too, that ``b`` hasn't."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def check(pairs: DataFrame, source: str = "source", rewrite: str = "rewrite", protected: str | None = None) -> DataFrame:
    """``pairs`` with ``passed, violations, checked``.

    Numbers are compared as multisets, dates as sets, both ways. Null texts are
    empty. ``protected`` names an array column of further terms to keep.
    """
    s, r = F.coalesce(F.col(source), F.lit("")), F.coalesce(F.col(rewrite), F.lit(""))
    more = F.coalesce(F.col(protected), F.array().cast("array<string>")) if protected else F.array().cast("array<string>")
    a = pairs.withColumns(
        {
            "__s": s, "__r": r, "__ns": tx.numbers(s), "__nr": tx.numbers(r), "__ds": tx.dates(s), "__dr": tx.dates(r),
            "__terms": F.array_distinct(F.filter(F.concat(more, tx.backticked(s)), lambda t: t != "")), "__names": F.array_distinct(tx.proper_names(s)),
            "__strong": tx.present_terms(s, v.OBLIGATION_STRONG), "__hedges": tx.present_terms(s, v.HEDGES),
        }
    )
    rw = F.col("__r")

    def each(category: str, xs: Column, expected: bool) -> Column:
        none = F.lit(None).cast("string")
        return F.transform(xs, lambda x: _violation(category, F.lit("lost" if expected else "invented"), x if expected else none, none if expected else x))

    strong_kept = tx.has_any(rw, v.OBLIGATION_STRONG)
    weak = F.array_join(tx.present_terms(rw, v.OBLIGATION_WEAK), ", ")
    added = F.filter(tx.present_terms(rw, v.ABSOLUTES), lambda x: ~tx.has_term(F.col("__s"), x))
    hedged = F.size("__hedges") > 0
    one = lambda cond, x: F.when(cond, F.array(x)).otherwise(F.array().cast(VIOLATIONS))
    violations = F.concat(
        each("number", more_often(F.col("__ns"), F.col("__nr")), True),
        each("number", more_often(F.col("__nr"), F.col("__ns")), False),
        each("date", absent(F.col("__ds"), F.col("__dr")), True),
        each("date", absent(F.col("__dr"), F.col("__ds")), False),
        each("protected_term", F.filter("__terms", lambda t: ~tx.has_term(rw, t)), True),
        one((F.size("__strong") > 0) & ~strong_kept, _violation("obligation", F.lit("weakened"), F.array_join("__strong", ", "), weak)),
        one(hedged & ~tx.has_any(rw, v.HEDGES), _violation("certainty", F.lit("hedge_lost"), F.array_join("__hedges", ", "), F.lit(None).cast("string"))),
        one(hedged & (F.size(added) > 0), _violation("certainty", F.lit("absolute_added"), F.lit(None).cast("string"), F.array_join(added, ", "))),
        each("name", F.filter("__names", lambda t: ~tx.has_term(rw, t)), True),
    )
    counts = {"numbers": "__ns", "dates": "__ds", "protected_terms": "__terms", "names": "__names", "obligations": "__strong", "hedges": "__hedges"}
    checked = F.create_map(*[x for n, c in counts.items() for x in (F.lit(n), F.size(c).cast("long"))])
    out = a.withColumns({"violations": violations, "checked": checked})
    return out.withColumn("passed", F.size("violations") == 0).drop("__s", "__r", *counts.values(), "__nr", "__dr")


VIOLATIONS = "array<struct<category:string,detail:string,expected:string,found:string>>"


def _violation(category: str, detail: Column, expected: Column, found: Column) -> Column:
    return F.struct(F.lit(category).alias("category"), detail.alias("detail"), expected.alias("expected"), found.alias("found"))


def accept_or_original(checked: DataFrame, source: str = "source", rewrite: str = "rewrite") -> DataFrame:
    """``accepted``: the rewrite if it passed, else the original, and then ``warning``."""
    return checked.withColumns(
        {
            "accepted": F.when(F.col("passed"), F.col(rewrite)).otherwise(F.col(source)),
            "warning": F.when(~F.col("passed"), F.concat(F.size("violations").cast("string"), F.lit(" violation(s); the original is kept"))),
        }
    )
