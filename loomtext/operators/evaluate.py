"""Batch evaluation of search results against cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as tx
from loomtext.functions import values as v


def marker_hits(cases: DataFrame, results: DataFrame) -> DataFrame:
    """``case_id, marker, position``: the first expected marker in the results, by position, then in the case's order.

    ``cases`` (case_id, expect_any); ``results`` (case_id, position, label), the
    label being the text that is searched, without regard to case.
    """
    want = cases.select("case_id", F.posexplode("expect_any").alias("at", "marker"))
    seen = want.join(results, "case_id").where(F.contains(F.lower("label"), F.lower("marker")))
    return seen.groupBy("case_id").agg(F.min(F.struct("position", "at", "marker")).alias("m")).select("case_id", "m.marker", "m.position")


def useful_rate(cases: DataFrame, hits: DataFrame) -> DataFrame:
    found = cases.join(hits.select("case_id", F.lit(1).alias("hit")).distinct(), "case_id", "left")
    return found.agg(F.count("*").alias("cases"), F.count("hit").alias("hits"), F.round(F.count("hit") / F.count("*"), 3).alias("rate"))


def source_mix(results: DataFrame, primary: tuple[str, ...], negative: str) -> DataFrame:
    """Share of ranked rows from primary types, and rows of the negative type."""
    good = F.coalesce(F.col("doc_type").isin(list(primary)), F.lit(False))
    bad = F.coalesce(F.col("doc_type") == negative, F.lit(False))
    return results.agg(F.count("*").alias("ranked"), F.count_if(good).alias("positive"), F.round(F.count_if(good) / F.count("*"), 6).alias("positive_ratio"), F.count_if(bad).alias("contamination"))


def latency_percentiles(runs: DataFrame, ms: str = "ms") -> DataFrame:
    """The median, cut to an integer, and the value at index int(0.95 n) - 1 of the sorted list (0 at least)."""
    n = runs.agg(F.count("*").alias("n"))
    w = Window.orderBy(ms)
    at = F.greatest(F.floor(0.95 * F.col("n")) - 1, F.lit(0))
    ranked = runs.select(ms, (F.row_number().over(w) - 1).alias("i")).crossJoin(F.broadcast(n))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    return ranked.agg(
        F.max("n").alias("n"),
        F.floor((F.max(F.when(F.col("i") == low, F.col(ms))) + F.max(F.when(F.col("i") == high, F.col(ms)))) / 2).cast("long").alias("p50"),
        F.max(F.when(F.col("i") == at, F.col(ms))).alias("p95"),
    )


def exact_terms(cases: DataFrame, lexical: DataFrame, texts: DataFrame) -> DataFrame:
    """``case_id, passed``: each exact term has a lexical hit for its case and stands in a ranked text.

    ``cases`` (case_id, exact_terms), ``lexical`` (case_id, lexical_rank),
    ``texts`` (case_id, text).
    """
    terms = cases.select("case_id", F.explode("exact_terms").alias("term"))
    hit = lexical.where("lexical_rank <= 3").select("case_id").distinct().withColumn("lexical", F.lit(True))
    seen = terms.join(texts, "case_id", "left").groupBy("case_id", "term").agg(F.max(F.coalesce(F.contains("text", F.col("term")), F.lit(False))).alias("seen"))
    joined = seen.join(hit, "case_id", "left")
    return joined.groupBy("case_id").agg(F.min(F.col("seen") & F.coalesce("lexical", F.lit(False))).alias("passed"))


def primary_checks(cases: DataFrame, results: DataFrame) -> DataFrame:
    """``case_id, first_type_ok, first_source_ok`` about the first result. Cases: forbid_primary_doc_types, require_primary_source."""
    first = results.groupBy("case_id").agg(F.min(F.struct("position", "doc_type", "source_id")).alias("r"))
    j = cases.join(first, "case_id", "left")
    ok_type = ~F.coalesce(F.array_contains("forbid_primary_doc_types", F.col("r.doc_type")), F.lit(False))
    ok_source = F.col("require_primary_source").isNull() | F.coalesce(F.col("r.source_id") == F.col("require_primary_source"), F.lit(False))
    return j.select("case_id", ok_type.alias("first_type_ok"), ok_source.alias("first_source_ok"))


def ranking_quality(results: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """Recall at k and mean reciprocal rank. ``relevant`` (query_id, chunk_id)."""
    hit = results.where(F.col("position") <= k).join(relevant, ["query_id", "chunk_id"])
    per = hit.groupBy("query_id").agg(F.count("*").alias("found"), F.min("position").alias("first"))
    total = relevant.groupBy("query_id").agg(F.count("*").alias("relevant"))
    j = total.join(per, "query_id", "left").fillna(0, ["found"])
    return j.agg(F.avg(F.col("found") / F.col("relevant")).alias("recall"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def contamination(cases: DataFrame, results: DataFrame, negative: str = v.NEGATIVE_TYPE) -> DataFrame:
    """``case_id, contamination``: rows of the negative type, counted for cases that forbid it only. Cases: case_id, forbid_doc_types."""
    bad = F.coalesce(F.col("doc_type") == negative, F.lit(False))
    found = results.groupBy("case_id").agg(F.count_if(bad).alias("n"))
    forbids = F.coalesce(F.array_contains("forbid_doc_types", negative), F.lit(False))
    return cases.join(found, "case_id", "left").select("case_id", F.when(forbids, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("contamination"))


def bad_citations(results: DataFrame, files: DataFrame) -> DataFrame:
    """The ranked rows (case_id, chunk_id, source_path) whose source path is blank or not in ``files`` (path)."""
    there = files.select(F.col("path").alias("source_path")).distinct()
    return results.join(there, "source_path", "left_anti").select("case_id", "chunk_id", "source_path")


def definitions(cases: DataFrame, results: DataFrame, least: int = v.LEAST_DEFINITION, mark: str = v.GROUNDED) -> DataFrame:
    """``case_id, definition_chars, cites, passed``: is the first result that owns the case's term a definition?

    Cases: case_id, term, owner (source id). Results: position, section_heading,
    source_id, text. A result owns a term that is its heading, in the owner's
    source; it defines it with ``least`` characters or more and the mark.
    """
    own = results.join(cases, "case_id").where((tx.strip(F.col("section_heading")) == F.col("term")) & (F.col("source_id") == F.col("owner")))
    first = own.groupBy("case_id").agg(F.min(F.struct("position", F.length("text").alias("n"), F.contains("text", F.lit(mark)).alias("cites"))).alias("r"))
    chars, cites = F.coalesce("r.n", F.lit(0)).cast("long"), F.coalesce("r.cites", F.lit(False))
    return cases.join(first, "case_id", "left").select("case_id", chars.alias("definition_chars"), cites.alias("cites"), (cites & (chars >= least)).alias("passed"))


def distances(hits: DataFrame, k: int = 5) -> DataFrame:
    """One row about the k nearest chunks of all queries: number, least, median and greatest distance, and the greatest similarity."""
    near = hits.where(F.col("dense_rank") <= k)
    least = F.min("distance")
    return near.agg(
        F.count("*").alias("n"), F.round(least, 6).alias("least"), F.round(F.median("distance"), 6).alias("median"),
        F.round(F.max("distance"), 6).alias("greatest"), F.round(1 - least, 6).alias("top_similarity"),
    )


def preservation_correctness(checked: DataFrame, expected: str = "must_pass") -> DataFrame:
    """One row: cases, those whose verdict (``passed``) is the expected one, and both kinds of error."""
    want = F.col(expected)
    return checked.agg(
        F.count("*").alias("cases"), F.count_if(F.col("passed") == want).alias("correct"),
        F.count_if(F.col("passed") & ~want).alias("wrongly_passed"), F.count_if(~F.col("passed") & want).alias("wrongly_refused"),
    )


def behaviour(results: DataFrame, phrases: tuple[str, ...] = v.WEAK_EVIDENCE) -> DataFrame:
    """``case_id, context_clean, refutation_retrieved`` over the ranked texts of each case, joined by position.

    These scores stand beside the hit rate, never in it.
    """
    got = results.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("position", "chunk_id", F.coalesce("text", F.lit("")).alias("t")))).alias("x"))
    joined = got.select("case_id", F.array_join(F.transform("x", lambda r: r["t"]), "\n").alias("context"))
    said = F.lit(False)
    for p in phrases:
        said = said | F.contains(F.lower("context"), F.lit(p))
    return joined.select("case_id", (F.size(tx.injection_kinds(F.col("context"))) == 0).alias("context_clean"), said.alias("refutation_retrieved"))
