"""Corpus lint: findings about sources, files and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as tx
from loomtext.functions import values as v

FINDING = "check string, severity string, message string, location string"


def _finding(rows: DataFrame, check: str, severity: str, message: Column, where: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), message.alias("message"), where.cast("string").alias("location"))


def statuses(sources: DataFrame) -> DataFrame:
    bad = sources.where(~F.coalesce(F.col("license_status").isin(list(v.STATUSES)), F.lit(False)))
    return _finding(bad, "accepted_status", "FAIL", F.concat(F.lit("status "), F.coalesce("license_status", F.lit("none"))), F.col("id"))


def license_labels(sources: DataFrame) -> DataFrame:
    bad = sources.where((F.col("license_status") == "approved") & (F.coalesce(F.trim("license"), F.lit("")) == ""))
    return _finding(bad, "license_label", "FAIL", F.lit("approved without a licence"), F.col("id"))


def binaries(files: DataFrame) -> DataFrame:
    low = F.lower("path")
    hit = F.lit(False)
    for s in v.BINARY_SUFFIXES:
        hit = hit | low.endswith(s)
    return _finding(files.where(hit), "no_binaries", "FAIL", F.lit("binary file"), F.col("path"))


def uncovered(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Files under no declared path. A declared path is a file's start, letter by letter; files meet only those of a length that some source has."""
    low = F.lower("path")
    text = F.lit(False)
    for s in v.TEXT_SUFFIXES:
        text = text | low.endswith(s)
    declared = sources.where("path is not null").select(F.col("path").alias("__prefix")).distinct()
    sizes = declared.agg(F.array_sort(F.collect_set(F.length("__prefix"))).alias("sizes"))  # one row: there are few lengths
    starts = files.where(text).crossJoin(F.broadcast(sizes)).select("path", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("n"))
    covered = starts.select("path", F.expr("substring(path, 1, n)").alias("start")).join(declared, F.col("start") == F.col("__prefix"), "left_semi")
    bad = files.where(text).join(covered.select("path").distinct(), "path", "left_anti")
    return _finding(bad, "coverage", "FAIL", F.lit("no source declares this file"), F.col("path"))


def repeated(chunks: DataFrame, by: Column, check: str, order: str = "ord", where: str = "location") -> DataFrame:
    """Chunks that agree in ``by`` with an earlier one; the message names the last one before.

    Only groups of two and more are sorted.
    """
    keyed = chunks.select(by.alias("__k"), order, where)
    many = keyed.groupBy("__k").count().where("count > 1").select("__k")
    w = Window.partitionBy("__k").orderBy(order)
    seen = keyed.join(many, "__k", "left_semi").withColumn("__before", F.lag(where).over(w)).where(F.col("__before").isNotNull())
    return _finding(seen, check, "FAIL", F.concat(F.lit("seen at "), F.col("__before")), F.col(where))


def text_checks(chunks: DataFrame, where: str = "location") -> DataFrame:
    """Secrets, claims and polarity in one pass over the texts."""
    negative = F.coalesce(F.col("doc_type") == v.NEGATIVE_TYPE, F.lit(False))
    rules = [
        ("secret", "FAIL", tx.has_secret(F.col("text")), "credential-shaped text"),
        ("claim", "WARN", F.col("text").rlike(v.java(v.CLAIMS)), "unapproved claim"),
        ("polarity", "FAIL", negative & F.col("text").rlike(v.POSITIVE), "negative material marked as positive"),
        ("polarity", "WARN", ~negative & F.contains(F.col("text"), F.lit(v.NEGATIVE_TYPE)), "negative marker outside negative material"),
    ]
    found = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(c).alias("check"), F.lit(s).alias("severity"), F.lit(m).alias("message"))) for c, s, hit, m in rules]))
    return chunks.select(F.col(where).alias("location"), F.explode_outer(found).alias("f")).where(F.col("f").isNotNull()).select("f.check", "f.severity", "f.message", "location")


def composition(chunks: DataFrame) -> DataFrame:
    """``doc_type, n, share`` with ``over_cap`` for auxiliary types above the cap."""
    counts = chunks.groupBy("doc_type").agg(F.count("*").alias("n"))
    total = chunks.agg(F.count("*").alias("total"))
    share = F.col("n") / F.col("total")
    auxiliary = ~F.coalesce(F.col("doc_type").isin(list(v.PRIMARY_TYPES)), F.lit(False))
    return counts.crossJoin(F.broadcast(total)).select("doc_type", "n", F.round(100 * share, 6).alias("share"), (auxiliary & (share > v.AUXILIARY_CAP)).alias("over_cap"))


def lint(sources: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """All findings. ``chunks`` has id, text, doc_type, ord, location."""
    parts = [
        statuses(sources), license_labels(sources), binaries(files), uncovered(files, sources),
        repeated(chunks, F.col("id"), "unique_ids"), repeated(chunks, F.sha2(tx.strip(F.col("text")), 256), "duplicates"), text_checks(chunks),
    ]
    over = composition(chunks).where("over_cap")
    parts.append(_finding(over, "composition", "FAIL", F.concat(F.col("share").cast("string"), F.lit(" %")), F.col("doc_type")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sources_of(chunks: DataFrame) -> DataFrame:
    """``source_id, chunks, files``: chunks of each source and its files, sorted. A source's files are gathered, not its chunks."""
    files = chunks.groupBy("source_id", "source_path").agg(F.count("*").alias("n"))
    return files.groupBy("source_id").agg(F.sum("n").alias("chunks"), F.array_sort(F.collect_list("source_path")).alias("files"))


def full_report(findings: DataFrame, chunks: DataFrame) -> DataFrame:
    """``section, name, n, share, files, severity, message, location``: composition by type, chunks and files by source, the findings, and totals.

    The totals are chunks, failures, warnings, and ``exit_status``: 1 if there is a failure.
    """
    none = lambda kind: F.lit(None).cast(kind)

    def part(rows: DataFrame, section: str, name: Column, n: Column | None = None, **more: Column) -> DataFrame:
        kinds = {"share": "double", "files": "array<string>", "severity": "string", "message": "string", "location": "string"}
        own = [more.get(c, none(k)).cast(k).alias(c) for c, k in kinds.items()]
        return rows.select(F.lit(section).alias("section"), name.alias("name"), (none("long") if n is None else n.cast("long")).alias("n"), *own)

    sums = report(findings).crossJoin(F.broadcast(chunks.agg(F.count("*").alias("chunks"))))  # one row each
    entries = F.array(*[F.struct(F.lit(k).alias("k"), x.cast("long").alias("x")) for k, x in (("chunks", F.col("chunks")), ("failures", F.col("failures")), ("warnings", F.col("warnings")), ("exit_status", (F.col("failures") > 0).cast("int")))])
    out = part(composition(chunks), "type", F.col("doc_type"), F.col("n"), share=F.col("share"))
    out = out.unionByName(part(sources_of(chunks), "source", F.col("source_id"), F.col("chunks"), files=F.col("files")))
    out = out.unionByName(part(findings, "finding", F.col("check"), None, severity=F.col("severity"), message=F.col("message"), location=F.col("location")))
    return out.unionByName(part(sums.select(F.inline(entries)), "total", F.col("k"), F.col("x")))


def exit_status(findings: DataFrame) -> int:
    return int(not findings.where("severity = 'FAIL'").isEmpty())


def report(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_if(F.col("severity") == "FAIL").alias("failures"), F.count_if(F.col("severity") == "WARN").alias("warnings"))
