"""From files to chunk records: one lazy plan over all sources."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as tx
from loomtext.operators.chunking import chunk
from loomtext.operators.identity import link_neighbors
from loomtext.settings import PROFILES, Settings
from loomtext.sources.files import approved, load_texts, write_report


def owners(files: DataFrame, sources: DataFrame, root: str | None = None) -> DataFrame:
    """``path, __prefix``: for each file the path of the source that it belongs to.

    A source's path is a file or a folder, in whole segments. With ``root`` it
    counts from there; else from wherever it is found first in the file's path.
    Of several that fit the longest owns the file. An equality join on the runs
    of segments of each path.
    """
    segments = F.filter(F.split(F.regexp_replace("path", "^[a-z]+:/*", ""), "/"), lambda s: s != "")
    skip = 0 if root is None else len([s for s in re.sub("^[a-z]+:/*", "", root).split("/") if s])
    own = files.select("path", segments.alias("s")).distinct()
    starts = F.array(F.lit(skip)) if root is not None else F.sequence(F.lit(0), F.size("s") - 1)
    runs = own.select("path", "s", F.explode(starts).alias("at")).where(F.col("at") < F.size("s"))
    runs = runs.select("path", "at", "s", F.explode(F.sequence(F.lit(1), F.size("s") - F.col("at"))).alias("n"))
    runs = runs.select("path", "at", "n", F.array_join(F.slice("s", F.col("at") + 1, F.col("n")), "/").alias("run"))
    named = sources.select(F.col("path").alias("__prefix"), F.array_join(F.filter(F.split("path", "/"), lambda s: (s != "") & (s != ".")), "/").alias("run")).distinct()
    found = runs.join(named, "run").groupBy("path").agg(F.min(F.struct("at", (-F.col("n")).alias("n"), "__prefix")).alias("o"))
    return found.select("path", "o.__prefix")


def build_records(files: DataFrame, sources: DataFrame, settings: Settings | None = None, root: str | None = None) -> DataFrame:
    """Chunk records of the files of approved sources, with ids, checksums and links.

    A file belongs to one source (see :func:`owners`); files of sources that are
    not approved, or of none, are left out. Documents that can't be cut have no
    records; :func:`chunk` says why.
    """
    s = settings or Settings()
    ok, _ = approved(sources)
    whose = owners(files, sources.where("path IS NOT NULL"), root)
    src = ok.select(F.col("id").alias("source_id"), F.col("title").alias("source_title"), F.col("path").alias("__prefix"), "doc_type", F.coalesce("chunk_profile", F.lit("reference")).alias("profile"), "license", "license_url", "dialect", "register")
    docs = load_texts(files).join(whose, "path").join(src, "__prefix").drop("__prefix", "raw_bytes").withColumnRenamed("path", "source_path")
    spoken = F.col("doc_type") == "pronunciation"
    normal = tx.normalize(docs, "text", "normal").withColumn("normal", F.when(spoken, tx.cmudict_records(F.col("normal"))).otherwise(F.col("normal"))).drop("text")
    normal = normal.withColumn("source_checksum", F.sha2("normal", 256))
    out = None
    for name in PROFILES:  # a profile is a setting of the cutter; each takes its own documents
        part = chunk(normal.where(F.col("profile") == name).drop("profile"), "normal", name)
        out = part if out is None else out.unionByName(part)
    out = out.where("chunk_error IS NULL").drop("chunk_error")
    total = out.groupBy("source_id", "source_path").agg(F.count("*").alias("chunk_total"))
    made = out.join(total, ["source_id", "source_path"]).withColumns(
        {
            "id": tx.chunk_id(F.col("source_id"), F.col("text"), F.col("chunk_index")),
            "tokenizer": F.lit(s.tokenizer), "embedding_model": F.lit(s.embedding_model), "embedding_dimension": F.lit(s.dimension), "ingested_at": F.current_timestamp(),
        }
    )
    return link_neighbors(made)


def manifest(records: DataFrame) -> DataFrame:
    """One row: chunks, tokens and tokens by source."""
    by = records.groupBy("source_id").agg(F.count("*").alias("n"), F.sum("token_count").alias("t"))
    return by.agg(F.sum("n").alias("chunks"), F.sum("t").alias("tokens"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_id", "n")))).alias("by_source"), F.current_timestamp().alias("generated"))


def write_manifest(records: DataFrame, folder: str, stamp: str, dry_run: bool) -> str:
    """Write the manifest of a run, dry runs too, before any gate is asked; its name says which kind it is. Returns the path."""
    path = f"{folder.rstrip('/')}/{'dryrun' if dry_run else 'run'}-{stamp}"
    write_report(manifest(records).withColumns({"dry_run": F.lit(dry_run), "stamp": F.lit(stamp)}), path)
    return path
