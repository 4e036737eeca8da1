"""The callable surface: seven tools over a store, with checked arguments and error codes."""

from __future__ import annotations

import inspect as pyinspect
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as tx
from loomtext.functions import values as v
from loomtext.operators import citations, flow, lexical, lifecycle, preservation, security, segments
from loomtext.operators.embed import Embedder, embed
from loomtext.operators.filters import FilterError
from loomtext.operators.keyed import KeyedStore
from loomtext.plans.commit import Committed, commit
from loomtext.plans.ingest import write_manifest
from loomtext.plans.search import SearchResult, search
from loomtext.settings import Settings, WriteRefused, check_write

# Limits of the surface.
LEAST_K, MOST_K, MOST_TEXT = 1, 10, 8000


class ToolError(Exception):
    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


@dataclass(frozen=True)
class Guidance:
    """Passages about prose for the measures of texts: quoted material, never instructions."""

    context: DataFrame  # query_id, context, refused
    citations: DataFrame
    kinds: DataFrame  # query_id, kinds: families of injected instructions in the passages


@dataclass(frozen=True)
class Analysis:
    measures: DataFrame
    guidance: Guidance


@dataclass(frozen=True)
class Rewrite:
    pairs: DataFrame  # the pairs with their verdicts, error and target
    guidance: Guidance


@dataclass
class Engine:
    """``index`` may be None, with ``lexical_error``: search then runs on vectors alone. Commits need ``store``, ``embedder`` and ``folder``."""

    spark: SparkSession
    chunks: DataFrame
    vectors: DataFrame
    index: lexical.LexicalIndex | segments.Segments | None
    settings: Settings
    store: lifecycle.Store | KeyedStore | None = None
    embedder: Embedder | None = None
    folder: str | None = None
    lexical_error: str | None = None

    def search(self, queries: DataFrame, k: int = 5, where: dict | None = None) -> SearchResult:
        from dataclasses import replace

        k = max(LEAST_K, min(MOST_K, k))
        return search(queries, self.chunks, self.vectors, self.index, where, replace(self.settings.retrieval, final_k=k), lexical_error=self.lexical_error)

    def health(self) -> DataFrame:
        indexed = self.chunks.limit(0).select(F.col("id").alias("chunk_id")) if self.index is None else self.index.doc_stats
        return lifecycle.health(self.chunks, indexed, self.vectors, self.settings.dimension)

    def inspect(self, chunk_id: str, include_neighbors: bool = True) -> DataFrame:
        if not lifecycle.CHUNK_ID.match(chunk_id):
            raise ToolError("INVALID_PARAMS", "malformed chunk id")
        ids = self.spark.createDataFrame([(chunk_id,)], "id string")
        return lifecycle.inspect(self.chunks, ids, include_neighbors)

    def passages(self, queries: DataFrame) -> Guidance:
        """Passages for a table of queries (query_id, query): embedded, searched, fenced and cited."""
        if self.embedder is None:
            raise ToolError("EMBEDDER_UNAVAILABLE")
        asked = embed(queries.select("query_id", "query"), self.embedder, self.settings.dimension, "query")
        hits = self.search(asked).results.join(self.chunks.withColumnRenamed("id", "chunk_id"), "chunk_id")
        for c in ("source_title", "license", "section_heading"):
            hits = hits if c in hits.columns else hits.withColumn(c, F.lit(None).cast("string"))
        for c in ("chunk_index", "chunk_total"):
            hits = hits if c in hits.columns else hits.withColumn(c, F.lit(None).cast("long"))
        kinds = hits.groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(tx.injection_kinds(F.coalesce("text", F.lit(""))))))).alias("kinds"))
        return Guidance(security.fence(hits), citations.build(hits), kinds)

    def guidance(self, register: str | None = None) -> Guidance:
        """Search the corpus for guidance on prose, for a register if one is named."""
        asked = f"{register} {v.GUIDANCE}" if register else v.GUIDANCE
        return self.passages(self.spark.createDataFrame([(0, asked)], "query_id long, query string"))

    def analyze(self, docs: DataFrame, text: str = "text", guidance: bool = False, register: str | None = None) -> DataFrame | Analysis:
        """Measures of each text; ``error`` for texts that are blank or too long. With ``guidance`` also passages about prose."""
        if guidance:
            return Analysis(self.analyze(docs, text), self.guidance(register))
        n = F.length(F.col(text))
        error = F.when(F.coalesce(tx.strip(F.col(text)) == "", F.lit(True)), "INVALID_PARAMS").when(n > MOST_TEXT, "TEXT_TOO_LONG")
        return flow.analyze(docs.withColumn("error", error), text)

    def rewrite(
        self, pairs: DataFrame, source: str = "source", rewrite: str = "rewrite", protected: str | None = None, context: bool = False, target: str = "conversational", key: str = "query_id",
    ) -> DataFrame | Rewrite:
        """Each rewrite, or the source where it would lose something. With ``context`` also passages for each text and its ``target`` (one search
        for all rows, which need an integer ``key``); blank or long texts get an ``error`` and neither."""
        checked_pairs = preservation.accept_or_original(preservation.check(pairs, source, rewrite, protected), source, rewrite)
        if not context:
            return checked_pairs
        n = F.greatest(F.length(source), F.coalesce(F.length(rewrite), F.lit(0)))
        error = F.when(F.coalesce(tx.strip(F.col(source)) == "", F.lit(True)), "INVALID_PARAMS").when(n > MOST_TEXT, "TEXT_TOO_LONG")
        asked = pairs.where(error.isNull()).select(F.col(key).alias("query_id"), F.concat(F.lit(f"{target} {v.REWRITE}: "), F.substring(source, 1, v.REWRITE_CHARS)).alias("query"))
        return Rewrite(checked_pairs.withColumns({"error": error, "target": F.lit(target)}), self.passages(asked))

    def feedback(self, requests: DataFrame, confirm: bool = False) -> DataFrame:
        """The requests as rows, with ``error`` for those refused. The others are appended to the feedback collection of the store, if there is one; the corpus itself never changes."""
        check_write(self.settings, confirm)
        rows = lifecycle.feedback(requests, self.chunks)
        if self.store is not None:
            self.store.append("feedback", rows.where("error IS NULL").drop("error"), confirm)
        return rows

    def reindex(self, wanted: DataFrame, dry_run: bool = True, partial: bool = False, delete_stale: bool = False, confirm: bool = False, stamp: str | None = None) -> DataFrame | Committed:
        """The plan of a re-index; when it is no dry run, it is committed to the store, and the engine then reads what is stored.

        With a folder and a ``stamp`` the manifest of the run is written first, whatever the gates say.
        """
        if self.folder and stamp:
            write_manifest(wanted, self.folder, stamp, dry_run)
        if dry_run:
            return lifecycle.plan(lifecycle.diff(wanted, self.chunks))
        check_write(self.settings, confirm)
        if self.store is None or self.embedder is None or self.folder is None:
            raise ToolError("COLLECTION_UNAVAILABLE", "a commit needs a store, an embedder and a folder")
        done = commit(self.store, wanted, self.settings, self.embedder, self.folder, delete_stale=delete_stale, partial=partial, confirm=confirm)
        self.chunks = self.store.read("chunks", done.version)
        self.vectors = self.chunks.select(F.col("id").alias("chunk_id"), "embedding", *[c for c in ("doc_type",) if c in self.chunks.columns])
        self.index, self.lexical_error = segments.open_index(self.spark, done.index_path)
        return done


TOOLS = ("search", "health", "inspect", "analyze", "rewrite", "feedback", "reindex")


def call(engine: Engine, tool: str, **arguments):
    """Run a tool by name; what goes wrong comes back as a ToolError with its code."""
    if tool not in TOOLS:
        raise ToolError("UNKNOWN_TOOL", tool)
    f = getattr(engine, tool)
    try:
        pyinspect.signature(f).bind(**arguments)
    except TypeError as e:
        raise ToolError("INVALID_PARAMS", str(e)) from e
    try:
        return f(**arguments)
    except WriteRefused as e:
        raise ToolError(str(e) if str(e).isupper() else "INVALID_PARAMS", str(e)) from e
    except FilterError as e:
        raise ToolError("INVALID_PARAMS", str(e)) from e
    except LookupError as e:
        raise ToolError("COLLECTION_UNAVAILABLE", str(e)) from e


def register_sql(spark: SparkSession) -> None:
    """SQL functions over texts: lt_terms, lt_tokens, lt_fingerprint, lt_chunk."""
    from loomtext.functions import values as v
    from loomtext.operators.chunking import chunk_column

    spark.udf.register("lt_chunk", chunk_column("reference"))
    q = lambda p: p.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION lt_tokens(t STRING) RETURNS BIGINT RETURN CAST(regexp_count(t, '{q(v.TOKEN_UNIT)}') AS BIGINT)")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION lt_terms(t STRING) RETURNS ARRAY<STRING> RETURN flatten(transform(regexp_extract_all(t, '{q(v.TERM)}', 0), x -> if(lower(x) = x, array(x), array(x, lower(x)))))"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION lt_fingerprint(t STRING) RETURNS STRING RETURN substring(trim(regexp_replace(t, '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+', ' ')), 1, 200)")
