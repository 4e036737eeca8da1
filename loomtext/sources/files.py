"""Corpus files, the source manifest and report sinks."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from loomtext.functions.values import TEXT_SUFFIXES

SOURCE = StructType(
    [StructField(c, StringType()) for c in ("id", "title", "url", "path", "doc_type", "chunk_profile", "license", "license_url", "license_status", "dialect", "register", "reason")]
    + [StructField("attribution_required", BooleanType())]
)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """``path, content, raw_bytes`` of the supported files under ``root``, dot-files aside. A missing root has none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "path string, content binary, raw_bytes long")
    low = F.lower("path")
    kept = F.lit(False)
    for s in TEXT_SUFFIXES:
        kept = kept | low.endswith(s)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return rows.where(kept & ~F.col("path").rlike(r"/\.[^/]+$")).select("path", "content", F.col("length").alias("raw_bytes"))


def load_texts(files: DataFrame) -> DataFrame:
    """``path, text, raw_bytes``: UTF-8 with undecodable bytes replaced; PDF pages are joined by a blank line."""
    pdf = F.lower("path").endswith(".pdf")
    plain = files.where(~pdf).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), "raw_bytes")
    return plain.unionByName(load_pdfs(files.where(pdf)))


def load_pdfs(files: DataFrame) -> DataFrame:
    """Needs the optional package pdfplumber on the executors; without it a PDF is an error when it is read."""

    def run(batches):
        for b in batches:
            import io

            import pdfplumber

            texts = []
            for raw in b["content"]:
                with pdfplumber.open(io.BytesIO(raw)) as doc:
                    texts.append("\n\n".join(page.extract_text() or "" for page in doc.pages))
            yield b[["path"]].assign(text=texts, raw_bytes=b["raw_bytes"])

    return files.mapInPandas(run, "path string, text string, raw_bytes long")


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    """The hand-kept manifest (YAML, a list under ``sources`` and ``quarantined``) as a table."""
    import yaml

    if not Path(path).exists():
        raise FileNotFoundError(path)
    got = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    rows = [*got.get("sources", []), *({"license_status": "quarantined"} | x for x in got.get("quarantined", []))]
    return spark.createDataFrame([tuple(None if r.get(f.name) is None else r[f.name] if f.dataType == BooleanType() else str(r[f.name]) for f in SOURCE) for r in rows], SOURCE)


def approved(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources that may be read (approved, with a licence), and the others."""
    ok = F.coalesce((F.col("license_status") == "approved") & (F.trim("license") != ""), F.lit(False))
    return sources.where(ok), sources.where(~ok)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


# The kinds of reports.
REPORTS = ("evaluation", "smoke", "session", "lint")


def write_named_report(df: DataFrame, folder: str, kind: str, stamp: str) -> str:
    """A report of one of the known kinds under its own name. Returns the path."""
    if kind not in REPORTS:
        raise ValueError(f"no report is called {kind!r}")
    path = f"{folder.rstrip('/')}/{kind}-{stamp}"
    write_report(df, path)
    return path


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; a local session without it uses a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/loomtext-{os.getpid()}"
    return base.rstrip("/")


_scratch: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the program ends."""
    if not _scratch:
        atexit.register(_forget)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as written to a new scratch folder: what several steps read is worked out once."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _forget() -> None:
    for path, spark in _scratch.items():
        with contextlib.suppress(Exception):  # the session may be gone already, and its folder with it
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
