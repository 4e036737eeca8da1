"""Cutting documents into chunks.

The unit splits (blank lines, headings, speaker turns) are native expressions.
The recursive split with overlap is a fold with a token count at every step, so
it runs in Python, a document at a time, over Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from loomtext.functions import values as v
from loomtext.functions.text import heading, strip
from loomtext.settings import HARD_MAX, PROFILES, SAFE_TARGET, Profile


CHUNKS = ArrayType(StructType([StructField("text", StringType()), StructField("index", IntegerType()), StructField("token_count", IntegerType()), StructField("heading", StringType()), StructField("error", StringType())]))


class ChunkingError(ValueError):
    """A profile or a chunk that is out of range."""


_unit = re.compile(v.TOKEN_UNIT)
_turn = re.compile(v.TURN)


def count_tokens(text: str) -> int:
    return len(_unit.findall(text))


def check_profile(name: str, profiles: dict[str, Profile] = PROFILES) -> Profile:
    if name not in profiles:
        raise ChunkingError(f"unknown profile {name!r}")
    p = profiles[name]
    if p.target > SAFE_TARGET:
        raise ChunkingError(f"target {p.target} is above {SAFE_TARGET}")
    if p.overlap >= p.target:
        raise ChunkingError("the overlap must be below the target")
    return p


# --- native unit splits ---


def split_blank(c: Column) -> Column:
    """Blocks between blank lines; blank blocks are dropped."""
    return F.filter(F.transform(F.split(c, r"\n[ \t\n\x0B\f\r]*\n"), strip), lambda x: x != "")


def split_heading(c: Column) -> Column:
    """Sections: a new one before each second-level heading, and at a line of three or more hyphens, which is dropped."""
    marked = F.regexp_replace(F.concat(F.lit("\n"), c), r"\n(##[ \t])", "\n\x01$1")
    marked = F.regexp_replace(marked, r"\n-{3,}[ \t]*(?:\n|\z)", "\n\x01")
    return F.filter(F.transform(F.split(marked, "\x01"), strip), lambda x: x != "")


def split_turns(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, unit, text``: a new unit at each line that opens a speaker's turn; what precedes the first belongs to it."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("at", "line"))
    w = Window.partitionBy(key).orderBy("at")
    starts = lines.withColumn("turn", F.sum(F.concat(F.col("line"), F.lit(" ")).rlike(v.TURN).cast("int")).over(w))
    units = starts.withColumn("unit", F.greatest(F.col("turn") - 1, F.lit(0)))
    joined = units.groupBy(key, "unit").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("ls"))
    out = joined.select(key, F.col("unit").cast("long").alias("unit"), strip(F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("text"))
    return out.where("text <> ''")


def carry_headings(units: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """``section_heading``: the first heading of the unit, else that of the unit before."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return units.withColumn("section_heading", F.last(heading(F.col(text)), ignorenulls=True).over(w))


# --- recursive split ---


def pieces(text: str, limit: int, count: Callable[[str], int] = count_tokens) -> list[str]:
    """Parts of at most ``limit`` tokens, cut at the strongest separator there is; a separator stays with what precedes it.

    Headings are the exception: their mark stays with the section it opens.
    """
    if count(text) <= limit:
        return [text] if text.strip() else []
    for sep in v.SEPARATORS:
        if sep in text.strip():
            parts = text.split(sep)
            if sep.startswith("\n#"):
                parts = [parts[0], *(sep[1:] + p for p in parts[1:])]
            else:
                parts = [*(p + sep for p in parts[:-1]), parts[-1]]
            parts = [p for p in parts if p.strip()]
            if len(parts) > 1:
                return [x for p in parts for x in pieces(p, limit, count)]
    found, out, at = list(_unit.finditer(text)), [], 0
    for i in range(limit, len(found), limit):
        out.append(text[at : found[i].start()])
        at = found[i].start()
    return [*out, text[at:]]


def tail(text: str, tokens: int) -> str:
    found = list(_unit.finditer(text))
    return text[found[-tokens].start() :] if tokens and len(found) > tokens else text if tokens else ""


def pack(parts: list[str], profile: Profile) -> list[str]:
    """Parts joined up to the target; each chunk opens with the last tokens of the one before."""
    out: list[str] = []
    held, n_held = "", 0  # parts are joined by a line end, which no token spans, so counts add up
    for p in parts:
        n = count_tokens(p)
        if held and n_held + n > profile.target:
            out.append(held.strip())
            over = tail(held.strip(), profile.overlap)
            held, n_held = (f"{over}\n{p}", min(profile.overlap, n_held) + n) if over else (p, n)
        else:
            held, n_held = f"{held.rstrip()}\n{p}" if held else p, n_held + n
    if held.strip():
        if out and profile.least and n_held < profile.least:
            out[-1] = f"{out[-1]}\n{held.strip()}"
        else:
            out.append(held.strip())
    return out


def units_of(text: str, unit: str) -> list[str]:
    if unit == "blank":
        parts = re.split(r"\n\s*\n", text)
    elif unit == "heading":
        parts = re.split(r"(?m)^(?=##\s)|^-{3,}[ \t]*$", text)
    elif unit == "turn":
        parts = [""]
        seen = False
        for line in text.split("\n"):
            if _turn.match(line + " "):
                if seen:
                    parts.append("")
                seen = True
            parts[-1] += line + "\n"
    else:
        parts = [text]
    return [p.strip() for p in parts if p.strip()]


def chunk_text(text: str, name: str, profiles: dict[str, Profile] = PROFILES) -> list[dict]:
    """Chunks of one document as ``text, index, token_count, heading``."""
    profile = check_profile(name, profiles)
    out, section = [], None
    for unit in units_of(text or "", profile.unit):
        first = re.search(r"(?m)^#+([^\n]*)", unit)
        if first and first[1].strip():
            section = first[1].strip()
        bodies = [unit] if profile.unit == "blank" and count_tokens(unit) <= profile.ceiling else pack(pieces(unit, profile.target), profile)
        for body in bodies:
            n = count_tokens(body)
            if n > min(HARD_MAX, profile.ceiling):
                raise ChunkingError(f"a chunk of {n} tokens is above {min(HARD_MAX, profile.ceiling)}")
            if n:
                out.append({"text": body, "index": len(out), "token_count": n, "heading": section})
    return out


def chunk_column(name: str, profiles: dict[str, Profile] = PROFILES):
    """A pandas UDF from text to an array of chunks."""
    check_profile(name, profiles)

    @pandas_udf(CHUNKS)
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    def one(text: str | None) -> list[dict]:
        try:
            return chunk_text(text, name, profiles)
        except ChunkingError as e:
            return [{"index": 0, "error": str(e)}]

    return chunks


def chunk(docs: DataFrame, text: str, name: str, profiles: dict[str, Profile] = PROFILES) -> DataFrame:
    """One row a chunk: the columns of ``docs`` but the text, and ``text, chunk_index, token_count, section_heading, chunk_profile, chunk_error``.

    A document that can't be cut has one row without a text, which says why.
    """
    rest = [c for c in docs.columns if c != text]
    made = docs.select(*rest, F.explode(chunk_column(name, profiles)(F.col(text))).alias("c"))
    return made.select(
        *rest, F.col("c.text").alias("text"), F.col("c.index").cast("long").alias("chunk_index"), F.col("c.token_count").cast("long").alias("token_count"),
        F.col("c.heading").alias("section_heading"), F.lit(name).alias("chunk_profile"), F.col("c.error").alias("chunk_error"),
    )
