"""Text operators as Column expressions; what has no built-in form is a DataFrame step."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import LongType, StringType

from loomtext.functions import values as v

BLANKS = " \t\n\x0b\x0c\r"
#: Characters of a text that its fingerprint looks at first.
HEAD = 400
#: Texts within these characters are in normal form C already.
PLAIN = "^[\\x{0}-\\x{2FF}\\x{2010}-\\x{2027}\\x{20A0}-\\x{20CF}\\x{FEFF}\\x{200B}-\\x{200F}]*$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def after_nfc(c: Column) -> Column:
    """What normalisation does after normal form C: line ends, zero-width marks, punctuation, blanks, blank lines."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, "[\\x{200B}-\\x{200F}\\x{FEFF}]", "")
    c = F.replace(F.translate(c, "‘’“”– ", "''\"\"- "), F.lit("…"), F.lit("..."))
    c = F.regexp_replace(c, "[ \t]+\n", "\n")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    return F.concat(strip(c), F.lit("\n"))


@pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalize(df: DataFrame, column: str = "text", to: str = "normalized") -> DataFrame:
    """``df`` with the normalised text. Only texts that may not be in normal form C go through Python."""
    plain = F.coalesce(F.col(column).rlike(PLAIN), F.lit(True))
    fast = df.where(plain).withColumn(to, after_nfc(F.col(column)))
    slow = df.where(~plain).withColumn(to, after_nfc(nfc(F.col(column))))
    return fast.unionByName(slow)


def cmudict_records(c: Column) -> Column:
    """Pronunciation lines as records of word, phonemes and stress digits, parted by blank lines."""
    lines = F.transform(F.split(c, "\n"), strip)
    fields = F.transform(F.filter(lines, lambda x: (x != "") & ~x.startswith(";;;")), lambda x: F.split(x, r"[ \t]+"))
    kept = F.filter(fields, lambda f: F.size(f) >= 2)

    def record(f: Column) -> Column:
        sounds = F.array_join(F.slice(f, F.lit(2), F.size(f) - 1), " ")
        stress = F.regexp_replace(sounds, "[^0-9]", "")
        return F.concat(F.get(f, F.lit(0)), F.lit("\nphonemes: "), sounds, F.lit("\nstress: "), F.when(stress == "", "none").otherwise(stress))

    return F.array_join(F.transform(kept, record), "\n\n")


def terms(c: Column) -> Column:
    """Search terms with notation marks intact; a term with capitals is followed by its lower-case form."""
    found = F.regexp_extract_all(c, F.lit(v.TERM), F.lit(0))
    both = lambda t: F.when(F.lower(t) == t, F.array(t)).otherwise(F.array(t, F.lower(t)))
    return F.flatten(F.transform(found, both))


@arrow_udf(LongType())
def token_count(texts: pa.Array) -> pa.Array:
    """The surrogate token count: word units and marks. Arrow counts matches; the built-in form makes a string of each."""
    return pc.count_substring_regex(texts, v.TOKEN_UNIT).cast(pa.int64())


def fingerprint(c: Column) -> Column:
    """White space collapsed, first 200 characters: texts that agree in it count as duplicates. The text's head does where it holds more than 200."""
    plain = lambda x: F.ltrim(F.regexp_replace(x, r"[ \t\n\x0B\f\r]+", " "))
    head = plain(F.substring(c, 1, HEAD))
    return F.substring(F.when(F.length(head) > 200, head).otherwise(F.rtrim(plain(c))), 1, 200)


def chunk_id(source: Column, text: Column, index: Column) -> Column:
    inner = F.concat(source, F.lit(":"), F.sha2(text, 256))
    return F.concat(F.substring(F.sha2(inner, 256), 1, 16), F.lit("_"), index.cast("string"))


def contrast_intent(query: Column) -> Column:
    low = F.lower(query)
    return F.exists(F.array(*[F.lit(p) for p in v.CONTRAST]), lambda p: F.contains(low, p))


def heading(c: Column) -> Column:
    """The first heading line, without its marks; null without one."""
    got = strip(F.regexp_extract(c, r"(?:^|\n)#+([^\n]*)", 1))
    return F.when(got != "", got)


def dates(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(v.java(v.DATE)), F.lit(0)), lambda d: F.lower(strip(d)))


def numbers(c: Column) -> Column:
    """Numbers outside dates, without commas and currency signs."""
    rest = F.regexp_replace(c, v.java(v.DATE), " ")
    return F.transform(F.regexp_extract_all(rest, F.lit(v.NUMBER_LOOKAROUND), F.lit(0)), lambda n: F.lower(F.regexp_replace(n, "[,$€£]", "")))


def backticked(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(v.BACKTICKED), F.lit(1)), strip)


def proper_names(c: Column) -> Column:
    """Capitalised words that don't open a sentence or line."""
    return F.regexp_extract_all(F.regexp_replace(c, v.java(v.SENTENCE_INITIAL), "$1 "), F.lit(v.java(v.NAME)), F.lit(0))


def has_term(c: Column, term: Column) -> Column:
    """Case-insensitive containment of a whole term."""
    quoted = F.regexp_replace(term, r"([^A-Za-z0-9 ])", r"\\$1")
    return F.rlike(c, F.concat(F.lit(r"(?i)(?<!\w)"), quoted, F.lit(r"(?!\w)")))


def has_any(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike(r"(?i)(?:^|\W)(?:" + "|".join(words) + r")(?:\W|$)")


def present_terms(c: Column, words: tuple[str, ...]) -> Column:
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: has_term(c, w))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def may_match(c: Column, family: str) -> Column:
    low, (first, *rest) = F.lower(c), v.INJECTION_WORDS[family]
    out = F.contains(low, F.lit(first))
    for word in rest:
        out = out | F.contains(low, F.lit(word))
    return out


def injection_counts(c: Column) -> dict[str, Column]:
    none = F.when(c.isNotNull(), F.lit(0).cast("long"))
    return {n: F.when(may_match(c, n), F.regexp_count(c, F.lit(v.bounded(p))).cast("long")).otherwise(none) for n, p in v.INJECTIONS.items()}


def injection_kinds(c: Column) -> Column:
    return F.array_sort(F.array_compact(F.array(*[F.when(may_match(c, n) & c.rlike(v.bounded(p)), F.lit(n)) for n, p in v.INJECTIONS.items()])))


def injection_summary(c: Column) -> Column:
    names = list(v.INJECTIONS)

    def said(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
        kinds = F.array_sort(F.array_compact(F.array(*[F.when(F.get(counts, F.lit(i)) > 0, F.lit(n)) for i, n in enumerate(names)])))
        return F.when(total > 0, F.concat(total.cast("string"), F.lit(" suspicious span(s): "), F.array_join(kinds, ", "))).otherwise("clean")

    return once(F.array(*injection_counts(c).values()), said)


def has_secret(c: Column) -> Column:
    out = F.lit(False)
    for p in v.SECRETS:
        out = out | c.rlike(v.java(p))
    return out
