"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import chat_format, exact_dedup, html_extract, importance, mixing, near_dup, packing, quality, shard_shuffle, simhash, suffix_dedup, turn_repair, url_filter
from loomtext.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

# --- 1: chat formatting -------------------------------------------------------------------------


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.digest(chat_format.expand_prefix_targets(turns.unionByName(more)))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length('<|im_start|><|im_sep|><|im_end|>')
      + length(regexp_replace(replace(role, '\', '\\'), '(<)(\||/?s>|</?SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g'))
      + length(regexp_replace(replace(text, '\', '\\'), '(<)(\||/?s>|</?SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')) AS drawn,
    row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
x AS (SELECT *, sum(drawn) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM e)
SELECT conv_id, CAST(max(n) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
"""

# --- 2: n-gram Jaccard join ---------------------------------------------------------------------


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dup.near_groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "n_links")


# --- 3: HTML extraction -------------------------------------------------------------------------


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


# --- 4: URL filter ------------------------------------------------------------------------------

#: Fixed by the query: (host and path, verdict).
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
#: The list of URLs is made of reported pages: all of these publishers (a label of their host), and single pages of any host whose title is junk.
LISTED_LABELS = ["ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
#: Junk titles have runs of three symbols.
JUNK_TITLE = r"<title>[^<]*(\*\*\*|%%%|###|\$\$\$)[^<]*</title>"


def listed_pages(pages: DataFrame) -> DataFrame:
    """``canon``: the canonical URLs of the reported pages."""
    by = r"(^|\.)(" + "|".join(LISTED_LABELS) + r")\."
    return pages.where(url_filter.url_host(pages["url"]).rlike(by) | pages["html"].rlike(JUNK_TITLE)).select(url_filter.canonical(pages["url"]).alias("canon"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages.select("page_id", "url"), listed_pages(pages), RULES).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH r AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
c AS (
  SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(regexp_replace(path, '/+$', ''), '\.html?$', '') AS canon,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM h),
l AS (SELECT DISTINCT canon FROM c WHERE canon <> '' AND (regexp_matches(host, '(^|\.)(ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.')
    OR regexp_matches(html, '<title>[^<]*(\*\*\*|%%%|###|\$\$\$)[^<]*</title>')))
SELECT page_id, host, path, rule,
  CASE rule WHEN 'com/en/' THEN 'block' WHEN 'example.com/en/7' THEN 'allow' WHEN 'net/de/' THEN 'allow' WHEN 'example.net/de/8' THEN 'block'
    WHEN 'org/es/' THEN 'block' ELSE CASE WHEN l.canon IS NULL THEN 'allow' ELSE 'block' END END AS verdict
FROM c LEFT JOIN l USING (canon)
"""

# --- 5: suffix-array dedup ----------------------------------------------------------------------


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


# --- 6: exact dedup -----------------------------------------------------------------------------


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

# --- 7: mixing ----------------------------------------------------------------------------------

#: Shares of the languages, which are the domains, in the mixture.
TARGETS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled documents with their language as domain."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id").distinct(), "doc_id")


def op7_mix_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), TARGETS)


# --- 8: packing ---------------------------------------------------------------------------------

BUCKETS, BUDGET = 16, 32768


def op8_pack_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", F.size(quality.words_of(F.coalesce("text", F.lit("")))).cast("long").alias("n_tokens"))
    return packing.pack(sized, "n_tokens", "doc_id", BUCKETS, BUDGET)


# --- 9: quality rules ---------------------------------------------------------------------------


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents of good quality that are not toxic."""
    return labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")


def op9_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))


# --- 10: sharding -------------------------------------------------------------------------------

SHARDS = 8


def op10_shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_shuffle.external_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    return out.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


# --- 11: conversation structure repair ----------------------------------------------------------


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turn_repair.report(turns, turn_repair.repair(turn_repair.damage(turns)))


#: DuckDB has no crc32: its table follows from the polynomial, and a checksum from that table, byte by byte.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab)"
CRC = "xor(list_reduce(list_prepend(4294967295, {bytes}), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"

OP11_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {CRC.format(bytes="list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 20 AS code
  FROM conversations, crc),
d AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM k, range(2) x(i) WHERE code <> 0 AND (i = 0 OR code = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
r AS (
  SELECT *, substr(role, 1, 1) AS ini, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'clean' ELSE 'truncated' END AS fault FROM o),
f AS (SELECT *, fault IN ('clean', 'truncated') AS ok, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM r),
n AS (SELECT conv_id, count(*) AS n FROM r GROUP BY conv_id),
v AS (
  SELECT conv_id, n AS i, 0 AS v0, 10 AS v1, 5 AS v2, 0 AS v3 FROM n
  UNION ALL
  SELECT conv_id, i, least(b0, 5 + b2, 10 + b3), least(b1, 5 + b2, 10 + b3), least(b2, 5 + b3), least(b3, 5 + b2) FROM (
    SELECT v.conv_id, v.i - 1 AS i,
      least(2 + v0, CASE WHEN ok THEN more + least(1 + v2, CASE ini WHEN 's' THEN v1 WHEN 'u' THEN v2 ELSE 999999 END) ELSE 999999 END) AS b0,
      least(2 + v1, CASE WHEN ok THEN more + v2 + CASE WHEN ini = 'u' THEN 0 ELSE 1 END ELSE 999999 END) AS b1,
      least(2 + v2, CASE WHEN ok THEN more + v3 + CASE WHEN ini = 'a' THEN 0 ELSE 1 END ELSE 999999 END) AS b2,
      least(2 + v3, CASE WHEN ok THEN more + v2 + CASE WHEN ini = 'u' THEN 0 ELSE 1 END ELSE 999999 END) AS b3
    FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i)),
s AS (
  SELECT v.conv_id, v.i, [v.v0, v.v1, v.v2, v.v3] AS v, [w.v0, w.v1, w.v2, w.v3] AS w, role, text, ini, coalesce(ok, false) AS ok, more
  FROM v LEFT JOIN v w ON w.conv_id IS NOT DISTINCT FROM v.conv_id AND w.i = v.i + 1 LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i + 1),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM n
  UNION ALL
  SELECT conv_id, i + CASE WHEN e = 'I' THEN 0 ELSE 1 END, CASE e WHEN 'D' THEN q WHEN 'K' THEN kq ELSE nq END, audit || e,
    CASE e WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text) WHEN 'I' THEN list_append(said, letter || ':') ELSE list_append(said, letter || ':' || text) END
  FROM (
    SELECT *, CASE WHEN w IS NULL THEN 'I' WHEN 2 + w[q + 1] = v[q + 1] THEN 'D' WHEN 5 + v[nq + 1] = v[q + 1] THEN 'I' WHEN kq IS NOT NULL AND more + w[kq + 1] = v[q + 1] THEN 'K' ELSE 'R' END AS e
    FROM (
      SELECT walk.*, s.v, CASE WHEN s.i < n.n THEN s.w END AS w, s.role, s.text, s.more, CASE q WHEN 2 THEN 3 ELSE 2 END AS nq, CASE q WHEN 2 THEN 'assistant' ELSE 'user' END AS letter,
        CASE WHEN NOT ok THEN NULL WHEN ini = 's' AND q = 0 THEN 1 WHEN ini = 'u' AND q <> 2 THEN 2 WHEN ini = 'a' AND q = 2 THEN 3 END AS kq
      FROM walk JOIN s ON s.conv_id IS NOT DISTINCT FROM walk.conv_id AND s.i = walk.i JOIN n ON n.conv_id IS NOT DISTINCT FROM walk.conv_id
      WHERE walk.i < n.n OR q IN (1, 2)))),
done AS (SELECT walk.* FROM walk JOIN n ON n.conv_id IS NOT DISTINCT FROM walk.conv_id WHERE walk.i = n.n AND q IN (0, 3)),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(v0, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM a.conv_id AND v.i = 0
"""

# --- 12: target-distribution importance resampling ---------------------------------------------


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), most=1, buckets=10_000, seed=2024, least_words=20, percent=10)


OP12_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH {CRC_TABLE},
dw AS (SELECT doc_id, unnest({OP12_WORDS}) AS word FROM documents),
c AS MATERIALIZED (SELECT doc_id, word, count(*) AS n FROM dw GROUP BY ALL),
bw AS (SELECT unnest({OP12_WORDS}) AS word FROM benchmark),
w AS (SELECT word, sum(s) AS s, sum(t) AS t, hex(encode(word)) AS h FROM (SELECT word, n AS s, 0 AS t FROM c UNION ALL SELECT word, 0, 1 FROM bw) GROUP BY word),
k AS MATERIALIZED (SELECT word, s, t, {CRC.format(bytes="list_transform(range(0, length(h), 2), lambda i: CAST('0x' || substr(h, i + 1, 2) AS BIGINT))")} % 10000 AS bucket FROM w, crc),
b AS (SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM k GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM b),
d AS (SELECT doc_id, sum(n) AS n, sum(n * gain) AS weight FROM c JOIN k USING (word) JOIN g USING (bucket) GROUP BY doc_id),
e AS (
  SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296e0))) AS BIGINT) AS score
  FROM documents LEFT JOIN d USING (doc_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, 10 * count(*) OVER (PARTITION BY n_features >= 20) // 100 AS draw FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= draw THEN r END AS rank FROM p
"""

# --- 13: SimHash near-dedup ---------------------------------------------------------------------


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(table(spark, sf_dir, "documents"), words=3, seed=42, most=3)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Query] = {
    "op1_chat_format": op1_chat_format,
    "op2_near_dup": op2_near_dup,
    "op3_html_extract": op3_html_extract,
    "op4_url_filter": op4_url_filter,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_mix_domains": op7_mix_domains,
    "op8_pack_buckets": op8_pack_buckets,
    "op9_quality_llr": op9_quality_llr,
    "op10_shard_shuffle": op10_shard_shuffle,
    "op11_turn_repair": op11_turn_repair,
    "op12_importance": op12_importance,
    "op13_simhash": op13_simhash,
}
SQL: dict[str, str] = {"op1_chat_format": OP1_SQL, "op4_url_filter": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op11_turn_repair": OP11_SQL, "op12_importance": OP12_SQL}
