"""Site-relative line dedup: lines that too many pages of one host share are boilerplate.

Only DataFrame functions. A host's boilerplate is a short list: as each page has so many
lines, at most (mean lines of a page) / (greatest ratio) lines can exceed the ratio. So it is
joined to the pages as one array for each host, and lines are never exploded back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.rows import table
from skyloom.plans.staging import stage

#: A line on a greater share of its host's pages is dropped.
RATIO = 0.3
#: Hosts of fewer pages are left alone; 1 leaves none. A line on one page only always stays.
MIN_PAGES = 1

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_BREAK = r"(?i)<(?:/?(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|title|body|html|head|blockquote|pre)(?:\s[^>]*)?|br\s*/?)>"
_HIDDEN = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>"


def host_of(url) -> F.Column:
    """The lower-case host of a URL without ``www.``; empty if it has none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1)), r"^www\.", "")


def page_lines(html) -> F.Column:
    """The visible lines of a page: text between line breaks and block tags, blanks folded, none empty."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, "")
    text = F.regexp_replace(text, _BREAK, "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    lines = F.transform(F.split(text, r"\n"), lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09\x0B-\x0D]+", " ")))
    return F.filter(lines, lambda x: x != "")


def boilerplate(lines: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(host, host_pages, drop)`` from ``(host, digests)``: the digests on too many of a host's pages."""
    pages = lines.groupBy("host").agg(F.count("*").alias("host_pages")).where(F.col("host_pages") >= min_pages)
    counts = lines.select("host", F.explode(F.array_distinct("digests")).alias("digest")).groupBy("host", "digest").agg(F.count("*").alias("n"))
    often = counts.where("n > 1").join(pages, "host").where(F.col("n") > ratio * F.col("host_pages"))
    return often.groupBy("host").agg(F.max("host_pages").alias("host_pages"), F.collect_list("digest").alias("drop"))


def line_dedup(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(page_id, host, n_lines, n_dropped, text)``, one row per page.

    ``text`` holds the page's lines without those that more than ``ratio`` of its host's pages
    contain, in order, joined by line breaks. A null or odd URL has the empty host and is left
    alone, as are hosts of fewer than ``min_pages`` pages; null HTML has no line. Rows that
    repeat a page count as pages of their own. An empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), page_lines(F.col(html_col)).alias("lines"))
    rows = stage(rows.withColumn("digests", F.transform("lines", lambda x: F.md5(x.cast("binary")))), "lines")
    drop = stage(boilerplate(rows.where("host <> ''").select("host", "digests"), ratio, min_pages), "boilerplate")
    joined = rows.join(drop, "host", "left")
    unwanted = F.coalesce("drop", F.array().cast("array<string>"))
    kept = F.transform(F.filter(F.arrays_zip("lines", "digests"), lambda x: ~F.array_contains(F.col("unwanted"), x["digests"])), lambda x: x["lines"])
    joined = joined.select("page_id", "host", "lines", "digests", unwanted.alias("unwanted")).withColumn("kept", kept)
    return joined.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "pages"))


OP7_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '') AS host,
    list_filter(list_transform(string_split(
      regexp_replace(regexp_replace(
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)<!doctype[^>]*>', '', 'g'),
        '(?i)<(?:/?(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|title|body|html|head|blockquote|pre)(?:\s[^>]*)?|br\s*/?)>', chr(10), 'g'),
        '<[^>]*>', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[\x20\x09\x0B-\x0D]+', ' ', 'g'))), lambda x: x <> '') AS lines
  FROM pages
), h AS (
  SELECT host, count(*) AS host_pages FROM p WHERE host <> '' GROUP BY host
), c AS (
  SELECT host, line, count(*) AS n FROM (SELECT DISTINCT rid, host, unnest(lines) AS line FROM p WHERE host <> '') GROUP BY host, line
), b AS (
  SELECT c.host, list(line) AS unwanted FROM c JOIN h ON c.host = h.host WHERE n > 1 AND n > 0.3::DOUBLE * host_pages GROUP BY c.host
)
SELECT page_id, p.host, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_filter(lines, lambda x: NOT list_contains(coalesce(unwanted, []), x))))::BIGINT AS n_dropped,
  coalesce(array_to_string(list_filter(lines, lambda x: NOT list_contains(coalesce(unwanted, []), x)), chr(10)), '') AS text
FROM p LEFT JOIN b ON p.host = b.host
"""
