"""URL filter: a blocked Bloom filter lets possible hits through to an exact hash join.

Two kinds of entries are listed: canonical URLs of single pages to block, and rules, each a host
and the beginning of a path. Every page looks up its canonical URL, and its host and path cut
to each length that a rule can have. All listed keys are in one blocked Bloom filter: a key sets eight bits
of one 256-bit block, so a look-up reads one row of four longs. Look-ups that miss it end there;
what passes is joined with the listed keys themselves, which removes false positives.
Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.rows import numbered, table
from skyloom.plans.staging import stage

#: Host, path and verdict of the rules. Fixed values.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Parts of host names whose pages are listed one by one where no list is given. Fixed values.
LISTED_HOSTS = ("ads", "adult", "bets", "casino", "pills", "spam")
#: Query parameters that don't tell pages apart. Fixed values.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"
#: Bits for each listed key, and the most blocks of 256 bits: 8 MB, so that the filter may be broadcast. With more keys more look-ups pass, and the join still decides.
BITS, MAX_BLOCKS = 16, 1 << 18


def _after_scheme(url) -> F.Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_and_path(url) -> tuple[F.Column, F.Column]:
    """What lies between the first ``://`` and ``/``, ``?``, ``#`` or the end, in lower case (ASCII); then up to ``?`` or ``#``. Both empty without ``://``."""
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical_url(url) -> F.Column:
    """Host without ``www.``, ``m.`` and a standard port, path without ``.html`` and closing slashes, query without tracking; no scheme, no fragment. Null without ``://``."""
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(host, r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path, r"(\.html?)?/*$", "")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.when(F.locate("://", url) > 0, F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def listed_urls(pages: DataFrame, url_col: str = "url", names: tuple[str, ...] = LISTED_HOSTS) -> DataFrame:
    """``(url)``: the canonical URLs of pages on hosts that have one of ``names`` as a part."""
    host, _ = host_and_path(F.col(url_col))
    return pages.where(host.rlike(rf"(^|[.-])({'|'.join(names)})([.-]|$)")).select(canonical_url(F.col(url_col)).alias("url")).distinct()


def _key(*parts) -> F.Column:
    return F.concat_ws("\x1f", *parts)


def _block(key: str, blocks: int) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _words(key: str) -> list[F.Column]:
    """The four longs in which a key sets its eight bits: two in each, one in either half."""
    bits = F.xxhash64(key, F.lit(7))
    five = lambda i: F.call_function("shiftrightunsigned", bits, F.lit(5 * i)).bitwiseAND(F.lit(31)).cast("int")
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at)
    return [bit(five(2 * i)).bitwiseOR(bit(five(2 * i + 1) + 32)) for i in range(4)]


def bloom_filter(keys: DataFrame, most: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """``(block, w0, w1, w2, w3)`` of the one column of ``keys``, one row for each block that isn't empty, and the number of blocks, a power of two up to ``most``."""
    (key,) = keys.columns
    blocks = min(most, 1 << max(0, (keys.count() * BITS - 1) // 256).bit_length())
    words = [w.alias(f"w{i}") for i, w in enumerate(_words(key))]
    held = keys.select(_block(key, blocks).alias("block"), *words).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])
    return stage(held, "bloom"), blocks


def passing(rows: DataFrame, key: str, held: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key may be in the filter."""
    bits = held.select(F.col("block").alias("__block"), *[F.col(f"w{i}").alias(f"__w{i}") for i in range(4)])
    on = _block(key, blocks) == F.col("__block")
    for i, word in enumerate(_words(key)):
        on &= F.col(f"__w{i}").bitwiseAND(word) == word
    return rows.join(F.broadcast(bits), on, "left_semi")


def _rule_keys(rules: DataFrame) -> DataFrame:
    """Rules with the key by which pages find them: the host, and the path up to its last slash."""
    head = F.when(F.locate("/", "path") > 0, F.regexp_extract("path", r"(?s)^(.*/)[^/]*$", 1)).otherwise("")
    return rules.select(_key(F.lit("r"), "host", head).alias("key"), F.concat("host", "path").alias("rule"), F.col("path").alias("rule_path"), "verdict")


def _look_ups(labels: int, depth: int) -> F.Column:
    """All keys of a page: its canonical URL's, and those of its host's ends and its path's beginnings, as long as a rule's may be."""
    hosts = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in range(1, labels + 1)]))
    heads = F.array(F.lit(""), *[F.when(F.substring_index("path", "/", n) != F.col("path"), F.concat(F.substring_index("path", "/", n), F.lit("/"))) for n in range(1, depth + 1)])
    heads = F.filter(heads, lambda x: x.isNotNull())
    rules = F.flatten(F.transform(hosts, lambda h: F.transform(heads, lambda p: _key(F.lit("r"), h, p))))
    return F.concat(F.filter(F.array(_key(F.lit("u"), "canonical")), lambda _: F.col("canonical").isNotNull()), rules)


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per page.

    ``rules`` has (host, path, verdict), ``listed`` the canonical URLs to block in its one column. A
    rule fits its host and all below it if the page's path begins with the rule's; of several the
    longest decides; of equally long ones the greatest; a rule that is listed both ways blocks. Without one, ``verdict`` is block if the canonical
    URL is listed, else allow. A null URL, or one without ``://``, has an empty host and path and is
    allowed. Rows that repeat a page each get their row; an empty table gives no rows; other
    columns are ignored. Rules without rows leave all to the list, an empty list all to the rules.
    Null entries of either don't count.
    """
    host, path = host_and_path(F.col("url"))
    rows, number = numbered(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")))
    rows = rows.select(F.col(number).alias("row"), "page_id", host.alias("host"), path.alias("path"), canonical_url(F.col("url")).alias("canonical"))
    rules = stage(_rule_keys(rules.dropna()).distinct(), "rules")
    (url,) = listed.columns
    none = F.lit(None).cast("string")
    entries = rules.unionAll(listed.dropna().select(_key(F.lit("u"), url).alias("key"), none, none, none).distinct())
    # staged, so that its side of the join has a shuffle of its own: a rule of very many pages can be split
    entries = stage(entries, "entries")
    ends = F.substring_index(F.substring_index("key", "\x1f", 2), "\x1f", -1)
    longest = rules.agg(F.coalesce(F.max(F.size(F.split(ends, r"\."))), F.lit(0)), F.coalesce(F.max(F.size(F.split("rule_path", "/"))) - 1, F.lit(0))).first()
    looks = rows.select("row", "path", F.explode(_look_ups(*longest)).alias("key"))
    possible = passing(looks, "key", *bloom_filter(entries.select("key").distinct()))
    hits = possible.join(entries, "key").where("rule IS NULL OR startswith(path, rule_path)")
    best = F.max(F.struct(F.length("rule").alias("length"), "rule", "verdict")).alias("best")
    found = hits.groupBy("row").agg(best, F.bool_or(F.col("rule").isNull()).alias("on_list"))
    joined = rows.join(found, "row", "left")
    return joined.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.when(F.col("on_list"), "block"), F.lit("allow")).alias("verdict"))


def rules_table(spark, rules: tuple = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def op13_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, rules_table(spark), listed_urls(pages))


_CANONICAL_SQL = r"""
  CASE WHEN contains(url, '://') THEN
    regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(path, '(\.html?)?/*$', '') ||
    coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))), '&'), ''), '')
  END"""

OP13_SQL = rf"""
WITH u AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM u
), c AS (
  SELECT *, {_CANONICAL_SQL} AS canonical FROM h
), listed AS (
  SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)')
), r AS (
  SELECT *, CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM c
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN canonical IN (SELECT canonical FROM listed WHERE canonical IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
