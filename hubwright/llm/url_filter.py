"""URL rules by host suffix and path prefix, with DataFrame functions only.

Each different (host, path) is expanded into expressions: host suffixes at label bounds,
joined with path prefixes. Expressions meet rules on the first four bytes of
their SHA-256; the full digest confirms, and the longest rule that fits wins.

Only those (labels, path length) shapes are expanded that some rule has. That loses nothing, as a rule
can fit no other, and a URL's number of expressions follows the rules, not its own length.

Defined results: host and path of a null url or one without ``://`` are empty; no rule
fits an empty host; a rule's path has to be the start of the url's path, letter by letter; without a rule the
verdict is ``default``; of rules equally long, the one with the longer host wins, then block before allow.
A url that repeats is judged once. Rules that repeat count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hubwright.llm.common import table
from hubwright.session import broadcast_if_small

# Host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

PREFIX_BYTES = 4


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` to ``/ ? #``, A-Z lower-cased; path: from there to ``? #``. Both empty without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def expression(host: Column, path: Column) -> Column:
    # a url's host has no question mark, so the text has one reading only
    return F.concat(host, F.lit("?"), path)


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict: one row per row of ``pages``. ``rules``: host, path, verdict."""
    labels = lambda host: F.size(F.split(host, r"\.", -1))
    rules = rules.where("host != ''").dropDuplicates(["host", "path", "verdict"])
    # metadata of the rules: the different shapes are no more than labels times path lengths
    shapes = [tuple(r) for r in rules.select(labels(F.col("host")).alias("l"), F.length("path").alias("p")).distinct().collect()]

    host, path = host_and_path(F.col(url))
    parsed = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    if not shapes:
        none = F.lit(None).cast("string")
        return parsed.select(F.col("page_id").alias(page_id), "host", "path", none.alias("rule"), F.lit(default).alias("verdict"))

    places = parsed.where("host != ''").select("host", "path").distinct()
    suffix = lambda n: F.substring_index("host", ".", -n)
    made = [
        F.when(
            (labels(F.col("host")) >= n) & (F.length("path") >= size), expression(suffix(n), F.substring("path", 1, size))
        )
        for n, size in sorted(shapes)
    ]
    expanded = places.select("host", "path", F.explode(F.array_compact(F.array(*made))).alias("expression"))
    digest = F.unhex(F.sha2("expression", 256))
    expanded = expanded.select("host", "path", digest.alias("digest"))
    short = lambda name: F.substring(name, 1, PREFIX_BYTES)

    listed = rules.select(
        F.unhex(F.sha2(expression(F.col("host"), F.col("path")), 256)).alias("rule_digest"),
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_length"),
        F.col("verdict").alias("rule_verdict"),
    ).withColumn("short", short("rule_digest"))
    hits = (
        expanded.withColumn("short", short("digest"))
        .join(broadcast_if_small(listed), "short")
        .where("digest = rule_digest")
    )
    order = F.struct(F.length("rule"), "host_length", (F.col("rule_verdict") == "block").cast("int"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), order).alias("best"))
    return parsed.join(best, ["host", "path"], "left").select(
        F.col("page_id").alias(page_id),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules)


OP6_SQL = r"""
WITH rules(rhost, rpath, rverdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), fits AS (
  SELECT page_id, host, path, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS n
  FROM parts LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM fits WHERE n = 1
"""
