"""URL filter: rules first, link-graph propagation for the rest (DataFrame operations only).

Rules decide the urls they fit.  Every other page takes its host's verdict,
which comes from two personalised PageRanks over the host graph:

* trust starts at the hosts with allowed pages and follows links: whom a
  trusted host links to gains trust;
* distrust starts at the hosts with blocked pages and runs against the links:
  who links to a distrusted host gains distrust.

Both are scaled to pages (the number of allowed and of blocked pages), so they
can be weighed against each other and against the host's own undecided pages.
A host is blocked where distrust is more than ``THRESHOLD`` of the three.

With restarts and dangling mass both going back to the seeds, the ranks are
proportional to the series  (1 - d) * sum_k (d * P^T)^k * seeds,  which is summed
until what moves is under ``TOLERANCE`` of the seeds, then normalised.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.llm.workspace import ascii_lower, columns_of, stored, table

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Rules are compiled into one expression.
MOST_RULES = 1000
DAMPING, THRESHOLD, TOLERANCE, MOST_STEPS = 0.85, 0.5, 1e-3, 50
LINK = r"""(?i)(?:href|src|action)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(after, r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule ``host/path`` that fits as a struct (rule, verdict), else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def link_graph(pages: DataFrame) -> DataFrame:
    """``a, b, n``: links between different hosts, from pages with ``host, html``."""
    found = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))))
    links = pages.filter(F.col("html").contains("//")).select(F.col("host").alias("a"), found.alias("b"))
    return links.select("a", ascii_lower(F.col("b")).alias("b")).filter("a <> b AND a <> ''").groupBy("a", "b").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING) -> DataFrame:
    """``host, trust, distrust`` from ``links(a, b, n)`` and ``seeds(host, good, bad)``.

    Both results have the sums of the seeds.  The moves are the same in every
    step, so they are written once: trust from a to b, distrust from b to a.
    """
    out = links.groupBy("a").agg(F.sum("n").alias("all_a"))
    back = links.groupBy("b").agg(F.sum("n").alias("all_b"))
    forth = links.join(out, "a").select(F.col("a").alias("host"), F.col("b").alias("to"), (F.col("n") / F.col("all_a")).alias("t"), F.lit(0.0).alias("d"))
    against = links.join(back, "b").select(F.col("b").alias("host"), F.col("a").alias("to"), F.lit(0.0).alias("t"), (F.col("n") / F.col("all_b")).alias("d"))
    moves = stored(forth.unionByName(against).groupBy("host", "to").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), "link-moves")
    now = stored(seeds.select("host", F.col("good").cast("double").alias("trust"), F.col("bad").cast("double").alias("distrust")), "link-mass")
    mass = now.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    start = (mass["t"] or 0.0, mass["d"] or 0.0)
    total = now
    for _ in range(MOST_STEPS):
        now = (
            now.filter("trust > 0 OR distrust > 0")
            .join(moves, "host")
            .groupBy(F.col("to").alias("host"))
            .agg(F.sum(F.col("trust") * F.col("t") * damping).alias("trust"), F.sum(F.col("distrust") * F.col("d") * damping).alias("distrust"))
        )
        now = stored(now, "link-mass")
        left = now.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
        if (left["t"] or 0.0) <= 0 and (left["d"] or 0.0) <= 0:
            break
        total = stored(total.unionByName(now).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "link-rank")
        if (left["t"] or 0.0) <= TOLERANCE * start[0] and (left["d"] or 0.0) <= TOLERANCE * start[1]:
            break
    sums = total.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    scale = [a / b if b else 0.0 for a, b in zip(start, (sums["t"], sums["d"]), strict=True)]
    return total.select("host", (F.col("trust") * scale[0]).alias("trust"), (F.col("distrust") * scale[1]).alias("distrust"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict, trust, distrust``.

    Null urls and those without ``://`` have an empty host and path; no rule
    fits them and, being no host, they are allowed.  Null html has no links.
    Null ids and repeated rows are judged like any other, and each counts as a
    page of its host.  An empty table gives no rows; other columns are ignored.
    """
    df = columns_of(pages, page_id=id_col, url=url_col, html=html_col)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    named = df.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    judged = named.withColumn("match", matched_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("match.rule").alias("rule"), F.col("match.verdict").alias("verdict"))
    links = stored(link_graph(df.select(F.coalesce(host, F.lit("")).alias("host"), "html")), "links")
    tally = lambda v: F.count_if(F.col("verdict").eqNullSafe(v))
    hosts = stored(judged.filter("host <> ''").groupBy("host").agg(tally("allow").alias("good"), tally("block").alias("bad"), tally(None).alias("open")), "link-hosts")
    ranks = propagate(links, hosts)
    spam = F.col("distrust") > threshold * (F.col("trust") + F.col("distrust") + F.coalesce("open", F.lit(0)))
    verdicts = hosts.join(ranks, "host", "left").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"), F.when(spam, "block").otherwise("allow").alias("own"))
    # a large host is a skewed key here: the page side is split by AQE, the host side has one row for it
    return judged.join(verdicts, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", "own", F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages")).drop("trust", "distrust")


SQL = r"""
WITH RECURSIVE
u AS (
  SELECT row_number() OVER () AS i, page_id, html, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest
  FROM pages),
p AS (
  SELECT i, page_id, html,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u),
r(verdict, rule, site, below) AS (VALUES
  ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
  ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
j AS (
  SELECT p.*, rule, verdict
  FROM p LEFT JOIN r ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, below)
  QUALIFY row_number() OVER (PARTITION BY i ORDER BY length(rule) DESC NULLS LAST) = 1),
h AS (
  SELECT host, count(*) FILTER (verdict = 'allow') AS good, count(*) FILTER (verdict = 'block') AS bad, count(*) FILTER (verdict IS NULL) AS open
  FROM j WHERE host <> '' GROUP BY host),
e AS (
  SELECT host AS a, unnest(list_distinct(regexp_extract_all(html, '(?i)(?:href|src|action)[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["'']?[\x20\x09-\x0D]*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\x20\x09-\x0D<>]+)', 1))) AS b
  FROM p WHERE host <> ''),
l AS (
  SELECT a, translate(b, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS b, count(*) AS n
  FROM e GROUP BY ALL HAVING a <> translate(b, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')),
m AS (
  SELECT a AS host, b AS next, n / sum(n) OVER (PARTITION BY a) AS t, 0.0 AS d FROM l
  UNION ALL
  SELECT b, a, 0.0, n / sum(n) OVER (PARTITION BY b) FROM l),
s AS (
  SELECT 0 AS k, host, CAST(good AS DOUBLE) AS trust, CAST(bad AS DOUBLE) AS distrust FROM h
  UNION ALL
  SELECT k + 1, next, CAST(sum(0.85 * trust * t) AS DOUBLE), CAST(sum(0.85 * distrust * d) AS DOUBLE)
  FROM s JOIN m ON s.host = m.host WHERE k < 50 AND (trust > 0 OR distrust > 0) GROUP BY ALL),
x AS (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM s GROUP BY host),
z AS (SELECT (SELECT sum(good) FROM h) / nullif(sum(trust), 0) AS t, (SELECT sum(bad) FROM h) / nullif(sum(distrust), 0) AS d FROM x),
v AS (
  SELECT h.host, coalesce(distrust * d, 0) > 0.5 * (coalesce(trust * t, 0) + coalesce(distrust * d, 0) + open) AS spam
  FROM h JOIN x ON h.host = x.host CROSS JOIN z)
SELECT page_id, j.host, path, rule, coalesce(verdict, CASE WHEN spam THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN v ON j.host = v.host
"""
