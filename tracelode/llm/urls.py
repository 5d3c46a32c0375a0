"""Operator 3: URL filter by rules and by the ratio of two character language models.

Every page address gets host and path, the longest fitting rule, and a verdict. Addresses that no
rule decides are judged by two variable-order Markov models over characters, one of the addresses
that the rules allow and one of those they block. The probability of a character after its three
predecessors mixes orders 3, 2, 1, 0 and the uniform distribution; the weight of an order follows
from how many different characters were seen after its context (Witten-Bell). The score is the mean
log-likelihood difference per character; the threshold is put between the mean scores of the two
training sets, at the same number of standard deviations from both.

DataFrame functions only. All addresses are counted once as character quadruples; the model tables
are made of these counts, so their size is that of the distinct quadruples. Scoring joins exploded
addresses with the model on the quadruple; common ones are split by the adaptive skew join.

Results: null, empty or `://`-less addresses have empty host and path, no rule and score 0. Repeated
page ids give one row per input row. Without training addresses of either kind the threshold is 0.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm.common import load, shared_table

#: (verdict, host and path): what the query's contract fixes.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
START, END = "\x02", "\x03"
#: Characters the lowest order spreads its rest over.
ALPHABET = 256


def address_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of an address."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(has, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def with_rule(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Add `rule` and `decided`, the longest rule that fits `host` and `path` and its verdict."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, path = text.split("/", 1)
        at = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule = F.when(at, text) if rule is None else rule.when(at, text)
        verdict = F.when(at, kind) if verdict is None else verdict.when(at, kind)
    none = F.lit(None).cast("string")
    return df.withColumn("rule", none if rule is None else rule).withColumn(
        "decided", none if verdict is None else verdict
    )


def quadruples(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """A row per character of host and path and for the end, with its three predecessors in `gram`."""
    padded = F.concat(F.lit(START * 3), "host", "path", F.lit(END))
    chars = df.select(*keep, F.split(padded, "").alias("c"))
    n = F.size("c")
    shifted = [F.col("c")] + [F.slice("c", k + 1, F.greatest(n - k, F.lit(0))) for k in (1, 2, 3)]
    zipped = F.arrays_zip(*[x.alias(f"c{k}") for k, x in enumerate(shifted)])
    rows = chars.select(*keep, F.explode(F.slice(zipped, 1, F.greatest(n - 3, F.lit(0)))).alias("q"))
    return rows.select(*keep, F.concat(*[F.col("q")[name] for name in rows.schema["q"].dataType.names]).alias("gram"))


def model(counts: DataFrame) -> DataFrame:
    """Log-likelihood difference `diff` of each `gram` from its counts `a` (allowed) and `b` (blocked)."""
    levels = {4: counts.select("gram", "a", "b")}
    for k in (3, 2, 1):
        levels[k] = levels[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(
            F.sum("a").alias("a"), F.sum("b").alias("b")
        )
    lower: DataFrame | None = None
    for k in (1, 2, 3, 4):
        context = F.substring("gram", 1, k - 1).alias("context")
        seen = levels[k].groupBy(context).agg(
            *[F.sum(x).alias(f"n{x}") for x in "ab"], *[F.sum((F.col(x) > 0).cast("long")).alias(f"t{x}") for x in "ab"]
        )
        here = levels[k].select("gram", "a", "b", context, F.substring("gram", 2, k - 1).alias("suffix"))
        here = here.join(seen, "context")
        if lower is None:
            below = {x: F.lit(1.0 / ALPHABET) for x in "ab"}
        else:
            here = here.join(lower.withColumnsRenamed({"gram": "suffix", "pa": "la", "pb": "lb"}), "suffix")
            below = {"a": F.col("la"), "b": F.col("lb")}
        p = {
            x: F.when(F.col(f"n{x}") > 0, (F.col(x) + F.col(f"t{x}") * below[x]) / (F.col(f"n{x}") + F.col(f"t{x}")))
            .otherwise(below[x])
            for x in "ab"
        }
        lower = here.select("gram", p["a"].alias("pa"), p["b"].alias("pb"))
    return lower.select("gram", (F.log("pa") - F.log("pb")).alias("diff"))


def filter_addresses(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) per row of `pages`(page_id, url)."""
    host, path = address_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = with_rule(rows, rules)
    counts = quadruples(rows, ["decided"]).groupBy("gram").agg(
        *[F.sum(F.when(F.col("decided") == kind, 1).otherwise(0)).alias(x) for x, kind in (("a", "allow"), ("b", "block"))]
    )
    grams = model(shared_table(counts, "url-counts"))
    # Equal host and path give equal scores: each is scored once, however many pages have it.
    texts = rows.select("host", "path").distinct()
    scored = quadruples(texts, ["host", "path"]).join(grams, "gram").groupBy("host", "path").agg(
        F.round(F.avg("diff"), 6).alias("score")
    )
    scored = shared_table(
        rows.join(scored, ["host", "path"], "left").withColumn(
            "score", F.when((F.col("host") == "") & (F.col("path") == ""), F.lit(0.0)).otherwise(F.col("score"))
        ),
        "url-scores",
    )
    kinds = (("a", "allow"), ("b", "block"))
    of = {x: F.when(F.col("decided") == kind, F.col("score")) for x, kind in kinds}
    fit = scored.agg(
        *[F.avg(of[x]).alias(f"m{x}") for x in "ab"], *[F.stddev_pop(of[x]).alias(f"s{x}") for x in "ab"]
    ).first()
    at = threshold(fit["ma"], fit["mb"], fit["sa"], fit["sb"])
    verdict = F.coalesce("decided", F.when(F.col("score") >= at, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def threshold(ma: float | None, mb: float | None, sa: float | None, sb: float | None) -> float:
    """Where both training sets are equally many standard deviations away; 0 if one is empty."""
    if ma is None or mb is None:
        return 0.0
    return (ma * sb + mb * sa) / (sa + sb) if sa + sb > 0 else (ma + mb) / 2


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_addresses(load(spark, sf_dir, "pages"))


OP3_SQL = r"""
WITH cut AS (
 SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
 SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
 SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM parts
), decided AS (
 SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS decided,
  chr(2) || chr(2) || chr(2) || host || path || chr(3) AS padded FROM ruled
), grams AS (
 SELECT host, path, decided, substr(padded, i, 4) AS g FROM decided, unnest(range(1, length(padded) - 2)) AS u(i)
), g4 AS (
 SELECT g, count(*) FILTER (decided = 'allow') AS a, count(*) FILTER (decided = 'block') AS b FROM grams GROUP BY g
), g3 AS (SELECT substr(g, 2) AS g, sum(a) AS a, sum(b) AS b FROM g4 GROUP BY 1
), g2 AS (SELECT substr(g, 2) AS g, sum(a) AS a, sum(b) AS b FROM g3 GROUP BY 1
), g1 AS (SELECT substr(g, 2) AS g, sum(a) AS a, sum(b) AS b FROM g2 GROUP BY 1
), w1 AS (SELECT *, sum(a) OVER () AS na, sum(b) OVER () AS nb, count(*) FILTER (a > 0) OVER () AS ta, count(*) FILTER (b > 0) OVER () AS tb FROM g1
), p1 AS (SELECT g, CASE WHEN na > 0 THEN (a + ta / 256.0::DOUBLE) / (na + ta) ELSE 1 / 256.0::DOUBLE END AS pa,
  CASE WHEN nb > 0 THEN (b + tb / 256.0::DOUBLE) / (nb + tb) ELSE 1 / 256.0::DOUBLE END AS pb FROM w1
), w2 AS (SELECT *, sum(a) OVER w AS na, sum(b) OVER w AS nb, count(*) FILTER (a > 0) OVER w AS ta, count(*) FILTER (b > 0) OVER w AS tb FROM g2 WINDOW w AS (PARTITION BY left(g, 1))
), p2 AS (SELECT w2.g, CASE WHEN na > 0 THEN (a + ta * pa) / (na + ta) ELSE pa END AS pa, CASE WHEN nb > 0 THEN (b + tb * pb) / (nb + tb) ELSE pb END AS pb FROM w2 JOIN p1 ON substr(w2.g, 2) = p1.g
), w3 AS (SELECT *, sum(a) OVER w AS na, sum(b) OVER w AS nb, count(*) FILTER (a > 0) OVER w AS ta, count(*) FILTER (b > 0) OVER w AS tb FROM g3 WINDOW w AS (PARTITION BY left(g, 2))
), p3 AS (SELECT w3.g, CASE WHEN na > 0 THEN (a + ta * pa) / (na + ta) ELSE pa END AS pa, CASE WHEN nb > 0 THEN (b + tb * pb) / (nb + tb) ELSE pb END AS pb FROM w3 JOIN p2 ON substr(w3.g, 2) = p2.g
), w4 AS (SELECT *, sum(a) OVER w AS na, sum(b) OVER w AS nb, count(*) FILTER (a > 0) OVER w AS ta, count(*) FILTER (b > 0) OVER w AS tb FROM g4 WINDOW w AS (PARTITION BY left(g, 3))
), p4 AS (SELECT w4.g, ln(CASE WHEN na > 0 THEN (a + ta * pa) / (na + ta) ELSE pa END) - ln(CASE WHEN nb > 0 THEN (b + tb * pb) / (nb + tb) ELSE pb END) AS diff FROM w4 JOIN p3 ON substr(w4.g, 2) = p3.g
), texts AS (SELECT DISTINCT host, path FROM decided
), scored AS (
 SELECT host, path, CASE WHEN host = '' AND path = '' THEN 0.0::DOUBLE ELSE round(avg(diff), 6) END AS score
 FROM (SELECT host, path, unnest(list_transform(range(1, length(p) - 2), lambda i: substr(p, i, 4))) AS g FROM (SELECT host, path, chr(2) || chr(2) || chr(2) || host || path || chr(3) AS p FROM texts)) JOIN p4 USING (g) GROUP BY host, path
), judged AS (SELECT page_id, decided.host, decided.path, rule, decided, score FROM decided JOIN scored ON decided.host = scored.host AND decided.path = scored.path
), fit AS (
 SELECT avg(score) FILTER (decided = 'allow') AS ma, avg(score) FILTER (decided = 'block') AS mb, stddev_pop(score) FILTER (decided = 'allow') AS sa, stddev_pop(score) FILTER (decided = 'block') AS sb FROM judged
), cutoff AS (SELECT CASE WHEN ma IS NULL OR mb IS NULL THEN 0 WHEN sa + sb > 0 THEN (ma * sb + mb * sa) / (sa + sb) ELSE (ma + mb) / 2 END AS t FROM fit)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN score >= t THEN 'allow' ELSE 'block' END) AS verdict, score FROM judged, cutoff
"""
