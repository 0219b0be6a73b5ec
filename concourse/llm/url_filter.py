"""Block or allow urls: host rules first, then logistic regression on hashed character n-grams of host and path.

Everything runs as DataFrame expressions.  A rule meets a url by an equi-join of the rule's host with the host itself
and its parent domains; distinct hosts are joined, so a host with a third of all rows is looked up once.  The model
is trained by full gradient steps with momentum: each step is one aggregation over the labelled table by n-gram bucket, and only the
``BUCKETS`` weights pass through the driver.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule, and the model's verdict for
empty strings; repeated rows are judged one by one; of rules of equal length the smallest wins; an empty rule table
leaves all to the model; a labelled table without rows gives zero weights (allow); other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
GRAMS = (3, 4, 5)
STEPS = 60
RATE = 8.0
MOMENTUM = 0.9
DECAY = 1e-4
MOST_LABELLED = 100_000
# Fixed values of the small labelled table: site names by label, each met with the same prefixes, endings and paths.
BLOCKED_SITES = "ads-track adult-x casino-win cheap-pills free-bets poker-bonus spam-farm win-prizes xxx-cams click-ads".split()
ALLOWED_SITES = (
    "archive atlas bakery botany bridge cinema coast-path concert courier daily-news farmers-market gardens gazette "
    "harbour health-info history hospital kitchen library lighthouse mathematics meadow museum music-school northern "
    "orchard parish physics post-office railway recipes river science station teacher theatre town-hall tourism "
    "university weather winery wonder workshop"
).split()
PREFIXES, ENDINGS = ("", "www.", "m.", "blog."), ("com", "net", "org")
PATHS = ("/en/12", "/de/407.html", "/fr/88/", "/es/951", "/")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: url and blocked."""
    rows = [
        (f"https://{prefix}{site}.example.{ending}{PATHS[(i + j + 2 * k) % 5]}", int(sites is BLOCKED_SITES))
        for sites in (BLOCKED_SITES, ALLOWED_SITES)
        for i, site in enumerate(sites)
        for j, prefix in enumerate(PREFIXES)
        for k, ending in enumerate(ENDINGS)
    ]
    return spark.createDataFrame(rows, "url string, blocked int")


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(text, pattern, 2)


def domains(host: Column) -> Column:
    """The host and all its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def rule_rows(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """``(verdict, host/path)`` pairs as a table: rule, rule_host, rule_path, rule_verdict."""
    table = spark.createDataFrame(rules, "rule_verdict string, rule string")
    cut = F.instr("rule", "/")
    return table.select("rule_verdict", "rule", F.expr("substring(rule, 1, instr(rule, '/') - 1)").alias("rule_host"), F.expr("substring(rule, instr(rule, '/'))").alias("rule_path")).filter(cut > 0)


def buckets(host: Column, path: Column) -> Column:
    """Buckets of all character n-grams of ``^host|path$``."""
    text = F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))
    grams = [
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))),
            lambda i, n=n: F.pmod(F.xxhash64(F.substring(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"),
        )
        for n in GRAMS
    ]
    return F.concat(*grams)


def _weights(values: list[float]) -> Column:
    """The weights as one constant array."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def score(features: Column, weights: Column, bias: float) -> Column:
    total = F.aggregate(features, F.lit(0.0), lambda acc, b: acc + F.get(weights, b))
    return 1.0 / (1.0 + F.exp(-(F.lit(bias) + total / F.sqrt(F.size(features).cast("double")))))


def train(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights and bias from ``url`` and ``blocked`` (0 or 1), at most ``MOST_LABELLED`` rows of it by hash of the url."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.filter(F.col("blocked").isNotNull()).orderBy(F.xxhash64("url"), "url").limit(MOST_LABELLED)
    rows = rows.select(buckets(host, path).alias("features"), F.col("blocked").cast("double").alias("y")).cache()
    weights, bias, n = [0.0] * BUCKETS, 0.0, rows.count()
    pace, bias_pace = [0.0] * BUCKETS, 0.0
    for _ in range(STEPS if n else 0):
        error = rows.select("features", (score(F.col("features"), _weights(weights), bias) - F.col("y")).alias("e"))
        share = (F.col("e") / F.sqrt(F.size("features").cast("double"))).alias("share")
        slope = error.select(F.explode(F.concat("features", F.array(F.lit(-1)))).alias("bucket"), share, "e")
        sums = slope.groupBy("bucket").agg(F.sum("share").alias("g"), F.sum("e").alias("e")).collect()
        slopes = {row["bucket"]: row["e" if row["bucket"] < 0 else "g"] / n for row in sums}
        pace = [MOMENTUM * v + slopes.get(i, 0.0) for i, v in enumerate(pace)]
        bias_pace = MOMENTUM * bias_pace + slopes.get(-1, 0.0) / 4
        weights = [w * (1 - RATE * DECAY) - RATE * v for w, v in zip(weights, pace, strict=True)]
        bias -= RATE * bias_pace
    rows.unpersist()
    return weights, bias


def judge(pages: DataFrame, rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, host, path, rule (or null), verdict and the model's score of every page."""
    weights, bias = train(labelled)
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = (
        urls.select("host").distinct()
        .select("host", F.explode(domains(F.col("host"))).alias("rule_host"))
        .join(rules, "rule_host")
        .groupBy("host")
        .agg(F.collect_set(F.struct((-F.length("rule")).alias("shortness"), "rule", "rule_path", "rule_verdict")).alias("rules"))
    )
    # The model reads each url where it is scanned; only its score goes through the join by host, so a hot host costs no scoring.
    p = score(buckets(F.col("host"), F.col("path")), _weights(weights), bias)
    urls = urls.withColumn("score", p).join(known, "host", "left")
    fits = F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"]))
    urls = urls.withColumn("best", F.array_min(fits))
    return urls.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "score",
    )
