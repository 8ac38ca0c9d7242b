"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule fits.

The trees (Spark ML) are trained on URLs that rules have labelled: a sample of TRAIN_ROWS at most, the first by hash. Features:
length, host and path depth, digit ratio, character entropy, number of parameters, and how often the host's suffixes, and the last of
them with the first part of the path, were blocked in the sample (smoothed). In training, these rates come from the other folds of hosts
only, so that they don't tell a URL's own label. Scoring is one pass over all URLs.

Cases: a null url, or one without ://, has empty host and path, fits no rule and is scored like any other; ties between rules of
equal length go to the smaller rule; without labelled URLs of both kinds the verdict is the one kind there is, else allow; rows
that repeat a page_id are judged each; very long urls are taken whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._base import stored

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 20, 4, 7
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_depth", "path_depth", "digit_ratio", "entropy", "parameters", "suffix_rate", "domain_rate", "section_rate")
SUFFIXES = ("suffix", "domain", "section")


def split_url(rows: DataFrame) -> DataFrame:
    """Adds host and path."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rows = rows.withColumn("rest", F.coalesce(rest, F.lit(""))).withColumn("host", F.regexp_extract("rest", r"^[^/?#]*", 0))
    rows = rows.withColumn("path", F.regexp_extract(F.expr("substring(rest, length(host) + 1)"), r"^[^?#]*", 0))
    return rows.withColumn("host", F.translate("host", UPPER, LOWER)).drop("rest")


def rule_of(rules=RULES) -> Column:
    """The longest rule that fits host and path, else null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        host, path = rule.split("/", 1)
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def verdict_of(rules=RULES) -> Column:
    return F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules], F.lit(None).cast("string"))


def lexical(rows: DataFrame) -> DataFrame:
    """Adds the features that need no training."""
    u = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    shares = F.transform(F.array_distinct(F.split(u, "")), lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n)
    entropy = F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    count = lambda col, c: (F.length(col) - F.length(F.translate(col, c, ""))).cast("double")
    return (
        rows.withColumn("length", F.length(u).cast("double"))
        .withColumn("host_depth", count(F.col("host"), "."))
        .withColumn("path_depth", count(F.col("path"), "/"))
        .withColumn("digit_ratio", count(u, "0123456789") / n)
        .withColumn("entropy", entropy)
        .withColumn("parameters", count(u, "&?"))
        .withColumn("suffix", F.substring_index("host", ".", -1))
        .withColumn("domain", F.substring_index("host", ".", -2))
        .withColumn("section", F.concat_ws("/", "suffix", F.regexp_extract("path", "^/([^/]*)", 1)))
    )


def _rate(blocked: Column, count: Column) -> Column:
    return (blocked + 1.0) / (count + 2.0)


def _with_rates(rows: DataFrame, rates: dict[str, DataFrame]) -> DataFrame:
    for key, table in rates.items():  # at most TRAIN_ROWS rows each
        on = [key, "fold"] if "fold" in table.columns else key
        rows = rows.join(F.broadcast(table), on, "left").withColumn(f"{key}_rate", F.coalesce(f"{key}_rate", F.lit(0.5)))
    return rows


class Trees:
    """Fitted on labelled URLs (url, host, path, label: 1.0 blocked), a bounded sample; None of a kind: a constant."""

    def __init__(self, sample: DataFrame):
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler

        sample = stored(lexical(sample).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS))))
        kinds = {r["label"] for r in sample.select("label").distinct().collect()}
        self.constant = None if len(kinds) == 2 else float(kinds == {1.0})
        if self.constant is not None:
            return
        self.rates, others = {}, {}
        for key in SUFFIXES:
            by = sample.groupBy(key, "fold").agg(F.sum("label").alias("b"), F.count(F.lit(1)).alias("c"))
            whole = by.groupBy(key).agg(F.sum("b").alias("b_all"), F.sum("c").alias("c_all"))
            self.rates[key] = stored(whole.select(key, _rate(F.col("b_all"), F.col("c_all")).alias(f"{key}_rate")))
            others[key] = by.join(whole, key).select(key, "fold", _rate(F.col("b_all") - F.col("b"), F.col("c_all") - F.col("c")).alias(f"{key}_rate"))
        self.vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        train = self.vector.transform(_with_rates(sample.coalesce(2), others)).select("features", "label")
        self.model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=64, seed=SEED).fit(train)

    def scored(self, rows: DataFrame) -> DataFrame:
        """Adds score (of being blocked) to rows with url, host and path."""
        from pyspark.ml.functions import vector_to_array

        if self.constant is not None:
            return rows.withColumn("score", F.lit(self.constant))
        return self.model.transform(self.vector.transform(_with_rates(lexical(rows), self.rates))).withColumn("score", vector_to_array("probability")[1])


def url_filter(pages: DataFrame, rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, url, host, path, rule, score (of being blocked), verdict."""
    rows = split_url(pages.select("page_id", "url")).withColumn("rule", rule_of(rules)).withColumn("ruled", verdict_of(rules))
    labelled = rows.filter(F.col("ruled").isNotNull()).withColumn("label", (F.col("ruled") == "block").cast("double"))
    trees = Trees(labelled.orderBy(F.xxhash64("url"), "page_id").limit(train_rows))
    own = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return trees.scored(rows).select("page_id", "url", "host", "path", "rule", "score", F.coalesce("ruled", own).alias("verdict"))


def query(spark, sf_dir):
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
