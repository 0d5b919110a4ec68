"""Ranked search over rules, and precision of rules over their examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.detect import first_match
from riskloom.ranks import SEVERITY, rank
from riskloom.rules.cards import RULES, SYNONYMS, Rule

# fixed values: what a term's hit is worth by field, and a synonym's share
TITLE, ID, TAG, BODY_MOST, SYNONYM = 10.0, 6.0, 3.0, 5, 0.4


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return spark.createDataFrame([(r.id, r.title, r.category, r.severity, r.status, list(r.tags), " ".join((*r.patterns, *r.positives)), r.review_due) for r in rules], "id string, title string, category string, severity string, status string, tags array<string>, body string, review_due string")


def expanded(query: str) -> list[tuple[str, float]]:
    terms = [t for t in query.lower().split() if t]
    return [(t, 1.0) for t in terms] + [(s, SYNONYM) for t in terms for s in SYNONYMS.get(t, ()) if s not in terms]


def search(rules: DataFrame, query: str, limit: int = 10, severity_min: str = "low") -> DataFrame:
    """Rules by weighted term score, ties by id."""
    total = F.lit(0.0)
    for term, weight in expanded(query):
        t = F.lit(term)
        body = F.floor((F.length("body") - F.length(F.replace(F.lower("body"), t, F.lit("")))) / F.length(t))
        own = F.when(F.contains(F.lower("title"), t), TITLE).otherwise(0.0) + F.when(F.contains(F.lower("id"), t), ID).otherwise(0.0)
        own = own + TAG * F.size(F.filter("tags", lambda x: F.contains(x, t))) + F.least(body, F.lit(BODY_MOST))
        total = total + own * weight
    scored = rules.where((rank(SEVERITY, "severity") >= SEVERITY[severity_min]) & (F.col("status") != "deprecated")).withColumn("score", F.round(total, 6))
    return scored.where("score > 0").orderBy(F.col("score").desc(), "id").limit(limit).select("id", "score")


def example_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    rows = [(r.id, text, fire) for r in rules for texts, fire in ((r.positives, True), (r.negatives, False)) for text in texts]
    return spark.createDataFrame(rows, "rule_id string, line string, expect boolean")


def evaluated(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rule_id, tp, fp, tn, fn, precision, recall, f1 over the rules' own examples; null where a ratio has no ground."""
    fired = F.lit(False)
    for r in rules:
        fired = F.when(F.col("rule_id") == r.id, first_match(F.col("line"), r).isNotNull()).otherwise(fired)
    own = example_table(spark, rules).withColumn("fired", fired)
    counts = own.groupBy("rule_id").agg(*[F.count_if((F.col("expect") == e) & (F.col("fired") == f)).alias(n) for n, e, f in (("tp", True, True), ("fp", False, True), ("tn", False, False), ("fn", True, False))])
    precision, recall = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def covering_pairs(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Pairs of rules of one category, without a group in common, where one fires on all of the other's positives."""
    pairs = [(a.id, b.id, t) for a in rules for b in rules if a.id < b.id and a.category == b.category and not (a.group and a.group == b.group) for t in b.positives]
    fired = F.lit(False)
    for r in rules:
        fired = F.when(F.col("a") == r.id, first_match(F.col("line"), r).isNotNull()).otherwise(fired)
    own = spark.createDataFrame(pairs, "a string, b string, line string").withColumn("fired", fired)
    return own.groupBy("a", "b").agg(F.bool_and("fired").alias("covers")).where("covers").select("a", "b")
