"""Feeds from a landing folder: exploited vulnerabilities, scores, base scores, advisories, notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = "struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string,limit:string>>>"
OSV = f"id string, summary string, modified string, aliases array<string>, severity array<struct<type:string,score:string>>, database_specific struct<severity:string>, references array<struct<type:string,url:string>>, affected array<struct<package:struct<name:string,ecosystem:string>,versions:array<string>,ranges:array<{RANGE}>>>"
#: A feed is stale after so many days; less than this share of the rows before is a broken delivery.
MAX_AGE_DAYS, KEEP_SHARE = 2, 0.8


def kev(spark: SparkSession, path: str) -> DataFrame:
    item = "struct<cveID:string,vendorProject:string,product:string,vulnerabilityName:string,dateAdded:string,shortDescription:string,requiredAction:string,dueDate:string,knownRansomwareCampaignUse:string,cwes:array<string>>"
    raw = spark.read.option("multiLine", "true").schema(f"vulnerabilities array<{item}>").json(path)
    return raw.select(F.explode("vulnerabilities").alias("v")).select("v.*").withColumn("dateAdded", F.to_date("dateAdded")).withColumn("dueDate", F.to_date("dueDate"))


def epss(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("multiLine", "true").schema("data array<struct<cve:string,epss:string,percentile:string,date:string>>").json(path)
    return raw.select(F.explode("data").alias("d")).select("d.cve", F.col("d.epss").cast("double").alias("epss"), F.col("d.percentile").cast("double").alias("percentile"), F.to_date("d.date").alias("date"))


def primary_metric(metrics: Column) -> Column:
    """The primary metric, else the first."""
    return F.coalesce(F.get(F.filter(metrics, lambda m: m["type"] == "Primary"), F.lit(0)), F.get(metrics, F.lit(0)))


def nvd(spark: SparkSession, path: str) -> DataFrame:
    metric = "struct<type:string,source:string,cvssData:struct<baseScore:double,baseSeverity:string>>"
    cve = f"struct<id:string,published:string,lastModified:string,vulnStatus:string,metrics:struct<cvssMetricV31:array<{metric}>>>"
    raw = spark.read.option("multiLine", "true").schema(f"vulnerabilities array<struct<cve:{cve}>>").json(path)
    own = raw.select(F.explode("vulnerabilities").alias("v")).select("v.cve.*").withColumn("m", primary_metric(F.col("metrics.cvssMetricV31")))
    return own.select("id", "published", "lastModified", "vulnStatus", F.col("m.cvssData.baseScore").alias("cvss31_base_score"), F.col("m.cvssData.baseSeverity").alias("cvss31_severity"), F.col("m.source").alias("cvss31_source"))


def osv(spark: SparkSession, path: str) -> DataFrame:
    """Advisories in the shape the package operators read, withdrawn fields dropped, four references by kind."""
    raw = spark.read.schema(OSV).json(path)
    kinds = F.array(*[F.lit(x) for x in ("ADVISORY", "FIX", "REPORT", "WEB")])
    refs = F.slice(F.array_sort(F.transform("references", lambda r: F.struct(F.when(F.array_position(kinds, r["type"]) > 0, F.array_position(kinds, r["type"])).otherwise(9).alias("k"), r["url"].alias("url")))), 1, 4)
    affected = F.transform("affected", lambda a: F.struct(a["package"]["name"].alias("name"), a["package"]["ecosystem"].alias("ecosystem"), a["versions"].alias("versions"), F.filter(a["ranges"], lambda r: r["type"].isin("SEMVER", "ECOSYSTEM")).alias("ranges")))
    return raw.select("id", "summary", "modified", "aliases", F.upper("database_specific.severity").alias("severity"), refs["url"].alias("references"), affected.alias("affected"))


def notices(spark: SparkSession, path: str) -> DataFrame:
    """RSS items with the CVE and CWE ids their text names; a feed with a document type declaration is refused."""
    raw = spark.read.text(path, wholetext=True).where(~F.col("value").rlike("(?i)<!DOCTYPE"))
    item = raw.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))).alias("x"))
    tag = lambda t: F.trim(F.regexp_replace(F.regexp_extract("x", rf"(?s)<{t}>(.*?)</{t}>", 1), r"^<!\[CDATA\[|\]\]>$", ""))
    ids = lambda p: F.array_distinct(F.regexp_extract_all("x", F.lit(p), F.lit(1)))
    return item.select(tag("link").alias("link"), tag("title").alias("title"), tag("description").alias("summary"), tag("pubDate").alias("published_at"), ids(r"(CVE-\d{4}-\d{4,})").alias("cve_ids"), ids(r"(CWE-\d+)").alias("cwe_ids"))


def delivery_problems(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Groups whose rows shrank below the share kept, gone ones included: a delivery to refuse."""
    old, new = before.groupBy(by).agg(F.count("*").alias("n_before")), after.groupBy(by).agg(F.count("*").alias("n_after"))
    return old.join(new, by, "left").withColumn("n_after", F.coalesce("n_after", F.lit(0))).where(F.col("n_after") < KEEP_SHARE * F.col("n_before"))


def source_state(sources: DataFrame, today: Column) -> DataFrame:
    """source, n, newest and whether it is stale. rows: source, fetched_on."""
    return sources.groupBy("source").agg(F.count("*").alias("n"), F.min("fetched_on").alias("oldest"), F.max("fetched_on").alias("newest")).withColumn("stale", F.datediff(today, F.col("newest")) > MAX_AGE_DAYS)
