"""Texts as files and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.text import lines_of

# fixed values: languages by extension, and folders that are not examined
LANGUAGE_BY_SUFFIX = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".html": "html", ".htm": "html", ".java": "java", ".go": "go", ".md": "markdown", ".yml": "yaml", ".yaml": "yaml", ".json": "json"}
EXCLUDED_FOLDERS = ("node_modules", ".git", "dist", "build", "__pycache__", ".venv", "venv")
MAX_FILE_BYTES = 8 * 1024 * 1024
GIANT_LINE = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def language_of(path: Column, given: Column | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGE_BY_SUFFIX.items() for x in kv])
    guessed = known[suffix(path)]
    return guessed if given is None else F.coalesce(given, guessed)


def spread(files: DataFrame) -> DataFrame:
    """The frame as its files split, or dealt anew where they give fewer tasks than there are cores: large inputs are never moved."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files if files.rdd.getNumPartitions() >= cores else files.repartition(cores)


def looks_binary(content: Column) -> Column:
    """A zero byte among the first 4,096."""
    return F.locate("\0", F.decode(F.substring(content, 1, 4096), "ISO-8859-1")) > 0


def looks_minified(text: Column) -> Column:
    """1,000 characters or more, and few very long lines or a median line of 400 or more; data URIs don't count."""
    plain = F.regexp_replace(text, r"data:[a-z/+.-]+;base64,[A-Za-z0-9+/=]+", "")
    sizes = F.array_sort(F.transform(F.split(plain, r"\r\n|\r|\n"), F.length))
    n = F.size(sizes)
    return (F.length(plain) >= 1000) & (((n <= 5) & (F.element_at(sizes, -1) >= 2000)) | (F.element_at(sizes, F.floor(n / 2).cast("int") + 1) >= 400))


def read_files(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(files, skipped) of a folder: every file is in one of the two, the skipped with a reason."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "content")
    folders = F.split(F.col("path"), "/")
    reason = (
        F.when(F.exists(folders, lambda x: x.isin(*EXCLUDED_FOLDERS)), "excluded folder")
        .when(F.col("length") > MAX_FILE_BYTES, "too large")
        .when(~suffix(F.col("path")).isin(*LANGUAGE_BY_SUFFIX), "kind not examined")
        .when(looks_binary(F.col("content")), "binary")
    )
    judged = raw.withColumn("reason", reason)
    utf8 = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    files = judged.where("reason is null").select("path", language_of(F.col("path")).alias("language"), utf8.alias("text"), F.sha2("content", 256).alias("sha256"))
    return files, judged.where("reason is not null").select("path", "reason")


def tree_hash(files: DataFrame) -> DataFrame:
    """One hash of all (path, sha256): of each path's row first, so no row is ever gathered whole in one string."""
    pieces = files.select(F.substring("sha256", 1, 2).alias("shard"), F.concat("path", F.lit("\0"), "sha256").alias("row"))
    shards = pieces.groupBy("shard").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2("row", 256))), "\n"), 256).alias("digest"))
    return shards.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "shard", "digest"))), "\n"), 256).alias("tree_hash"))


def documents_as_files(docs: DataFrame) -> DataFrame:
    """documents as files of no programming language, their path by source and id."""
    return docs.select(F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat(F.lit("doc"), F.col("doc_id").cast("string"))).alias("path"), F.lit(None).cast("string").alias("language"), "text", "doc_id", "source", "lang")


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """keep, line_no from 1, line; the text itself does not ride along."""
    return files.select(*keep, F.posexplode(lines_of(F.col("text"))).alias("at", "line")).select(*keep, (F.col("at") + 1).alias("line_no"), "line")


def script_view(html: Column) -> Column:
    """Only the bodies of script elements, all else blanked to its line feeds, so line numbers stand."""
    parts = F.split(html, r"(?i)(?<=<script[^>]{0,200}>)|(?=</script>)")
    blank = lambda x: F.regexp_replace(x, r"[^\n]", "")
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, x).otherwise(blank(x))), "")
