"""Manifests, lockfiles and SBOMs to package rows, on Spark where JSON and regular expressions suffice."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.package import parse_purl

PACKAGE_SCHEMA = "path string, ecosystem string, name string, version string, version_exact boolean, spec string, problem string"
EDGE_SCHEMA = "path string, parent string, child string"

# fixed values: file names and what they hold
FORMATS = {
    "package-lock.json": ("npm", "lock"), "npm-shrinkwrap.json": ("npm", "lock"), "yarn.lock": ("npm", "lock"), "pnpm-lock.yaml": ("npm", "lock"), "package.json": ("npm", "manifest"),
    "poetry.lock": ("pypi", "lock"), "uv.lock": ("pypi", "lock"), "requirements.txt": ("pypi", "manifest"), "pyproject.toml": ("pypi", "manifest"),
}


def classify(name: Column) -> Column:
    """struct(ecosystem, kind) of a file name; null for others."""
    out = F.lit(None).cast("struct<ecosystem:string,kind:string>")
    for file, (eco, kind) in FORMATS.items():
        out = F.when(F.lower(name) == file, F.struct(F.lit(eco).alias("ecosystem"), F.lit(kind).alias("kind"))).otherwise(out)
    return F.when(F.lower(name).rlike(r"^requirements[\w.-]*\.txt$"), F.struct(F.lit("pypi").alias("ecosystem"), F.lit("manifest").alias("kind"))).otherwise(out)


def requirements(files: DataFrame) -> DataFrame:
    """path, name, version, version_exact, spec of requirement lines; comments, options and markers are cut off."""
    line = files.select("path", F.explode(F.split("text", "\r?\n")).alias("raw")).withColumn("line", F.trim(F.regexp_replace("raw", r"(\s*#.*|\s*;.*)$", "")))
    form = r"^([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*((?:===?|[<>!~]=?).*)?$"
    own = line.where(F.col("line").rlike(form)).withColumn("spec", F.trim(F.regexp_extract("line", form, 2)))
    pinned = F.regexp_extract("spec", r"^===?\s*([^,*\s]+)$", 1)
    return own.select("path", F.regexp_extract("line", form, 1).alias("name"), F.when(pinned != "", pinned).alias("version"), (pinned != "").alias("version_exact"), F.when(F.col("spec") != "", F.col("spec")).alias("spec"))


def package_json(files: DataFrame) -> DataFrame:
    """path, name, version, version_exact, spec of all dependency maps of package.json files."""
    maps = "struct<dependencies:map<string,string>,devDependencies:map<string,string>,optionalDependencies:map<string,string>>"
    own = files.withColumn("j", F.from_json("text", maps, {"allowComments": "true"}))
    merged = F.flatten(F.array_compact(F.array(*[F.map_entries(f"j.{k}") for k in ("dependencies", "devDependencies", "optionalDependencies")])))
    one = own.select("path", F.explode(merged).alias("e")).select("path", F.col("e.key").alias("name"), F.col("e.value").alias("spec"))
    exact = F.col("spec").rlike(r"^=?\d+\.\d+\.\d+([-+][0-9A-Za-z.-]+)?$")
    return one.select("path", "name", F.when(exact, F.regexp_replace("spec", "^=", "")).alias("version"), exact.alias("version_exact"), "spec")


def package_lock(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packages, edges) of npm lockfiles v2 and v3; the project's own edges have no parent."""
    entry = "map<string,struct<version:string,resolved:string,integrity:string,hasInstallScript:boolean,link:boolean,dependencies:map<string,string>>>"
    own = files.withColumn("j", F.from_json("text", f"struct<packages:{entry}>"))
    one = own.select("path", F.explode("j.packages").alias("place", "p"))
    name = F.regexp_replace("place", r"^.*node_modules/", "")
    packages = one.where((F.col("place") != "") & ~F.coalesce(F.col("p.link"), F.lit(False))).select("path", name.alias("name"), F.col("p.version").alias("version"), F.lit(True).alias("version_exact"), F.col("p.resolved").alias("resolved"), F.col("p.integrity").isNotNull().alias("has_integrity"), F.coalesce("p.hasInstallScript", F.lit(False)).alias("install_script")).dropDuplicates(["path", "name", "version"])
    edges = one.select("path", F.when(F.col("place") != "", name).alias("parent"), F.explode(F.map_keys("p.dependencies")).alias("child")).distinct()
    return packages, edges


def _toml_rows(name: str, text: str) -> Iterator[tuple]:
    data = tomllib.loads(text)
    if name == "pyproject.toml":
        specs = list(data.get("project", {}).get("dependencies", []))
        for group in data.get("project", {}).get("optional-dependencies", {}).values():
            specs += group
        for spec in specs:
            m = re.match(r"\s*([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*([^;]*)", spec)
            if m:
                pin = re.fullmatch(r"===?\s*([^,*\s]+)", m[2].strip())
                yield m[1], pin[1] if pin else None, bool(pin), m[2].strip() or None
        for dep, spec in data.get("tool", {}).get("poetry", {}).get("dependencies", {}).items():
            if dep.lower() != "python":
                yield dep, None, False, spec if isinstance(spec, str) else None
    else:
        for p in data.get("package", []):
            source = p.get("source", {})
            if not ({"virtual", "editable"} & set(source)):
                yield p["name"], p.get("version"), True, None


def _yarn_rows(text: str) -> Iterator[tuple]:
    for m in re.finditer(r'(?m)^"?((?:@[^/\s"]+/)?[^@\s",]+)@[^\n]*:\n\s+version:?\s+"?([^"\s]+)"?', text):
        if m[1] != "__metadata":
            yield m[1], m[2], True, None


def _pnpm_rows(text: str) -> Iterator[tuple]:
    body = text.split("\npackages:", 1)[-1].split("\nsnapshots:", 1)[0]
    for m in re.finditer(r"(?m)^  '?/?((?:@[^/\s@]+/)?[^/\s@]+)[@/]([0-9][^:\s('_]*)[^:\n]*'?:", body):
        yield m[1], m[2], True, None


def parsed(files: DataFrame) -> DataFrame:
    """Packages of files whose format needs a parser (TOML, yarn, pnpm). files: path, name, text.

    A file that can't be parsed gives one row with its problem, so it is never taken for one without packages.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, name, text in zip(batch.path, batch.name, batch.text, strict=True):
                eco = FORMATS.get(name, ("unknown",))[0]
                try:
                    own = _yarn_rows(text) if name == "yarn.lock" else _pnpm_rows(text) if name == "pnpm-lock.yaml" else _toml_rows(name, text)
                    rows += [(path, eco, *r, None) for r in own]
                except (tomllib.TOMLDecodeError, KeyError, TypeError, AttributeError) as e:
                    rows.append((path, eco, None, None, None, None, f"unreadable: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PACKAGE_SCHEMA.split(", ")])

    return files.select("path", "name", "text").mapInPandas(run, PACKAGE_SCHEMA)


def sbom(files: DataFrame) -> DataFrame:
    """path, ecosystem, name, version, problem of CycloneDX and SPDX components; what lacks a usable purl has a problem."""
    doc = "struct<components:array<struct<name:string,version:string,purl:string>>,packages:array<struct<name:string,versionInfo:string,externalRefs:array<struct<referenceType:string,referenceLocator:string>>>>>"
    own = files.withColumn("j", F.from_json("text", doc))
    cyclone = F.transform(F.coalesce("j.components", F.array()), lambda c: F.struct(c["name"].alias("name"), c["purl"].alias("purl")))
    spdx = F.transform(F.coalesce("j.packages", F.array()), lambda p: F.struct(p["name"].alias("name"), F.get(F.filter(p["externalRefs"], lambda r: r["referenceType"] == "purl"), F.lit(0))["referenceLocator"].alias("purl")))
    one = own.select("path", F.explode(F.concat(cyclone, spdx)).alias("c")).withColumn("p", parse_purl(F.col("c.purl")))
    return one.select("path", "p.ecosystem", F.coalesce("p.name", "c.name").alias("name"), "p.version", F.when(F.col("p").isNull(), "no usable purl").when(F.col("p.version").isNull(), "no version").alias("problem"))


def load_json(text: str):
    """JSON with comments and commas at the end; None where it still can't be read."""
    out, i, quoted = [], 0, False
    while i < len(text):
        c = text[i]
        if quoted:
            out.append(text[i : i + 2] if c == "\\" else c)
            i += 1 + (c == "\\")
            quoted = c != '"'
            continue
        if text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
            continue
        if text.startswith("/*", i):
            i = text.find("*/", i) + 2 if "*/" in text[i:] else len(text)
            continue
        quoted = c == '"'
        out.append(c)
        i += 1
    try:
        return json.loads(re.sub(r",(\s*[}\]])", r"\1", "".join(out)))
    except ValueError:
        return None
