"""Files as tables: directory scans, git snapshots and changed files, manifests and configuration."""

from __future__ import annotations

import re
import subprocess
import tomllib
from dataclasses import dataclass, field
from fnmatch import translate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.idents import language

FILES = "path string, lang string, source string, sha256 string"


@dataclass(frozen=True)
class Config:
    """What is scanned; unknown keys are an error."""

    roots: tuple[str, ...] = (".",)
    exclude: tuple[str, ...] = ()
    languages: tuple[str, ...] = ("rust", "python", "typescript", "tsx", "go")
    extra: dict = field(default_factory=dict)


def load_config(text: str) -> Config:
    data = tomllib.loads(text)
    unknown = set(data) - {"roots", "exclude", "languages", "extra"}
    if unknown:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    out = Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})
    if any(r.startswith("/") or ".." in r.split("/") for r in out.roots):
        raise ValueError("roots must stay inside the project")
    return out


def normalized_path(path):
    """A relative path without ./ and double slashes; one that leaves the project is null."""
    p = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/"), r"^(\./)+", "")
    return F.when(F.startswith(p, F.lit("/")) | F.exists(F.split(p, "/"), lambda s: s == ".."), None).otherwise(p)


def as_files(rows: DataFrame) -> DataFrame:
    """files (path, lang, source, sha256) of rows (path, content: binary); bytes that aren't UTF-8 fail the scan as a whole."""
    out = rows.withColumn("lang", language(F.col("path"))).where("lang is not null")
    ok = F.is_valid_utf8(F.col("content").cast("string"))
    source = F.when(ok, F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "path")).cast("string"))
    return out.select("path", "lang", source.alias("source"), F.sha2("content", 256).alias("sha256"))


def scan(spark: SparkSession, root: str, config: Config = Config()) -> DataFrame:
    """The source files below the configured roots, read by Spark, without what is excluded, by path relative to root."""
    paths = [root if r == "." else f"{root.rstrip('/')}/{r}" for r in config.roots]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{rs,py,ts,mts,cts,tsx,go}").load(paths)
    base = re.escape(re.sub(r"^\w+:/*", "/", root).rstrip("/"))
    rows = raw.select(F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), f"^{base}/", "").alias("path"), "content")
    for glob in config.exclude:
        rows = rows.where(~F.regexp_like("path", F.lit("^" + translate(glob).replace("\\Z", "$").replace("\\z", "$"))))
    out = as_files(rows)
    return out.where(F.col("lang").isin(*config.languages)).dropDuplicates(["path"])


def git(root: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, timeout=120).stdout


def snapshot(spark: SparkSession, root: str, ref: str, config: Config = Config()) -> DataFrame:
    """The source files of a commit."""
    names = [n for n in git(root, "ls-tree", "-r", "--name-only", "-z", ref).decode().split("\0") if re.search(r"\.(rs|py|ts|mts|cts|tsx|go)$", n)]
    rows = spark.createDataFrame([(n, bytearray(git(root, "show", f"{ref}:{n}"))) for n in names], "path string, content binary")
    for glob in config.exclude:
        rows = rows.where(~F.regexp_like("path", F.lit("^" + translate(glob).replace("\\Z", "$").replace("\\z", "$"))))
    return as_files(rows)


def changed_files(spark: SparkSession, root: str) -> DataFrame:
    """(path): staged, changed and untracked files, each once."""
    found: list[str] = []
    for args in (("diff", "--cached", "--name-only", "-z"), ("diff", "--name-only", "-z"), ("ls-files", "--others", "--exclude-standard", "-z")):
        found += [n for n in git(root, *args).decode().split("\0") if n]
    return spark.createDataFrame([(n,) for n in dict.fromkeys(found)], "path string").where(language(F.col("path")).isNotNull())


def cargo_binaries(text: str) -> dict[str, str]:
    """{target: path} of a package's binaries."""
    data = tomllib.loads(text)
    return {b["name"]: b.get("path", f"src/bin/{b['name']}.rs") for b in data.get("bin", []) if "name" in b}


def cargo_name(text: str) -> str | None:
    return tomllib.loads(text).get("package", {}).get("name")


def go_module(text: str) -> str | None:
    m = re.search(r"^\s*module\s+(\S+)", text, re.MULTILINE)
    return m[1].strip('"') if m else None
