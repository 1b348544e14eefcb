"""Source trees as tables: listing, filters, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import path_filter
from ..operators.extract import LANGUAGES

MAX_BYTES = 1 << 20
# Names of files that hold secrets and are never read.
SENSITIVE = r"(^|/)\.env($|\.|/)|(^|/)(id_(rsa|dsa|ecdsa|ed25519)|identity)$|\.(pem|key|p8|p12|pfx|jks|keystore)$|(^|/)(\.npmrc|\.netrc|\.pypirc|credentials)$"
# Words that mark a file as one of secrets, between dots, dashes and underscores of its name.
SECRET_WORDS = ("secret", "secrets", "credential", "credentials", "apikey", "api_key", "api.key", "api-key", "privatekey", "private_key", "private.key", "private-key")
SKIP_DIRS = r"(^|/)(\.git|node_modules|__pycache__|\.venv|vendor|dist|build|target)/"


def sensitive(path: Column) -> Column:
    """Whether a file holds secrets, by its name."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    padded = F.concat(F.lit("."), F.regexp_replace(name, "[-_]", "."), F.lit("."))
    words = sorted({w.replace("_", ".").replace("-", ".") for w in SECRET_WORDS})
    named = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(padded, F.concat(F.lit("."), w, F.lit("."))))
    return F.lower(path).rlike(SENSITIVE) | named


def skip_reason(path: Column, size: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(sensitive(path), "sensitive").when(path.rlike(SKIP_DIRS), "ignored").when(~extension.isin(*LANGUAGES), "language").when(size > MAX_BYTES, "size")


def scan(spark: SparkSession, root: str, include=(), exclude=()) -> DataFrame:
    """(path, size, modified_at, content, content_hash, skip_reason) of the files below ``root``.

    Whether a file is skipped is decided by its path and size; the contents of such files are neither returned nor
    hashed.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.expr(f"substring(path, instr(path, '{base}') + {len(base) + 1})")
    rows = raw.select(path.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_at"), "content")
    rows = rows.withColumn("skip_reason", skip_reason(F.col("path"), F.col("size")))
    kept = F.col("skip_reason").isNull()
    rows = rows.withColumn("content_hash", F.when(kept, F.sha2("content", 256))).withColumn("content", F.when(kept, F.decode("content", "UTF-8")))
    return rows.where(path_filter(F.col("path"), list(include), list(exclude)))


def scan_stats(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce("skip_reason", F.lit("read")).alias("reason")).agg(F.count("*").alias("n"))
