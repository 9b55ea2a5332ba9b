"""Source files as tables: whole texts, digests, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.incremental import root_hash

# Folders that are never read.
PRUNED = ("target", "vendor", ".git", ".jj", ".direnv", ".skeleton")


def is_pruned(path: Column) -> Column:
    return path.rlike("(^|/)(" + "|".join(p.replace(".", r"\.") for p in PRUNED) + ")/")


def read_sources(spark: SparkSession, root: str, glob: str = "*.rs") -> DataFrame:
    """(path, content, size, last_modified) below a folder, pruned folders left out.

    Paths are relative to the folder. Spark's readers skip empty files.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace("path", rf"^.*?\Q{base}\E/", "")
    return raw.select(rel.alias("path"), F.decode("content", "utf-8").alias("content"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("last_modified"), F.sha2("content", 256).alias("content_hash")).where(~is_pruned(F.col("path")))


def fingerprint(files: DataFrame) -> str:
    """A digest of paths and contents."""
    return root_hash(files.select("path", "content_hash")).first()["root"]


def looks_binary(content: Column) -> Column:
    """Any zero byte, or over a tenth control characters."""
    control = F.regexp_count(content, F.lit(r"[\x01-\x08\x0B\x0C\x0E-\x1F]"))
    return content.contains("\0") | (control > F.length(content) / 10)


def read_file(spark: SparkSession, path: str) -> str:
    """A text file's content, or a line that says why there is none."""
    row = spark.read.text(path, wholetext=True).select("value", looks_binary(F.col("value")).alias("b")).first()
    if row is None or row["value"] == "":
        return "(the file is empty)"
    return "(the file is binary)" if row["b"] else row["value"]
