"""The corpus pipeline: from ``documents`` to encoded text in five stages.

Each stage reads what the one before wrote. All but the last return the columns
of documents, less the rows they reject; other columns of the input are left out.

Defined results, by stage: null and empty texts have no language and go in the first
stage; handed to a later one, they count as empty texts, which are copies of each
other and hold no benchmark passage. Null ids are kept by all stages but where a copy
with an id stays instead. Repeated rows are exact copies. Of ties, the least id stays.
Texts of any length are taken whole. Empty tables pass through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, exact_dedup, language_id, pieces, simhash
from graphloom.session import materialize, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without any letter or text, which have no language.

    All others are in a learned language, or stay if no row has a label.
    """
    return language_id.keep_identified(docs.select(COLUMNS))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first of the documents with equal texts, white space aside; a null id comes last."""
    return exact_dedup.keep_first(docs.select(COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near copies by five-word shingles, and those with a null id."""
    return simhash.keep_one(docs.select(COLUMNS), groups=simhash.near_groups)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage; items of under 6 tokens are left out of account."""
    return decontaminate.drop_contaminated(docs.select(COLUMNS), read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with their number and checksum; null texts have null ids."""
    ids = pieces.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))
    return ids.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("encode", encode),
]

# The language and encoding stages have no SQL form; tests hold the result
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
