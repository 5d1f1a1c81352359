"""The corpus pipeline: five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.  Stages judge rows,
not ids: rows with a null id, or several texts under one id, are documents of
their own in every stage.  Null texts count as empty.  An empty table gives an
empty table.  Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.llm import jaccard, mixing, packing, quality, scratch, suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Executors hold workers of other stages as well, so the Jaccard join gets half of its usual ranges.
RANGE_TOKENS = jaccard.RANGE_TOKENS // 2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the distribution-divergence rules keep; repeated rows go or stay together, null and empty texts go."""
    return quality.kept_rows(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row, of the smallest id; rows with a null id or without words all stay."""
    return jaccard.one_of_each(docs.select(*COLUMNS), range_tokens=RANGE_TOKENS)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 50 bytes that earlier ones hold; those with nothing left are dropped.

    A cut inside a character takes the rest of that character with it.  Rows
    with a null id stay as they are, rows of one id are cut each by itself, and
    a text that isn't cut stays as it is, null or empty ones too.
    """
    cut = suffix_dedup.deduplicate_substrings(docs.select(*COLUMNS), with_text=True, keep=("text", "lang", "source", "n_chars"))
    # bytes of characters that were cut through don't decode and go
    rest = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\ufffd", "")
    was_cut = F.col("n_removed") > 0
    out = cut.select("doc_id", was_cut.alias("was_cut"), F.when(was_cut, rest).otherwise(F.col("text")).alias("text"), "lang", "source", "n_chars").where("NOT was_cut OR text <> ''")
    return out.withColumn("n_chars", F.when(F.col("was_cut"), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weights 1, 2, 3: a row for every turn in which words of a document are taken."""
    return mixing.mix_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed texts, packed into sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_substrings),
    ("mixing to target weights", target_mix),
    ("best-fit packing", packed_sequences),
]

#: Signature trees, suffix sorting and bin completion are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch.dropping(spark) as kept:
            docs = scratch.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
