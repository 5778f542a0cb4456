"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of documents.  Lists of kept or dropped rows grow with the input, so
they are joined by sorting at every size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.bpe import bpe_round_trip
from seqloom.llm.decontaminate import find_leaks
from seqloom.llm.jaccard_join import jaccard_components
from seqloom.llm.line_dedup import line_dedup
from seqloom.llm.quality_rules import quality_rules
from seqloom.plans.scratch import materialize

#: The verdict's cutoffs depend on exact binomial bounds and the chunks of one
#: stage on the texts of the one before; SQL cannot express the whole.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or that with underscores before it, which ``docs`` has no column of (names differ in more than case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """With a row key, and its name: the same for rows with equal doc_id and text, never null."""
    key = _free(docs, "row_key")
    text = F.coalesce(F.md5("text"), F.lit("null"))
    return docs.withColumn(key, F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text))), key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the calibrated rules go."""
    keyed, key = _keyed(docs)
    verdicts = quality_rules(keyed, spark.read.parquet(f"{sf_dir}/labels.parquet"), key_col=key)
    return keyed.join(verdicts.where("kept").select(key).distinct().hint("merge"), key, "left_semi").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go, then what is left of repeated passages of two lines or more; so do documents of which nothing but blanks is left by that."""
    total, before, now = (_free(docs, x) for x in ("lines_total", "lines_before", "lines_now"))
    chunks = materialize(line_dedup(docs, results=(total, before)).drop(total), "chunks_gone")
    reduced = line_dedup(chunks, passages=True, results=(total, now))
    rest = reduced.where((F.col(before) + F.col(now) == 0) | (F.trim(F.translate("text", "\n\r\t", "   ")) != ""))
    return rest.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group stays; of equal rows one stays."""
    keyed, key = _keyed(docs)
    pair = _free(keyed, "pair")
    groups = jaccard_components(keyed.withColumn(pair, F.struct(F.col("doc_id"), F.col(key).alias("row_key"))), id_col=pair)
    chosen = groups.where(F.col(pair) == F.col("component_id")).select(F.col(f"{pair}.row_key").alias(key)).distinct().hint("merge")
    return keyed.join(chosen, key, "left_semi").dropDuplicates([key]).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    keyed, key = _keyed(docs)
    leaks = find_leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    return keyed.join(materialize(leaks.select(key).distinct(), "leaks").hint("merge"), key, "left_anti").select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of them and of the round trip."""
    import public_tokenizers

    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("decontamination", decontamination), ("byte_level_bpe", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
