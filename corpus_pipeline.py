"""From raw documents to packed training sequences, in five stages.

Each stage reads what the one before it kept, whole: quality rules drop documents, the n-gram
join keeps one document of each component, substring de-duplication cuts repeated passages,
personal data is masked, and packing deals the token ids into sequences. Between stages `run`
writes Parquet to the shared folder. All stages but the last return the columns of documents,
also such as an operator's own columns are named after: they are set aside and come back.

ORACLE_SQL is None: the chosen cutoffs (exact binomial bounds), the field's spans and token ids
are not expressible in SQL; tests hold every stage against a brute-force version instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm import ngram_join, packing, pii, quality_rules, substring_dedup
from quillspark.llm.scratch import Scratch

ORACLE_SQL = None
READ = ("doc_id", "lang", "text")


def _aside(docs: DataFrame) -> DataFrame:
    """Columns that no operator reads get names that clash with none."""
    return docs.select(*[c if c in READ else F.col(c).alias(f"given {k}") for k, c in enumerate(docs.columns)])


def _back(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` under their names, n_chars following the text."""
    name = lambda k, c: F.length("text").cast("long") if c == "n_chars" else F.col(c if c in READ else f"given {k}")
    return df.select(*[name(k, c).alias(c) for k, c in enumerate(docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or a cutoff that the labels show to be safe, go. A null id is judged like any other.
    Texts are measured once and written with their statistics, from which the cutoffs are chosen and the documents judged."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scratch = Scratch(spark)
    measured = scratch.keep(quality_rules.statistics(_aside(docs), keep_text=True))
    cuts = scratch.keep(quality_rules.cutoffs(measured.drop("text"), labels))  # a row per stratum
    kept = quality_rules.judge(measured, cuts).where("kept")
    return kept.select(*[F.col(c if c in READ else f"given {k}").alias(c) for k, c in enumerate(docs.columns)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the least id stays; of repeated ids each row of that one. Null ids stay."""
    gone = ngram_join.join_components(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 13 words or more that an earlier document has are cut; a text without any stays as it is."""
    return _back(substring_dedup.remove_repeats(_aside(docs), tidy=False), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind in angle brackets."""
    return _back(pii.find(_aside(docs), mask=True), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of up to 1024 tokens, as op1_packing returns them."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("pii", personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
