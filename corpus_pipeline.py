"""Corpus pipeline over ``documents``: each stage reads what the one before has kept and written.

1. toxicity: documents that the classifier rejects go.
2. language ID: documents whose language the fused evidence leaves open go.
3. line dedup: of near-equal lines the first stays; texts lose the others.
4. SimHash near-dedup: one document of each group stays.
5. best-fit packing: the token pieces of what is left, in sequences.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunesmith.llm import catalog, language, line_dedup, packing, simhash, toxicity
from tunesmith.llm.features import free_names
from tunesmith.session import materialize, release
from tunesmith.sources.tables import table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go (operator 3); null and empty texts are clean."""
    model = catalog.toxicity_model(spark, docs, sf_dir)
    return toxicity.keep_clean(docs, model, catalog.TOXICITY_BAR)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go (operator 5): no letters, or a posterior under the bar."""
    key = F.md5(F.to_json(F.struct("doc_id", "text", "lang", "source")))
    rows = language.labelled_documents(docs.withColumn("doc_id", key))
    found = language.identify(rows, language.fit(docs))
    name, = free_names(docs.columns, "rejected")
    rejected = materialize(found.where(~F.col("accepted")).select(F.col("id").alias(name)).distinct(), "pipeline-rejected")
    return docs.join(rejected, key == F.col(name), "left_anti")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-equal lines but the first go from the texts (operator 7); n_chars follows the text, null for a null text.

    Ties, repeated rows and empty tables as in ``line_dedup.deduplicate_lines``; further columns stay, whatever their names.
    """
    return line_dedup.deduplicate_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays (operator 4): the first by id (nulls last), then text.

    Null, empty and blank texts are one group, very long texts are read whole; an empty table gives no rows.
    """
    return simhash.keep_one(docs, shingle=catalog.SIMHASH_SHINGLE, max_bits=catalog.SIMHASH_BITS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, packed into sequences (operator 10).

    Null and empty texts are one piece of one token; only longer documents than a sequence are cut; repeated rows
    are packed each; other columns are not read; an empty table gives no rows.
    """
    return packing.pack_documents(docs, catalog.vocabulary(), catalog.SEQUENCE_TOKENS)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", simhash_stage),
    ("best_fit_packing", packing_stage),
]

#: Classifiers, MinHash and BPE have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; what a stage returns is written as Parquet and read again.

    A stage's table goes when the next one is written. For nulls, ties, repeated rows, very long texts, empty tables
    and further columns see the stages; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
            release(before)
    return docs
