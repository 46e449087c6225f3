"""From documents to training batches: toxic, copied and contaminated documents go, personal data is masked, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import decontaminate, neardup, packing, pii, toxicity
from tidewatch.llm.common import stored
from tidewatch.sources.tables import table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id stays."""
    return neardup.keep_one(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of which one word in twenty or more is inside a benchmark window."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the new text."""
    clean = pii.redact(docs)
    return clean.selectExpr(*[f"cast(length(text) as {kind}) as n_chars" if c == "n_chars" else f"`{c}`" for c, kind in docs.dtypes])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences, their length buckets and batches."""
    return packing.packed(docs)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("contamination", contaminated), ("personal_data", personal_data), ("packing", packed)]

#: The first two stages are a learnt model and an iterative join: SQL does not express them, the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
