"""The corpus pipeline: stages over documents, each an operator of tidepool.llm whose decisions take effect.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidepool.llm import packing, quality, secrets, simhash, toxicity
from tidepool.llm.common import save, table
from tidepool.llm.entry import toxicity_model, trusted_ids

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is too high for their language go."""
    return quality.keep(docs, trusted_ids(spark, sf_dir), stored=True)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.keep(docs, *toxicity_model(spark, docs, sf_dir))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share 80 % of their five-word shingles the document with the smallest doc_id stays."""
    return simhash.deduplicate(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its secrets replaced by marks."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: The models and the curve are beyond SQL; tests hold run() against plain Python, stage after stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
