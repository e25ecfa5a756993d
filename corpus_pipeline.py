"""The corpus pipeline: toxic documents, exact copies and near copies go, sources are mixed, the rest is tokenized.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver of the stages writes each result and reads
it again as the next one's docs. All but the last keep the columns of documents.

In every stage null texts count as empty, texts are read whole however long they are, repeated rows are rows of their own
unless the stage says otherwise, other columns go along whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from estatelens.llm import exact_dedup, mixing, near_dedup, sentencepiece_codec, toxicity
from estatelens.llm.common import Workspace
from estatelens.llm.queries import tokenizer


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; labels are learnt from their training rows only. Empty texts and null ids are judged alike and stay."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the least doc_id stays, null ids coming last; of rows repeated with one id, one."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: five words a shingle, similarity 0.8 or more. Texts without words and null ids stay."""
    return near_dedup.drop_near_duplicates(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that words of a document are taken into the mix; documents without words stay as they are, a null source is the last one."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, whether they decode to its text, and the digest of what they decode to; empty texts have no tokens."""
    return sentencepiece_codec.encode(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("sentencepiece", tokenize),
]
#: The toxicity model and the tokenizer are beyond SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again."""
    space = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = space.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
