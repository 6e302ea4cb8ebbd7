"""The corpus pipeline: documents in, packed training sequences out.

Five stages, each a function of (spark, docs, sf_dir) whose result is written as
Parquet and read again as the next one's docs: documents that the quality
ranking rejects go, repeated lines go, one document of each group of
near-duplicates stays, sources are mixed to target weights (documents go or are
repeated), and what is left is packed into windows.  All stages but the last
return the columns of documents.

Defined cases, the same in all stages: a null text is an empty one; a null id is
a document of its own; rows that repeat an id and a text are treated alike, ids
with several texts are one document to the near-duplicate stage alone; ties go to
the smaller id; a very long text is handled whole, one to a batch; columns beside
those of documents are passed on, whatever they are called; an empty table gives
an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import lines, minhash, mixing, packing, quality
from pagewright.llm.common import materialize

#: A line class loses its later occurrences from this many occurrences on, as in op6.
LINE_REPEATS = 2
NEAR_PERCENT = 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at or above the fitted threshold of the pairwise ranking."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines, up to small edits, stay where they come first."""
    return lines.drop_repeated_lines(docs, repeats=LINE_REPEATS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 percent of its shingles."""
    return minhash.drop_near_duplicates(docs, NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.mix_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 4096 tokens."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality", keep_quality),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixture", mix_sources),
    ("packing", pack_windows),
]

#: The ranking's fit, the signatures and the packing aren't expressible in SQL;
#: tests/llm holds the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
