"""The corpus pipeline: five stages from raw documents to a token store.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows to the shared folder and
reads them again as the next one's docs, so a lost executor costs a stage at most.  All but the last return the columns
of documents, and further columns of any name untouched; none of these takes part in a decision, rows are judged each on its
own unless said otherwise, and a table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultlens.llm import decontam, mixing, near_copies, quality_fm, token_store
from vaultlens.llm.queries import END_ID, GOOD_ENOUGH, table, tokenizer_path
from vaultlens.llm.shared import new_folder

#: Near-duplicates: 5-word shingles.  DISTANCE, of the former rule of 3 of 64 bits, is in no use but a test's.
SHINGLE_WORDS, DISTANCE = 5, 3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels that aren't held out, doesn't reject.

    Null and empty texts have a score like any other; equal texts have equal scores; without labels all score 0.5 and stay.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality_fm.keep_good(docs, quality_fm.fit(docs, labels), GOOD_ENOUGH)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingle sets have a Jaccard similarity of 0.8 or more: the one with the least id.

    Texts without words, null ones included, are copies of each other; of repeated rows one stays; rows of one id with
    different texts are documents of their own; rows without id stay.
    """
    return near_copies.keep_first(docs, words=SHINGLE_WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a 10-word window of the benchmark.

    Null and empty texts stay; repeated rows share their fate; without benchmark rows all stay.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Null and empty texts have size 0 and come once for each whole pass over their source; a null source is one of its own,
    the last; ties between documents of a size are drawn by a seeded hash of the id; rows of one id share their fate.
    """
    return mixing.repeat_sources(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, in a store that is written and read back: a row for every row, by doc_id, null first.

    Null and empty texts have the end id alone; repeated rows are stored each.
    """
    path = new_folder(spark, "tokens")
    token_store.write_store(docs, path, tokenizer_path(), end_id=END_ID)
    return token_store.read_digests(spark, path)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("source mix", mix),
    ("token store", tokens),
]

#: Factorisation machines, star contraction and the knapsack aren't SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = new_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
