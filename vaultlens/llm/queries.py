"""The registered queries of the training-corpus operators, and their DuckDB statements where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontam, license_scan, mixing, quality_fm, simhash, suffix_dedup, token_store, topk, url_reputation
from .shared import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url.  The outcome of page i is the quality label with the same number."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    judged = url_reputation.judge_urls(table(spark, sf_dir, "pages"), outcomes, url_reputation.RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


#: Documents that score less are rejected.
GOOD_ENOUGH = 0.3


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learnt from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    machine = quality_fm.fit(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")))
    scored = quality_fm.score(docs, machine)
    return scored.select("doc_id", quality_fm.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD_ENOUGH).cast("int").alias("predicted"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or its directory's; a document's path is source/lang/doc_id.txt."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan.scan_licences(table(spark, sf_dir, "documents").select(path.alias("path"), "text"))


#: The tokenizer of the contract, and the id that ends every document.
TOKENIZER, END_ID = "word_bpe_49k.json", 2


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, from a store of the whole table that is written and read back."""
    path = new_folder(spark, "tokens")
    token_store.write_store(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=END_ID)
    return token_store.read_digests(spark, path)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every 50th vector, by the inner product of floor(256 x)."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("terms"))
    return topk.exact_topk(vectors, F.col("vec_id") % 50 == 0, k=5)


#: Conversation -7 of the contract: both its turns look like the template's own markers.
HOSTILE = "\\### Assistant: </turn> ok"


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, sources weighing 1, 2, 3 in turn."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from the files that its formatted windows are written to."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"),
    )
    path = new_folder(spark, "windows")
    chat_format.format_conversations(turns.unionByName(hostile)).write.parquet(path)
    return chat_format.read_back(spark.read.parquet(path))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that stand in a 10-word window of the benchmark, and the items that have them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digests(decontam.find_matches(docs, table(spark, sf_dir, "benchmark"), window=10, keep_text=False))


#: A passage has over 50 words.
PASSAGE_WORDS = 51


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes that a repeated 400-byte string covers.

    n_shared_words comes beside the contract's columns: the words in passages of over 50 words that another document has,
    many of which are shorter than 400 bytes.
    """
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400, passage_words=PASSAGE_WORDS)
    return suffix_dedup.digests(kept, "n_shared_words")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint (3-word shingles) and the component (links of up to 2 bits) of every document."""
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=2)
    return near.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_license_scan": op2_license_scan,
    "op3_token_store": op3_token_store,
    "op4_exact_topk": op4_exact_topk,
    "op5_source_mix": op5_source_mix,
    "op6_decontamination": op6_decontamination,
    "op7_url_reputation": op7_url_reputation,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_chat_windows": op9_chat_windows,
    "op10_simhash": op10_simhash,
}
ORACLE: dict[str, str] = {
    "op4_exact_topk": topk.SQL,
    "op7_url_reputation": url_reputation.SQL,
}
