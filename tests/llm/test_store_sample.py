import json

from tokenizers import Tokenizer

from vaultlens.llm import queries, token_store
from vaultlens.llm.shared import new_folder


def written(spark, docs, partitions, tokenizer=None, **options):
    path = new_folder(spark, "sample")
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(partitions)
    token_store.write_store(frame, path, tokenizer or queries.tokenizer_path(), end_id=2, **options)
    return path


def test_sample_is_the_same_in_any_partitioning(spark):
    docs = [(i % 90, f"text {i * i} of some words {i % 7}") for i in range(300)] + [(None, None), (7, ""), (None, "one more")]
    hashes = {spark.read.parquet(f"{written(spark, docs, n, sample_docs=40)}/dictionary").first()["sha256"] for n in (1, 5)}
    assert len(hashes) == 1


def test_words_that_depend_on_others_are_taken_whole(spark, tmp_path):
    """A tokenizer that doesn't split at white space: its words have other ids alone than in a text."""
    spec = {
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None,
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False,
                  "byte_fallback": False, "vocab": {"a": 0, "b": 1, "<end>": 2, " ": 3, "a ": 4, "a b": 5}, "merges": [["a", " "], ["a ", "b"]]},
    }
    path = str(tmp_path / "whole.json")
    open(path, "w").write(json.dumps(spec))
    docs = [(i, "a b" * (i % 3 + 1)) for i in range(20)]
    got = {r["doc_id"]: list(r["ids"]) for r in token_store.read_documents(spark, written(spark, docs, 2, path), range(20)).collect()}
    own = Tokenizer.from_file(path)
    assert got == {i: [*own.encode(t, add_special_tokens=False).ids, 2] for i, t in docs}
