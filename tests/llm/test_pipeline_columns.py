"""The pipeline's stages with columns called like their own."""

import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_ops import CLASH, edge_docs, frame

NAMES = sorted({*CLASH, "n_words", "matches", "size", "copies", "taken", "target", "source_size", "__copy", "__salt", "row", "keep", "prob", "sid", "tk", "first", "root", "bucket", "__id", "__tk"})


@pytest.mark.parametrize("rows", ["edges", "none"])
def test_columns_of_any_name_stay(spark, rows):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = frame(spark, edge_docs() if rows == "edges" else [], clash=False).withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in NAMES})
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert rows == "edges" or got == []
        if name != "token store":
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
            assert all(r[c] == f"{c}{'-' if r['doc_id'] is None else r['doc_id']}" for r in got for c in NAMES), name
