from oracle import compare, connect
from pyspark.sql import functions as F

from vaultlens.operators import quality
from vaultlens.plans import registry


def test_whole_pages_are_judged(spark):
    sf = "/root/testdata/sf0.01"
    rows = compare(registry.QUERIES["html_noise_whole"](spark, sf), connect(sf), registry.ORACLE["html_noise_whole"])
    assert len(rows) == 250
    slices, whole = ({r["page_id"]: r["noise"] for r in registry.QUERIES[n](spark, sf).collect()} for n in ("html_noise", "html_noise_whole"))
    changed = [(slices[p], whole[p]) for p in whole if slices[p] != whole[p]]
    print("changed", len(changed))
    assert changed


def test_the_end_of_a_page_counts(spark):
    plain = "A plain page of words. " * 100
    tokens = " ".join(c * 24 for c in "xyz")
    df = spark.createDataFrame([(plain, False), (plain + tokens, True), ("<b><i>x</i></b>" + plain, False)], "html string, noise boolean")
    assert df.where(quality.html_noise(F.col("html")) != F.col("noise")).count() == 0
