"""Conflicts come out by the labelled rows' pools and by the pools of all documents."""

from tidegate.queries import QUERIES


def test_labelled_pools_and_numbered_ones(spark, tmp_path):
    docs = [(2, "even both", "en", "s"), (4, "even both", "en", "s"), (6, "odd and even", "en", "s"), (7, "odd and even", "en", "s"), (9, "alone", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 1, 1), (4, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {tuple(r) for r in QUERIES["pool_conflicts"](spark, str(tmp_path)).collect()}
    assert got == {("label", "even both"), ("number", "odd and even")}
