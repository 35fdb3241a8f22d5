"""Short benchmark items in the pipeline's decontamination stage."""

import corpus_pipeline


def test_short_items_drop_no_documents(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, "paris is a city on the river seine in france", "en", "a", 1), (2, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 1),
         (3, "a b c d e f g h and more", "en", "a", 1), (4, None, None, None, None)],
        "doc_id long, text string, lang string, source string, n_chars long")
    items = [(1, "Paris"), (2, "river seine in"), (3, "two three four five six seven eight nine ten eleven"), (4, "A b, c d e; f g h"), (5, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4] and kept.columns == docs.columns
