"""What the operators for training data sent too often in the third review round."""

from pyspark.sql import functions as F

from clinprep.llm import jaccard


def test_groups_that_share_nodes_are_sent_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    chain = [(k, c) for k in range(6) for c in (f"x{k}", f"x{k + 1}")]
    rows = [(10, "a"), (10, "b"), (11, "b"), (11, "c"), (12, "a"), (12, "c"), (12, "d"), *chain]
    got = jaccard.together(spark.createDataFrame(rows, "`group` long, key string").select("group", F.col("key").cast("binary").alias("key")))
    names = {}
    for r in got.select("group", F.col("key").cast("string").alias("key")).collect():
        names.setdefault(r.group, []).append(r.key)
    # seven nodes in a chain are more than a block
    assert sorted(map(sorted, names.values())) == sorted([["a", "b", "c", "d"], *[[f"x{k}", f"x{k + 1}"] for k in range(6)]])


def test_sets_are_in_no_join(spark):
    docs = spark.createDataFrame([(k, f"one two three four five six {k // 2}") for k in range(8)], "doc_id long, text string")
    sets = jaccard.document_sets(docs, "doc_id", "text", 5)
    nodes = sets.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n_copies"), F.first("values").alias("values"))
    found = jaccard.compare(nodes.selectExpr("1L as `group`", "key"), docs, nodes, "doc_id", "text", 5, 0.3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("sets_of")] if "sets_of" in plan else plan[:[i for i in range(len(plan)) if plan.startswith("MapInArrow", i)][1]]
    assert "Join" not in above
    assert sorted(r.n_links for r in found.collect()) == [3, 3, 3, 3]


def test_values_are_sent_on_only_for_nodes_of_large_buckets(spark, monkeypatch):
    """At each level below the first the values of the nodes in large buckets alone are joined."""
    kept, plain = [], jaccard.stored

    def stored(df, label):
        out = plain(df, label)
        if label == "alive":
            kept.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stored", stored)
    monkeypatch.setattr(jaccard, "LEAF", 5)
    same = " ".join(f"w{k}" for k in range(200))
    texts = [same + f" x{k}" for k in range(12)] + [" ".join(f"u{k}n{j}" for j in range(30)) for k in range(300)]
    got = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.n_links for r in got.where("doc_id < 12").collect()} == {11} and {r.n_links for r in got.where("doc_id >= 12").collect()} == {0}
    assert all(n <= 12 for n in kept)
