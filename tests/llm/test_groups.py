"""Large groups of near copies: what a step passes on grows with the group, not with its square."""

import random

from tributary.llm import graph, ngram_join


def near_copies(spark, n):
    rng = random.Random(8)
    base = [f"word{i}" for i in range(400)]
    texts = [" ".join(base[:at] + [f"own{i}"] + base[at + 1 :]) for i in range(n) for at in [rng.randrange(400)]]
    return spark.createDataFrame([*enumerate(texts, 1)], "doc_id bigint, text string")


def test_edges_of_a_large_group_do_not_grow_with_its_blocks(spark, monkeypatch):
    docs, n = near_copies(spark, 192), 192
    monkeypatch.setattr(ngram_join, "BLOCK", 12)
    given, components = [], graph.components
    monkeypatch.setattr(graph, "components", lambda edges: components((given.append((edges.count(), edges.distinct().count())), edges)[1]))
    rows = ngram_join.classes(docs).collect()
    made, different = given[0]
    # 16 blocks to a bucket: n for each band, and one for each two blocks
    assert made <= ngram_join.BANDS * (n + 16 * 17 // 2) and different <= 16 * n
    assert {r["class_id"] for r in rows} == {1} and {r["links"] for r in rows} == {n - 1}
