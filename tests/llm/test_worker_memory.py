"""Workers live on from stage to stage of the pipeline: kernels see small slices and give freed memory back."""

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from tributary.llm import common, lines, packing, ppm, rules
from tributary.llm.queries import vocabulary


def test_language_kernel_sees_slices_of_a_megabyte(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "en", f"word{i} " * 60_000) for i in range(12)], "doc_id bigint, lang string, text string").coalesce(1)
    made = []
    kept = common.text_kernel
    monkeypatch.setattr(common, "text_kernel", lambda kernel, schema, **more: (made.append(more), kept(kernel, schema, **more))[1])
    assert ppm.keep_identified(docs, ppm.train(docs)).count() == 12
    assert made and made[0]["limit"] <= 1 << 20


def test_slices_are_bounded_and_every_batch_gives_memory_back(spark):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(50)], "doc_id bigint, text string").coalesce(1)

    def kernel(texts: list) -> dict:
        return {"n": [len(texts)] * len(texts)}

    seen = docs.select(common.text_kernel(kernel, "n int", limit=10_000)(F.col("text")).getField("n").alias("n")).collect()
    assert len(seen) == 50 and {r["n"] for r in seen} == {10}


def test_lines_are_aligned_and_cut_once_in_different_stages(spark):
    block = "\n".join(f"line {i} of a passage that two documents share" for i in range(4))
    docs = spark.createDataFrame([(1, block), (2, f"its own beginning\n{block}"), (3, "alone"), (4, None)], "doc_id bigint, text string")
    out = lines.clean(docs)
    for made in (out, lines.removals(docs)):
        assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(map(tuple, out.collect())) == [(1, block), (2, "its own beginning"), (3, "alone"), (4, None)]


def test_samples_take_no_workers_of_their_own(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "en" if i % 2 else "de", f"word{i} of a text") for i in range(40)], "doc_id bigint, lang string, text string").persist()
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int").persist()
    assert docs.count() == labels.count() == 40

    def refused(*_, **__):
        raise AssertionError("rows of the driver pass through Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    assert ppm.train(docs).languages == ["de", "en"]
    assert rules.fit(docs, labels) is not None


def test_local_tables_keep_types_and_nulls(spark):
    rows = [(1, "a", None), (None, None, 2)]
    made = common.local_table(spark, rows, "n bigint, s string, i int")
    assert made.dtypes == [("n", "bigint"), ("s", "string"), ("i", "int")] and sorted(map(tuple, made.collect()), key=str) == sorted(rows, key=str)
    assert common.local_table(spark, [], "n bigint").count() == 0


def test_packing_sees_slices_of_a_megabyte(monkeypatch):
    class Task:
        def partitionId(self):
            return 0

    path, seen = vocabulary("word_bpe_49k.json"), []
    tokens = packing.loaded(path)
    ids = tokens.ids
    monkeypatch.setattr(TaskContext, "get", lambda: Task())
    monkeypatch.setattr(tokens, "ids", lambda texts: (seen.append(sum(map(len, texts))), ids(texts))[1])
    batch = pa.RecordBatch.from_arrays([pa.array(["word " * 60_000] * 12), pa.array(range(12), pa.int64())], names=["text", "keep0"])
    made = pa.Table.from_batches(packing.piece_kernel(path, 4096, 1)([batch])).to_pandas()
    assert max(seen) <= 1 << 20 and sum(seen) == 12 * 300_000
    assert made.groupby("keep0").length.sum().to_dict() == {i: 60_001 for i in range(12)}
    for _, same in made.groupby("length"):  # ranks go on from slice to slice
        assert sorted(same.place) == list(range(len(same)))
