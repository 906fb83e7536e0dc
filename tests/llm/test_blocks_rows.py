from syndrift.llm import decontam
from syndrift.llm.store import Scratch


def test_blocks_keep_rows_apart(spark):
    words = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(i, " ".join(words[i : i + 20])) for i in range(0, 20, 5)], "item_id bigint, text string")
    texts = [(1, " ".join(words)), (1, "clean text"), (None, " ".join(words[3:30])), (None, "other " * 30), (2, None), (1, " ".join(words))]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    one, many = (sorted(map(repr, decontam.report(decontam.contamination(docs, bench, Scratch(spark, "t"), **k)).collect())) for k in ({}, {"block_chars": 30}))
    assert many == one and len(one) == 6
