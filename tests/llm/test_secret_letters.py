from pyspark.sql import functions as F

from syndrift.llm import secret_scan


def test_ratio_decides_for_letters_only(spark):
    model = secret_scan.trained(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    texts = ["key ZkQwXyJLmVTgBqnRvHsKJd", "-" * 60, "=" * 60, "_" * 60, "plain_identifier_name_here", "theinternationalisation", "other/the/nation/in/there", "key Zk9QwXy7Lm3TgB5nR8vHs2Jd"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: [s.value for s in r.spans] for r in secret_scan.scan(df, model).collect()}
    assert got == {i: [t[4:]] if t.startswith("key ") else [] for i, t in enumerate(texts)}
