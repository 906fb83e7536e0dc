"""Whole jobs: nothing that an operator learns from or links is cut off."""

from pyspark.sql import functions as F

from syndrift.llm import secret_scan

# ---- 6 secret scans


def test_ordinary_model_reads_every_document(spark):
    df = spark.range(700).select(F.col("id").alias("doc_id"), F.lit("some plain words").alias("text"))
    last = df.orderBy(F.xxhash64("doc_id").desc()).first().doc_id
    more = df.withColumn("text", F.when(F.col("doc_id") == last, F.lit("qzqzqz qzqz qzqzqzqz")).otherwise(F.col("text")))
    odds = [spark.range(1).select(secret_scan.log_odds(F.lit("qzqzqzqzqzqzqzqz"), secret_scan.trained(d))).first()[0] for d in (df, more)]
    assert odds[1] < odds[0] - 1


def test_pairs_equal_those_of_written_identifiers(spark):
    texts = [None, "", "One two", "One two THREE x four", "a_b cd5 naïve Word word-word, word ß end", "aa bb cc " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    number = {r.w: str(r.n) for r in df.select(F.explode(F.split("text", "[^A-Za-z]+")).alias("w")).select("w", F.pmod(F.xxhash64("w"), F.lit(1000)).alias("n")).collect()}
    want: dict = {}
    for t in texts:
        w = [x for x in secret_scan_words(t or "") if len(x) > 1]
        made = w + [f"{a}_{b}" for a, b in zip(w, w[1:])] + [a + b.capitalize() + number[b] for a, b in zip(w, w[1:])] if len(w) > 2 else []
        for token in made:
            for pair in zip(f"^{token}", f"{token}^"):
                want["".join(pair)] = want.get("".join(pair), 0) + 1
    got = {r.pair: r.k for r in secret_scan.ordinary_pairs(df).collect() if r.k}
    assert got == want


def secret_scan_words(text):
    import re

    return re.findall(r"(?<![A-Za-z0-9])[A-Za-z]+(?![A-Za-z0-9])", text)
