"""Very long texts: runs of white space, and tens of thousands of matches in one text."""

import hashlib
import time

import brute
import pytest
import tiktoken

from syndrift.llm import licenses, secret_scan, token_counts


def test_tokens_of_long_white_space(monkeypatch):
    ranks, pattern = token_counts.vocabulary()
    plain = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    count = token_counts.counter(ranks, pattern)
    for blank in ("\n", " ", "\n ", " \t", "\u3000", "\xa0 "):
        for before in ("", "word", "end. ", "\n"):
            for after in ("", "word", " word", "7", "!", "'s", "é\n"):
                text = before + blank * 5000 + after + blank * 4999 + "x" + blank * 4100
                assert count(text) == len(plain.encode_ordinary(text))


@pytest.mark.parametrize("blank", ["\n", " ", "\t\n"])
def test_a_million_blanks(spark, blank):
    df = spark.createDataFrame([("a" + blank * 1_000_000 + "b",), (blank * 1_000_000,)], "text string")
    began = time.monotonic()
    rows = token_counts.histogram(df).collect()
    assert sum(r.n_docs for r in rows) == 2 and time.monotonic() - began < 20


def test_tens_of_thousands_of_matches(spark):
    """Work follows the number of matches: no array or text is copied for each."""
    n = 25_000
    keys = [hashlib.md5(str(i).encode()).hexdigest() for i in range(n)]
    text = " ".join(f"é {k} password=abc{i:06d}x other_plain_name_{i % 7}" for i, k in enumerate(keys))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    for f in (lambda: secret_scan.scan(df, [0.0] * len(secret_scan.ALPHABET) ** 2).collect()[0], lambda: secret_scan.mask(df).collect()[0]):
        began = time.monotonic()
        found = f()
        assert time.monotonic() - began < 25
        if "base" in found:
            assert [(s.start, s.end) for s in found.base] == [(a, b) for a, _, _, b in brute.secrets(text)] and len(found.base) == 2 * n
        else:
            assert found.text == " ".join(f"é [REDACTED:hex] [REDACTED:assign] other_plain_name_{i % 7}" for i in range(n))
    text = "licensed under the mit license or the apache license version 2.0 " * n
    began = time.monotonic()
    found = licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()[0]
    assert len(found.base) == 2 * n and len(found.found) == 2 * n and time.monotonic() - began < 40
