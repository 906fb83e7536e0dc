"""Quality rules by repetition coverage: how much of a text lies inside repeated n-grams and lines.

Rolling hashes of runs of 2 to 10 words are taken over a whole batch of texts at once.  For the longer lengths the
measure is the share of the word characters inside runs that repeat an earlier one of their text, each word once;
for the short ones the share covered by the most covering single run that stands twice or more.  Lines are compared
as they stand, and those equal to an earlier one count.

Defined results: a null or empty text has no words and fails the base rules; a text shorter than a run has none
of them; rows map one to one; other columns are ignored; thresholds are met when exceeded, so ties keep a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as T

PART_BYTES = 1 << 20
#: Characters in the most covering run, in repeating runs, and in repeating lines.  The first and last are published
#: thresholds for web text; those for runs lie a twentieth above, as texts here begin at 50 words, where one
#: repeated heading is a tenth.  The share of lines counts from MIN_LINES on.
TOP_NGRAM = {2: 0.20, 3: 0.18, 4: 0.16}
ALL_NGRAMS = {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15}
DUP_LINES, DUP_LINE_CHARS, MIN_LINES = 0.30, 0.20, 5
MIN_WORDS, MAX_REPEATED = 50, 50

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
CONTINUES = (np.arange(256) & 0xC0) == 0x80


def _sums(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[cut[1:]] - total[cut[:-1]]


def _repeated(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For hashes and their texts: the group of each, the size of each group, and who is not its group's first."""
    _, first, group, size = np.unique(T.mix(h ^ T.mix(text.astype(np.uint64))), return_index=True, return_inverse=True, return_counts=True)
    again = np.ones(len(h), bool)
    again[first] = False
    return group, size, again


def _inside(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a run of k from one of ``at``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """All counts and shares of a batch."""
    buf, offs = T.pack(texts)
    starts, ends, counts = T.words(buf, offs, T.SPACE)
    n = len(counts)
    h = T.hashes(buf, starts, ends)
    lead = np.concatenate([[0], np.cumsum(~CONTINUES[buf])])
    chars = lead[ends] - lead[starts]
    cut = np.concatenate([[0], np.cumsum(counts)])
    text = np.repeat(np.arange(n), counts)
    out = {"n_words": counts, "word_chars": _sums(chars, cut), "n_symbols": _sums(SYMBOLS[buf], offs)}
    size = np.maximum(out["word_chars"], 1)
    for k in (*TOP_NGRAM, *ALL_NGRAMS):
        g, at = T.grams(h, counts, k)
        group, many, again = _repeated(g, text[at])
        if k == 3:
            out["n_repeat_words"] = _sums(_inside(at[many[group] > 1], k, len(h)), cut)
        if k in TOP_NGRAM:
            covered = np.bincount(group, np.concatenate([[0], np.cumsum(chars)])[at + k] - np.concatenate([[0], np.cumsum(chars)])[at], len(many)) * (many > 1)
            most = np.zeros(n)
            np.maximum.at(most, text[at], covered[group])
            out[f"top_{k}gram"] = np.minimum(most / size, 1)
        else:
            out[f"dup_{k}gram"] = _sums(chars * _inside(at[again], k, len(h)), cut) / size
    # lines: those with a word, equal to an earlier one
    ends_line = np.unique(np.concatenate([np.flatnonzero(buf == 10), offs[1:]])).astype(np.int64)
    begin = np.concatenate([[0], ends_line[:-1]])
    begin = begin + ((begin < len(buf)) & (buf[np.minimum(begin, max(len(buf) - 1, 0))] == 10) if len(buf) else 0)
    begin = np.minimum(begin, ends_line)
    first = np.searchsorted(starts, begin)
    has = np.searchsorted(starts, ends_line) > first
    begin, ends_line = begin[has], ends_line[has]
    owner = text[first[has]]
    lh = T.hashes(buf, begin, ends_line)
    key = T.mix(lh ^ T.mix(owner.astype(np.uint64)))
    _, seen = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[seen] = False
    width = lead[ends_line] - lead[begin]
    out["n_lines"] = np.bincount(owner, minlength=n)
    out["n_dup_lines"] = np.bincount(owner, again, n).astype(np.int64)
    out["dup_lines"] = out["n_dup_lines"] * (out["n_lines"] >= MIN_LINES) / np.maximum(out["n_lines"], 1)
    out["dup_line_chars"] = np.bincount(owner, again * width, n) / np.maximum(np.bincount(owner, width, n), 1)
    return out


LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = (*(f"top_{k}gram" for k in TOP_NGRAM), *(f"dup_{k}gram" for k in ALL_NGRAMS), "dup_lines", "dup_line_chars")


def repetition(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and the shares of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in T.parts(batch.column(1), PART_BYTES):
                got = measure(batch.column(1).slice(lo, hi - lo))
                columns = [pa.array(got[k], pa.int64()) for k in LONGS] + [pa.array(got[k], pa.float64()) for k in SHARES]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], ["doc_id", *LONGS, *SHARES])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = ", ".join(["doc_id bigint", *(f"{k} bigint" for k in LONGS), *(f"{k} double" for k in SHARES)])
    return narrow.mapInArrow(run, kinds)


def verdict(measured: DataFrame) -> DataFrame:
    """Adds base_failed, the first rule that the text breaks, and kept."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    limits = {f"top_{k}gram": v for k, v in TOP_NGRAM.items()} | {f"dup_{k}gram": v for k, v in ALL_NGRAMS.items()} | {"dup_lines": DUP_LINES, "dup_line_chars": DUP_LINE_CHARS}
    broken = F.coalesce(F.when(base, F.lit("base")), *(F.when(F.col(k) > v, F.lit(k)) for k, v in limits.items()))
    return measured.withColumns({"base_failed": base, "broken_rule": broken, "kept": broken.isNull()})
