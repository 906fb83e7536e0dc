"""Bit masks as BIGINT patterns, run-length codes and packed bits, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit(mask: Column, i: Column | int) -> Column:
    return F.getbit(mask, F.lit(i) if isinstance(i, int) else i)


def pack_mask(bits: Column) -> Column:
    """Bit j of the mask is element j; at most 64 elements count."""
    place = F.sequence(F.lit(0), F.lit(63))
    parts = F.zip_with(F.slice(bits, 1, 64), place, lambda b, j: F.when(b.isNotNull() & b.cast("boolean"), F.call_function("shiftleft", F.lit(1).cast("bigint"), j)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def set_bits(mask: Column) -> Column:
    """Numbers of the set bits, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(mask, i) == 1)


def corrections(mask: Column) -> Column:
    """One correction (logical_id, pauli Z) for each set bit."""
    return F.transform(set_bits(mask), lambda i: F.struct(i.alias("logical_id"), F.lit("Z").alias("pauli")))


def active(events: Column) -> Column:
    """Numbers of the fired positions of a boolean array."""
    return F.filter(F.transform(events, lambda e, i: F.when(e, i)), lambda i: i.isNotNull())


def weight(events: Column) -> Column:
    return F.size(F.filter(events, lambda e: e))


def outcomes(events: Column) -> Column:
    """Measured values: -1 where fired, else 1."""
    return F.transform(events, lambda e: F.when(e, -1).otherwise(1).cast("tinyint"))


def _bytes(code: Column) -> Column:
    h = F.hex(code)
    places = F.when(F.length(code) > 0, F.sequence(F.lit(1), F.length(code))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(places, lambda i: F.conv(F.substring(h, 2 * i - 1, F.lit(2)), 16, 10).cast("int"))


def rle_decode(code: Column) -> Column:
    """Booleans of a run-length code: each byte has the value in its top bit and the length below."""
    runs = F.transform(_bytes(code), lambda b: F.array_repeat((b >= 128), F.pmod(b, F.lit(128)).cast("int")))
    return F.flatten(runs)


def fit(events: Column, n: Column | int) -> Column:
    """Padded with false, or cut, to n."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(F.concat(events, F.array_repeat(F.lit(False), F.greatest(n - F.size(events), F.lit(0)))), F.lit(1), n)


def rle_popcount(code: Column) -> Column:
    """Number of fired positions, without decoding."""
    return F.aggregate(_bytes(code), F.lit(0), lambda a, b: a + F.when(b >= 128, b - 128).otherwise(0))


def rle_bit(code: Column, i: Column | int) -> Column:
    """The bit at a position; 0 past the end."""
    return F.coalesce(F.get(rle_decode(code), F.lit(i) if isinstance(i, int) else i), F.lit(False)).cast("int")


def rle_tokens(events: Column) -> Column:
    """Token bytes of the code of a boolean array; runs over 127 take several, a null counts as not fired."""
    text = F.array_join(F.transform(events, lambda e: F.when(e, "1").otherwise("0")), "")
    runs = F.regexp_extract_all(text, F.lit("(0{1,127}|1{1,127})"), F.lit(1))
    return F.transform(runs, lambda r: F.length(r) + F.when(F.startswith(r, F.lit("1")), 128).otherwise(0))


def rle_encode(events: Column) -> Column:
    tokens = F.transform(rle_tokens(events), lambda b: F.lpad(F.hex(b.cast("bigint")), 2, "0"))
    return F.unhex(F.array_join(tokens, ""))


def pack_bytes(bits: Column) -> Column:
    """Packed bits, least significant first in each byte."""
    n = F.ceil(F.size(bits) / 8).cast("int")
    groups = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    own = lambda g: F.aggregate(F.transform(F.slice(bits, g * 8 + 1, F.lit(8)), lambda b, j: F.when(b, F.pow(F.lit(2), j)).otherwise(0).cast("int")), F.lit(0), lambda a, x: a + x)
    return F.unhex(F.array_join(F.transform(groups, lambda g: F.lpad(F.hex(own(g).cast("bigint")), 2, "0")), ""))


def edge_weight(p: Column) -> Column:
    """Log-odds against an error, rounded to single precision."""
    return (-F.ln(p / (1 - p))).cast("float").cast("double")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
