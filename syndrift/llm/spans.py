"""Places of regex matches, with built-in functions only.

Spark gives the matches of a regex and the pieces between them, but not where they stand; a match begins after
the pieces and matches before it.  Arrays are walked in runs of ``RUN`` items, each of which makes an array of its own;
appending item by item to one array would copy it each time, and a text may have tens of thousands of matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,end:bigint,no:int,value:string>"
#: Items walked at a time, and code points of a slice of a text.
RUN, SLICE = 64, 1024


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named there."""
    return F.transform(F.array(value), use)[0]


def walk(items: Column, start: Column, state: str, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """An array with one entry of type ``kind`` for each item: ``step(state, item) -> (next state, entry)``.

    ``aggregate`` copies what it has gathered at every step.  So first only the states at the beginnings of runs are
    gathered, then each run makes its own entries.
    """
    empty = lambda of: F.expr(f"cast(array() as array<{of}>)")
    pack = lambda s, out: F.struct(s.cast(state).alias("s"), out.alias("out"))

    def one(a: Column, x: Column) -> Column:
        after, entry = step(a["s"], x)
        return pack(after, F.concat(a["out"], F.array(entry.cast(kind))))

    def whole(all_: Column) -> Column:
        run = lambda at: F.slice(all_, at, RUN)
        begins = F.sequence(F.lit(1), F.size(all_), F.lit(RUN))
        after = lambda states, at: F.aggregate(run(at), F.element_at(states, -1), lambda s, x: step(s, x)[0].cast(state))
        states = F.aggregate(begins, F.array(start.cast(state)), lambda states, at: F.concat(states, F.array(after(states, at))))
        entries = lambda b: F.aggregate(run(b["at"]), pack(b["s"], empty(kind)), one)["out"]
        return F.flatten(F.transform(F.arrays_zip(begins.alias("at"), F.slice(states, 1, F.size(begins)).alias("s")), entries))

    return let(items, lambda all_: F.when(F.size(all_) > 0, whole(all_)).otherwise(empty(kind)))


def no_spans() -> Column:
    return F.expr(f"cast(array() as array<{SPAN}>)")


def matches(text: Column, pattern: str, gate: Column) -> Column:
    """struct(pieces, found) of a text for which ``gate`` holds, else null."""
    return F.when(gate, F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")))


def located(m: Column, no: int, value: Column | None = None) -> Column:
    """The spans (code points, end exclusive) of ``matches``; ``value``: an array with something of each match."""
    found = m["found"]
    pairs = F.arrays_zip(F.slice(m["pieces"], 1, F.size(found)).alias("piece"), found.alias("hit"), (found if value is None else value).alias("value"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + F.length(x["piece"])
        end = begin + F.length(x["hit"])
        return end, F.struct(begin.alias("start"), end.alias("end"), F.lit(no).alias("no"), x["value"].alias("value"))

    return F.when(found.isNotNull() & (F.size(found) > 0), walk(pairs, F.lit(0), "bigint", SPAN, step)).otherwise(no_spans())


def free(own: Column, others: Column) -> Column:
    """The spans of ``own`` that meet none of ``others``: those that begin at or after the ends of all earlier others
    and end before the next other begins."""
    both = F.array_sort(F.concat(*(F.transform(x, lambda s, k=k: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("other"), s.alias("span"))) for k, x in ((1, others), (0, own)))))
    kind = f"struct<start:bigint,end:bigint,other:int,span:{SPAN},clear:boolean>"
    marked = lambda x, ok: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["other"].alias("other"), x["span"].alias("span"), ok.alias("clear"))
    ahead = walk(both, F.lit(-1), "bigint", kind, lambda end, x: (F.when(x["other"] == 1, F.greatest(end, x["end"])).otherwise(end), marked(x, x["start"] >= end)))
    back = walk(F.reverse(ahead), F.lit(1 << 62), "bigint", kind, lambda begin, x: (F.when(x["other"] == 1, x["start"]).otherwise(begin), marked(x, x["clear"] & (x["end"] <= begin))))
    return F.transform(F.filter(back, lambda x: x["clear"] & (x["other"] == 0)), lambda x: x["span"])


def slices(text: Column) -> Column:
    """A text cut into slices of ``SLICE`` code points, so that a part can be taken without a walk from its beginning."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SLICE}}}"), F.lit(0))


def part(cut: Column, begin: Column, end: Column) -> Column:
    """Code points ``begin`` to ``end`` (exclusive) of a text in ``slices``."""
    first, last = F.floor(begin / SLICE).cast("int"), F.floor((end - 1) / SLICE).cast("int")
    piece = lambda k, a, b: F.substring(F.get(cut, k), (a + 1).cast("int"), (b - a).cast("int"))
    low, high = begin - first.cast("bigint") * SLICE, end - last.cast("bigint") * SLICE
    across = F.concat(piece(first, low, F.lit(SLICE)), F.array_join(F.slice(cut, first + 2, last - first - 1), ""), piece(last, F.lit(0), high))
    return F.when(end <= begin, F.lit("")).when(first == last, piece(first, low, high)).otherwise(across)


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in kinds))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["no"] + 1), s["start"].cast("string"), s["end"].cast("string"))))
