"""Detector error models: the text grammar and the DataFrames of a model."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class ModelError(ValueError):
    """A line that the grammar does not allow; ``kind`` is one of five."""

    def __init__(self, kind: str, line: str):
        super().__init__(f"{kind}: {line}")
        self.kind = kind


@dataclass
class ErrorModel:
    """errors: (probability, detectors, observables); detectors: id to coordinates or None, in order of first mention."""

    errors: list[tuple[float, list[int], list[int]]] = field(default_factory=list)
    detectors: dict[int, tuple[float, float, float] | None] = field(default_factory=dict)
    declared: list[int] = field(default_factory=list)

    @property
    def detector_count(self) -> int:
        ids = [d for _, ds, _ in self.errors for d in ds] + list(self.detectors)
        return max(ids, default=-1) + 1

    @property
    def observable_count(self) -> int:
        ids = [o for _, _, os in self.errors for o in os] + self.declared
        return max(ids, default=-1) + 1

    @property
    def mean_probability(self) -> float:
        return sum(p for p, _, _ in self.errors) / len(self.errors) if self.errors else 0.0


def _error(line: str) -> tuple[float, list[int], list[int]]:
    head, closed, targets = line.removeprefix("error(").partition(")")
    try:
        p = float(head)
    except ValueError:
        closed = ""
    if not closed:
        raise ModelError("InvalidProbability", line)
    found: dict[str, list[int]] = {"D": [], "L": []}
    for token in targets.split():
        if token != "^":
            if not re.fullmatch(r"[DL]\d+", token) or int(token[1:]) >= 1 << (8 if token[0] == "L" else 32):
                raise ModelError("MalformedTarget", token)
            found[token[0]].append(int(token[1:]))
    return p, found["D"], found["L"]


def _number(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        return 0.0


def _detector(line: str) -> tuple[int, tuple[float, float, float] | None]:
    """Id (the first D token) and coordinates; missing or bad ones are 0."""
    at, rest = None, line.removeprefix("detector")
    if "(" in line:
        inside, closed, rest = line.partition("(")[2].partition(")")
        if not closed:
            raise ModelError("MalformedCoords", line)
        at = tuple(([_number(x) for x in inside.split(",")] + [0.0] * 3)[:3])
    ids = re.findall(r"(?<!\S)D(\d+)(?!\S)", rest)
    if not ids:
        raise ModelError("MalformedTarget", line)
    return int(ids[0]), at


def parse(text: str) -> ErrorModel:
    """Line by line; blank lines, comments and unknown instructions are skipped.

    A repeat block ends at the first line that is a closing brace, so a block inside a block is unterminated.  Its
    errors are cloned without shifting detectors, its detectors are taken once; a block may also stand on one line.
    """
    model, lines = ErrorModel(), iter(text.splitlines())
    for line in (x.strip() for x in lines):
        if line.startswith("error("):
            model.errors.append(_error(line))
        elif line.startswith("detector"):
            model.detectors.setdefault(*_detector(line))
        elif line.startswith("logical_observable"):
            model.declared += [int(x) for x in re.findall(r"(?<!\S)L(\d+)(?!\S)", line)[:1]]
        elif line.startswith("repeat "):
            count, _, rest = line.removeprefix("repeat").strip().partition(" ")
            if not count.isdecimal():
                raise ModelError("InvalidRepeatCount", count)
            if line.endswith("}"):
                body = [rest.strip("{} ")]
            else:
                body = []
                for inner in (x.strip() for x in lines):
                    if inner == "}":
                        break
                    body.append(inner)
                else:
                    raise ModelError("UnterminatedRepeat", line)
            inside = parse("\n".join(body))
            model.errors += inside.errors * int(count)
            for k, at in inside.detectors.items():
                model.detectors.setdefault(k, at)
    return model


def tables(spark: SparkSession, model: ErrorModel) -> tuple[DataFrame, DataFrame]:
    """dem_errors(seq, p, detectors, observables) and dem_detectors(id, coords)."""
    errors = spark.createDataFrame([(i, *e) for i, e in enumerate(model.errors)], "seq int, p double, detectors array<bigint>, observables array<int>")
    detectors = spark.createDataFrame([(i, c) for i, c in model.detectors.items()], "id bigint, coords struct<x:double,y:double,t:double>")
    return errors, detectors


def render(model: ErrorModel) -> str:
    lines = [f"error({p:g}) " + " ".join([f"D{d}" for d in ds] + (["^", *(f"L{o}" for o in os)] if os else [])) for p, ds, os in model.errors]
    lines += ["detector" + (f"({c[0]:g},{c[1]:g},{c[2]:g})" if c else "") + f" D{i}" for i, c in model.detectors.items()]
    return "\n".join(lines) + "\n"
