"""Every rule is found in an example of it, and suppression follows its definition."""

import random
import re
from re import _parser

from pyspark.sql import functions as F

from syndrift.llm import licenses


def example(regex: str) -> str:
    """A text that a regex matches: first branches, fewest repeats."""

    def made(tree) -> str:
        out = ""
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "NOT_LITERAL":
                out += "q"
            elif name == "IN":
                out += "q" if str(arg[0][0]) == "NEGATE" else chr(arg[0][1][0] if str(arg[0][0]) == "RANGE" else arg[0][1])
            elif name == "SUBPATTERN":
                out += made(arg[3])
            elif name == "BRANCH":
                out += made(arg[1][0])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                out += made(arg[2]) * arg[0]
            else:
                raise ValueError(name)
        return out

    return made(_parser.parse(regex.removeprefix("(?<= )").removesuffix("(?= )")))


def test_every_rule_is_reached(spark):
    """Its gate and its keyword let every rule's own example through."""
    known = licenses.rules()
    rows = [(r["no"], example(r["regex"]).replace(" ", mark)) for r in known for mark in (" ", "_")]
    df = spark.createDataFrame([(n, t.title()) for n, t in rows], "doc_id bigint, text string")
    assert [t for n, t in rows if not any(stem in t and (around is None or re.search(around, t, re.A)) for stem, around in licenses.GATES.items())] == []
    alone = {n: [r for r in known if r["no"] == n] for n, _ in rows}
    found = licenses.scan(df).collect()
    assert [alone[r.doc_id][0]["regex"] for r in found if not r.found] == []
    written = licenses.GRANTS + licenses.TITLES + [x[:3] for x in licenses.NOTICES]
    assert len(written) + len(licenses.NAMES) + len(licenses.PHRASES) > 230 and len({x[2] for x in written} | {x[2] for x in licenses.NAMES}) > 220
    keyword = {x[2]: x[1] for x in written}
    gate = lambda k, t: f" {k}" in f" {t}" if k in licenses.PREFIXES else f" {k} " in f" {t} "
    assert [x for x, k in keyword.items() if not gate(k, example(x))] == []


def test_found_licenses(spark):
    texts = {
        "SPDX-License-Identifier: GPL-2.0-only": "gpl-2.0", "LGPL-2.1-or-later license": "lgpl-2.1", "licensed under the GPLv3": "gpl-3.0", "Released under the GPL v2 license": "gpl-2.0",
        "See the License for the specific language governing permissions and\nlimitations under the License.": "apache-2.0",
        " * you can redistribute it and/or modify it; either version 2 of the License, or (at your option) any later version.": "gpl-2.0",
        "Unauthorized copying of this file, via any medium is strictly prohibited": "proprietary", "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa", "Altered source versions must be plainly marked as such": "zlib",
        "a success of the discussion in the permit office": "", "the smith licenses nothing": "",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.labels for r in licenses.report(licenses.scan(df)).collect()} == dict(enumerate(texts.values()))


def test_suppression_follows_its_definition(spark):
    rng = random.Random(6)
    sets = [[(0, 6, 50), (3, 8, 30), (4, 6, 40)], [(0, 6, 10), (1, 3, 30), (3, 5, 20)], [(0, 2, 1), (0, 2, 1)], []]
    sets += [[(a := rng.randrange(12), a + rng.randrange(1, 7), rng.randrange(4)) for _ in range(rng.randrange(1, 14))] for _ in range(150)] + [[(a := rng.randrange(500), a + rng.randrange(1, 60), rng.randrange(5)) for _ in range(400)]]
    rows, want = [], {}
    for i, own in enumerate(sets):
        found = sorted((a, -b, -p, no) for no, (a, b, p) in enumerate(own))
        hides = lambda y, x: y[0] <= x[0] and -y[1] >= -x[1] and (-y[2] > -x[2] or y[2] == x[2] and (y[:2] != x[:2] or y[3] < x[3]))
        want[i] = sorted(x[3] for x in found if not any(hides(y, x) for y in found if y != x))
        rows.append((i, [(*x, "l", 1.0) for x in found]))
    df = spark.createDataFrame(rows, f"i int, found {licenses.FOUND}")
    got = {r.i: sorted(r.k) for r in df.select("i", F.transform(licenses.outermost(F.col("found")), lambda x: x["no"]).alias("k")).collect()}
    assert got == want and got[0] == [0, 1] and got[1] == [0, 1, 2]
