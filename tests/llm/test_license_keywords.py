"""Prefilters of the licence rules: no match of a pattern may lack its keyword or the gate."""

import itertools
import re
from re import _parser

from staveforge.llm import licenses


def matches(tree):
    """Texts of every branch and option of a pattern; one character for a class."""
    parts = []
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(arg)])
        elif name == "IN":
            parts.append([chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])])
        elif name == "SUBPATTERN":
            parts.append(matches(arg[3]))
        elif name == "BRANCH":
            parts.append([x for b in arg[1] for x in matches(b)])
        elif name == "MAX_REPEAT":
            low, high, inner = arg
            parts.append([x * n for n in {low, max(low, 1)} for x in matches(inner)])
        else:
            raise ValueError(name)
    return ["".join(p) for p in itertools.product(*parts)]


def test_matches_hold_their_keyword_and_pass_the_gate():
    wrong = {(r[0], r[2], r[3]) for r in licenses.rules() for x in matches(_parser.parse(r[3])) if r[2] not in f" {x} " or not re.search(licenses._GATE, f" {x} ")}
    assert not wrong


def test_gnu_notices_without_the_foundation(spark):
    rows = [(i, f"You can redistribute it and/or modify it under the terms of the GNU {x} Public License, version 3.") for i, x in enumerate(("General", "Lesser General", "Affero General"))]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "license.*").collect()
    assert len(got) == 3 and all(abs(r.score - 0.9) < 1e-9 for r in got)
