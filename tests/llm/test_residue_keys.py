import re
from re import _constants as sre
from re import _parser

import pytest

from glossaflow.llm import residue as R

MISSED = [
    "405 Method Not Allowed", "409 Conflict", "402 Payment Required", "You do not have permission to view this.", "We are not able to show this article", "Register to read this article", "This page is currently not available", "Veuillez vous connecter", "The page you tried to open", "Code 404", "Ocorreu um erro.", "Erro: 503",
    "consectetur adipiscing elit sed ut", "( insert name )", "[5 items here later]",
]


def examples(parsed, groups):
    """Texts in which each choice of a parsed pattern is made at least once."""
    parts = []
    for op, x in parsed:
        if op is sre.LITERAL:
            part = [chr(x)]
        elif op is sre.IN:
            kind, value = x[0]
            part = [" "] if kind is sre.NEGATE else [chr(value) if kind is sre.LITERAL else chr(value[0]) if kind is sre.RANGE else {sre.CATEGORY_SPACE: " ", sre.CATEGORY_DIGIT: "4", sre.CATEGORY_WORD: "q", sre.CATEGORY_NOT_WORD: " ", sre.CATEGORY_NOT_SPACE: "q"}[value]]
        elif op is sre.BRANCH:
            part = [e for y in x[1] for e in examples(y, groups)]
        elif op is sre.SUBPATTERN:
            part = groups[x[0]] = examples(x[-1], groups)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            part = [e * max(1, x[0]) for e in examples(x[2], groups)] + [""] * (x[0] == 0)
        elif op is sre.GROUPREF:
            part = groups[x]
        else:
            part = ["q" if op is sre.ANY else ""]
        parts.append(part)
    return ["".join(p[i % len(p)] for p in parts) for i in range(max(map(len, parts), default=1))]


@pytest.mark.parametrize("text", MISSED)
def test_evidence_without_a_listed_key(text):
    assert R.pieces(text) and R.pieces("Some real content here. " + text)


@pytest.mark.parametrize("pattern", [*R.FIELDS, *R.FILLER, *R.ERRORS, *R.SCRIPTS])
def test_each_alternative_passes(pattern):
    texts = [t for e in examples(_parser.parse(pattern, re.A), {}) for t in (e, e + ".") if re.search(pattern, t, re.A)]
    assert texts
    assert [t for t in texts if not R.pieces(t)] == []
