"""The first look for refusals lets through whatever the patterns match."""

import random
import re._parser as parser

import pytest

from scoreloom.llm import pairrules as R


@pytest.mark.parametrize(
    "text",
    [
        "I am unwilling to help with this.", "I have to pass on writing this story.", "I have to steer clear of this.", "My training prevents that.", "My policy forbids this.",
        "Als Assistent kann ich das tun.", "No estoy autorizado a continuar", "No se me permite escribir", "Das ist einer sprachlichen языковой моделью", "Мы вынуждены отказаться",
    ],
)
def test_found(text):
    assert R.is_refusal(text, None)


def _one(items, rng):
    """A random string that a pattern matches, but for what its zero-width parts ask."""
    out = ""
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            out += chr(value)
        elif name in ("NOT_LITERAL", "ANY"):
            out += "~"
        elif name == "IN":
            kind, v = next((x for x in value if str(x[0]) == "LITERAL"), value[0]) if str(value[0][0]) != "NEGATE" else ("", 0)
            out += chr(v) if str(kind) == "LITERAL" else {"CATEGORY_WORD": "w", "CATEGORY_SPACE": " "}.get(str(v), "~")
        elif name == "SUBPATTERN":
            out += _one(value[3], rng)
        elif name == "BRANCH":
            out += _one(rng.choice(value[1]), rng)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(_one(value[2], rng) for _ in range(rng.randint(value[0], min(value[1], value[0] + 1))))
    return out


@pytest.mark.parametrize("pattern", R._REFUSALS)
def test_every_alternative_passes(pattern):
    rng = random.Random(0)
    for _ in range(3000):
        text = _one(parser.parse(pattern), rng)
        assert R._hinted(text) and R._hinted(text.upper()), text


def test_letters_without_case():
    assert R._hinted("İ HAVE TO STEER CLEAR OF THIS") and R._hinted("I WILL NOT") and R._hinted("aſ an aı")
