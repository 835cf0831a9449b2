"""Tokens are read without named tuples, trees by levels, with the same results."""

import io
import random
import sys
import tokenize

import pytest
from pyspark.sql import functions as F

from quillscope.functions import pysyntax
from quillscope.functions.pytables import nodes
from snippets import AI_PYTHON, HUMAN_PYTHON

PARTS = ["def f(a):\n", "    x = 1\n", "  y\n", "(", ")", "'", '"""', "#c\n", "if a:\n", "\t", "lambda: 0\n", "@d\n", "é", "\\\n", "try:\n", "1.5", "[i for i in x]\n", " ", "\0", "\r"]


def _tokens(code):
    found = tokenize.generate_tokens(io.StringIO(code).readline)
    return [t.string for t in found if t.type not in pysyntax._LAYOUT and t.string]


def _outcome(tokens, code):
    try:
        return tokens(code)
    except Exception as exc:
        return type(exc), None if isinstance(exc, tokenize.TokenError) else str(exc)


def test_tokens_and_errors_are_those_of_the_module():
    rng = random.Random(31)
    codes = [AI_PYTHON, HUMAN_PYTHON, "", "\0", "x\0y", "'''a", "if a:\n\tb\n        c\n"]
    codes += ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    for code in codes:
        assert _outcome(pysyntax.token_strings, code) == _outcome(_tokens, code), code


@pytest.mark.skipif(sys.version_info < (3, 13), reason="older interpreters are read through the module")
def test_tokens_are_read_without_named_tuples(monkeypatch):
    expected = _tokens(AI_PYTHON)
    monkeypatch.setattr(tokenize, "generate_tokens", None)
    assert pysyntax.token_strings(AI_PYTHON) == expected


def test_nodes_without_anything_below_are_counted_by_depth_only(monkeypatch, spark):
    looked = []
    monkeypatch.setattr(pysyntax, "children", lambda node, f=pysyntax.children: looked.append(type(node).__name__) or f(node))
    codes = ["x", "pass", "a + b", "def f():\n  def g(): return not a\n  yield", "-" * 30 + "1", AI_PYTHON, HUMAN_PYTHON]
    found = [pysyntax.examine(c) for c in codes]
    assert "Name" in looked and not {"Load", "Store", "Add"} & set(looked)
    table = nodes(spark.createDataFrame(list(enumerate(codes)), "file_id long, chunk string"))
    deepest = {r.file_id: r.d for r in table.groupBy("file_id").agg(F.max("depth").alias("d")).collect()}
    assert [f["max_depth"] for f in found] == [deepest[i] for i in range(len(codes))]
