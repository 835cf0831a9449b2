"""Python syntax as tables: ``py_nodes(code)`` and ``py_tokens(code)`` under LATERAL.

Both are Arrow table functions around the interpreter's own ``ast`` and
``tokenize``.  ``register(spark)`` makes them known to SQL:

    SELECT c.file_id, n.* FROM chunks c LEFT JOIN LATERAL py_nodes(c.chunk) n ON true

Code that does not parse has no node rows, code that the tokeniser refuses no
token rows, and null neither.
"""

from __future__ import annotations

import ast
import sys
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import pysyntax
from .pysyntax import _guards_main, children, in_pieces, token_strings

NODE_SCHEMA = (
    "bfs_pos int, parent_pos int, depth int, fn_depth int, kind string, is_stmt boolean, name string, lineno int, "
    "end_lineno int, has_doc boolean, annotated boolean, num_value double, is_main_guard boolean, bare_except boolean"
)
TOKEN_SCHEMA = "pos int, token string"


_NOTHING = (None, False, False, None, False, False)


def _number(node: ast.Constant) -> tuple:
    if not isinstance(node.value, int | float):
        return _NOTHING
    try:
        return (None, False, False, float(node.value), False, False)
    except OverflowError:  # an integer beyond all doubles is no common number either
        return (None, False, False, float("inf"), False, False)


def _function(node: ast.FunctionDef | ast.AsyncFunctionDef) -> tuple:
    return (node.name, bool(ast.get_docstring(node)), node.returns is not None, None, False, False)


# What features read of a node, by its type: name, has_doc, annotated, num_value, is_main_guard, bare_except.
_READ = {
    ast.FunctionDef: _function,
    ast.AsyncFunctionDef: _function,
    ast.ClassDef: lambda node: (node.name, *_NOTHING[1:]),
    ast.Name: lambda node: (node.id, *_NOTHING[1:]),
    ast.arg: lambda node: (node.arg, False, node.annotation is not None, None, False, False),
    ast.Constant: _number,
    ast.If: lambda node: (*_NOTHING[:4], _guards_main(node.test), False),
    ast.ExceptHandler: lambda node: (*_NOTHING[:5], node.type is None),
}


def _node_row(node: ast.AST, place: tuple[int, int | None, int, int]) -> tuple:
    """One node: its place in the tree, and what features read of it."""
    kind = type(node)
    name, *others = _READ[kind](node) if kind in _READ else _NOTHING
    return (*place, kind.__name__, isinstance(node, ast.stmt), name, getattr(node, "lineno", None), getattr(node, "end_lineno", None), *others)


class PyNodes:
    """A row per node of the syntax tree, in breadth-first order."""

    def eval(self, code: str) -> Iterator[tuple]:
        try:
            tree = ast.parse(code) if code is not None else None
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return
        queue, position = deque([(tree, None, 0, 0)] if tree is not None else []), 0
        while queue:
            node, parent, depth, inside = queue.popleft()
            inside += isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef))
            yield _node_row(node, (position, parent, depth, inside))
            queue.extend((child, position, depth + 1, inside) for child in children(node))
            position += 1


class PyTokens:
    """A row per token, layout and comments left out."""

    def eval(self, code: str) -> Iterator[tuple]:
        try:
            found = token_strings(code) if code is not None else []
        except Exception:  # what the tokeniser refuses has no tokens
            return
        yield from enumerate(found)


def register(spark: SparkSession) -> None:
    """Makes py_nodes and py_tokens known to the session's SQL."""
    spark.udtf.register("py_nodes", F.udtf(PyNodes, returnType=NODE_SCHEMA, useArrow=True))
    spark.udtf.register("py_tokens", F.udtf(PyTokens, returnType=TOKEN_SCHEMA, useArrow=True))


# The same rows as arrays, for whole batches of code: a table function is called, and answers, row by row.

def _in_batches(table, schema: str):
    """An Arrow UDF that returns the rows ``table`` has for each code, as arrays of structs built column by column."""
    fields = T.StructType.fromDDL(schema)
    types = [to_arrow_type(f.dataType) for f in fields]
    names = fields.names

    @F.arrow_udf(T.ArrayType(fields))
    def rows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for codes in in_pieces(batch, len):
                found, ends = [], [0]
                for code in codes:
                    found += table(code)
                    ends.append(len(found))
                columns = list(zip(*found)) or [()] * len(types)
                structs = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)

    return rows


def nodes(chunks: DataFrame, code: str = "chunk") -> DataFrame:
    """The columns of ``chunks`` but its code, and a row per node; a chunk that does not parse has one row without a node."""
    return _rows(chunks, code, _in_batches(lambda c: list(PyNodes().eval(c)), NODE_SCHEMA))


def tokens(chunks: DataFrame, code: str = "chunk") -> DataFrame:
    """The columns of ``chunks`` but its code, and a row per token; a chunk without tokens has one row without a token."""
    return _rows(chunks, code, _in_batches(lambda c: list(PyTokens().eval(c)), TOKEN_SCHEMA))


def token_counts(chunks: DataFrame, code: str = "chunk") -> DataFrame:
    """The token table with equal tokens of a chunk as one row, and their number ``n``; a chunk without tokens has one row without a token."""
    return _rows(chunks, code, _in_batches(lambda c: list(Counter(t for _, t in PyTokens().eval(c)).items()), "token string, n long"))


def _rows(chunks: DataFrame, code: str, table) -> DataFrame:
    return chunks.select(*(c for c in chunks.columns if c != code), F.inline_outer(table(F.col(code))))


try:  # ship these helpers by value: executors need not have this package installed
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
    _cloudpickle.register_pickle_by_value(pysyntax)
except Exception:  # pragma: no cover - older cloudpickle without the hook
    pass
