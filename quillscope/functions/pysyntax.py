"""The Python-side helper: tokens and syntax-tree counts of a chunk.

One Arrow UDF over a file's chunks calls the interpreter's own ``tokenize`` and
``ast`` once per chunk; no lexer or parser is written here.  It returns the
tokens and names, which features need as lists, and counts; the tree itself
stays in the worker.  Features are Catalyst expressions over the result (see
``operators/features``).
"""

from __future__ import annotations

import ast
import io
import sys
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .constants import ERR_TOO_DEEP, MAX_TREE_DEPTH, PY_COMMON_NUMBERS, PY_LAYOUT_TOKENS

COUNTS = ("functions", "documented", "loops", "tries", "magic_numbers", "bare_excepts", "nested_depth", "max_depth")
FLAGS = ("parseable", "main_guard", "comprehensions", "walrus", "f_strings", "annotated")
LISTS = ("tokens", "statements", "names")
SYNTAX_TYPE = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in COUNTS]
    + [T.StructField(n, T.BooleanType()) for n in FLAGS]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in LISTS]
    + [T.StructField("function_lengths", T.ArrayType(T.IntegerType())), T.StructField("error", T.StringType()),
       T.StructField("python_version", T.StringType())]
)
_ARROW_TYPE = to_arrow_type(T.ArrayType(SYNTAX_TYPE))
_LAYOUT = tuple(getattr(tokenize, name) for name in PY_LAYOUT_TOKENS)
try:  # what ``tokenize.generate_tokens`` reads
    from _tokenize import TokenizerIter as _TokenizerIter
except ImportError:
    _TokenizerIter = None
if sys.version_info < (3, 13):
    _TokenizerIter = None  # not compared with the module's own tokens there
_VERSION = f"{sys.version_info.major}.{sys.version_info.minor}"


def _message(exc: Exception) -> str:
    return f"{type(exc).__name__}: {exc}"


def token_strings(code: str) -> list[str]:
    """The tokens that are no layout.

    ``tokenize.generate_tokens`` makes a named tuple of what the interpreter's iterator yields; the iterator is
    read itself, with the same tokens and errors (a NUL aside, for which the generator alone fails)."""
    readline = io.StringIO(code).readline
    if _TokenizerIter is None or "\0" in code:
        return [t.string for t in tokenize.generate_tokens(readline) if t.type not in _LAYOUT and t.string]
    try:
        return [t[1] for t in _TokenizerIter(readline, extra_tokens=True) if t[0] not in _LAYOUT and t[1]]
    except SyntaxError as exc:
        if type(exc) is SyntaxError:  # not its kinds, as IndentationError
            raise tokenize.TokenError(exc.msg, (exc.lineno, exc.offset)) from None
        raise


def _guards_main(test: ast.expr) -> bool:
    match test:
        case ast.Compare(left=ast.Name(id="__name__"), ops=ops, comparators=sides):
            values = [side.value for side in sides if isinstance(side, ast.Constant)]
            return "__main__" in values and ast.Eq in map(type, ops)
    return False


def _function(node, fn_depth: int, out: dict) -> None:
    out["functions"] += 1
    out["documented"] += bool(ast.get_docstring(node))
    out["annotated"] |= node.returns is not None
    out["nested_depth"] = max(out["nested_depth"], fn_depth)
    out["function_lengths"].append(max(1, (node.end_lineno or node.lineno) - node.lineno + 1))
    out["names"].append(node.name)


def _argument(node, fn_depth: int, out: dict) -> None:
    out["names"].append(node.arg)
    out["annotated"] |= node.annotation is not None


def _constant(node, fn_depth: int, out: dict) -> None:
    if isinstance(node.value, int | float):
        out["magic_numbers"] += node.value not in PY_COMMON_NUMBERS


def _condition(node, fn_depth: int, out: dict) -> None:
    out["main_guard"] |= _guards_main(node.test)


def _named(field: str):
    return lambda node, fn_depth, out: out["names"].append(getattr(node, field))


def _counted(key: str, test=lambda node: True):
    def add(node, fn_depth: int, out: dict) -> None:
        out[key] += test(node)

    return add


def _flagged(key: str):
    return lambda node, fn_depth, out: out.__setitem__(key, True)


# What a node adds to the counts, by its type; most types add nothing.
_LOOKS = (
    {ast.FunctionDef: _function, ast.AsyncFunctionDef: _function, ast.ClassDef: _named("name"), ast.Name: _named("id"), ast.arg: _argument}
    | {ast.Constant: _constant, ast.If: _condition, ast.Try: _counted("tries"), ast.ExceptHandler: _counted("bare_excepts", lambda node: node.type is None)}
    | dict.fromkeys((ast.For, ast.While, ast.AsyncFor), _counted("loops"))
    | dict.fromkeys((ast.ListComp, ast.DictComp, ast.SetComp, ast.GeneratorExp), _flagged("comprehensions"))
    | {ast.NamedExpr: _flagged("walrus"), ast.JoinedStr: _flagged("f_strings")}
)


def children(node: ast.AST) -> list[ast.AST]:
    """``ast.iter_child_nodes`` as a list, without its generators."""
    found = []
    for field in node._fields:
        value = getattr(node, field, None)
        if type(value) is list:
            found += [item for item in value if isinstance(item, ast.AST)]
        elif isinstance(value, ast.AST):
            found.append(value)
    return found


class _Kinds(dict):
    """Per node type: what it adds, its name if it is a statement, whether it opens a function, whether nothing can hang below it."""

    def __missing__(self, kind: type) -> tuple:
        found = (_LOOKS.get(kind), kind.__name__ if issubclass(kind, ast.stmt) else None, issubclass(kind, (ast.FunctionDef, ast.AsyncFunctionDef)),
                 not kind._fields and kind not in _LOOKS and not issubclass(kind, ast.stmt))
        self[kind] = found
        return found


_KINDS = _Kinds()


def _walk(tree: ast.AST, out: dict) -> None:
    """Adds up what the tree's nodes add, level by level."""
    kinds, statements = _KINDS, out["statements"]
    level, depth = [(tree, 0)], 0
    while level:
        out["max_depth"] = depth
        below, deeper = [], False
        for node, fn_depth in level:
            look, statement, _, _ = kinds[type(node)]
            if look:
                look(node, fn_depth, out)
            if statement:
                statements.append(statement)
            for child in children(node):
                _, _, opens, bare = kinds[type(child)]
                if bare:  # an operator or a context: it counts for the depth only
                    deeper = True
                else:
                    below.append((child, fn_depth + opens))
        level, depth = below, depth + 1
        if deeper and not below:
            out["max_depth"] = depth


def examine(code: str | None) -> dict | None:
    """Tokens and tree counts of one chunk.

    A tokeniser that runs into the end of the chunk leaves it without tokens,
    and a syntax error without a tree; any other failure is its ``error``."""
    if code is None:
        return None
    out = dict.fromkeys(COUNTS, 0) | dict.fromkeys(FLAGS, False) | {n: [] for n in (*LISTS, "function_lengths")}
    out |= {"error": None, "python_version": _VERSION}
    try:
        out["tokens"] = token_strings(code)
    except tokenize.TokenError:
        pass
    except Exception as exc:  # IndentationError and friends fail the file
        out["error"] = _message(exc)
    try:
        tree = ast.parse(code)
    except SyntaxError:
        return out
    except Exception as exc:
        out["error"] = out["error"] or _message(exc)
        return out
    out["parseable"] = True
    _walk(tree, out)
    if out["max_depth"] > MAX_TREE_DEPTH:
        out["error"] = out["error"] or ERR_TOO_DEEP
    return out


# Ship these helpers by value: executors need not have this package installed.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the hook
    pass


#: Results leave the worker after so many characters of code, whatever the batch that Spark sends holds.
PIECE_CHARS = 1 << 20


def in_pieces(batch: pa.Array, size) -> Iterator[list]:
    """The values of a batch as Python objects, a bounded piece at a time; a larger value is a piece of its own."""
    piece, held = [], 0
    for value in batch:
        value = value.as_py()
        piece.append(value)
        held += 64 + (size(value) if value is not None else 0)
        if held >= PIECE_CHARS:
            yield piece
            piece, held = [], 0
    if piece:
        yield piece


@F.arrow_udf(T.ArrayType(SYNTAX_TYPE))
def _examine_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for files in in_pieces(batch, lambda chunks: sum(map(len, chunks))):
            yield pa.array([None if chunks is None else [examine(c) for c in chunks] for chunks in files], type=_ARROW_TYPE)


def python_syntax(chunks: Column) -> Column:
    """What the interpreter says of every chunk of an array."""
    return _examine_batches(chunks)
