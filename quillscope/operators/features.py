"""Chunk features (sections E, G, H, J of the inventory) as Catalyst expressions
over the structs of a file's chunk array.

Every function takes ``row``, the struct of one chunk: ``chunk``, ``lines``
(``str.splitlines``), ``tokens`` (language tokens) and, for Python chunks,
``syn`` (counts and names of the syntax tree, and errors).  All chunks of a
file stay in the file's row, so nothing here shuffles.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.pysyntax import SYNTAX_TYPE, python_syntax
from ..functions.regex import java_regex
from ..functions.text import (
    clamp,
    count_where,
    dominant_ratio,
    entropy,
    leading_spaces,
    once,
    pattern_repetition,
    py_lstrip,
    py_rstrip,
    py_strip,
    stripped_startswith,
    quote_consistency,
    safe_ratio,
    saturate,
    split_lines,
    stddev_pop_of,
    sum_of,
)

PY, JS = "python", "javascript"

# Feature columns of the wide result schema, in output order.
LONG_FEATURES = [
    "total_lines",
    "non_empty_lines",
    "token_count",
    "function_count",
    "loop_count",
    "try_except_count",
    "max_ast_depth",
]
SUM_FEATURES = LONG_FEATURES[:-1]
MAX_FEATURES = ["max_ast_depth"]

PY_BOOL = [
    "parseable", "has_main_guard", "has_docstrings", "uses_comprehensions", "uses_walrus_operator",
    "uses_f_strings", "uses_type_hints", "has_todo_comments", "has_debug_prints", "has_commented_code",
    "has_magic_numbers", "has_long_lines", "has_trailing_whitespace",
]
PY_DOUBLE = [
    "blank_line_ratio", "token_entropy", "comment_ratio", "avg_line_length", "line_length_variance",
    "line_length_uniformity", "docstring_coverage", "import_organization_score", "nested_function_depth",
    "function_length_variance", "function_length_variance_score", "naming_consistency_score",
    "uses_snake_case_ratio", "meaningful_name_ratio", "single_letter_var_ratio", "avg_name_length",
    "pattern_repetition_score", "indentation_consistency", "quote_consistency", "todo_comment_score",
    "debug_print_score", "commented_code_score", "magic_number_score", "long_line_score",
    "trailing_whitespace_score", "bare_except_score", "generic_example_score", "example_usage_score",
    "placeholder_score", "over_explanation_score",
]
JS_BOOL = [
    "uses_arrow_functions", "uses_async_await", "uses_destructuring", "uses_template_literals",
    "uses_spread_operator", "uses_optional_chaining", "has_iife", "import_export_usage", "uses_strict_mode",
    "has_console_log", "has_debugger", "has_todo_comments", "has_commented_code", "has_alert", "has_eval",
    "has_var_declarations", "has_long_lines", "has_callback_hell", "uses_jquery", "uses_react_patterns",
    "uses_node_patterns", "uses_typescript_patterns",
]
JS_DOUBLE = [
    "blank_line_ratio", "token_entropy", "comment_ratio", "avg_line_length", "line_length_variance",
    "line_length_uniformity", "function_style_consistency", "pattern_repetition_score",
    "uses_camel_case_ratio", "uses_snake_case_ratio", "meaningful_name_ratio", "single_letter_var_ratio",
    "avg_name_length", "naming_consistency_score", "semicolon_consistency", "quote_consistency",
    "indentation_consistency", "console_log_score", "debugger_score", "todo_comment_score",
    "commented_code_score", "alert_score", "eval_score", "var_declaration_score", "callback_hell_score",
    "jquery_score", "long_line_score", "generic_example_score", "example_usage_score", "placeholder_score",
    "excessive_comments_ratio",
]
JS_STRING = ["module_pattern"]


def _dedupe(names):
    seen, out = set(), []
    for n in names:
        if n not in seen:
            seen.add(n)
            out.append(n)
    return out


BOOL_FEATURES = _dedupe(PY_BOOL + JS_BOOL)
DOUBLE_FEATURES = _dedupe(PY_DOUBLE + JS_DOUBLE)
STRING_FEATURES = JS_STRING
ALL_FEATURES = LONG_FEATURES + BOOL_FEATURES + DOUBLE_FEATURES + STRING_FEATURES


# Literals every match of a pattern contains (any one of them).  A native
# substring test skips the regex scan on chunks that cannot match; only
# case-sensitive patterns are listed.
REQUIRED_LITERALS = {
    id(K.JS_PATTERNS): {
        "function_word": ["function"], "arrow": ["=>"], "try": ["try"], "loop": ["for", "while", "do"],
        "async_await": ["async", "await"], "destructuring": ["const", "let"], "template_literal": ["`"],
        "iife": ["function"], "import_export": ["import", "export"], "strict_mode": ["use strict"],
        "function_named": ["function"], "function_anonymous": ["function"], "console": ["console."],
        "debugger": ["debugger"], "todo": ["//"], "commented_code": ["//"], "alert": ["alert"], "eval": ["eval"],
        "var": ["var"], "jquery_call": ["$", "jQuery"], "jquery_require": ["require"],
        "callback_hell": ["function"], "commonjs": ["exports"], "es6": ["export", "import"],
        "react": ["useState", "useEffect", "React.", "jsx", "className="],
        "node": ["require", "module.exports", "process.", "__dirname", "__filename"],
        "typescript": ["@param", "@returns", "interface", "string", "number", "boolean"],
    },
    id(K.PY_PATTERNS): {"todo": ["#"], "commented_code": ["#"], "debug": ["print", "breakpoint"]},
}


# Characters that matches begin with (a class body), where a pattern does not begin with one literal.
STARTS = {
    id(K.JS_PATTERNS): {
        "function_word": "f", "loop": "fwd", "try": "t", "async_await": "a", "destructuring": "cl", "function_named": "f",
        "function_anonymous": "f", "debugger": "d", "alert": "a", "eval": "e", "var": "v", "jquery_call": "$j",
        "react": "uRjc", "node": "rmp_", "typescript": "@:i", "generic": "fbesdthm", "example_usage": "esdm", "placeholder": "tfirym",
    },
    id(K.PY_PATTERNS): {"debug": "pb", "generic": "fbesdth", "example_usage": "esd", "placeholder": "tfiryms"},
}
# The same for patterns that ignore case: literals in small letters, looked for in the lower-cased chunk.
FOLDED_LITERALS = {
    id(K.JS_PATTERNS): {
        "generic": ["foo", "bar", "baz", "example", "sample", "demo", "tutorial", "helper", "myfunction", "myvariable"],
        "example_usage": ["example", "sample", "demo", "mock"], "placeholder": ["todo", "fixme", "insert", "replace", "your-", "my-"],
        "todo": ["todo", "fixme", "hack", "xxx", "bug"],
    },
    id(K.PY_PATTERNS): {
        "generic": ["foo", "bar", "baz", "example", "sample", "demo", "tutorial", "helper"], "example_usage": ["example", "sample", "demo"],
        "placeholder": ["todo", "fixme", "insert", "replace", "your_", "my_", "some_"], "todo": ["todo", "fixme", "hack", "xxx", "bug", "refactor"],
    },
}
# Characters beyond ASCII that a pattern which ignores case takes for i, k or s.
FOLDED_TO_ASCII = "\u0130\u0131\u017f\u212a"
JS_TOKEN_REGEX = java_regex(K.JS_TOKEN)
JS_STRING_REGEX = java_regex(K.JS_STRING, starts="'\"`")
JS_KEYWORDS_REGEX = java_regex(K.JS_KEYWORDS, starts="cfilrtvw")
JS_DO_REGEX = java_regex(r"\bdo\b", starts="d")  # the one word of the pattern ``loop`` that is no keyword of JS_KEYWORDS
JS_NAME_DECLARED_REGEX = java_regex(K.JS_NAME_DECLARED, starts="cflv")
# What follows a name or a blank begins with neither, so nothing that these took is given back.
JS_NAME_ARROW_REGEX = java_regex(K.JS_NAME_ARROW.replace("*)\\s*", "*+)\\s*+"), starts="A-Za-z_$")


def _contains_any(text: Column, literals) -> Column:
    return reduce(or_, (text.contains(lit) for lit in literals))


def _may_match(pattern_key, table, text: Column, lower: Column | None = None):
    literals = REQUIRED_LITERALS.get(id(table), {}).get(pattern_key)
    test = _contains_any(text, literals) if literals else None
    folded = FOLDED_LITERALS[id(table)].get(pattern_key)
    if lower is None or folded is None:
        return test
    # ``lower`` is null where the chunk has a character that only a pattern takes for a letter.
    may = lower.isNull() | _contains_any(lower, folded)
    return may if test is None else test & may


def _folded(text: Column) -> Column:
    """The text in small letters; null if it has one of FOLDED_TO_ASCII."""
    return F.when(~_contains_any(text, FOLDED_TO_ASCII), F.lower(text))


def _pattern(pattern_key, table) -> str:
    return java_regex(*table[pattern_key], STARTS[id(table)].get(pattern_key, ""))


def _count(pattern_key, table, text: Column, lower: Column | None = None) -> Column:
    """Matches in ``text``; ``lower``, its :func:`_folded`, spares most texts the patterns that ignore case."""
    n = F.regexp_count(text, F.lit(_pattern(pattern_key, table)))
    gate = _may_match(pattern_key, table, text, lower)
    return n if gate is None else F.when(gate, n).otherwise(F.lit(0))


def _has(pattern_key, table, text: Column) -> Column:
    hit = text.rlike(_pattern(pattern_key, table))
    gate = _may_match(pattern_key, table, text)
    return hit if gate is None else (gate & hit)


def _starts_with(line: Column, *prefixes: str) -> Column:
    """``line.strip().startswith(prefixes)``."""
    return stripped_startswith(line, *prefixes)


# ---------------------------------------------------------------------------
# Common text metrics
# ---------------------------------------------------------------------------

def _trimmed(row: Column) -> dict:
    """Stage 1: every line without the blanks before it (``left``) and after it (``right``)."""
    return {"_trim": F.transform(row["lines"], lambda l: F.struct(l.alias("line"), py_lstrip(l).alias("left"), py_rstrip(l).alias("right")))}


def _common_arrays(row: Column) -> dict:
    """Intermediate arrays shared by both languages (stage 2)."""
    trim = row["_trim"]
    nonblank = F.filter(trim, lambda z: z["left"] != "")
    return {
        "_folded": _folded(row["chunk"]),
        "_nb_len": F.transform(nonblank, lambda z: F.length(z["right"])),
        "_indents": F.filter(F.transform(nonblank, lambda z: leading_spaces(z["line"])), lambda n: n > 0),
        "_long_n": count_where(trim, lambda z: F.length(z["right"]) > K.LONG_LINE_CHARS),
    }


def _common_counts(row: Column) -> dict:
    """Stage 3: numbers that several features read."""
    lengths = row["_nb_len"]
    return {"_avg_len": safe_ratio(sum_of(lengths), F.size(lengths)), "_std_len": stddev_pop_of(lengths)}


def _pattern_counts(names, table, row: Column) -> dict:
    return {f"_n_{name}": _count(name, table, row["chunk"], row["_folded"]) for name in names}


def _text_metrics(row: Column, comment_lines: Column) -> dict:
    lines = row["lines"]
    tokens = row["tokens"]
    total = F.size(lines)
    lengths = row["_nb_len"]
    n_nonblank = F.size(lengths)
    avg_len, std_len = row["_avg_len"], row["_std_len"]
    return {
        "total_lines": total.cast("long"),
        "non_empty_lines": n_nonblank.cast("long"),
        "blank_line_ratio": safe_ratio(total - n_nonblank, total),
        "token_count": F.size(tokens).cast("long"),
        "token_entropy": entropy(tokens),
        "comment_ratio": safe_ratio(comment_lines, total),
        "avg_line_length": avg_len,
        "line_length_variance": std_len,
        "line_length_uniformity": F.lit(1.0) - clamp(safe_ratio(std_len, F.when(avg_len == 0, F.lit(1.0)).otherwise(avg_len))),
    }


def _divisible_by(width: int):
    return lambda x: x % F.lit(width) == 0


def indentation_consistency(indents: Column, widths) -> Column:
    """Share of space indents divisible by the best of ``widths``."""
    n = F.size(indents)
    shares = [count_where(indents, _divisible_by(w)) / n for w in widths]
    best = shares[0] if len(shares) == 1 else F.greatest(*shares)
    return F.when(n == 0, F.lit(0.0)).otherwise(best.cast("double"))


# ---------------------------------------------------------------------------
# Python (E5, E12, E13, E15, G1-G16, H1-H6)
# ---------------------------------------------------------------------------

def import_organization(lines: Column) -> Column:
    """Share of islands of adjacent import lines that are in code-point order."""
    imports = F.filter(
        F.transform(lines, lambda l, i: F.struct(i.alias("i"), l.alias("l"))),
        lambda s: _starts_with(s["l"], "import ", "from "),
    )
    imports = F.transform(imports, lambda s: F.struct(s["i"].alias("i"), py_strip(s["l"]).alias("s")))
    init = F.struct(
        F.lit(0).alias("groups"),
        F.lit(0).alias("ordered"),
        F.lit(-2).alias("prev_i"),
        F.lit(None).cast("string").alias("prev_s"),
        F.lit(True).alias("cur_ordered"),
    )

    def step(acc, x):
        adjacent = x["i"] - acc["prev_i"] == 1
        return F.when(
            adjacent,
            F.struct(
                acc["groups"].alias("groups"),
                acc["ordered"].alias("ordered"),
                x["i"].alias("prev_i"),
                x["s"].alias("prev_s"),
                (acc["cur_ordered"] & (acc["prev_s"] <= x["s"])).alias("cur_ordered"),
            ),
        ).otherwise(
            F.struct(
                F.when(acc["prev_s"].isNull(), acc["groups"]).otherwise(acc["groups"] + 1).alias("groups"),
                F.when(acc["prev_s"].isNotNull() & acc["cur_ordered"], acc["ordered"] + 1)
                .otherwise(acc["ordered"]).alias("ordered"),
                x["i"].alias("prev_i"),
                x["s"].alias("prev_s"),
                F.lit(True).alias("cur_ordered"),
            )
        )

    def finish(acc):
        groups = acc["groups"] + 1
        ordered = F.when(acc["cur_ordered"], acc["ordered"] + 1).otherwise(acc["ordered"])
        return ordered.cast("double") / groups

    return once(imports, lambda found: F.when(F.size(found) < 2, F.lit(0.0)).otherwise(F.aggregate(found, init, step, finish)))


def _islower(x: Column) -> Column:
    return (F.lower(x) == x) & (F.upper(x) != x)


def _isupper(x: Column) -> Column:
    return (F.upper(x) == x) & (F.lower(x) != x)


SNAKE = "^[a-z_][a-z0-9_]*\\z"
CAMEL = "^[a-z][a-zA-Z0-9]*\\z"


def _naming(names: Column, counts, stop_names, exempt: str, order) -> dict:
    n = F.size(names)
    ratio = lambda c: F.when(n == 0, F.lit(0.0)).otherwise(c.cast("double") / n)
    meaningful = count_where(names, lambda x: (F.length(x) > 3) & ~F.lower(x).isin(*stop_names))
    single = count_where(names, lambda x: (F.length(x) == 1) & ~x.isin(*list(exempt)))
    avg_len = F.when(n == 0, F.lit(0.0)).otherwise(sum_of(names, lambda x: F.length(x)) / n)
    out = {
        "meaningful_name_ratio": ratio(meaningful),
        "single_letter_var_ratio": ratio(single),
        "avg_name_length": avg_len,
        "naming_consistency_score": F.when(n == 0, F.lit(0.0)).otherwise(dominant_ratio(*[counts[k] for k in order])),
    }
    return out


def python_arrays(row: Column) -> dict:
    """Stage-2 intermediates of a Python chunk."""
    trim = row["_trim"]
    arrays = _common_arrays(row)
    arrays.update(
        {
            "_comments": F.transform(F.filter(trim, lambda z: F.startswith(z["left"], F.lit("#"))), lambda z: F.length(py_rstrip(z["left"]))),
            "_strings": F.filter(row["tokens"], lambda t: F.substring(t, 1, 1).isin("'", '"')),
            "_trailing_n": count_where(trim, lambda z: z["right"] != z["line"]),
            "_imports": F.when(row["syn"]["parseable"], import_organization(row["lines"])).otherwise(F.lit(0.0)),
        }
    )
    return arrays


def python_counts(row: Column) -> dict:
    """Stage-3 numbers of a Python chunk."""
    names, comments = row["syn"]["names"], row["_comments"]
    n_comment = F.size(comments)
    return _common_counts(row) | _pattern_counts(K.PY_PATTERNS, K.PY_PATTERNS, row) | {
        "_snake": count_where(names, lambda x: x.rlike(SNAKE)),
        "_lower": count_where(names, lambda x: _islower(x) & ~x.contains("_")),
        "_upper": count_where(names, lambda x: _isupper(x)),
        "_fn_std": stddev_pop_of(row["syn"]["function_lengths"]),
        "_avg_comment": F.when(n_comment == 0, F.lit(0.0)).otherwise(sum_of(comments) / n_comment),
    }


def python_features(row: Column) -> dict:
    syn = row["syn"]
    parseable = F.coalesce(syn["parseable"], F.lit(False))

    comments = row["_comments"]
    n_comment = F.size(comments)
    f = _text_metrics(row, n_comment)

    n_fns = syn["functions"]
    documented = syn["documented"]
    fn_std = row["_fn_std"]
    names = syn["names"]
    snake = row["_snake"]
    naming = _naming(names, {k: row[f"_{k}"] for k in ("snake", "lower", "upper")}, K.PY_STOP_NAMES,
                     K.PY_EXEMPT_LETTERS, ["snake", "lower", "upper"])
    n_names = F.size(names)

    todo, debug, ccode = row["_n_todo"], row["_n_debug"], row["_n_commented_code"]
    trailing = row["_trailing_n"]
    long_n = row["_long_n"]
    magic = syn["magic_numbers"]
    bare = syn["bare_excepts"]
    avg_comment = row["_avg_comment"]

    f.update(
        {
            "parseable": parseable,
            "function_count": n_fns.cast("long"),
            "loop_count": syn["loops"].cast("long"),
            "try_except_count": syn["tries"].cast("long"),
            "max_ast_depth": F.coalesce(syn["max_depth"], F.lit(0)).cast("long"),
            "has_main_guard": syn["main_guard"],
            "has_docstrings": documented > 0,
            "docstring_coverage": F.when(n_fns == 0, F.lit(0.0)).otherwise(documented / n_fns),
            "uses_comprehensions": syn["comprehensions"],
            "uses_walrus_operator": syn["walrus"],
            "uses_f_strings": syn["f_strings"],
            "uses_type_hints": syn["annotated"],
            "import_organization_score": F.coalesce(row["_imports"], F.lit(0.0)),
            "nested_function_depth": syn["nested_depth"].cast("double"),
            "function_length_variance": fn_std,
            "function_length_variance_score": saturate(fn_std, 10.0),
            "naming_consistency_score": naming["naming_consistency_score"],
            "uses_snake_case_ratio": F.when(n_names == 0, F.lit(0.0)).otherwise(snake / n_names),
            "meaningful_name_ratio": naming["meaningful_name_ratio"],
            "single_letter_var_ratio": naming["single_letter_var_ratio"],
            "avg_name_length": naming["avg_name_length"],
            "pattern_repetition_score": pattern_repetition(syn["statements"]),
            "indentation_consistency": indentation_consistency(row["_indents"], K.PY_INDENT_WIDTHS),
            "quote_consistency": quote_consistency(row["_strings"]),
            "has_todo_comments": todo > 0,
            "has_debug_prints": debug > 0,
            "has_commented_code": ccode > 0,
            "has_magic_numbers": magic > 0,
            "has_long_lines": long_n > 0,
            "has_trailing_whitespace": trailing > 0,
            "todo_comment_score": saturate(todo, 2.0),
            "debug_print_score": saturate(debug, 2.0),
            "commented_code_score": saturate(ccode, 2.0),
            "magic_number_score": saturate(magic, 6.0),
            "long_line_score": saturate(long_n, 3.0),
            "trailing_whitespace_score": saturate(trailing, 2.0),
            "bare_except_score": saturate(bare, 2.0),
            "generic_example_score": saturate(row["_n_generic"], 3.0),
            "example_usage_score": saturate(row["_n_example_usage"], 4.0),
            "placeholder_score": saturate(row["_n_placeholder"], 3.0),
            "over_explanation_score": saturate(avg_comment, 70.0) * saturate(n_comment, 4.0),
        }
    )
    return f


# ---------------------------------------------------------------------------
# JavaScript
# ---------------------------------------------------------------------------

def js_comment_lines(lines: Column) -> Column:
    """Lines that start ``//`` or ``/*`` or lie inside an open block comment."""
    return _comment_lines(F.transform(lines, lambda l: py_lstrip(l)))


def _comment_lines(lefts: Column) -> Column:
    init = F.struct(F.lit(0).alias("n"), F.lit(False).alias("open"))

    def step(acc, l):
        blank = l == ""
        closes = l.contains("*/")
        return (
            F.when(blank, acc)
            .when(acc["open"], F.struct((acc["n"] + 1).alias("n"), (~closes).alias("open")))
            .when(F.startswith(l, F.lit("//")), F.struct((acc["n"] + 1).alias("n"), F.lit(False).alias("open")))
            .when(F.startswith(l, F.lit("/*")), F.struct((acc["n"] + 1).alias("n"), (~closes).alias("open")))
            .otherwise(acc)
        )

    return F.aggregate(lefts, init, step, lambda acc: acc["n"])


# Comments and string literals as the brace scanner sees them: a quote not
# preceded by a backslash opens a string that the next such quote closes.
_QUOTED = "|".join(f"(?<!\\\\){q}(?:.*?(?<!\\\\){q}|.*\\z)" for q in ("'", '"', "`"))
BRACE_MASK = "(?s)(?=[/'\"`])(?://[^\\n]*|/(?=\\*).*?(?:\\*/|\\z)|" + _QUOTED + ")"


def brace_depth(code: Column) -> Column:
    """Deepest ``{`` nesting outside comments and strings, depth floored at 0."""
    braces = F.regexp_extract_all(F.regexp_replace(code, F.lit(BRACE_MASK), F.lit("")), F.lit("[{}]"), 0)
    init = F.struct(F.lit(0).alias("d"), F.lit(0).alias("best"))

    def step(acc, b):
        d = F.when(b == F.lit("{"), acc["d"] + 1).otherwise(F.greatest(acc["d"] - 1, F.lit(0)))
        return F.struct(d.alias("d"), F.greatest(acc["best"], d).alias("best"))

    return F.when(~code.contains("{"), F.lit(0)).otherwise(F.aggregate(braces, init, step, lambda acc: acc["best"]))


def js_names(code: Column) -> Column:
    return F.concat(
        F.regexp_extract_all(code, F.lit(JS_NAME_DECLARED_REGEX), 1),
        F.when(~code.contains("=>"), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(code, F.lit(JS_NAME_ARROW_REGEX), 1)),
    )


def javascript_arrays(row: Column) -> dict:
    """Stage-2 intermediates of a JavaScript chunk."""
    code = row["chunk"]
    trim = row["_trim"]
    opens = lambda z, *prefixes: reduce(or_, (F.startswith(z["left"], F.lit(p)) for p in prefixes))
    arrays = _common_arrays(row)
    arrays.update(
        {
            "_comment_n": _comment_lines(trim["left"]),
            "_names": js_names(code),
            "_strings": F.regexp_extract_all(code, F.lit(JS_STRING_REGEX), 0),
            "_keywords": F.regexp_extract_all(code, F.lit(JS_KEYWORDS_REGEX), 1),
            "_line_comments": count_where(trim, lambda z: opens(z, "//")),
            "_candidates": F.exists(
                trim,
                lambda z: (z["left"] != "")
                & ~opens(z, "//", "/*", "*")
                & ~F.substring(z["right"], -1, 1).isin("{", "}", ",", ":", ";"),
            ),
            "_depth": brace_depth(code),
        }
    )
    return arrays


JS_COUNTED = (
    "function_named", "function_anonymous", "arrow", "console", "debugger", "todo", "commented_code", "alert", "eval",
    "var", "callback_hell", "jquery_call", "jquery_require", "generic", "example_usage", "placeholder",
)


def javascript_counts(row: Column) -> dict:
    """Stage-3 numbers of a JavaScript chunk."""
    names = row["_names"]
    return _common_counts(row) | _pattern_counts(JS_COUNTED, K.JS_PATTERNS, row) | {
        "_camel": count_where(names, lambda x: x.rlike(CAMEL)),
        "_snake": count_where(names, lambda x: x.rlike(SNAKE)),
        "_plain": count_where(names, lambda x: _islower(x) & ~x.contains("_") & ~x.contains("$")),
        # The keywords' pattern found these words already, each where its own pattern would.
        "_n_function_word": count_where(row["_keywords"], lambda x: x == "function"),
        "_n_try": count_where(row["_keywords"], lambda x: x == "try"),
        "_n_for_while": count_where(row["_keywords"], lambda x: x.isin("for", "while")),
    }


def javascript_features(row: Column) -> dict:
    code = row["chunk"]
    P = K.JS_PATTERNS
    f = _text_metrics(row, row["_comment_n"])

    names = row["_names"]
    n_names = F.size(names)
    camel, snake = row["_camel"], row["_snake"]
    naming = _naming(names, {k: row[f"_{k}"] for k in ("camel", "snake", "plain")}, K.JS_STOP_NAMES,
                     K.JS_EXEMPT_LETTERS, ["camel", "snake", "plain"])

    counts = {k: row[f"_n_{k}"] for k in ("function_word", *JS_COUNTED)}
    named = counts["function_named"]
    anonymous = counts["function_anonymous"] - named
    arrows = counts["arrow"]
    line_comments = row["_line_comments"]
    jquery = counts["jquery_call"] + counts["jquery_require"]
    long_n = row["_long_n"]

    f.update(
        {
            "function_count": (counts["function_word"] + arrows).cast("long"),
            "loop_count": (row["_n_for_while"] + F.when(code.contains("do"), F.regexp_count(code, F.lit(JS_DO_REGEX))).otherwise(F.lit(0))).cast("long"),
            "try_except_count": row["_n_try"].cast("long"),
            "max_ast_depth": row["_depth"].cast("long"),
            "uses_arrow_functions": code.contains("=>"),
            "uses_async_await": _has("async_await", P, code),
            "uses_destructuring": _has("destructuring", P, code),
            "uses_template_literals": _has("template_literal", P, code),
            "uses_spread_operator": code.contains("..."),
            "uses_optional_chaining": code.contains("?."),
            "has_iife": _has("iife", P, code),
            "import_export_usage": _has("import_export", P, code),
            "uses_strict_mode": _has("strict_mode", P, code),
            "function_style_consistency": dominant_ratio(named, anonymous, arrows),
            "pattern_repetition_score": pattern_repetition(row["_keywords"]),
            "uses_camel_case_ratio": F.when(n_names == 0, F.lit(0.0)).otherwise(camel / n_names),
            "uses_snake_case_ratio": F.when(n_names == 0, F.lit(0.0)).otherwise(snake / n_names),
            "meaningful_name_ratio": naming["meaningful_name_ratio"],
            "single_letter_var_ratio": naming["single_letter_var_ratio"],
            "avg_name_length": naming["avg_name_length"],
            "naming_consistency_score": naming["naming_consistency_score"],
            "semicolon_consistency": F.when(row["_candidates"], F.lit(1.0)).otherwise(F.lit(0.0)),
            "quote_consistency": quote_consistency(row["_strings"]),
            "indentation_consistency": indentation_consistency(row["_indents"], K.JS_INDENT_WIDTHS),
            "has_console_log": counts["console"] > 0,
            "has_debugger": counts["debugger"] > 0,
            "has_todo_comments": counts["todo"] > 0,
            "has_commented_code": counts["commented_code"] > 0,
            "has_alert": counts["alert"] > 0,
            "has_eval": counts["eval"] > 0,
            "has_var_declarations": counts["var"] > 0,
            "has_long_lines": long_n > 0,
            "has_callback_hell": counts["callback_hell"] > 0,
            "uses_jquery": jquery > 0,
            "console_log_score": saturate(counts["console"], 3.0),
            "debugger_score": saturate(counts["debugger"], 1.0),
            "todo_comment_score": saturate(counts["todo"], 2.0),
            "commented_code_score": saturate(counts["commented_code"], 2.0),
            "alert_score": saturate(counts["alert"], 1.0),
            "eval_score": saturate(counts["eval"], 1.0),
            "var_declaration_score": saturate(counts["var"], 3.0),
            "callback_hell_score": saturate(counts["callback_hell"], 1.0),
            "jquery_score": saturate(jquery, 1.0),
            "long_line_score": saturate(long_n, 3.0),
            "generic_example_score": saturate(counts["generic"], 3.0),
            "example_usage_score": saturate(counts["example_usage"], 4.0),
            "placeholder_score": saturate(counts["placeholder"], 3.0),
            "excessive_comments_ratio": saturate(line_comments, 5.0)
            * saturate(line_comments, F.greatest(F.size(row["lines"]), F.lit(1))),
            "uses_react_patterns": _has("react", P, code),
            "uses_node_patterns": _has("node", P, code),
            "uses_typescript_patterns": _has("typescript", P, code),
            "module_pattern": F.when(_has("commonjs", P, code), F.lit("commonjs"))
            .when(_has("es6", P, code), F.lit("es6"))
            .otherwise(F.lit("none")),
        }
    )
    return f


def _typed(name: str, col: Column) -> Column:
    if name in LONG_FEATURES:
        return col.cast("long")
    if name in BOOL_FEATURES:
        return col.cast("boolean")
    if name in DOUBLE_FEATURES:
        return col.cast("double")
    return col.cast("string")


INPUTS = ("chunk", "lines", "syn", "tokens")
#: Per language: stages of intermediates, each evaluated once and read by those after it, and the features.
STAGES = {PY: ((_trimmed, python_arrays, python_counts), python_features), JS: ((_trimmed, javascript_arrays, javascript_counts), javascript_features)}


def _staged(base: Column, language: str, result, needed=None) -> Column:
    """``result`` of a chunk's row with the intermediates of all stages, or of those of them that are ``needed``."""
    stages = STAGES[language][0]

    def at(k: int, have: tuple):
        def then(row: Column) -> Column:
            if k == len(stages):
                return result(row)
            new = {n: c for n, c in stages[k](row).items() if needed is None or n in needed}
            return once(F.struct(*(row[c].alias(c) for c in have), *(c.alias(n) for n, c in new.items())), at(k + 1, (*have, *new)))
        return then

    return once(base, at(0, INPUTS))


def _chunk_struct(chunk: Column, syn: Column, tokens: Column, language: str) -> Column:
    """Features of one chunk: intermediates first, each evaluated once, then what reads them."""
    def all_features(row: Column) -> Column:
        own = STAGES[language][1](row)
        cols = [_typed(name, own.get(name, F.lit(None))).alias(name) for name in ALL_FEATURES]
        return F.struct(*cols, row["syn"]["error"].alias("chunk_error"), row["syn"]["python_version"].alias("python_version"))

    return _staged(F.struct(chunk.alias("chunk"), split_lines(chunk).alias("lines"), syn.alias("syn"), tokens.alias("tokens")), language, all_features)


def _needed(language: str, names) -> set[str]:
    """The intermediates and inputs that the named features read, directly or through others."""
    stages, features = STAGES[language]
    row = F.col("row")
    built = features(row)
    text, needed = " ".join(str(built[n]) for n in names), set()
    for candidates in (*(stage(row) for stage in reversed(stages)), dict.fromkeys(INPUTS)):
        found = [c for c in candidates if re.search(rf"\b{c}\b", text)]
        text += "".join(f" {candidates[c]}" for c in found)
        needed.update(found)
    return needed


def chunk_metrics(language: str, names) -> Column:
    """The array of structs of the named features only, of column ``chunks`` of files of one language.

    Intermediates that they do not read are left out.  Features of the syntax
    tree and of Python tokens are not among them: they need the Python worker."""
    needed = _needed(language, names)
    if language == PY and needed & {"tokens", "syn"}:
        raise ValueError("these features need the syntax tree")

    def named(row: Column) -> Column:
        own = STAGES[language][1](row)
        return F.struct(*(_typed(n, own[n]).alias(n) for n in names))

    def of(c: Column) -> Column:
        found = F.regexp_extract_all(c, F.lit(JS_TOKEN_REGEX), 0) if "tokens" in needed else F.lit(None).cast("array<string>")
        base = F.struct(c.alias("chunk"), split_lines(c).alias("lines"), F.lit(None).cast(SYNTAX_TYPE).alias("syn"), found.alias("tokens"))
        return _staged(base, language, named, needed)

    return F.transform(F.col("chunks"), of)


def with_syntax(files: DataFrame, languages=(PY, JS)) -> DataFrame:
    """Adds ``_syntax``, the interpreter's view of every chunk of a Python file.

    The Python UDF receives NULL for other files, so it does no work there,
    and is left out where no Python is asked for."""
    if PY not in languages:
        return files
    return files.withColumn("_syntax", python_syntax(F.when(F.col("language") == F.lit(PY), F.col("chunks"))))


def chunk_features(languages=(PY, JS)) -> Column:
    """The array of feature structs of column ``chunks`` (and ``_syntax``), one path per language.

    A chunk's features never leave its file's row: no row per chunk, no shuffle."""
    out = None
    if PY in languages:
        of_python = F.transform(
            F.arrays_zip("chunks", "_syntax"),
            lambda z: _chunk_struct(z["chunks"], z["_syntax"], z["_syntax"]["tokens"], PY),
        )
        out = F.when(F.col("language") == F.lit(PY), of_python)
    if JS in languages:
        of_javascript = F.transform(
            F.col("chunks"),
            lambda c: _chunk_struct(c, F.lit(None).cast(SYNTAX_TYPE), F.regexp_extract_all(c, F.lit(JS_TOKEN_REGEX), 0), JS),
        )
        out = (F if out is None else out).when(F.col("language") == F.lit(JS), of_javascript)
    return out
