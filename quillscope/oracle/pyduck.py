"""DuckDB oracle SQL of the Python features (correctness gate only).

No parser: the subset of Python that the derived corpus is written in.  A line
is cut into tokens by one pattern; its normal form (names ``n``, strings ``s``,
numbers ``0``) is looked up in a table of statements, which gives the kind and
how deep the tree goes below it.  Blocks follow from indents alone: the nearest
earlier line with less indent is the parent, the nearest with no more is the
open level that a line goes back to.  A chunk parses if every form is known,
indents fit and brackets close.  Nothing here is shared with the engine but the
fixed values.
"""

from __future__ import annotations

import keyword
import sys

from ..functions import constants as K
from ..operators.features import BOOL_FEATURES, DOUBLE_FEATURES, LONG_FEATURES, PY_BOOL, PY_DOUBLE
from .duck import NONWS, WSC, chunks_ctes, count, dominant, js_file_ctes, js_score_ctes, q, ratio, sat, strip_starts

TOKEN = r"""#.*|\"{3}.*?\"{3}|"[^"]*"|'[^']*'|[\p{L}_][\p{L}\p{N}_]*|\d+(?:\.\d+)?|->|==|\+=|[^\s\p{L}\p{N}_]"""
NAME = r"^[\p{L}_]"

# Normal form of a statement's line, kind of its node, and levels of nodes below it (context nodes such as Load and Store
# count, the statements of its block do not), taken from the definition of the syntax tree.
FORMS = [
    ("s", "Expr", 1),
    ("import n", "Import", 1),
    ("import n , n", "Import", 1),
    ("def n ( ) :", "FunctionDef", 1),
    ("def n ( n ) :", "FunctionDef", 2),
    ("def n ( n : n ) -> n :", "FunctionDef", 4),
    ("with n ( n ) as n :", "With", 4),
    ("for n in n :", "For", 2),
    ("for n in n . n [ 0 : ] :", "For", 4),
    ("if n :", "If", 2),
    ("if n == s :", "If", 3),
    ("try :", "Try", 0),
    ("except :", "ExceptHandler", 0),
    ("return n", "Return", 2),
    ("return n + 0", "Return", 3),
    ("return n ( n )", "Return", 3),
    ("return n . n ( n )", "Return", 4),
    ("n = 0", "Assign", 2),
    ("n = s", "Assign", 2),
    ("n = n + 0", "Assign", 3),
    ("n = n ( n )", "Assign", 3),
    ("n = n ( s )", "Assign", 3),
    ("n = [ n , 0 , 0 , 0 ]", "Assign", 3),
    ("n = n ( n ) . n ( )", "Assign", 5),
    ("n = [ n for n in n . n ( ) ]", "Assign", 6),
    ("n = n ( n . n ( ) [ 0 ] ) * 0", "Assign", 7),
    ("n += n", "AugAssign", 2),
    ("n ( n )", "Expr", 3),
    ("n ( s , n )", "Expr", 3),
    ("n ( n ( n ) )", "Expr", 4),
    ("n . n ( n ( n ) + 0 )", "Expr", 5),
]


def text_ctes() -> str:
    """E1-E12, E15, H1-H6 of every chunk as ``pyt``: what needs no syntax."""
    P = K.PY_PATTERNS
    c = "ch.chunk"
    bare = f"regexp_replace(line, {q(WSC + '+$')}, '')"
    filled = f"regexp_matches(line, {q(NONWS)})"
    indent = "length(line) - length(ltrim(line, ' '))"
    return f""",
pl AS (SELECT file_id, chunk_id,
    count(*) FILTER (WHERE {filled}) AS non_empty_lines,
    avg(length({bare})) FILTER (WHERE {filled}) AS avg_len,
    coalesce(stddev_pop(length({bare})) FILTER (WHERE {filled}), 0.0) AS std_len,
    count(*) FILTER (WHERE {strip_starts('line', '#')}) AS comments,
    avg(length(trim(line, {q(K.PY_WHITESPACE)}))) FILTER (WHERE {strip_starts('line', '#')}) AS comment_len,
    count(*) FILTER (WHERE regexp_matches(line, {q(WSC + '$')})) AS trailing,
    count(*) FILTER (WHERE length({bare}) > {K.LONG_LINE_CHARS}) AS long_n,
    count(*) FILTER (WHERE {filled} AND {indent} > 0) AS n_ind,
    count(*) FILTER (WHERE {filled} AND {indent} > 0 AND ({indent}) % 4 = 0) AS n_ind4
  FROM lines GROUP BY ALL),
pf AS (
  SELECT ch.file_id, ch.chunk_id, ch.chunk_count, CAST(len(cl.lines) AS BIGINT) AS total_lines,
    CAST(coalesce(pl.non_empty_lines, 0) AS BIGINT) AS non_empty_lines,
    {ratio('len(cl.lines) - coalesce(pl.non_empty_lines, 0)', 'len(cl.lines)')} AS blank_line_ratio,
    {ratio('coalesce(pl.comments, 0)', 'len(cl.lines)')} AS comment_ratio,
    coalesce(pl.avg_len, 0.0) AS avg_line_length,
    CASE WHEN coalesce(pl.non_empty_lines, 0) < 2 THEN 0.0 ELSE pl.std_len END AS line_length_variance,
    CASE WHEN coalesce(pl.n_ind, 0) = 0 THEN 0.0 ELSE pl.n_ind4 / pl.n_ind END AS indentation_consistency,
    {count(c, *P['todo'])} AS n_todo, {count(c, *P['debug'])} AS n_debug,
    {count(c, *P['commented_code'])} AS n_ccode, coalesce(pl.long_n, 0) AS n_long,
    coalesce(pl.trailing, 0) AS n_trailing,
    {count(c, *P['generic'])} AS n_generic, {count(c, *P['example_usage'])} AS n_exu,
    {count(c, *P['placeholder'])} AS n_plc,
    coalesce(pl.comments, 0) AS n_comments, coalesce(pl.comment_len, 0.0) AS comment_len
  FROM ch JOIN cl ON cl.file_id = ch.file_id AND cl.chunk_id = ch.chunk_id
  LEFT JOIN pl ON pl.file_id = ch.file_id AND pl.chunk_id = ch.chunk_id),
pyt AS (
  SELECT file_id, chunk_id, chunk_count, total_lines, non_empty_lines, blank_line_ratio, comment_ratio, avg_line_length, line_length_variance,
    1.0 - least(1.0, greatest(0.0, {ratio('line_length_variance', 'CASE WHEN avg_line_length = 0 THEN 1.0 ELSE avg_line_length END')})) AS line_length_uniformity,
    indentation_consistency, n_todo > 0 AS has_todo_comments, n_debug > 0 AS has_debug_prints, n_ccode > 0 AS has_commented_code,
    n_long > 0 AS has_long_lines, n_trailing > 0 AS has_trailing_whitespace,
    {sat('n_todo', 2)} AS todo_comment_score, {sat('n_debug', 2)} AS debug_print_score, {sat('n_ccode', 2)} AS commented_code_score,
    {sat('n_long', 3)} AS long_line_score, {sat('n_trailing', 2)} AS trailing_whitespace_score, {sat('n_generic', 3)} AS generic_example_score,
    {sat('n_exu', 4)} AS example_usage_score, {sat('n_plc', 3)} AS placeholder_score, {sat('comment_len', 70)} * {sat('n_comments', 4)} AS over_explanation_score
  FROM pf)"""


def token_ctes() -> str:
    """Statement lines ``sl`` with their tokens, what is wrong with a chunk's layout (``state``), counts (``pts``)."""
    openers = "len(list_filter(toks, lambda t: t IN ('(', '[', '{')))"
    closers = "len(list_filter(toks, lambda t: t IN (')', ']', '}')))"
    return f""",
sl AS (
  SELECT file_id, chunk_id, ln, length(line) - length(ltrim(line, ' ')) AS ind,
    list_filter(regexp_extract_all(line, {q(TOKEN)}), lambda t: NOT starts_with(t, '#')) AS toks
  FROM lines WHERE regexp_matches(line, {q(NONWS)}) AND NOT {strip_starts('line', '#')}),
rel AS (
  SELECT a.file_id, a.chunk_id, a.ln,
    max(b.ln) FILTER (WHERE b.ln < a.ln AND b.ind <= a.ind) AS level_ln, arg_max(b.ind, b.ln) FILTER (WHERE b.ln < a.ln AND b.ind <= a.ind) AS level_ind,
    max(b.ln) FILTER (WHERE b.ln < a.ln AND b.ind < a.ind) AS parent_ln, min(b.ln) FILTER (WHERE b.ln > a.ln AND b.ind <= a.ind) AS end_ln
  FROM sl a JOIN sl b ON a.file_id = b.file_id AND a.chunk_id = b.chunk_id GROUP BY ALL),
stmt AS (
  SELECT sl.*, rel.* EXCLUDE (file_id, chunk_id, ln), coalesce(lag(ind) OVER w, 0) AS before_ind, lead(ind) OVER w AS next_ind, lead(toks) OVER w AS next_toks
  FROM sl JOIN rel USING (file_id, chunk_id, ln) WINDOW w AS (PARTITION BY file_id, chunk_id ORDER BY ln)),
state AS (
  SELECT file_id, chunk_id, sum({openers}) <> sum({closers}) AS unclosed,
    CASE WHEN sum({openers}) = sum({closers}) THEN min(ln) FILTER (WHERE ind > 0 AND ind < before_ind AND (level_ind IS NULL OR level_ind < ind)) END AS bad_dedent
  FROM stmt GROUP BY ALL),
ptok AS (SELECT file_id, chunk_id, unnest(toks) AS token FROM sl JOIN state USING (file_id, chunk_id) WHERE NOT unclosed AND bad_dedent IS NULL),
pts AS (
  SELECT file_id, chunk_id, sum(n) AS token_count, -sum((n / t) * log2(n / t)) AS token_entropy,
    coalesce(sum(n) FILTER (WHERE starts_with(token, '"')), 0) AS n_double, coalesce(sum(n) FILTER (WHERE starts_with(token, '''')), 0) AS n_single
  FROM (SELECT *, sum(n) OVER (PARTITION BY file_id, chunk_id) AS t FROM (SELECT file_id, chunk_id, token, count(*) AS n FROM ptok GROUP BY ALL)) GROUP BY ALL)"""


def structure_ctes() -> str:
    """G0-G16 and E13 of every chunk as ``pst``."""
    keywords = ", ".join(q(k) for k in keyword.kwlist)
    forms = ", ".join(f"({q(f)}, {q(kind)}, {below})" for f, kind, below in FORMS)
    normal = f"""list_transform(toks, lambda t: CASE WHEN t IN ({keywords}) THEN t WHEN regexp_matches(t, {q(NAME)}) THEN 'n'
      WHEN regexp_matches(t, '^["'']') THEN 's' WHEN regexp_matches(t, '^[0-9]') THEN '0' ELSE t END)"""
    named = f"list_filter(toks, lambda t, i: regexp_matches(t, {q(NAME)}) AND t NOT IN ({keywords}) AND coalesce(i = 1 OR toks[i - 1] <> '.', true))"
    stop = ", ".join(q(w) for w in K.PY_STOP_NAMES)
    exempt = ", ".join(q(x) for x in K.PY_EXEMPT_LETTERS)
    common = ", ".join(str(n) for n in K.PY_COMMON_NUMBERS)
    key = "file_id, chunk_id"
    share = lambda part, whole: f"CASE WHEN coalesce({whole}, 0) = 0 THEN 0.0 ELSE {part} / {whole} END"
    flag = lambda test: f"coalesce(bool_or({test}), false)"
    return f""",
form (form, kind, below) AS (VALUES {forms}),
known AS (
  SELECT s.*, form.form, form.kind, form.below, array_to_string(normal, ' ') AS text FROM (SELECT *, {normal} AS normal FROM stmt) s
  LEFT JOIN form ON form.form = array_to_string(normal, ' ')),
fits AS (
  SELECT k.{key.replace(', ', ', k.')},
    bool_and(k.form IS NOT NULL
      AND CASE WHEN ends_with(k.text, ':') THEN coalesce(k.next_ind > k.ind, false) ELSE coalesce(k.next_ind <= k.ind, true) END
      AND (k.parent_ln IS NOT NULL OR k.ind = 0)
      AND (k.ind >= k.before_ind OR k.ind = 0 OR coalesce(k.level_ind = k.ind, false))
      AND CASE WHEN k.kind = 'ExceptHandler' THEN coalesce(o.kind = 'Try' AND o.ind = k.ind, false) ELSE true END
      AND CASE WHEN k.kind = 'Try' THEN coalesce(e.kind = 'ExceptHandler' AND e.ind = k.ind, false) ELSE true END) AS fits
  FROM known k LEFT JOIN known o ON o.file_id = k.file_id AND o.chunk_id = k.chunk_id AND o.ln = k.level_ln
  LEFT JOIN known e ON e.file_id = k.file_id AND e.chunk_id = k.chunk_id AND e.ln = k.end_ln GROUP BY ALL),
parsed AS (SELECT {key}, coalesce(fits AND NOT unclosed AND bad_dedent IS NULL, true) AS parseable FROM ch LEFT JOIN fits USING ({key}) LEFT JOIN state USING ({key})),
good AS (SELECT known.* FROM known JOIN parsed USING ({key}) WHERE parseable),
tree AS (
  SELECT {key}, ln, 1 + CAST(kind = 'ExceptHandler' AS INT) AS depth, CAST(kind = 'FunctionDef' AS INT) AS fn FROM good WHERE parent_ln IS NULL
  UNION ALL
  SELECT g.file_id, g.chunk_id, g.ln, t.depth + 1 + CAST(g.kind = 'ExceptHandler' AS INT), t.fn + CAST(g.kind = 'FunctionDef' AS INT)
  FROM tree t JOIN good g ON g.file_id = t.file_id AND g.chunk_id = t.chunk_id AND g.parent_ln = t.ln),
placed AS (SELECT * FROM good JOIN tree USING ({key}, ln)),
seen AS (SELECT {key}, kind || '|' || lead(kind, 1) OVER w || '|' || lead(kind, 2) OVER w AS gram FROM placed WHERE kind <> 'ExceptHandler'
  WINDOW w AS (PARTITION BY {key} ORDER BY depth, ln)),
grams AS (SELECT {key}, max(n) / sum(n) AS pattern_repetition_score FROM (SELECT {key}, gram, count(*) AS n FROM seen WHERE gram IS NOT NULL GROUP BY ALL) GROUP BY ALL),
body AS (
  SELECT f.file_id, f.chunk_id, f.ln, max(l.ln) - f.ln + 1 AS size FROM placed f JOIN placed l ON l.file_id = f.file_id AND l.chunk_id = f.chunk_id AND l.ln >= f.ln AND l.ln < coalesce(f.end_ln, 1000000000)
  WHERE f.kind = 'FunctionDef' GROUP BY f.file_id, f.chunk_id, f.ln),
bodies AS (SELECT {key}, stddev_pop(size) AS spread FROM body GROUP BY ALL),
called AS (SELECT {key}, unnest({named}) AS name FROM good WHERE kind <> 'Import'),
naming AS (
  SELECT {key}, count(*) AS n, count(*) FILTER (WHERE regexp_matches(name, '^[a-z_][a-z0-9_]*$')) AS snake,
    count(*) FILTER (WHERE lower(name) = name AND upper(name) <> name AND NOT contains(name, '_')) AS low,
    count(*) FILTER (WHERE upper(name) = name AND lower(name) <> name) AS up,
    count(*) FILTER (WHERE length(name) > 3 AND lower(name) NOT IN ({stop})) AS meaningful,
    count(*) FILTER (WHERE length(name) = 1 AND name NOT IN ({exempt})) AS single, avg(length(name)) AS avg_length
  FROM called GROUP BY ALL),
numbers AS (SELECT {key}, count(*) FILTER (WHERE CAST(number AS DOUBLE) NOT IN ({common})) AS magic
  FROM (SELECT {key}, unnest(list_filter(toks, lambda t: regexp_matches(t, '^[0-9]'))) AS number FROM good) GROUP BY ALL),
imported AS (SELECT {key}, ln, trim(line, {q(K.PY_WHITESPACE)}) AS line FROM lines WHERE {strip_starts('line', 'import |from ')}),
island AS (SELECT *, ln - row_number() OVER (PARTITION BY {key} ORDER BY ln) AS g FROM imported),
stepped AS (SELECT {key}, g, coalesce(lag(line) OVER (PARTITION BY {key}, g ORDER BY ln) <= line, true) AS up FROM island),
imports AS (SELECT {key}, sum(n) AS n, avg(CAST(ordered AS INT)) AS organized FROM (SELECT {key}, g, count(*) AS n, bool_and(up) AS ordered FROM stepped GROUP BY ALL) GROUP BY ALL),
counted AS (
  SELECT {key}, count(*) FILTER (WHERE kind = 'FunctionDef') AS functions, count(*) FILTER (WHERE kind = 'For') AS loops, count(*) FILTER (WHERE kind = 'Try') AS tries,
    max(depth + below) AS deepest, max(fn) FILTER (WHERE kind = 'FunctionDef') AS nested, {flag("form = 'if n == s :' AND toks[2] = '__name__' AND toks[4] = '\"__main__\"'")} AS guard,
    count(*) FILTER (WHERE kind = 'FunctionDef' AND len(next_toks) = 1 AND regexp_matches(next_toks[1], '[^"]')) AS documented,
    {flag("contains(form, '[ n for')")} AS comprehensions, {flag("contains(form, '->') OR starts_with(form, 'def n ( n :')")} AS annotated, count(*) FILTER (WHERE form = 'except :') AS bare
  FROM placed GROUP BY ALL),
pst AS (
  SELECT {key}, parseable, CAST(coalesce(functions, 0) AS BIGINT) AS function_count, CAST(coalesce(loops, 0) AS BIGINT) AS loop_count, CAST(coalesce(tries, 0) AS BIGINT) AS try_except_count,
    CAST(coalesce(deepest, 0) AS BIGINT) AS max_ast_depth, coalesce(guard, false) AS has_main_guard, coalesce(documented, 0) > 0 AS has_docstrings,
    {share('documented', 'functions')} AS docstring_coverage, coalesce(comprehensions, false) AS uses_comprehensions, false AS uses_walrus_operator, false AS uses_f_strings,
    coalesce(annotated, false) AS uses_type_hints, CAST(coalesce(nested, 0) AS DOUBLE) AS nested_function_depth, coalesce(spread, 0.0) AS function_length_variance,
    {sat('coalesce(spread, 0.0)', 10)} AS function_length_variance_score, coalesce(pattern_repetition_score, 0.0) AS pattern_repetition_score,
    CASE WHEN coalesce(naming.n, 0) = 0 THEN 0.0 ELSE {dominant('snake', 'low', 'up')} END AS naming_consistency_score,
    {share('snake', 'naming.n')} AS uses_snake_case_ratio, {share('meaningful', 'naming.n')} AS meaningful_name_ratio, {share('single', 'naming.n')} AS single_letter_var_ratio,
    coalesce(avg_length, 0.0) AS avg_name_length, coalesce(magic, 0) > 0 AS has_magic_numbers, {sat('coalesce(magic, 0)', 6)} AS magic_number_score, {sat('coalesce(bare, 0)', 2)} AS bare_except_score,
    CASE WHEN parseable AND coalesce(imports.n, 0) >= 2 THEN organized ELSE 0.0 END AS import_organization_score
  FROM parsed LEFT JOIN counted USING ({key}) LEFT JOIN bodies USING ({key}) LEFT JOIN grams USING ({key}) LEFT JOIN naming USING ({key}) LEFT JOIN numbers USING ({key}) LEFT JOIN imports USING ({key}))"""


STRUCTURE_COLUMNS = [
    "parseable", "function_count", "loop_count", "try_except_count", "max_ast_depth", "has_main_guard", "has_docstrings", "docstring_coverage",
    "uses_comprehensions", "uses_walrus_operator", "uses_f_strings", "uses_type_hints", "nested_function_depth", "function_length_variance",
    "function_length_variance_score", "pattern_repetition_score", "naming_consistency_score", "uses_snake_case_ratio", "meaningful_name_ratio",
    "single_letter_var_ratio", "avg_name_length", "has_magic_numbers", "magic_number_score", "bare_except_score",
]


def feature_ctes() -> str:
    """Every feature of every chunk as ``py``."""
    return f"""{text_ctes()}{token_ctes()}{structure_ctes()},
py AS (
  SELECT pyt.*, pst.* EXCLUDE (file_id, chunk_id), CAST(coalesce(token_count, 0) AS BIGINT) AS token_count, coalesce(token_entropy, 0.0) AS token_entropy,
    CASE WHEN coalesce(n_double + n_single, 0) = 0 THEN 0.0 ELSE greatest(n_double, n_single) / (n_double + n_single) END AS quote_consistency, 'null' AS module_pattern
  FROM pyt JOIN pst USING (file_id, chunk_id) LEFT JOIN pts USING (file_id, chunk_id)),
broken AS (
  SELECT file_id, 'IndentationError: unindent does not match any outer indentation level (<string>, line ' || arg_min(bad_dedent, chunk_id) || ')' AS error
  FROM state WHERE bad_dedent IS NOT NULL GROUP BY file_id)"""


MEANS = ("ai_score", "human_score", "score_gap", "signal_strength", "ai_probability", "confidence", *PY_DOUBLE)


def file_ctes() -> str:
    """K1-K8 and L1-L10 under the Python weights: ``files``, which hold those of ``broken`` too."""
    return js_score_ctes(table="py", ai=K.PY_AI_WEIGHTS, human=K.PY_HUMAN_WEIGHTS) + js_file_ctes(flags=PY_BOOL, means=MEANS)


def chunk_query(select: str, src: str, ctes: str) -> str:
    return f"WITH RECURSIVE {chunks_ctes(src)}{ctes}\n{select}"


def file_query(select: str, src: str) -> str:
    return chunk_query(select, src, feature_ctes() + file_ctes())


def rounded(names: list[str], doubles=frozenset(DOUBLE_FEATURES)) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if c in doubles else c for c in names)


def results_sql(corpus: str) -> str:
    """The wide result of every Python file: counts of a failed file are -1, flags are text."""
    guard = lambda value, name: f"CASE WHEN error IS NULL THEN {value} END AS {name}"
    number = lambda value, name: f"CAST(CASE WHEN error IS NULL THEN {value} ELSE -1 END AS BIGINT) AS {name}"
    flags = [f"CASE WHEN error IS NULL THEN CAST({c} AS VARCHAR) ELSE 'null' END AS {c}" if c in PY_BOOL else f"'null' AS {c}" for c in BOOL_FEATURES]
    doubles = [guard(f"round({c}, 6)", c) if c in PY_DOUBLE else f"CAST(NULL AS DOUBLE) AS {c}" for c in DOUBLE_FEATURES]
    columns = [
        "file_id", "path", "'python' AS language", guard("classification", "classification"), number(f"CAST(classification = {q(K.AI_LABEL)} AS INT)", "result"),
        *(guard(f"round({c}, 6)", c) for c in MEANS[:6]), *(guard(c, c) for c in ("decision_basis", "top_ai_signals", "top_human_signals")),
        number("n", "chunk_count"), number("clear_chunk_count", "clear_chunk_count"), guard("replace(chunk_classes, '|', ', ')", "chunk_classifications"),
        "CAST(len(parts) AS BIGINT) AS file_total_lines", *(number(c, c) for c in LONG_FEATURES), *flags, *doubles, "'null' AS module_pattern",
        f"'{sys.version_info.major}.{sys.version_info.minor}' AS python_version", "error",
    ]
    return file_query(f"SELECT {', '.join(columns)} FROM files JOIN lk USING (file_id) JOIN ({corpus}) c USING (file_id) LEFT JOIN broken USING (file_id)", f"SELECT file_id, code FROM ({corpus})")
