"""DuckDB oracle SQL for the registered queries (correctness gate only).

Written independently of the Spark plan: chunking is a recursive CTE over
lines, token statistics, comment blocks, brace depth and trigrams are
``unnest`` + window / GROUP BY formulations.  DuckDB runs RE2, so the
patterns are given in RE2 form; RE2's ``\\b`` is ASCII, hence texts are
mapped to ASCII letters (``z``) before word-boundary patterns — valid on the
driver data, where every non-ASCII character is a letter.
"""

from __future__ import annotations

from ..functions import constants as K
from ..functions.regex import _is_quantifier
from ..operators.features import ALL_FEATURES, JS_BOOL, JS_DOUBLE, LONG_FEATURES
from ..sources.corpus import render

WS = r"\t\n\x0B\x0C\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NONWS = f"[^{WS}]"
WSC = f"[{WS}]"
BR = r"\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}"
TERM = rf"\r\n|[{BR}]"
LWE = rf"[^{BR}]*(?:\r\n|[{BR}])|[^{BR}]+"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str, flags: str = "") -> str:
    """Python-re pattern → RE2 (ASCII data): escape literal braces."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            out.append(pattern[i:i + 2])
            i += 2
            continue
        if in_class:
            if ch == "]" and out[-1] not in ("[", "[^"):
                in_class = False
            out.append(ch)
        elif ch == "[":
            in_class = True
            if pattern[i + 1:i + 2] == "^":
                out.append("[^")
                i += 2
                continue
            out.append(ch)
        elif ch == "{":
            n = _is_quantifier(pattern, i)
            if n:
                out.append(pattern[i:i + n])
                i += n
                continue
            out.append("\\{")
        elif ch == "}":
            out.append("\\}")
        else:
            out.append(ch)
        i += 1
    prefix = ""
    if "I" in flags:
        prefix += "(?i)"
    if "M" in flags:
        prefix += "(?m)"
    if "S" in flags:
        prefix += "(?s)"
    return prefix + "".join(out)


def ascii_letters(expr: str) -> str:
    return f"regexp_replace({expr}, '[^\\x00-\\x7F]', 'z', 'g')"


def count(expr: str, pattern: str, flags: str = "", word: bool = True) -> str:
    text = ascii_letters(expr) if word else expr
    return f"len(regexp_extract_all({text}, {q(re2(pattern, flags))}))"


def has(expr: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({ascii_letters(expr)}, {q(re2(pattern, flags))})"


def sat(expr: str, scale: float) -> str:
    return f"least(1.0, greatest(0.0, CAST({expr} AS DOUBLE) / {float(scale)}))"


def ratio(n: str, d: str) -> str:
    return f"CASE WHEN ({d}) <= 0 THEN 0.0 ELSE CAST({n} AS DOUBLE) / ({d}) END"


def dominant(*xs: str) -> str:
    pos = [f"greatest(CAST({x} AS DOUBLE), 0.0)" for x in xs]
    total = " + ".join(pos)
    return f"CASE WHEN ({total}) <= 0 THEN 0.0 ELSE greatest({', '.join(pos)}) / ({total}) END"


def strip_starts(line: str, prefix_re: str) -> str:
    return f"regexp_matches({line}, {q('^' + WSC + '*(?:' + prefix_re + ')')})"


# ---------------------------------------------------------------------------
# sources
# ---------------------------------------------------------------------------

def corpus_sql() -> str:
    return render("duckdb", "documents")


def resolved_corpus_sql() -> str:
    """Corpus with B1-B3 language resolution (extension, then content)."""
    ext = "lower(CASE WHEN contains(path, '.') THEN regexp_extract(path, '\\.([^.]*)$', 1) ELSE path END)"
    by_ext = "CASE " + " ".join(f"WHEN {ext} = {q(e)} THEN {q(lang)}" for e, lang in K.EXTENSION_LANGUAGE.items()) + " END"
    js_ws = r"\t\n\x0B\x0C\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

    def ecma(p: str, flags: str) -> str:
        out = re2(p).replace("[^\\s]", f"[^{js_ws}]").replace("\\s", f"[{js_ws}]")
        out = out.replace(".*", "[^\\n\\r\\x{2028}\\x{2029}]*")
        return ("(?m)" if "M" in flags else "") + out

    def score(patterns) -> str:
        return " + ".join(f"CASE WHEN regexp_matches(code, {q(ecma(p, f))}) THEN 1 ELSE 0 END" for p, f in patterns)

    py, js = score(K.DETECT_PYTHON), score(K.DETECT_JAVASCRIPT)
    by_content = f"CASE WHEN ({py}) > ({js}) THEN 'python' WHEN ({js}) > ({py}) THEN 'javascript' END"
    return f"""SELECT file_id, path, code, template,
        coalesce(lower(language), {by_ext}, {by_content}) AS language
      FROM ({corpus_sql()}) c"""


# ---------------------------------------------------------------------------
# chunking (C1-C6) as a recursive CTE; src has (file_id, code)
# ---------------------------------------------------------------------------

def chunks_ctes(src: str, target: int = 2200, tail: int = 500) -> str:
    """Defaults are written out here, not taken from the engine's constants."""
    return f"""
src AS ({src}),
lk AS (SELECT file_id, regexp_extract_all(code, {q(LWE)}) AS parts FROM src),
ln AS (SELECT file_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM lk),
rec AS (
  SELECT file_id, i, line, 0 AS c, length(line) AS cur FROM ln WHERE i = 1
  UNION ALL
  SELECT n.file_id, n.i, n.line,
         CASE WHEN r.cur + length(n.line) > {target} THEN r.c + 1 ELSE r.c END,
         CASE WHEN r.cur + length(n.line) > {target} THEN length(n.line) ELSE r.cur + length(n.line) END
  FROM rec r JOIN ln n ON n.file_id = r.file_id AND n.i = r.i + 1
),
raw AS (SELECT file_id, c, trim(string_agg(line, '' ORDER BY i), chr(10)) AS chunk FROM rec GROUP BY file_id, c),
lastc AS (SELECT file_id, max(c) AS last_c FROM raw GROUP BY file_id),
merged AS (
  SELECT r.file_id, r.c,
         CASE WHEN k.last_c > 0 AND r.c = k.last_c - 1 AND length(l.chunk) < {tail}
              THEN r.chunk || chr(10) || l.chunk ELSE r.chunk END AS chunk
  FROM raw r JOIN lastc k ON k.file_id = r.file_id
  LEFT JOIN raw l ON l.file_id = r.file_id AND l.c = k.last_c
  WHERE NOT (k.last_c > 0 AND r.c = k.last_c AND length(r.chunk) < {tail})
),
kept AS (SELECT file_id, c, chunk FROM merged WHERE regexp_matches(chunk, {q(NONWS)})),
numbered AS (SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY c) - 1 AS INT) AS chunk_id, chunk FROM kept),
ch0 AS (
  SELECT file_id, chunk_id, chunk FROM numbered
  UNION ALL
  SELECT s.file_id, 0, s.code FROM src s WHERE NOT EXISTS (SELECT 1 FROM numbered n WHERE n.file_id = s.file_id)
),
ch AS (SELECT file_id, chunk_id, chunk, CAST(count(*) OVER (PARTITION BY file_id) AS INT) AS chunk_count FROM ch0),
cl0 AS (SELECT file_id, chunk_id, string_split_regex(chunk, {q(TERM)}) AS parts FROM ch),
cl AS (SELECT file_id, chunk_id,
         CASE WHEN parts[len(parts)] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS lines FROM cl0),
lines AS (SELECT file_id, chunk_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS ln FROM cl)"""


# ---------------------------------------------------------------------------
# JavaScript chunk features (E, F, J) — needs chunks_ctes
# ---------------------------------------------------------------------------

def js_feature_ctes() -> str:
    P = K.JS_PATTERNS
    tok = q(re2(K.JS_TOKEN))
    kw = q(re2(K.JS_KEYWORDS))
    mask = q(r"(?s)//[^\n]*|/\*.*?(?:\*/|$)|'[^']*(?:'|$)|" + '"[^"]*(?:"|$)|`[^`]*(?:`|$)')
    c = "ch.chunk"
    names = (
        f"list_concat(regexp_extract_all({c}, {q(re2(K.JS_NAME_DECLARED))}, 1), "
        f"regexp_extract_all({c}, {q(re2(K.JS_NAME_ARROW))}, 1))"
    )
    return f""",
tokens AS (SELECT file_id, chunk_id, unnest(regexp_extract_all(chunk, {tok})) AS token FROM ch),
tok_counts AS (SELECT file_id, chunk_id, token, count(*) AS n FROM tokens GROUP BY ALL),
tok_stats AS (
  SELECT file_id, chunk_id, sum(n) AS token_count,
         -sum((n / t) * log2(n / t)) AS token_entropy
  FROM (SELECT *, sum(n) OVER (PARTITION BY file_id, chunk_id) AS t FROM tok_counts) GROUP BY ALL),
kws AS (SELECT file_id, chunk_id, unnest(regexp_extract_all({ascii_letters('chunk')}, {kw}, 1)) AS k,
               generate_subscripts(regexp_extract_all({ascii_letters('chunk')}, {kw}, 1), 1) AS p FROM ch),
tri AS (SELECT file_id, chunk_id, k || '|' || lead(k, 1) OVER w || '|' || lead(k, 2) OVER w AS g
        FROM kws WINDOW w AS (PARTITION BY file_id, chunk_id ORDER BY p)),
tri_stats AS (SELECT file_id, chunk_id, max(n) / sum(n) AS pattern_repetition_score
        FROM (SELECT file_id, chunk_id, g, count(*) AS n FROM tri WHERE g IS NOT NULL GROUP BY ALL) GROUP BY ALL),
ev AS (SELECT file_id, chunk_id, ln, line,
         regexp_matches(line, {q(NONWS)}) AS nonblank,
         CASE WHEN contains(line, '*/') THEN 0 WHEN {strip_starts('line', '/\\*')} THEN 1 END AS e
       FROM lines),
blk AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY file_id, chunk_id ORDER BY ln
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS in_block FROM ev),
line_stats AS (
  SELECT file_id, chunk_id,
    count(*) FILTER (WHERE nonblank AND (in_block = 1 OR {strip_starts('line', '//|/\\*')})) AS comment_lines,
    count(*) FILTER (WHERE nonblank) AS non_empty_lines,
    avg(length(regexp_replace(line, {q(WSC + '+$')}, ''))) FILTER (WHERE nonblank) AS avg_len,
    coalesce(stddev_pop(length(regexp_replace(line, {q(WSC + '+$')}, ''))) FILTER (WHERE nonblank), 0.0) AS std_len,
    count(*) FILTER (WHERE nonblank) AS n_nb,
    count(*) FILTER (WHERE length(regexp_replace(line, {q(WSC + '+$')}, '')) > {K.LONG_LINE_CHARS}) AS long_n,
    count(*) FILTER (WHERE nonblank AND length(line) - length(ltrim(line, ' ')) > 0) AS n_ind,
    count(*) FILTER (WHERE nonblank AND length(line) - length(ltrim(line, ' ')) > 0
                     AND (length(line) - length(ltrim(line, ' '))) % 2 = 0) AS n_ind2,
    count(*) FILTER (WHERE nonblank AND length(line) - length(ltrim(line, ' ')) > 0
                     AND (length(line) - length(ltrim(line, ' '))) % 4 = 0) AS n_ind4,
    count(*) FILTER (WHERE {strip_starts('line', '//')}) AS line_comments,
    bool_or(nonblank AND NOT {strip_starts('line', '//|/\\*|\\*')}
            AND NOT regexp_matches(line, {q('[{},:;]' + WSC + '*$')})) AS candidates
  FROM blk GROUP BY ALL),
braces AS (SELECT file_id, chunk_id, unnest(regexp_extract_all(regexp_replace(chunk, {mask}, '', 'g'), '[{{}}]')) AS b,
                  generate_subscripts(regexp_extract_all(regexp_replace(chunk, {mask}, '', 'g'), '[{{}}]'), 1) AS p FROM ch),
walk AS (SELECT *, sum(CASE WHEN b = '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY file_id, chunk_id ORDER BY p) AS s FROM braces),
depth AS (SELECT file_id, chunk_id, max(s - least(0, m)) AS depth FROM (
            SELECT *, min(s) OVER (PARTITION BY file_id, chunk_id ORDER BY p) AS m FROM walk) GROUP BY ALL),
jsf AS (
  SELECT ch.file_id, ch.chunk_id, ch.chunk_count, ch.chunk,
    CAST(len(cl.lines) AS BIGINT) AS total_lines,
    CAST(coalesce(ls.non_empty_lines, 0) AS BIGINT) AS non_empty_lines,
    {ratio('len(cl.lines) - coalesce(ls.non_empty_lines, 0)', 'len(cl.lines)')} AS blank_line_ratio,
    CAST(coalesce(ts.token_count, 0) AS BIGINT) AS token_count,
    coalesce(ts.token_entropy, 0.0) AS token_entropy,
    {ratio('coalesce(ls.comment_lines, 0)', 'len(cl.lines)')} AS comment_ratio,
    coalesce(ls.avg_len, 0.0) AS avg_line_length,
    CASE WHEN coalesce(ls.n_nb, 0) < 2 THEN 0.0 ELSE ls.std_len END AS line_length_variance,
    CAST({count(c, *P['function_word'])} + {count(c, *P['arrow'])} AS BIGINT) AS function_count,
    CAST({count(c, *P['loop'])} AS BIGINT) AS loop_count,
    CAST({count(c, *P['try'])} AS BIGINT) AS try_except_count,
    CAST(coalesce(d.depth, 0) AS BIGINT) AS max_ast_depth,
    contains({c}, '=>') AS uses_arrow_functions,
    {has(c, *P['async_await'])} AS uses_async_await,
    {has(c, *P['destructuring'])} AS uses_destructuring,
    {has(c, *P['template_literal'])} AS uses_template_literals,
    contains({c}, '...') AS uses_spread_operator,
    contains({c}, '?.') AS uses_optional_chaining,
    {has(c, *P['iife'])} AS has_iife,
    {has(c, *P['import_export'])} AS import_export_usage,
    {has(c, *P['strict_mode'])} AS uses_strict_mode,
    {dominant(count(c, *P['function_named']), f"{count(c, *P['function_anonymous'])} - {count(c, *P['function_named'])}", count(c, *P['arrow']))} AS function_style_consistency,
    coalesce(tr.pattern_repetition_score, 0.0) AS pattern_repetition_score,
    {names} AS names,
    regexp_extract_all({c}, {q(re2(K.JS_STRING))}) AS strings,
    CASE WHEN coalesce(ls.candidates, false) THEN 1.0 ELSE 0.0 END AS semicolon_consistency,
    CASE WHEN coalesce(ls.n_ind, 0) = 0 THEN 0.0 ELSE greatest(ls.n_ind2, ls.n_ind4) / ls.n_ind END AS indentation_consistency,
    {count(c, *P['console'])} AS n_console, {count(c, *P['debugger'])} AS n_debugger,
    {count(c, *P['todo'])} AS n_todo, {count(c, *P['commented_code'])} AS n_ccode,
    {count(c, *P['alert'])} AS n_alert, {count(c, *P['eval'])} AS n_eval, {count(c, *P['var'])} AS n_var,
    {count(c, *P['jquery_call'])} + {count(c, *P['jquery_require'])} AS n_jquery,
    {count(c, *P['callback_hell'])} AS n_cbh,
    coalesce(ls.long_n, 0) AS n_long,
    {count(c, *P['generic'])} AS n_generic, {count(c, *P['example_usage'])} AS n_exu,
    {count(c, *P['placeholder'])} AS n_plc,
    coalesce(ls.line_comments, 0) AS line_comments,
    {has(c, *P['react'])} AS uses_react_patterns,
    {has(c, *P['node'])} AS uses_node_patterns,
    {has(c, *P['typescript'])} AS uses_typescript_patterns,
    CASE WHEN {has(c, *P['commonjs'])} THEN 'commonjs' WHEN {has(c, *P['es6'])} THEN 'es6' ELSE 'none' END AS module_pattern
  FROM ch JOIN cl ON cl.file_id = ch.file_id AND cl.chunk_id = ch.chunk_id
  LEFT JOIN line_stats ls ON ls.file_id = ch.file_id AND ls.chunk_id = ch.chunk_id
  LEFT JOIN tok_stats ts ON ts.file_id = ch.file_id AND ts.chunk_id = ch.chunk_id
  LEFT JOIN tri_stats tr ON tr.file_id = ch.file_id AND tr.chunk_id = ch.chunk_id
  LEFT JOIN depth d ON d.file_id = ch.file_id AND d.chunk_id = ch.chunk_id
),
js AS (
  SELECT *,
    1.0 - least(1.0, greatest(0.0, {ratio('line_length_variance', 'CASE WHEN avg_line_length = 0 THEN 1.0 ELSE avg_line_length END')})) AS line_length_uniformity,
    CASE WHEN len(names) = 0 THEN 0.0 ELSE len(list_filter(names, lambda x: regexp_matches(x, '^[a-z][a-zA-Z0-9]*$'))) / len(names) END AS uses_camel_case_ratio,
    CASE WHEN len(names) = 0 THEN 0.0 ELSE len(list_filter(names, lambda x: regexp_matches(x, '^[a-z_][a-z0-9_]*$'))) / len(names) END AS uses_snake_case_ratio,
    CASE WHEN len(names) = 0 THEN 0.0 ELSE len(list_filter(names, lambda x: length(x) > 3 AND lower(x) NOT IN ({', '.join(q(w) for w in K.JS_STOP_NAMES)}))) / len(names) END AS meaningful_name_ratio,
    CASE WHEN len(names) = 0 THEN 0.0 ELSE len(list_filter(names, lambda x: length(x) = 1 AND x NOT IN ({', '.join(q(ch) for ch in K.JS_EXEMPT_LETTERS)}))) / len(names) END AS single_letter_var_ratio,
    CASE WHEN len(names) = 0 THEN 0.0 ELSE list_sum(list_transform(names, lambda x: length(x))) / len(names) END AS avg_name_length,
    CASE WHEN len(names) = 0 THEN 0.0 ELSE {dominant(
        "len(list_filter(names, lambda x: regexp_matches(x, '^[a-z][a-zA-Z0-9]*$')))",
        "len(list_filter(names, lambda x: regexp_matches(x, '^[a-z_][a-z0-9_]*$')))",
        "len(list_filter(names, lambda x: lower(x) = x AND upper(x) <> x AND NOT contains(x, '_') AND NOT contains(x, '$')))")} END AS naming_consistency_score,
    CASE WHEN len(strings) = 0 THEN 0.0 ELSE greatest(
        len(list_filter(strings, lambda s: left(s, 1) = '''')),
        len(list_filter(strings, lambda s: left(s, 1) = '"')),
        len(list_filter(strings, lambda s: left(s, 1) = '`'))) / len(strings) END AS quote_consistency,
    n_console > 0 AS has_console_log, n_debugger > 0 AS has_debugger, n_todo > 0 AS has_todo_comments,
    n_ccode > 0 AS has_commented_code, n_alert > 0 AS has_alert, n_eval > 0 AS has_eval,
    n_var > 0 AS has_var_declarations, n_long > 0 AS has_long_lines, n_cbh > 0 AS has_callback_hell,
    n_jquery > 0 AS uses_jquery,
    {sat('n_console', 3)} AS console_log_score, {sat('n_debugger', 1)} AS debugger_score,
    {sat('n_todo', 2)} AS todo_comment_score, {sat('n_ccode', 2)} AS commented_code_score,
    {sat('n_alert', 1)} AS alert_score, {sat('n_eval', 1)} AS eval_score, {sat('n_var', 3)} AS var_declaration_score,
    {sat('n_cbh', 1)} AS callback_hell_score, {sat('n_jquery', 1)} AS jquery_score, {sat('n_long', 3)} AS long_line_score,
    {sat('n_generic', 3)} AS generic_example_score, {sat('n_exu', 4)} AS example_usage_score,
    {sat('n_plc', 3)} AS placeholder_score,
    {sat('line_comments', 5)} * least(1.0, greatest(0.0, CAST(line_comments AS DOUBLE) / greatest(total_lines, 1))) AS excessive_comments_ratio
  FROM jsf
)"""


JS_FEATURE_COLUMNS = [
    "total_lines", "non_empty_lines", "blank_line_ratio", "token_count", "token_entropy", "comment_ratio",
    "avg_line_length", "line_length_variance", "line_length_uniformity", "function_count", "loop_count",
    "try_except_count", "max_ast_depth", "uses_arrow_functions", "uses_async_await", "uses_destructuring",
    "uses_template_literals", "uses_spread_operator", "uses_optional_chaining", "has_iife", "import_export_usage",
    "uses_strict_mode", "function_style_consistency", "pattern_repetition_score", "uses_camel_case_ratio",
    "uses_snake_case_ratio", "meaningful_name_ratio", "single_letter_var_ratio", "avg_name_length",
    "naming_consistency_score", "semicolon_consistency", "quote_consistency", "indentation_consistency",
    "has_console_log", "has_debugger", "has_todo_comments", "has_commented_code", "has_alert", "has_eval",
    "has_var_declarations", "has_long_lines", "has_callback_hell", "uses_jquery", "console_log_score",
    "debugger_score", "todo_comment_score", "commented_code_score", "alert_score", "eval_score",
    "var_declaration_score", "callback_hell_score", "jquery_score", "long_line_score", "generic_example_score",
    "example_usage_score", "placeholder_score", "excessive_comments_ratio", "uses_react_patterns",
    "uses_node_patterns", "uses_typescript_patterns", "module_pattern",
]


def _weighted(weights: dict) -> str:
    return " + ".join(f"coalesce(CAST({n} AS DOUBLE), 0.0) * {float(w)}" for n, w in weights.items())


def _top(weights: dict, alias: str) -> str:
    entries = ", ".join(
        f"{{'c': coalesce(CAST({n} AS DOUBLE), 0.0) * {float(w)}, 'n': {q(n)}}}" for n, w in weights.items()
    )
    return (
        f"array_to_string(list_transform(list_sort(list_filter([{entries}], lambda e: e.c > 0), 'DESC')[1:{K.TOP_SIGNALS}], "
        f"lambda e: replace(e.n, '_', ' ')), ', ') AS {alias}"
    )


def round4(value: str) -> str:
    """round(value, 4) of Python, ties to even by the double's binary value: the exact product with 10^4 as a double and its error."""
    high = "(v * 134217729.0::DOUBLE - (v * 134217729.0::DOUBLE - v))"
    error = f"(({high} * 10000.0::DOUBLE - p) + (v - {high}) * 10000.0::DOUBLE)"
    up = f"p - floor(p) > 0.5 OR (p - floor(p) = 0.5 AND ({error} > 0 OR ({error} = 0 AND floor(p) % 2 <> 0)))"
    inner = f"list_transform([v * 10000.0::DOUBLE], lambda p: (floor(p) + CASE WHEN {up} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / 10000.0::DOUBLE)[1]"
    return f"list_transform([CAST({value} AS DOUBLE)], lambda v: {inner})[1]"


def js_score_ctes(lines: int = K.MINIMUM_LINES, tokens: int = K.MINIMUM_TOKENS, signal: float = K.MINIMUM_SIGNAL, margin: float = K.MINIMUM_MARGIN,
                  table: str = "js", ai: dict = K.JS_AI_WEIGHTS, human: dict = K.JS_HUMAN_WEIGHTS) -> str:
    """K1-K8 over the chunk features of ``table``."""
    return f""",
js_raw AS (
  SELECT *, ({_weighted(ai)}) AS ai, ({_weighted(human)}) AS hu,
         {_top(ai, 'top_ai')}, {_top(human, 'top_human')}
  FROM {table}),
js_scored AS (
  SELECT *,
    {round4('ai')} AS ai_score, {round4('hu')} AS human_score, {round4('ai - hu')} AS score_gap,
    {round4('ai + hu')} AS signal_strength, {round4('1.0 / (1.0 + exp(-(ai - hu)))')} AS ai_probability,
    {round4('0.5 + 0.5 * least(1.0, greatest(0.0, (abs(ai - hu) / 3.0) * least((ai + hu) / 4.0, 1.0)))')} AS confidence,
    CASE WHEN non_empty_lines < {lines} OR token_count < {tokens}
              OR ai + hu < {signal} OR abs(ai - hu) < {margin} THEN {q(K.UNCERTAIN_LABEL)}
         WHEN ai - hu > 0 THEN {q(K.AI_LABEL)} ELSE {q(K.HUMAN_LABEL)} END AS classification,
    CASE WHEN non_empty_lines < {lines} OR token_count < {tokens} THEN {q(K.BASIS_LOW)}
         WHEN ai + hu < {signal} OR abs(ai - hu) < {margin} THEN {q(K.BASIS_CONFLICT)}
         ELSE {q(K.BASIS_CLEAR)} END AS decision_basis
  FROM js_raw)"""


def weight_set_ctes(rows, features, **thresholds) -> str:
    """js_scored under every set of a table of weights: chunk features unpivoted, joined by name, summed in the table's order."""
    values = ", ".join(f"({q(s)}, {q(side)}, {q(f)}, CAST({w!r} AS DOUBLE), {i})" for s, _, side, f, w, i in rows)
    numbers = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in features)
    top = lambda side: f"array_to_string(list_transform(list_sort(list({{'c': c, 'n': feature}}) FILTER (WHERE side = {q(side)} AND c > 0), 'DESC')[1:3], lambda e: replace(e.n, '_', ' ')), ', ')"
    total = lambda side: f"coalesce(list_reduce(list_prepend(0.0::DOUBLE, list(c ORDER BY position) FILTER (WHERE side = {q(side)})), lambda a, b: a + b), 0.0)"
    scored = js_score_ctes(**thresholds)
    return f""",
weight (weight_set, side, feature, weight, position) AS (VALUES {values}),
every AS (SELECT file_id, chunk_id, non_empty_lines, token_count, weight_set FROM js, (SELECT DISTINCT weight_set FROM weight)),
valued AS (UNPIVOT (SELECT file_id, chunk_id, {numbers} FROM js) ON {", ".join(features)} INTO NAME feature VALUE value),
part AS (SELECT file_id, chunk_id, weight_set, side, feature, position, coalesce(value, 0.0) * weight AS c FROM valued JOIN weight USING (feature)),
summed AS (SELECT file_id, chunk_id, weight_set, {total('ai')} AS ai, {total('human')} AS hu, coalesce({top('ai')}, '') AS top_ai, coalesce({top('human')}, '') AS top_human FROM part GROUP BY ALL),
js_raw AS (SELECT e.*, coalesce(ai, 0.0) AS ai, coalesce(hu, 0.0) AS hu, coalesce(top_ai, '') AS top_ai, coalesce(top_human, '') AS top_human
  FROM every e LEFT JOIN summed s ON s.file_id = e.file_id AND s.chunk_id = e.chunk_id AND s.weight_set = e.weight_set),
{scored[scored.index("js_scored AS ("):]}"""


JS_MEANS = ("ai_score", "human_score", "score_gap", "signal_strength", "ai_probability", "confidence", *JS_DOUBLE)


def js_file_ctes(flags=JS_BOOL, means=JS_MEANS) -> str:
    """L1-L10 over js_scored."""
    return f""",
w AS (SELECT *, greatest(signal_strength, 0.5) * greatest(CAST(non_empty_lines AS DOUBLE), 1.0) AS wt FROM js_scored),
fagg AS (
  SELECT file_id, count(*) AS n, sum(wt ORDER BY chunk_id) AS wsum,
    sum(CASE WHEN decision_basis = {q(K.BASIS_CLEAR)} THEN 1 ELSE 0 END) AS clear_chunk_count,
    sum(total_lines) AS total_lines, sum(non_empty_lines) AS non_empty_lines, sum(token_count) AS token_count,
    sum(function_count) AS function_count, sum(loop_count) AS loop_count, sum(try_except_count) AS try_except_count,
    max(max_ast_depth) AS max_ast_depth,
    {", ".join(f"bool_or({c}) AS {c}" for c in flags)},
    {", ".join(f"max({c}) AS {c}_1, sum({c} * wt ORDER BY chunk_id) AS {c}_w" for c in means)},
    arg_min(module_pattern, chunk_id) AS module1, arg_min(classification, chunk_id) AS class1, arg_min(decision_basis, chunk_id) AS basis1,
    arg_min(top_ai, chunk_id) AS top_ai1, arg_min(top_human, chunk_id) AS top_human1,
    string_agg(classification, '|' ORDER BY chunk_id) AS chunk_classes
  FROM w GROUP BY file_id),
fmean AS (
  SELECT *,
    {", ".join(f"CASE WHEN n = 1 THEN {c}_1 ELSE {round4(c + '_w / wsum')} END AS {c}" for c in means)}
  FROM fagg),
sig AS (
  SELECT file_id, side, s, count(*) AS cnt, min(chunk_id * 8 + pos) AS first_seen FROM (
    SELECT file_id, chunk_id, 'ai' AS side, unnest(string_split(top_ai, ', ')) AS s,
           generate_subscripts(string_split(top_ai, ', '), 1) AS pos FROM w WHERE top_ai <> ''
    UNION ALL
    SELECT file_id, chunk_id, 'hu', unnest(string_split(top_human, ', ')),
           generate_subscripts(string_split(top_human, ', '), 1) FROM w WHERE top_human <> '')
  GROUP BY ALL),
sig_top AS (
  SELECT file_id,
    coalesce(string_agg(s, ', ' ORDER BY cnt DESC, first_seen) FILTER (WHERE side = 'ai' AND r <= {K.TOP_SIGNALS}), '') AS top_ai_m,
    coalesce(string_agg(s, ', ' ORDER BY cnt DESC, first_seen) FILTER (WHERE side = 'hu' AND r <= {K.TOP_SIGNALS}), '') AS top_human_m
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id, side ORDER BY cnt DESC, first_seen) AS r FROM sig)
  GROUP BY file_id),
files AS (
  SELECT f.*,
    CASE WHEN n = 1 THEN class1
         WHEN clear_chunk_count = 0 OR abs(score_gap) < {K.FILE_MINIMUM_GAP} THEN {q(K.UNCERTAIN_LABEL)}
         WHEN ai_probability >= {K.FILE_AI_PROBABILITY} THEN {q(K.AI_LABEL)}
         WHEN ai_probability <= {K.FILE_HUMAN_PROBABILITY} THEN {q(K.HUMAN_LABEL)}
         ELSE {q(K.UNCERTAIN_LABEL)} END AS classification,
    CASE WHEN n = 1 THEN basis1 WHEN clear_chunk_count > 0 THEN {q(K.BASIS_CHUNKS)} ELSE {q(K.BASIS_LOW)} END AS decision_basis,
    CASE WHEN n = 1 THEN top_ai1 ELSE coalesce(t.top_ai_m, '') END AS top_ai_signals,
    CASE WHEN n = 1 THEN top_human1 ELSE coalesce(t.top_human_m, '') END AS top_human_signals
  FROM fmean f LEFT JOIN sig_top t ON t.file_id = f.file_id)"""


def to_fixed(value: str, digits: int) -> str:
    """C's printf rounds the exact binary value but takes ties to even; ties (odd multiples of 1/4 or 1/8) go up."""
    step = {1: 4, 2: 8}[digits]
    tie = f"({value}) * {step} = floor(({value}) * {step}) AND CAST(floor(({value}) * {step}) AS BIGINT) % 2 = 1"
    up = f"printf('%.{digits}f', (floor(({value}) * {10**digits}) + 1) / {10**digits})"
    return f"CASE WHEN {tie} THEN {up} ELSE printf('%.{digits}f', {value}) END"


def js_report_sql(language: str = "javascript") -> str:
    rows = [
        ("Classification", "classification"), ("Language", q(language)), ("Confidence", to_fixed("confidence * 100", 1) + " || '%'"), ("", "''"),
        ("Token Entropy", to_fixed("token_entropy", 2)), ("Comment Ratio", to_fixed("comment_ratio * 100", 1) + " || '%'"),
        ("Total Lines", "CAST(total_lines AS VARCHAR)"), ("Functions", "CAST(function_count AS VARCHAR)"), ("Loops", "CAST(loop_count AS VARCHAR)"),
        ("Try/Except Blocks", "CAST(try_except_count AS VARCHAR)"), ("Max AST Depth", "CAST(max_ast_depth AS VARCHAR)"),
    ]
    return " UNION ALL ".join(f"SELECT file_id, {i} AS position, {q(name)} AS property, {value} AS value FROM files" for i, (name, value) in enumerate(rows))


def js_detailed_sql() -> str:
    """A5: every column of the detailed output; what only Python files have is the text ``null``."""

    def feature(name: str) -> str:
        if name in LONG_FEATURES:
            return f"CAST({name} AS BIGINT) AS {name}"
        if name == "module_pattern":
            return "CASE WHEN n = 1 THEN module1 ELSE 'null' END AS module_pattern"
        if name in JS_BOOL:
            return name
        if name in JS_DOUBLE:
            return f"round({name}, 6) AS {name}"
        return f"'null' AS {name}"

    scores = ", ".join(f"round({c}, 6) AS {c}" for c in JS_MEANS[:6])
    return f"""SELECT file_id, CASE WHEN classification = {q(K.AI_LABEL)} THEN 1 ELSE 0 END AS result, classification, 'javascript' AS language, {scores},
      decision_basis, top_ai_signals, top_human_signals, CAST(n AS INT) AS chunk_count, CAST(clear_chunk_count AS INT) AS clear_chunk_count,
      replace(chunk_classes, '|', ', ') AS chunk_classifications, {", ".join(feature(c) for c in ALL_FEATURES)}, CAST(NULL AS VARCHAR) AS error FROM files"""


def labelled_ctes() -> str:
    """Files with an expected class and their results."""
    return f""",
labelled AS (SELECT f.classification AS predicted, CASE WHEN quality = 1 THEN {q(K.HUMAN_LABEL)} ELSE {q(K.AI_LABEL)} END AS expected,
    substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3') AS held_out, ai_probability
  FROM labels l JOIN files f ON f.file_id = l.doc_id * 4 + 1 WHERE quality IS NOT NULL)"""


CLASS_METRICS_SQL = """SELECT held_out, class, CAST(count(*) FILTER (class = expected) AS BIGINT) AS as_expected, CAST(count(*) FILTER (class = predicted) AS BIGINT) AS as_predicted,
  CAST(count(*) FILTER (class = expected AND class = predicted) AS BIGINT) AS hits,
  round(count(*) FILTER (class = expected AND class = predicted) / nullif(count(*) FILTER (class = predicted), 0), 6) AS precision,
  round(count(*) FILTER (class = expected AND class = predicted) / nullif(count(*) FILTER (class = expected), 0), 6) AS recall,
  round(2 * count(*) FILTER (class = expected AND class = predicted) / (count(*) FILTER (class = expected) + count(*) FILTER (class = predicted)), 6) AS f1
FROM labelled JOIN (SELECT held_out, expected AS class FROM labelled UNION SELECT held_out, predicted FROM labelled) USING (held_out)
WHERE class IN (expected, predicted) GROUP BY ALL"""


def reliability_sql(bins: int = 10) -> str:
    return f"""SELECT held_out, CAST(bin AS INT) AS bin, CAST(sum(n) AS BIGINT) AS files, round(min(p) / 10000, 6) AS low, round(max(p) / 10000, 6) AS high,
  round(sum(n * p) / sum(n) / 10000, 6) AS mean_probability, round(sum(hits) / sum(n), 6) AS share
FROM (SELECT *, (sum(n) OVER (PARTITION BY held_out ORDER BY p) - n) * {bins} // sum(n) OVER (PARTITION BY held_out) AS bin
  FROM (SELECT held_out, CAST(round(ai_probability * 10000) AS BIGINT) AS p, count(*) AS n, count(*) FILTER (expected = {q(K.AI_LABEL)}) AS hits FROM labelled GROUP BY ALL))
GROUP BY held_out, bin"""


def stored_files_sql(per_file: int) -> str:
    """The stored files as (file_id, code, bad), written out again from the documents."""
    return f"""SELECT file_id, bad, CASE WHEN starts_with(code, chr(65279)) THEN substr(code, 2) ELSE code END AS code
      FROM (SELECT CAST(floor(doc_id / {per_file}) AS BIGINT) AS file_id, bool_or(doc_id % {per_file} = 0 AND floor(doc_id / {per_file}) % 3 <> 1 AND floor(doc_id / {per_file}) % 5 = 2) AS bad,
          string_agg(CASE WHEN doc_id % {per_file} = 0 AND floor(doc_id / {per_file}) % 3 = 1 THEN chr(65279) ELSE '' END || coalesce(text, '') || chr(10), '' ORDER BY doc_id, coalesce(text, '')) AS code
        FROM documents GROUP BY 1)"""
