"""Behavioural constants of the detector.

FIXED VALUES: everything in this module must equal the values of the
heuristic detector we reproduce (weights, thresholds, scales, word lists
and regular expressions).  They are stated plainly and in their natural
order.  Regular expressions are written in Python ``re`` syntax (or, for
language detection, ECMAScript syntax) exactly as the heuristics define
them; :mod:`quillscope.functions.regex` translates them mechanically to
the Java dialect Spark executes.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# FIXED VALUES: classification labels and decision-basis strings
# --------------------------------------------------------------------------
AI_LABEL = "AI-Generated Code"
HUMAN_LABEL = "Human-Written Code"
UNCERTAIN_LABEL = "Uncertain (Mixed Signals)"

BASIS_LOW = "low-signal snippet"
BASIS_CONFLICT = "conflicting heuristics"
BASIS_CLEAR = "clear heuristic signal"
BASIS_CHUNKS = "chunk-level aggregation"

ERR_UNDETECTED = "Unable to detect language. Please specify the language explicitly."
ERR_UNSUPPORTED = "Unsupported language: {}"
ERR_NO_CODE = "No code provided"
ERR_ENCODING = "File is not valid UTF-8"
ERR_TOO_LARGE = "File is too large"
ERR_MALFORMED = "Malformed record"
ERR_TOO_DEEP = "RecursionError: maximum recursion depth exceeded"

# Trees this deep exceed the default recursion limit of a recursive depth walk.
MAX_TREE_DEPTH = 990

# FIXED VALUES: token kinds (names in the standard ``tokenize`` module) that
# are layout or comments and are not counted
PY_LAYOUT_TOKENS = ("INDENT", "DEDENT", "NEWLINE", "NL", "COMMENT", "ENCODING")

# --------------------------------------------------------------------------
# FIXED VALUES: chunking and abstention thresholds (keyword arguments)
# --------------------------------------------------------------------------
TARGET_CHARS = 2200
MINIMUM_TAIL_CHARS = 500
MINIMUM_LINES = 5
MINIMUM_TOKENS = 24
MINIMUM_SIGNAL = 1.2
MINIMUM_MARGIN = 0.8
FILE_MINIMUM_GAP = 0.75
FILE_AI_PROBABILITY = 0.65
FILE_HUMAN_PROBABILITY = 0.35
TOP_SIGNALS = 3
LONG_LINE_CHARS = 100

# --------------------------------------------------------------------------
# FIXED VALUES: weights per language and side
# --------------------------------------------------------------------------
PY_AI_WEIGHTS = {
    "generic_example_score": 1.5,
    "example_usage_score": 1.1,
    "placeholder_score": 1.0,
    "over_explanation_score": 0.9,
    "docstring_coverage": 0.6,
    "import_organization_score": 0.5,
    "pattern_repetition_score": 0.7,
    "indentation_consistency": 0.4,
    "quote_consistency": 0.3,
    "naming_consistency_score": 0.4,
    "line_length_uniformity": 0.3,
}

PY_HUMAN_WEIGHTS = {
    "todo_comment_score": 1.6,
    "debug_print_score": 1.2,
    "commented_code_score": 1.1,
    "magic_number_score": 0.6,
    "trailing_whitespace_score": 1.0,
    "single_letter_var_ratio": 0.4,
    "function_length_variance_score": 0.6,
    "bare_except_score": 1.0,
    "long_line_score": 0.4,
}

JS_AI_WEIGHTS = {
    "generic_example_score": 1.5,
    "example_usage_score": 1.2,
    "placeholder_score": 1.0,
    "excessive_comments_ratio": 0.7,
    "function_style_consistency": 0.5,
    "semicolon_consistency": 0.4,
    "indentation_consistency": 0.4,
    "quote_consistency": 0.3,
    "pattern_repetition_score": 0.7,
    "line_length_uniformity": 0.3,
}

JS_HUMAN_WEIGHTS = {
    "todo_comment_score": 1.6,
    "debugger_score": 1.4,
    "commented_code_score": 1.1,
    "alert_score": 0.9,
    "eval_score": 0.8,
    "var_declaration_score": 0.7,
    "callback_hell_score": 0.9,
    "jquery_score": 0.9,
    "console_log_score": 0.6,
    "single_letter_var_ratio": 0.4,
    "long_line_score": 0.4,
}

# --------------------------------------------------------------------------
# FIXED VALUES: word lists and sets
# --------------------------------------------------------------------------
PY_STOP_NAMES = ["tmp", "temp", "var", "val", "res", "ret", "obj", "item", "data"]
JS_STOP_NAMES = ["tmp", "temp", "var", "val", "res", "ret", "obj", "item", "data", "arr"]
PY_EXEMPT_LETTERS = "ijkxyz"
JS_EXEMPT_LETTERS = "ijkxy"
PY_COMMON_NUMBERS = [0, 1, 2, -1, 10, 60, 100, 1000]
PY_INDENT_WIDTHS = [4]
JS_INDENT_WIDTHS = [2, 4]

# Characters at which Python's str.splitlines breaks a line.
LINE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
# Characters Python's str.isspace / str.strip treat as whitespace.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --------------------------------------------------------------------------
# FIXED VALUES: Python heuristics (Python ``re`` syntax; I = IGNORECASE)
# --------------------------------------------------------------------------
PY_PATTERNS = {
    "todo": (r"#\s*(TODO|FIXME|HACK|XXX|BUG|REFACTOR)\b", "I"),
    "debug": (r"\b(print|breakpoint)\s*\(", ""),
    "commented_code": (r"#\s*(if|for|while|def|class|import|return|with)\b", ""),
    "generic": (r"\b(foo|bar|baz|example|sample|demo|tutorial|helper)\b", "I"),
    "example_usage": (r"\b(example|sample|demo)_?\w*\b|example usage", "I"),
    "placeholder": (r"\b(TODO|FIXME|INSERT|REPLACE|your_|my_|some_)\b", "I"),
}

# --------------------------------------------------------------------------
# FIXED VALUES: JavaScript heuristics (Python ``re`` syntax; I = IGNORECASE,
# M = MULTILINE, S = DOTALL)
# --------------------------------------------------------------------------
JS_TOKEN = r"[A-Za-z_$][A-Za-z0-9_$]*|\d+(?:\.\d+)?|==|!=|<=|>=|=>|\.\.\.|[{}()[\].,;:+\-*/%<>!?=]"
JS_STRING = r"'[^'\n]*'|\"[^\"\n]*\"|`[^`\n]*`"
JS_KEYWORDS = r"\b(if|for|while|function|const|let|var|return|class|try|catch)\b"
JS_NAME_DECLARED = r"(?:var|let|const|function|class)\s+([A-Za-z_$][A-Za-z0-9_$]*)"
JS_NAME_ARROW = r"\b([A-Za-z_$][A-Za-z0-9_$]*)\s*=>"

JS_PATTERNS = {
    "function_word": (r"\bfunction\b", ""),
    "arrow": (r"=>", ""),
    "loop": (r"\b(for|while|do)\b", ""),
    "try": (r"\btry\b", ""),
    "async_await": (r"\basync\b|\bawait\b", ""),
    "destructuring": (r"(?:const|let)\s*[{[][^}\]]+[}\]]\s*=", ""),
    "template_literal": (r"`[^`]*\$\{[^}]+\}", ""),
    "iife": (r"\(\s*function\s*\([^)]*\)\s*{", ""),
    "import_export": (r"^\s*(import|export)\s+", "M"),
    "strict_mode": (r"[\"']use strict[\"']", ""),
    "function_named": (r"\bfunction\s+\w+\s*\(", ""),
    "function_anonymous": (r"\bfunction\s*\(", ""),
    "console": (r"console\.(log|debug|warn|error)\s*\(", ""),
    "debugger": (r"\bdebugger\b", ""),
    "todo": (r"//\s*(TODO|FIXME|HACK|XXX|BUG)\b", "I"),
    "commented_code": (r"//\s*(if|for|while|function|const|let|var|return|class)\b", ""),
    "alert": (r"\balert\s*\(", ""),
    "eval": (r"\beval\s*\(", ""),
    "var": (r"\bvar\s+", ""),
    "jquery_call": (r"\$\s*\(|jQuery\s*\(", ""),
    "jquery_require": (r"require\s*\(\s*[\"']jquery[\"']\s*\)", ""),
    "callback_hell": (r"function\s*\([^)]*\)\s*{[^{}]*function\s*\([^)]*\)\s*{", "S"),
    "generic": (r"\b(foo|bar|baz|example|sample|demo|tutorial|helper|myFunction|myVariable)\b", "I"),
    "example_usage": (r"\b(example|sample|demo|mock)(?:Data|Input|Output)?\b|example usage", "I"),
    "placeholder": (r"\b(TODO|FIXME|INSERT|REPLACE|your-|my-)\b", "I"),
    "react": (r"(useState|useEffect|React\.|jsx|className=)", ""),
    "node": (r"(require\s*\(|module\.exports|process\.|__dirname|__filename)", ""),
    "typescript": (r"(@param\s*{|@returns\s*{|:\s*(string|number|boolean)|interface\s+\w+)", ""),
    "commonjs": (r"module\.exports|exports\.", ""),
    "es6": (r"export\s+(default|const|function|class)|import\s+.*\s+from", ""),
}

# --------------------------------------------------------------------------
# FIXED VALUES: language detection (ECMAScript syntax; M = multiline flag)
# --------------------------------------------------------------------------
EXTENSION_LANGUAGE = {
    "py": "python",
    "js": "javascript",
    "jsx": "javascript",
    "ts": "javascript",
    "tsx": "javascript",
}

DETECT_PYTHON = [
    (r"^import\s+\w+", "M"),
    (r"^from\s+\w+\s+import", "M"),
    (r"^def\s+\w+\s*\(", "M"),
    (r"^class\s+\w+", "M"),
    (r"if\s+__name__\s*==\s*[\"']__main__[\"']:", ""),
    (r"^\s{4,}[^\s]", "M"),
]

DETECT_JAVASCRIPT = [
    (r"^const\s+\w+\s*=", "M"),
    (r"^let\s+\w+\s*=", "M"),
    (r"^var\s+\w+\s*=", "M"),
    (r"^function\s+\w+\s*\(", "M"),
    (r"^export\s+(default\s+)?", "M"),
    (r"^import\s+.*\s+from\s+[\"']", "M"),
    (r"=>\s*{", ""),
    (r"\{\s*\n\s*[^\s]", "M"),
]
