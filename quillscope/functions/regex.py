"""Mechanical translation of the fixed patterns to the Java regex dialect.

Spark evaluates ``rlike``/``regexp_*`` with ``java.util.regex``.  The
heuristics are defined in Python ``re`` (str patterns: Unicode ``\\w``,
``\\d``, ``\\b``; ``\\s`` = ``str.isspace``; ``.`` excludes only ``\\n``) and,
for language detection, in ECMAScript (ASCII ``\\w``/``\\d``/``\\b``, its own
``\\s`` set, ``^`` after ``\\n \\r U+2028 U+2029`` in multiline mode).
The functions here rewrite only what differs between dialects.
"""

from __future__ import annotations

from functools import lru_cache

from .constants import LINE_BREAKS, PY_WHITESPACE

# ECMAScript WhiteSpace + LineTerminator, the set of JS ``\s``.
_ECMA_WHITESPACE = (
    "\t\n\x0b\x0c\r \xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
_ECMA_LINE_TERMINATORS = "\n\r\u2028\u2029"


def _escape_chars(chars: str) -> str:
    """Class body for ``chars``: those below 256 one by one, which Java keeps in
    one bit set, others with consecutive code points merged into ranges, as each
    listed character or range is a test of its own."""
    points = sorted({ord(ch) for ch in chars})
    parts, i = [], 0
    while i < len(points):
        j = i
        while points[i] > 0xFF and j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        lo, hi = points[i], points[j]
        parts.append(f"\\u{lo:04X}" if lo == hi else f"\\u{lo:04X}-\\u{hi:04X}")
        i = j + 1
    return "".join(parts)


# Python's str.isspace set is exactly Unicode White_Space plus U+001C..U+001F;
# under (?U) Java's \s is that property, a single fast predicate.
_PY_WS_UNICODE_INNER = "\\s\\x1C-\\x1F"


PY_WS_CLASS = "[" + _escape_chars(PY_WHITESPACE) + "]"
PY_NON_WS_CLASS = "[^" + _escape_chars(PY_WHITESPACE) + "]"
LINE_BREAK_CLASS = "[" + _escape_chars(LINE_BREAKS) + "]"
# One line terminator as str.splitlines sees it (\r\n counts as one).  It begins with the class, so that
# other characters cost one test.
LINE_BREAK = LINE_BREAK_CLASS + "(?:(?<=\\r)\\n)?"
# A line with its terminator, if it has one.
LINE = "[^" + LINE_BREAK_CLASS[1:] + "+(?:" + LINE_BREAK + ")?|" + LINE_BREAK


#: What ``^`` may follow in multiline mode.
ECMA_LINE_END = "[" + _escape_chars(_ECMA_LINE_TERMINATORS) + "]"


def _is_quantifier(pattern: str, i: int) -> int:
    """Length of a ``{n}``, ``{n,}`` or ``{n,m}`` quantifier at ``i``, else 0."""
    j = i + 1
    digits = 0
    while j < len(pattern) and pattern[j].isdigit():
        j += 1
        digits += 1
    if digits == 0:
        return 0
    if j < len(pattern) and pattern[j] == "}":
        return j - i + 1
    if j < len(pattern) and pattern[j] == ",":
        j += 1
        while j < len(pattern) and pattern[j].isdigit():
            j += 1
        if j < len(pattern) and pattern[j] == "}":
            return j - i + 1
    return 0


def _rewrite(pattern: str, ws_inner: str, dot: str | None, caret: str | None) -> str:
    out = []
    i = 0
    in_class = False
    class_start = False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(ws_inner if in_class else "[" + ws_inner + "]")
            else:
                out.append(ch + nxt)
            i += 2
            class_start = False
            continue
        if in_class:
            last = pattern[i + 2:i + 3]
            if ch == "]" and not class_start:
                in_class = False
                out.append(ch)
            elif ch.isalnum() and pattern[i + 1:i + 2] == "-" and last.isalnum() and last.isascii():
                # Letters and digits one by one: Java keeps them in one bit set, a range is a test of its own.
                out.append("".join(map(chr, range(ord(ch), ord(last) + 1))))
                class_start = False
                i += 3
                continue
            elif ch in "[{}&":
                out.append("\\" + ch)
            elif ch == "^" and class_start:
                out.append(ch)
                i += 1
                continue
            else:
                out.append(ch)
            class_start = False
            i += 1
            continue
        if ch == "[":
            in_class = True
            class_start = True
            out.append(ch)
        elif ch == "{":
            q = _is_quantifier(pattern, i)
            if q:
                out.append(pattern[i:i + q])
                i += q
                continue
            out.append("\\{")
        elif ch == "}":
            out.append("\\}")
        elif ch == "." and dot is not None:
            out.append(dot)
        elif ch == "^" and caret is not None:
            out.append(caret)
        else:
            out.append(ch)
        i += 1
    return "".join(out)


@lru_cache(maxsize=None)
def java_regex(pattern: str, flags: str = "", starts: str = "") -> str:
    """Python ``re`` (str pattern) → Java regex with the same matches.

    ``starts``, a class body, lists the characters that matches can begin with:
    at others the pattern (Unicode word boundaries above all) is not tried."""
    prefix = "(?U)(?d)"
    if "I" in flags:
        prefix += "(?i)"
    if "M" in flags:
        prefix += "(?m)"
    if "S" in flags:
        prefix += "(?s)"
    body = _rewrite(pattern, _PY_WS_UNICODE_INNER, None, None)
    return prefix + (f"(?=[{starts}])(?:{body})" if starts else body)


@lru_cache(maxsize=None)
def ecma_regex(pattern: str, flags: str = "") -> str:
    """ECMAScript regex → Java regex with the same matches (no ``u`` flag)."""
    caret = None
    if "M" in flags:
        caret = "(?:\\A|(?<=[" + _escape_chars(_ECMA_LINE_TERMINATORS) + "]))"
    dot = "[^" + _escape_chars(_ECMA_LINE_TERMINATORS) + "]"
    return _rewrite(pattern, _escape_chars(_ECMA_WHITESPACE), dot, caret)
