"""Language detection and resolution (B1-B3) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .regex import ECMA_LINE_END, ecma_regex

SUPPORTED = ("python", "javascript")


def language_by_extension(path: Column) -> Column:
    """Text after the last ``.`` (whole name without a dot), lower-cased."""
    ext = F.lower(F.substring_index(path, ".", -1))
    out = None
    for e, lang in K.EXTENSION_LANGUAGE.items():
        out = (F if out is None else out).when(ext == F.lit(e), F.lit(lang))
    return out


# Text that every match of a pattern contains, in the patterns' order: a substring test spares most files the pattern.
REQUIRED = {
    id(K.DETECT_PYTHON): ("import", "import", "def", "class", "__name__", ""),
    id(K.DETECT_JAVASCRIPT): ("const", "let", "var", "function", "export", "import", "=>", "{"),
}


def _found(code: Column, pattern: str, flags: str) -> Column:
    """Whether a pattern occurs.  One for the start of a line is looked for after a line's end only."""
    if pattern.startswith("^") and "M" in flags:
        return F.concat(F.lit("\n"), code).rlike(ECMA_LINE_END + ecma_regex(pattern[1:]))
    return code.rlike(ecma_regex(pattern, flags))


def _score(code: Column, patterns) -> Column:
    total = None
    for (pattern, flags), text in zip(patterns, REQUIRED[id(patterns)], strict=True):
        hit = F.when(code.contains(text) & _found(code, pattern, flags), 1).otherwise(0)
        total = hit if total is None else total + hit
    return total


def language_by_content(code: Column) -> Column:
    """More matching Python patterns than JavaScript ones → python, fewer →
    javascript, tie → NULL (presence of each pattern, not counts)."""
    py = _score(code, K.DETECT_PYTHON)
    js = _score(code, K.DETECT_JAVASCRIPT)
    by_sign = F.array(F.lit("javascript"), F.lit(None), F.lit("python"))  # one mention of the scores: each would run all patterns
    return F.get(by_sign, F.signum(py - js).cast("int") + 1)


def resolve_language(explicit: Column, path: Column, code: Column) -> Column:
    """explicit > extension > content."""
    return F.coalesce(F.lower(explicit), language_by_extension(path), language_by_content(code))


def language_error(language: Column) -> Column:
    return (
        F.when(language.isNull(), F.lit(K.ERR_UNDETECTED))
        .when(~language.isin(*SUPPORTED), F.format_string(K.ERR_UNSUPPORTED.replace("{}", "%s"), language))
    )


def detect_language(code: Column, path: Column | None = None) -> Column:
    """U4: the language of ``code``, by the extension of ``path`` where it has a known one, else by content; null where neither tells."""
    return resolve_language(F.lit(None).cast("string"), F.lit(None).cast("string") if path is None else path, code)
