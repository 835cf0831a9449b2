"""Column helpers: bounded arithmetic, Python-compatible strip/split, and
sequence statistics over arrays (all JVM-side built-ins, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import LINE_BREAKS, PY_WHITESPACE
from .regex import LINE_BREAK


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def once(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once: inside a lambda every mention of an expression evaluates it again."""
    return F.transform(F.array(value), body)[0]


# --- F1-F6 -----------------------------------------------------------------

def clamp(value, minimum: float = 0.0, maximum: float = 1.0) -> Column:
    """``value`` within the bounds; null stays null (greatest and least would skip it)."""
    v = _c(value).cast("double")
    return F.when(v.isNotNull(), F.greatest(F.lit(float(minimum)), F.least(F.lit(float(maximum)), v)))


def safe_ratio(numerator, denominator) -> Column:
    d = _c(denominator).cast("double")
    return F.when(d <= 0, F.lit(0.0)).otherwise(_c(numerator).cast("double") / d)


def saturate(value, scale) -> Column:
    s = _c(scale).cast("double")
    return F.when(s <= 0, F.lit(0.0)).otherwise(clamp(_c(value).cast("double") / s))


def sigmoid(value) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(value)))


def round_even(value: Column, digits: int = 4) -> Column:
    """``round(value, digits)`` of Python: by the double's binary value, ties to even, for magnitudes under 2^38.

    The product with 10^digits is taken exactly, as a double and its error: the
    value is split in two halves of at most 26 bits, whose products are exact.
    Only a product that lies on a tie can be on another side than it seems."""
    scale = F.lit(float(10**digits))
    high = value * 134217729.0 - (value * 134217729.0 - value)
    product = value * scale
    error = (high * scale - product) + (value - high) * scale
    whole = F.floor(product).cast("double")
    part = product - whole
    odd = whole % 2 != 0
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & odd)))
    return F.when(F.abs(value) >= 2.0**38, value).otherwise((whole + up.cast("double")) / scale)


# --- Python str semantics --------------------------------------------------

# Native trims take a character set: exact Python str.strip semantics,
# without a regex per line.
def py_strip(line) -> Column:
    return F.trim(_c(line), F.lit(PY_WHITESPACE))


def py_rstrip(line) -> Column:
    return F.rtrim(_c(line), F.lit(PY_WHITESPACE))


def py_lstrip(line) -> Column:
    return F.ltrim(_c(line), F.lit(PY_WHITESPACE))


def py_nonblank(line) -> Column:
    return F.length(py_lstrip(line)) > 0


def stripped_startswith(line, *prefixes: str) -> Column:
    """``line.strip().startswith(prefixes)``."""
    head = py_lstrip(line)
    out = None
    for p in prefixes:
        t = F.startswith(head, F.lit(p))
        out = t if out is None else (out | t)
    return out


def split_lines(text) -> Column:
    """``str.splitlines()``: no terminators, no trailing empty line, '' → []."""
    return once(
        F.split(_c(text), LINE_BREAK, -1),
        lambda parts: F.when(F.element_at(parts, -1) == F.lit(""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts),
    )


def line_count(text) -> Column:
    """``len(text.splitlines())`` without materialising the lines: the
    number of terminators, plus one if the text does not end in one."""
    t = _c(text)
    last = F.substring(t, -1, 1)
    open_tail = (F.length(t) > 0) & ~last.isin(*list(LINE_BREAKS))
    return F.regexp_count(t, F.lit(LINE_BREAK)) + F.when(open_tail, 1).otherwise(0)


def leading_spaces(line) -> Column:
    """``len(line) - len(line.lstrip(' '))``."""
    return F.length(_c(line)) - F.length(F.ltrim(_c(line)))


# --- sequence statistics over arrays (F7-F9, D4) ---------------------------

def dominant_ratio(*counts) -> Column:
    """max / sum over the positive values, 0 if none."""
    pos = [F.greatest(_c(c).cast("double"), F.lit(0.0)) for c in counts]
    total = pos[0]
    for p in pos[1:]:
        total = total + p
    return F.when(total <= 0, F.lit(0.0)).otherwise(F.greatest(*pos) / total)


def _run_fold(values: Column, on_run) -> Column:
    """Fold over the runs of equal values of an array, sorted; ``on_run(acc, run_length, size)`` is applied to each,
    and 0 is that of an empty array.  Only the ends of runs are folded."""
    def fold(b: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), b["n"]), lambda i: (i == b["n"]) | (F.get(b["s"], i) != F.get(b["s"], i - 1)))
        start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("acc"))
        step = lambda a, end: F.struct(end.alias("at"), on_run(a["acc"], end - a["at"], b["n"]).alias("acc"))
        return F.when(b["n"] == 0, F.lit(0.0)).otherwise(F.aggregate(ends, start, step, lambda a: a["acc"]))

    return once(F.struct(F.sort_array(values).alias("s"), F.size(values).alias("n")), fold)


def entropy(tokens) -> Column:
    """Shannon entropy (base 2) of the value frequencies of an array."""
    return _run_fold(_c(tokens), lambda acc, run, n: acc - (run / n) * F.log2(run / n))


def max_run(values) -> Column:
    """Largest multiplicity of a value in an array (0 for an empty array)."""
    return _run_fold(_c(values), lambda acc, run, _: F.greatest(acc, run.cast("double")))


def pattern_repetition(seq, window: int = 3) -> Column:
    """Most frequent sliding ``window``-gram / number of windows; 0 if short."""
    def share(arr: Column) -> Column:
        n = F.size(arr)
        heads = F.slice(arr, 1, F.greatest(n - (window - 1), F.lit(0)))
        grams = F.transform(heads, lambda x, i: F.concat_ws("\u0001", x, *[F.get(arr, i + k) for k in range(1, window)]))
        windows = (n - (window - 1)).cast("double")
        return F.when(n < window, F.lit(0.0)).otherwise(max_run(grams) / windows)

    return once(_c(seq), share)


def _opens_with(quote: str):
    return lambda s: F.startswith(s, F.lit(quote))


def quote_consistency(strings) -> Column:
    """Largest share of one opening quote among strings of length >= 2."""
    def share(c: Column) -> Column:
        total = c["a"] + c["b"] + c["c"]
        return F.when(total == 0, F.lit(0.0)).otherwise(F.greatest(c["a"], c["b"], c["c"]).cast("double") / total)

    opening = lambda arr: [count_where(arr, _opens_with(q)).alias(n) for q, n in zip(("'", '"', "`"), "abc")]
    return once(F.filter(_c(strings), lambda s: F.length(s) >= 2), lambda arr: once(F.struct(*opening(arr)), share))


def count_where(arr, pred) -> Column:
    return F.size(F.filter(_c(arr), pred))


def sum_of(arr, fn=None) -> Column:
    a = _c(arr) if fn is None else F.transform(_c(arr), fn)
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def stddev_pop_of(arr) -> Column:
    """Population std-dev (two-pass, the mean carried in the accumulator),
    0 when fewer than two values."""
    a = _c(arr)
    n = F.size(a).cast("double")
    init = F.struct((sum_of(a) / n).alias("m"), F.lit(0.0).alias("ss"))
    ss = F.aggregate(
        a,
        init,
        lambda s, x: F.struct(s["m"].alias("m"), (s["ss"] + (x.cast("double") - s["m"]) * (x.cast("double") - s["m"])).alias("ss")),
        lambda s: s["ss"],
    )
    return F.when(F.size(a) < 2, F.lit(0.0)).otherwise(F.sqrt(ss / n))
