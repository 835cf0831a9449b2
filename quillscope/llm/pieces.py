"""Pre-tokenisation of a byte-level BPE as a deterministic transducer.

The pattern that byte-level BPE vocabularies split texts with,

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

looks ahead by one character only, so it is a transducer of thirteen states
whose transitions say "a piece starts before this character" and / or "a piece
starts before the previous one".  :func:`boundaries` runs it over a buffer of
many texts at once: the buffer is cut into equal chunks, the *state map* of
every chunk (for each start state, its end state) is computed in lock step,
the maps are composed with a parallel prefix scan (composition of functions is
associative), and with each chunk's true start state known the transitions'
outputs are read off, again in lock step.
"""

from __future__ import annotations

import functools
import gc
from collections.abc import Iterator

import numpy as np
import regex

# Character classes.
LETTER, NUMBER, SPACE, BLANK, OTHER, QUOTE, STMD, R, V, L, E = range(11)
CLASSES = 11
IDENTITY = 2 * CLASSES  # padding of the last chunk: keeps every state
# States: at a piece start; in a run of letters / numbers / others; a quote at
# a piece start, alone or followed by r / v / l; a contraction that is complete;
# one or more white-space characters, the last of them a space or another one.
START, WORD, NUM, SYM, Q, QR, QV, QL, DONE, SP1, SPN, WS1, WSN = range(13)
STATES = 13
ROW = 16
BEFORE, BEFORE_PREVIOUS = 1, 2
PENDING = (QR, QV, QL)  # at the end of a text, their letter is a piece of its own

CHUNK = 128
COALESCE_AFTER = 16
WINDOW = 1 << 21


def _after_run(c: int) -> int:
    """State after a character that starts a piece behind a finished one."""
    if c in (LETTER, STMD, R, V, L, E):
        return WORD
    return {NUMBER: NUM, SPACE: SP1, BLANK: WS1, OTHER: SYM, QUOTE: Q}[c]


def _step(q: int, c: int) -> tuple[int, int]:
    """(next state, output) of one transition."""
    letter, white = c in (LETTER, STMD, R, V, L, E), c in (SPACE, BLANK)
    if q in (START, DONE):
        return _after_run(c), BEFORE
    if q in (WORD, NUM):
        if (letter and q == WORD) or (c == NUMBER and q == NUM):
            return q, 0
        return _after_run(c), BEFORE
    if q == SYM:
        return (SYM, 0) if c in (OTHER, QUOTE) else (_after_run(c), BEFORE)
    if q == Q:
        if c == STMD:
            return DONE, 0
        if c in (R, V, L):
            return {R: QR, V: QV, L: QL}[c], 0
        if c in (OTHER, QUOTE):
            return SYM, 0
        return _after_run(c), BEFORE
    if q in PENDING:
        if (q, c) in ((QR, E), (QV, E), (QL, L)):
            return DONE, 0
        after, out = _step(WORD, c)
        return after, out | BEFORE_PREVIOUS
    if white:
        return (SPN if c == SPACE else WSN), 0
    # A run of white space ends: its last character is left for the next piece
    # where it is a space, and is a piece of its own where it is not.
    cut = BEFORE_PREVIOUS if q in (SPN, WSN) else 0
    if q in (SP1, SPN):
        return (WORD if letter else NUM if c == NUMBER else SYM), cut
    return _after_run(c), cut | BEFORE


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output by class * ROW + state; classes CLASSES.. are first characters of a text."""
    move = np.zeros((2 * CLASSES + 1) * ROW, np.uint8)
    out = np.zeros_like(move)
    for c in range(CLASSES):
        for q in range(STATES):
            move[c * ROW + q], out[c * ROW + q] = _step(q, c)
            first, says = _step(START, c)
            at = (CLASSES + c) * ROW + q
            move[at], out[at] = first, says | (BEFORE_PREVIOUS if q in PENDING else 0)
    move[IDENTITY * ROW : IDENTITY * ROW + STATES] = range(STATES)
    return move, out


@functools.cache
def _class_of() -> np.ndarray:
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", BLANK)):
        for m in regex.finditer(pattern, every):
            table[np.frombuffer(m[0].encode("utf-32-le"), np.uint32)] = c
    for chars, c in ((" ", SPACE), ("'", QUOTE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[[ord(x) for x in chars]] = c
    return table


def state_maps(columns: np.ndarray) -> np.ndarray:
    """For a CHUNK x M matrix of classes: each chunk's end state for every start state, M x STATES.

    All start states of most chunks meet within a few characters; from then
    on one of them stands for all.
    """
    move, _ = _tables()
    m = columns.shape[1]
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], m, axis=1)
    for column in columns[:COALESCE_AFTER]:
        maps = move[column.astype(np.uint16) * ROW + maps]
    met = (maps == maps[0]).all(axis=0)
    one, rest = maps[0], np.flatnonzero(~met)
    apart = maps[:, rest]
    for column in columns[COALESCE_AFTER:]:
        index = column.astype(np.uint16) * ROW
        one = move[index + one]
        if len(rest):
            apart = move[index[rest] + apart]
    maps[:] = one
    maps[:, rest] = apart
    return np.ascontiguousarray(maps.T)


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive scan under composition: row i maps a start state before chunk 0 to the state after chunk i."""
    scanned, d = maps.copy(), 1
    while d < len(scanned):
        scanned[d:] = np.take_along_axis(scanned[d:], scanned[:-d].astype(np.intp), axis=1)
        d *= 2
    return scanned


def boundaries(classes: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each character; classes as of :func:`_tables`."""
    move, out = _tables()
    n = len(classes)
    m = -(-n // CHUNK)
    columns = np.full(m * CHUNK, IDENTITY, np.uint8)
    columns[:n] = classes
    columns = np.ascontiguousarray(columns.reshape(m, CHUNK).T)
    scanned = prefix_scan(state_maps(columns))
    state = np.empty(m, np.uint8)
    state[0], state[1:] = START, scanned[:-1, START]
    says = np.empty_like(columns)
    for j, column in enumerate(columns):
        index = column.astype(np.uint16) * ROW + state
        says[j] = out[index]
        state = move[index]
    says = says.T.reshape(-1)[:n]
    starts = says & BEFORE != 0
    starts[:-1] |= says[1:] & BEFORE_PREVIOUS != 0
    if scanned[-1, START] in PENDING:
        starts[-1] = True
    return starts


def _windows(texts: list[bytes]) -> Iterator[tuple[bytes, list[int], list[int], bool]]:
    """(buffer, byte length of each text, index of each, whether the last goes on) of about WINDOW bytes."""
    held, which, size = [], [], 0
    for i, t in enumerate(texts):
        if t:
            held.append(t)
            which.append(i)
            size += len(t)
        if size >= WINDOW:
            yield b"".join(held), [len(x) for x in held], which
            held, which, size = [], [], 0
    if held:
        yield b"".join(held), [len(x) for x in held], which


def _long(text: bytes) -> Iterator[bytes]:
    """Parts of a long text that begin and end at piece boundaries."""
    at = 0
    while at < len(text):
        width = WINDOW
        while True:
            end = min(len(text), at + width)
            while end < len(text) and text[end] & 0xC0 == 0x80:
                end += 1
            part = text[at:end]
            if end == len(text):
                yield part
                return
            starts = piece_starts(part, [len(part)])
            # The last start that has been read is certain: a transition says it at most one character late.
            if len(starts) > 1:
                yield part[: starts[-1]]
                at += int(starts[-1])
                break
            width *= 2


def piece_starts(buffer: bytes, lengths: list[int]) -> np.ndarray:
    """Byte offsets at which pieces start, in a buffer of non-empty UTF-8 texts of these lengths."""
    raw = np.frombuffer(buffer, np.uint8)
    firsts = np.concatenate([[0], np.cumsum(lengths[:-1])]).astype(np.int64)
    lead = None
    if raw.max() >= 0x80:
        lead = np.flatnonzero(raw & 0xC0 != 0x80)
        classes = _class_of()[np.frombuffer(buffer.decode().encode("utf-32-le"), np.uint32)]
        firsts = np.searchsorted(lead, firsts)
    else:
        classes = _class_of()[raw]
    classes[firsts] += CLASSES
    starts = np.flatnonzero(boundaries(classes))
    return starts if lead is None else lead[starts]


def split_pieces(texts: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(pieces, number of pieces of each text, index of each text) window by window; empty texts have none.

    A text longer than a window comes in several windows, in order.
    """
    for buffer, lengths, which in _windows(texts):
        parts = [(buffer, lengths, which)]
        if len(lengths) == 1 and lengths[0] > 2 * WINDOW:
            parts = ((p, [len(p)], which) for p in _long(buffer))
        for part, sizes, index in parts:
            starts = piece_starts(part, sizes)
            at = starts.tolist()
            pieces = [part[s:e] for s, e in zip(at, [*at[1:], len(part)], strict=True)]
            cut = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
            yield pieces, np.diff(cut), np.asarray(index)


_HELD: dict = {}


def held(key, make):
    """What a Python worker keeps for the operator it runs, made once; that of another operator is let go.

    Workers live on from stage to stage, and tables of several operators together would not fit beside each other.
    """
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = make()
    return _HELD[key]


def utf8(text) -> bytes:
    """Valid UTF-8 of an Arrow string scalar's bytes or None; invalid bytes become U+FFFD."""
    if text is None:
        return b""
    try:
        text.decode()
    except UnicodeDecodeError:
        return text.decode(errors="replace").encode()
    return text


def texts_of(column) -> list[bytes]:
    """The values of an Arrow string column as UTF-8; null is empty."""
    import pyarrow as pa

    return [utf8(x) for x in column.cast(pa.large_binary()).to_pylist()]


def text_slices(column, most: int = WINDOW) -> Iterator[list[bytes]]:
    """The texts of an Arrow column in runs of about ``most`` bytes, so that a large batch is never copied as a whole."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield texts_of(column.slice(a, b - a))
        a = b
