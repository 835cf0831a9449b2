"""Operator 1: token counts by a compiled finite-state tokenizer.

The tokenizer file (byte-level BPE, ``.json`` of the ``tokenizers`` library)
is compiled into a cascade of two deterministic transducers:

* the pre-tokeniser of :mod:`pieces` (thirteen states, chunk state maps, prefix scan);
* a BPE transducer over the bytes of a piece.  Every transition is annotated
  with the number of tokens it adds: the token count of the prefix with the
  byte minus that of the prefix before it, so the annotations along a path sum
  to the token count of the piece.

A state of the BPE transducer is what the rest of the piece can still depend
on: for every earlier position from which a token may still be growing, the
node of the token trie reached from there, the last token of the encoding up
to there, and the token count up to there relative to now.  The last token of
a prefix is the one suffix token that is *compatible* with the last token of
what stands before it (encoding both together gives just the two).  States are
finite but many, so they are compiled when a text first reaches them, as lazy
regular-expression automata do; a full table is dropped and compiled anew,
which changes no result.

Cases: a null or empty text has 0 tokens; special strings inside a text count
one each, as the library does by default; invalid UTF-8 counts as U+FFFD; a
text of any length is read window by window.
"""

from __future__ import annotations

import json
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscope.llm.pieces import held, split_pieces, texts_of

MAX_STATES = 400_000
MAX_CACHED_PIECES = 500_000
LONGEST_CACHED = 64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tokens, merge ranks and special strings of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE without a normaliser is needed")
        to_byte = byte_alphabet()
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        as_bytes = lambda t: bytes(to_byte[c] for c in t)
        self.id_of = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t.encode() not in self.special}
        self.bytes_of = {i: t for t, i in self.id_of.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # rank, left and right part
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = (self.id_of[as_bytes(x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank[a, b] = r
            self.made.setdefault(self.id_of[self.bytes_of[a] + self.bytes_of[b]], (r, a, b))
        self.whole: dict[int, bool] = {}

    def is_whole(self, token: int) -> bool:
        """Whether a token's own bytes are encoded as that token."""
        if (got := self.whole.get(token)) is None:
            ids = [self.id_of[bytes([b])] for b in self.bytes_of[token]]
            while len(ids) > 1 and (best := min((self.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(ids, ids[1:], strict=False))))[0] < 1 << 30:
                i = best[1]
                ids[i : i + 2] = [self.id_of[self.bytes_of[ids[i]] + self.bytes_of[ids[i + 1]]]]
            got = self.whole[token] = ids == [token]
        return got

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b, together, are encoded as a and b.

        The merges that made the two are undone, the latest first.  While a
        pair of parts stands at the joint, a merge of the pair must not come
        before the merge that ends it; of equal merges the left one comes first.
        """
        ends = 1 << 30
        while True:
            if self.rank.get((a, b), ends) < ends:
                return False
            of_a, of_b = self.made.get(a), self.made.get(b)
            if of_a and (not of_b or of_a[0] > of_b[0]):
                ends, a = of_a[0], of_a[2]
            elif of_b:
                ends, b = of_b[0] + 1, of_b[1]
            else:
                return True


class Transitions:
    """(state, byte) -> value: a growing open-addressing table that is read for whole arrays of keys."""

    def __init__(self):
        self.keys, self.values, self.used = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, np.int64), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - len(self.keys).bit_length() + 1)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key has none."""
        slot, out, mask = self._slot(keys), np.full(len(keys), -1, np.int64), len(self.keys) - 1
        at = self.keys[slot]
        hit = at == keys
        out[hit] = self.values[slot[hit]]
        left = np.flatnonzero(~hit & (at >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            at = self.keys[slot[left]]
            hit = at == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (at >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are new and differ."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            had = self.keys >= 0
            old, size = (self.keys[had], self.values[had]), len(self.keys)
            while 2 * (self.used + len(keys)) > size:
                size *= 2
            self.keys, self.values, self.used = np.full(size, -1, np.int64), np.zeros(size, np.int64), 0
            self.put(*old)
        slot, left, mask = self._slot(keys), np.arange(len(keys)), len(self.keys) - 1
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]
            done = self.keys[slot[left]] == keys[left]
            self.values[slot[left[done]]] = values[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) & mask
        self.used += len(keys)


class CountingTransducer:
    """The BPE transducer; the table's values are next state * 256 + emitted count + 128."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.child: dict[int, int] = {}
        self.token_at, self.grows = [-1], [False]
        for token, i in vocabulary.id_of.items():
            node = 0
            for b in token:
                self.grows[node] = True
                if (key := node << 8 | b) not in self.child:
                    self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.grows.append(False)
                node = self.child[key]
            self.token_at[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        start = ((0, -1, 0),)
        self.number, self.states = {start: 0}, [start]
        self.table = Transitions()
        if len(self.pairs) > 1_000_000:
            self.pairs = {}

    def compatible(self, before: int, token: int) -> bool:
        got = self.pairs.get((before, token))
        if got is None:
            v = self.vocabulary
            got = self.pairs[before, token] = v.is_whole(token) and (before < 0 or v.stays_apart(before, token))
        return got

    def compile(self, state: int, byte: int) -> int:
        """The value of one transition; its end state gets a number if it is new."""
        grown, last, adds = [], -1, 0
        for node, before, count in self.states[state]:
            node = self.child.get(node << 8 | byte, -1)
            if node < 0:
                continue
            token = self.token_at[node]
            if last < 0 and token >= 0 and self.compatible(before, token):
                last, adds = token, count + 1
            if self.grows[node]:
                grown.append((node, before, count))
        if last < 0:
            raise ValueError("no token fits; the merges are not those of a BPE")
        key = (*[(n, b, c - adds) for n, b, c in grown], (0, last, 0))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        return to << 8 | adds + 128

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Token counts of non-empty pieces: all pieces step through the transducer together."""
        if len(self.states) > MAX_STATES:
            self.clear()
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(length, kind="stable")
        sorted_length = length[order]
        at = (np.cumsum(length) - length)[order]
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        state = np.zeros(len(pieces), np.int64)
        total = np.zeros(len(pieces), np.int64)
        for j in range(int(sorted_length[-1]) if len(pieces) else 0):
            live = slice(int(np.searchsorted(sorted_length, j, "right")), None)
            keys = state[live] << 8 | raw[at[live] + j]
            got = self.table.get(keys)
            if (missing := got < 0).any():
                fresh = np.unique(keys[missing])
                self.table.put(fresh, np.array([self.compile(k >> 8, k & 255) for k in fresh.tolist()], np.int64))
                got[missing] = self.table.get(keys[missing])
            total[live] += (got & 255) - 128
            state[live] = got >> 8
        out = np.empty_like(total)
        out[order] = total
        return out


class TokenCounter:
    """Counts of texts in one Python worker."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.transducer = CountingTransducer(self.vocabulary)
        self.known: dict[bytes, int] = {}

    def of_pieces(self, pieces: list[bytes]) -> np.ndarray:
        got = list(map(self.known.get, pieces))
        if None in got:
            missing = list({p for p, n in zip(pieces, got) if n is None})
            fresh = dict(zip(missing, self.transducer.counts(missing).tolist()))
            got = [fresh[p] if n is None else n for p, n in zip(pieces, got)]
            if len(self.known) > MAX_CACHED_PIECES:
                self.known = {}
            self.known.update((p, n) for p, n in fresh.items() if len(p) <= LONGEST_CACHED)
        return np.asarray(got, np.int64)

    def count(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        plain, owner = [], []
        for i, text in enumerate(texts):
            parts = [text]
            for special in self.vocabulary.special:
                if special in text:
                    parts = [q for p in parts for q in p.split(special)]
            out[i] += len(parts) - 1
            plain += parts
            owner += [i] * len(parts)
        owner = np.asarray(owner, np.int64)
        for pieces, sizes, index in split_pieces(plain):
            sums = np.add.reduceat(self.of_pieces(pieces), np.cumsum(sizes) - sizes)
            np.add.at(out, owner[index], sums)
        return out


def counter(path: str) -> TokenCounter:
    return held(("counts by", path), lambda: TokenCounter(path))


def token_count(text: Column | str, tokenizer: str | None = None) -> Column:
    """Number of tokens (long) of a string column."""

    @F.arrow_udf("long")
    def n_tokens(column: pa.Array) -> pa.Array:
        return pa.array(counter(tokenizer or default_tokenizer()).count(texts_of(column)), pa.int64())

    return n_tokens(text)


def count_tokens(df: DataFrame, text: str = "text", limit: int = 1024, tokenizer: str | None = None) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens > limit) to every row.

    Columns of these names in ``df`` are replaced; all others stay.  Rows are
    kept as they are, repeated ones too.
    """
    out = df.withColumn("n_tokens", token_count(F.col(text), tokenizer))
    return out.withColumns({
        "n_bytes": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"),
        "over_limit": F.col("n_tokens") > limit,
    })
