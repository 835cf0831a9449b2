"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import random
import re

import xxhash

SF_SMALL, SF_CHECK = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ALPHABET = [*"aestmdrvleAB 'x\n\té中1２9!?-#", "'re", "'ll", "'ve", "<|endoftext|>", " ", " ", "\x85", "\x1c", "😀"]


def random_texts(n: int, longest: int = 60, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def edge_rows(spark):
    """Null in every column, empty and long texts, ties, repeated rows, and columns whose names operators use inside."""
    rows = [
        (1, "the cat sat on the mat and the dog ran after it all day long", "en", "s1", 60, 7, 0.5),
        (1, "the cat sat on the mat and the dog ran after it all day long", "en", "s1", 60, 7, 0.5),
        (2, "the cat sat on the mat and the dog ran after it all day long", None, None, None, None, None),
        (3, "", "en", "s2", 0, 1, 1.0),
        (4, None, "fr", "s2", None, 1, 1.0),
        (None, "a text without a number", "en", None, 3, 1, 1.0),
        (None, None, None, None, None, None, None),
        (5, "long words " * 30_000, "en", "s1", 1, 1, 1.0),
        (6, "x" * 20_000, "en", "s1", 1, 1, 1.0),
        (7, "...", "de", "s1", 1, 1, 1.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp long, score double")


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def simhash(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def component_ids(ids: list[int], fps: list[int], radius: int = 3) -> dict[int, int]:
    """The least id reachable over links, by repeated passes."""
    least = dict(zip(ids, ids, strict=True))
    changed = True
    while changed:
        changed = False
        for i, f in zip(ids, fps, strict=True):
            for j, g in zip(ids, fps, strict=True):
                if least[j] < least[i] and (f ^ g).bit_count() <= radius:
                    least[i], changed = least[j], True
    return least


def windows_hit(text: str | None, items: dict[str, str | None], n: int = 10) -> tuple[int, set[int], set[str]]:
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    doc, hit, found = words(text), set(), set()
    for item, body in items.items():
        w = words(body)
        size = min(n, len(w))
        for i in range(len(w) - size + 1) if w else ():
            for at in range(len(doc) - size + 1):
                if doc[at : at + size] == w[i : i + size]:
                    hit |= set(range(at, at + size))
                    found.add(item)
    return len(doc), hit, found
