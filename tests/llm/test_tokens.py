"""Operators 1 and 9: counts, ids and packing, against the tokenizers library."""

import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillscope.llm import hilbert_pack, pieces, token_counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_counts.default_tokenizer())


@pytest.fixture(scope="module")
def texts():
    return [*brute.random_texts(3000), "a" * 3000, " " * 2000, "\n" * 700 + "x", "ab" * 9000, "it's we'll they've 'tis ''s"]


def test_counts_equal_the_library(library, texts):
    want = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.counter(token_counts.default_tokenizer()).count([t.encode() for t in texts]).tolist() == want


def test_counts_do_not_depend_on_windows_or_table_size(library, texts, monkeypatch):
    monkeypatch.setattr(pieces, "WINDOW", 700)
    monkeypatch.setattr(token_counts, "MAX_STATES", 500)
    monkeypatch.setattr(token_counts, "MAX_CACHED_PIECES", 50)
    want = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.TokenCounter(token_counts.default_tokenizer()).count([t.encode() for t in texts]).tolist() == want


def test_state_maps_compose_like_the_step_function():
    rng = np.random.default_rng(3)
    classes = rng.integers(0, pieces.CLASSES, 5 * pieces.CHUNK).astype(np.uint8)
    scanned = pieces.prefix_scan(pieces.state_maps(np.ascontiguousarray(classes.reshape(5, -1).T)))
    for start in range(pieces.STATES):
        state = start
        for k, c in enumerate(classes):
            state = pieces._step(state, int(c))[0]
            if (k + 1) % pieces.CHUNK == 0:
                assert scanned[k // pieces.CHUNK, start] == state


def test_pairs_of_tokens_stay_apart_as_the_library_says(library):
    vocabulary = token_counts.Vocabulary(token_counts.default_tokenizer())
    letters = [i for t, i in vocabulary.id_of.items() if t.isalpha() and t.isascii() and len(t) < 5]
    rng = np.random.default_rng(4)
    for a, b in rng.choice(letters, (2000, 2)).tolist():
        text = (vocabulary.bytes_of[a] + vocabulary.bytes_of[b]).decode()
        assert vocabulary.stays_apart(a, b) == (library.encode(text, add_special_tokens=False).ids == [a, b])


def test_count_tokens_edge_rows(spark, library):
    rows = token_counts.count_tokens(brute.edge_rows(spark).withColumn("n_tokens", F.lit("taken"))).collect()
    assert len(rows) == 10
    for r in rows:
        assert r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert r["n_bytes"] == len((r["text"] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 1024)
    assert token_counts.count_tokens(brute.edge_rows(spark).limit(0)).count() == 0


def test_ids_equal_the_library(library, texts):
    want = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
    assert hilbert_pack.Encoder(token_counts.default_tokenizer()).encode([t.encode() for t in texts]) == want


def test_hilbert_curve_visits_neighbours():
    cube = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    index = hilbert_pack.hilbert_index(cube, 3)
    assert sorted(index.tolist()) == list(range(512))
    assert (np.abs(np.diff(cube[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def check_packing(rows, texts, library):
    """Every id of every document in exactly one piece; sequences without gaps."""
    want = {}
    for doc, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.setdefault((doc, len(ids)), []).append(ids)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        (of_doc,) = {tuple(x) for x in want[r["doc_id"], r["doc_tokens"]]}
        part = of_doc[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    assert sum(r["length"] for r in rows) == sum(k[1] * len(v) for k, v in want.items())
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    return by_sequence


def test_pack_table(spark, library, monkeypatch):
    monkeypatch.setattr(hilbert_pack, "RANGE_BYTES", 100_000)
    docs = spark.read.parquet(f"{brute.SF_SMALL}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = hilbert_pack.pack(docs).collect()
    sequences = check_packing(rows, texts, library)
    assert len({s >> 32 for s in sequences}) > 2
    full = sum(sum(r["length"] for r in x) == 1024 for x in sequences.values())
    assert full >= len(sequences) - len({s >> 32 for s in sequences})


def test_pack_edge_rows(spark, library):
    docs = brute.edge_rows(spark).withColumn("body", F.lit(1))
    check_packing(hilbert_pack.pack(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], library)
    assert hilbert_pack.pack(docs.limit(0)).count() == 0
    row = hilbert_pack.pack(docs.where("doc_id = 7"), with_ids=True).first()
    assert row["ids"] == [*library.encode("...", add_special_tokens=False).ids, 0]
