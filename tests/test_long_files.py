"""Files cut over tasks: the same chunks as from the whole text in one row."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillscope.functions.chunking import with_chunks
from quillscope.functions.constants import ERR_ENCODING
from quillscope.sources import long_files
from quillscope.sources.long_files import block_map, long_file_chunks, read_lines, starts_from


def _texts():
    rng = random.Random(7)
    ends = ["\n", "\n", "\n", "\r\n", "\r", "\x0b", " ", "\n\n"]
    line = lambda most: "".join(rng.choice("ab é\t(;漢") for _ in range(rng.randint(0, most)))
    out = {f"mixed{i}": "".join(line(most) + rng.choice(ends) for _ in range(n)) for i, (most, n) in enumerate([(90, 900), (8, 3000), (400, 200), (3000, 30), (5, 4)])}
    out |= {"no_end": out["mixed0"].rstrip("\n") + "\nlast", "one_line": "x" * 9000, "long_then_break": "\n" * 5 + "x" * 3000 + "\x0b", "breaks": ("x" * 2300 + "\x0b") * 3, "lines_alone": "\n" * 7000 + "a", "blank": " \n" * 3000, "blank_no_end": "\n \t", "short_tail": ("y" * 99 + "\n") * 23,
            "feeds": "\n" * 3000, "exact": ("z" * 21 + "\n") * 300, "exact_no_end": ("z" * 21 + "\n") * 199 + "z" * 22, "tail_at_limit": ("z" * 99 + "\n") * 22 + "w" * 499, "tail_over": ("z" * 99 + "\n") * 22 + "w" * 500}
    return out


@pytest.mark.parametrize("broadcast", [65_536, 0])
def test_blocks_give_the_chunks_of_the_whole_text(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(long_files, "MAX_BROADCAST_BLOCKS", broadcast)
    texts = _texts()
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    (tmp_path / "marked.txt").write_bytes(b"\xef\xbb\xbf" + texts["no_end"].encode())
    (tmp_path / "bad.txt").write_bytes(b"fine\n" * 2000 + b"\xff\n" + b"fine\n" * 2000)
    (tmp_path / "empty.txt").write_bytes(b"")
    texts["marked"] = texts["no_end"]
    whole = with_chunks(spark.createDataFrame(list(texts.items()), "name string, code string")).select("name", "chunks").collect()
    expected = {(r["name"], i): (len(r["chunks"]), c) for r in whole for i, c in enumerate(r["chunks"])}
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("1500", "20000", old["spark.sql.files.maxPartitionBytes"]):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            found = long_file_chunks(spark, str(tmp_path), glob="*.txt").withColumn("name", F.regexp_extract("path", r"([a-z_0-9]+)\.txt$", 1)).collect()
            rows = {(r["name"], r["chunk_id"]): (r["chunk_count"], r["chunk"]) for r in found if r["error"] is None}
            assert len(rows) + 1 == len(found)
            assert [(r["name"], r["error"], r["chunk"]) for r in found if r["error"]] == [("bad", ERR_ENCODING, None)]
            assert rows.keys() == expected.keys()
            assert all(rows[k] == expected[k] for k in expected)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        assert read_lines(spark, str(tmp_path), glob="mixed0.txt").select("block").distinct().count() > 10
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_maps_of_blocks_compose_to_one_pass():
    rng = np.random.default_rng(3)
    for _ in range(300):
        lengths = rng.integers(1, rng.integers(2, 400), rng.integers(1, 200))
        target = int(rng.integers(1, 500))
        whole = starts_from(lengths, 0, target)
        carry, opened, base, found = -1, -1, 0, []
        for part in np.split(lengths, np.sort(rng.integers(0, len(lengths) + 1, 4))):
            if not len(part):
                continue
            effect = block_map(part, target)
            first = 0 if carry < 0 else int(np.searchsorted(effect["ends"], target - carry, "right"))
            found += [base + s for s in starts_from(part, first, target)] if first < len(effect["ends"]) else []
            if first < len(effect["ends"]):
                carry, opened = effect["carries"][first], base + effect["lasts"][first]
                before = effect["befores"][first]
                assert before < 0 or (base + before == found[-2])
            else:
                carry += int(part.sum())
            base += len(part)
            assert opened == found[-1]
        assert found == whole


def test_no_file_is_no_row(spark, tmp_path):
    (tmp_path / "empty.txt").write_bytes(b"")
    assert long_file_chunks(spark, str(tmp_path)).collect() == []
