"""A3: the stream gives the same rows as the batch job."""

import json
import os
import tempfile

from quillscope import detect
from quillscope.sources.files import SNIPPET_SCHEMA, read_code_files, read_snippets
from quillscope.streaming.stream import detect_stream
from snippets import AI_JAVASCRIPT, AI_PYTHON, HUMAN_PYTHON, LOW_SIGNAL_PYTHON


def test_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="qs-stream-")
    src = os.path.join(base, "in")
    os.makedirs(src)
    rows = [
        {"file_id": 1, "code": AI_PYTHON, "language": "Python"},
        {"file_id": 2, "code": HUMAN_PYTHON},
        {"file_id": 3, "code": AI_JAVASCRIPT, "language": "javascript"},
        {"file_id": 4, "code": LOW_SIGNAL_PYTHON, "language": None},
    ]
    for i, part in enumerate([rows[:2], rows[2:]]):
        with open(os.path.join(src, f"part-{i}.json"), "w") as fh:
            fh.write("\n".join(json.dumps(r) for r in part))
    stream = spark.readStream.schema(SNIPPET_SCHEMA).option("maxFilesPerTrigger", 1).json(src)
    out_dir = os.path.join(base, "out")
    q = detect_stream(stream, out_dir, os.path.join(base, "ckpt"), trigger_once=True)
    q.awaitTermination()
    streamed = spark.read.parquet(out_dir)
    batch = detect(read_snippets(spark, src))
    cols = ["file_id", "language", "classification", "ai_score", "human_score", "confidence"]
    assert sorted(map(tuple, streamed.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))
    langs = {r.file_id: r.language for r in batch.collect()}
    assert langs[1] == "python" and langs[4] == "python"


def test_read_code_files_detects_by_extension_and_content(spark):
    base = tempfile.mkdtemp(prefix="qs-files-")
    os.makedirs(os.path.join(base, "sub"))
    files = {
        "a.py": AI_PYTHON,
        "b.JS": AI_JAVASCRIPT,
        "sub/c.tsx": AI_JAVASCRIPT,
        "sub/noext": HUMAN_PYTHON,
        "d.rb": "puts 'hello'\n",
    }
    for name, text in files.items():
        with open(os.path.join(base, name), "w") as fh:
            fh.write(text)
    res = {os.path.basename(r.path): r for r in detect(read_code_files(spark, base)).collect()}
    assert res["a.py"].language == "python" and res["b.JS"].language == "javascript"
    assert res["c.tsx"].language == "javascript" and res["noext"].language == "python"
    assert res["d.rb"].error is not None and res["a.py"].file_total_lines == len(AI_PYTHON.splitlines())
    assert len({r.file_id for r in res.values()}) == len(files)


def test_stream_restart_is_idempotent(spark):
    base = tempfile.mkdtemp(prefix="qs-restart-")
    src, out, ckpt = (os.path.join(base, d) for d in ("in", "out", "ckpt"))
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w") as fh:
        fh.write(json.dumps({"file_id": 1, "code": AI_PYTHON}))
    schema_stream = lambda: spark.readStream.schema(SNIPPET_SCHEMA).json(src)
    detect_stream(schema_stream(), out, ckpt, trigger_once=True).awaitTermination()
    first = spark.read.parquet(out).count()
    # restart on the same checkpoint with no new input: nothing is reprocessed
    detect_stream(schema_stream(), out, ckpt, trigger_once=True).awaitTermination()
    assert spark.read.parquet(out).count() == first == 1
    # new input after the restart is picked up exactly once
    with open(os.path.join(src, "b.json"), "w") as fh:
        fh.write(json.dumps({"file_id": 2, "code": AI_JAVASCRIPT, "language": "javascript"}))
    detect_stream(schema_stream(), out, ckpt, trigger_once=True).awaitTermination()
    ids = sorted(r.file_id for r in spark.read.parquet(out).select("file_id").collect())
    assert ids == [1, 2]


def test_malformed_lines_keep_their_rows(spark):
    src = tempfile.mkdtemp(prefix="qs-bad-")
    with open(os.path.join(src, "a.json"), "w") as fh:
        fh.write('{"file_id": 1, "code": "a = 1"}\n{"file_id": 2, "code": \nnot json at all\n{"file_id": 3, "code": 3\n')
    out = detect(read_snippets(spark, src)).collect()
    assert len(out) == 4
    assert sorted(str(r.error) for r in out) == ["Malformed record"] * 3 + ["None"]


def test_read_code_files_on_dirty_storage(spark, tmp_path):
    """Byte-order marks go, bad bytes and large files are error rows, filters of name and time hold."""
    files = {"bom.py": b"\xef\xbb\xbf" + AI_PYTHON.encode(), "plain.py": AI_PYTHON.encode(), "bad.py": b"x = '\xff\xfe'\n" * 20, "utf16.py": AI_PYTHON.encode("utf-16"), "empty.py": b"", "large.py": b"a = 1\n" * 5000, "skip.txt": b"x"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = read_code_files(spark, str(tmp_path), glob="*.py", max_bytes=20_000)
    rows = {os.path.basename(r.path): r for r in detect(found).collect()}
    assert set(rows) == {n for n, data in files.items() if n.endswith(".py") and data}
    assert rows["bom.py"].error is None and rows["bom.py"].ai_score == rows["plain.py"].ai_score and rows["bom.py"].parseable
    assert rows["bad.py"].error == rows["utf16.py"].error == "File is not valid UTF-8" and rows["bad.py"].classification is None
    assert rows["large.py"].error == "File is too large"
    assert read_code_files(spark, str(tmp_path), modified_after="2200-01-01T00:00:00").count() == 0
