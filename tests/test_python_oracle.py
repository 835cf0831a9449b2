"""The SQL oracle of Python structure: against the interpreter on cut code, and against the engine on the corpus."""

import ast
import math

import duckdb
import pytest

import __spark_entry__ as entry
from quillscope.functions.pysyntax import examine
from quillscope.oracle import pyduck
from quillscope.sources import corpus

SF = "/root/testdata/sf0.001"
WHOLE = [t.replace("@A", "v_one").replace("@B", "v_two").replace("@C", "v_three").replace("@M", "a note")
         for t in (corpus.T_AI_PY, corpus.T_HUMAN_PY, corpus.T_TWO_LINES, corpus.T_BLOCK * 2, corpus.T_SYNTAX_ERROR,
                   corpus.T_DEEP_HEAD + corpus.T_DEEP_LINE * 3 + corpus.T_DEEP_TAIL, corpus.T_LONG_HEAD + corpus.T_LONG_LINE * 3, "# only a note\n")]
# Every tail and head of every template: blocks cut anywhere, as chunks cut them.
CUT = sorted({"".join(lines[a:b]) for t in WHOLE for lines in [t.splitlines(keepends=True)] for a in range(len(lines)) for b in (len(lines), a + 3, a + 7)})


def test_structure_sql_agrees_with_the_interpreter_on_cut_code():
    con = duckdb.connect()
    con.execute("CREATE TABLE snippet (file_id BIGINT, code VARCHAR)")
    con.executemany("INSERT INTO snippet VALUES (?, ?)", list(enumerate(CUT)))
    sql = pyduck.chunk_query(
        "SELECT file_id, chunk, py.*, broken.error FROM py JOIN ch USING (file_id, chunk_id) LEFT JOIN broken USING (file_id)", "SELECT * FROM snippet", pyduck.feature_ctes())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    rows = [dict(zip(names, r)) for r in cursor.fetchall()]
    assert len(rows) == len(CUT) > 100
    kinds = set()
    for row in rows:
        seen = examine(row["chunk"])
        kinds.add((seen["parseable"], seen["error"] is not None, bool(seen["tokens"])))
        assert row["error"] == seen["error"], row["chunk"]
        assert row["parseable"] == seen["parseable"], row["chunk"]
        assert row["token_count"] == len(seen["tokens"]), row["chunk"]
        for mine, theirs in (("function_count", "functions"), ("loop_count", "loops"), ("try_except_count", "tries"), ("max_ast_depth", "max_depth"),
                             ("has_main_guard", "main_guard"), ("uses_type_hints", "annotated"), ("uses_comprehensions", "comprehensions"), ("nested_function_depth", "nested_depth")):
            assert row[mine] == seen[theirs], (mine, row["chunk"])
        assert row["has_docstrings"] == (seen["documented"] > 0)
        assert row["has_magic_numbers"] == (seen["magic_numbers"] > 0)
        names_of = seen["names"]
        assert math.isclose(row["avg_name_length"], sum(map(len, names_of)) / len(names_of) if names_of else 0.0)
    assert len(kinds) >= 4  # parsed, cut, with an error, without tokens


def test_depths_of_the_form_table_are_those_of_the_interpreter():
    def below(node):
        return max((1 + below(child) for child in ast.iter_child_nodes(node) if not isinstance(child, ast.stmt | ast.ExceptHandler)), default=0)

    for form, kind, depth in pyduck.FORMS:
        line = form.replace("s", '"s"') if form == "s" else " ".join('"s"' if t == "s" else t for t in form.split())
        if kind == "ExceptHandler":
            node = ast.parse(f"try:\n  pass\n{line}\n  pass").body[0].handlers[0]
        else:
            node = ast.parse(line + ("\n  pass\nexcept: pass" if kind == "Try" else "\n  pass" if line.endswith(":") else "")).body[0]
        assert type(node).__name__ == kind and below(node) == depth, form


@pytest.mark.parametrize("name", ["py_structure", "py_token_stats", "py_file_results", "errors"])
def test_queries_of_python_files_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in cursor.description)
    order = [[d[0] for d in cursor.description].index(c) for c in columns]
    expected = [[row[i] for i in order] for row in cursor.fetchall()]
    found = entry.queries()[name](spark, SF)
    assert sorted(found.columns) == columns
    key = [columns.index(c) for c in ("file_id", "chunk_id") if c in columns]
    by_key = lambda row: tuple(row[i] for i in key)
    rows = sorted(([r[c] for c in columns] for r in found.collect()), key=by_key)
    assert len(rows) == len(expected)
    for mine, theirs in zip(rows, sorted(expected, key=by_key)):
        for c, x, y in zip(columns, mine, theirs):
            assert math.isclose(x, y, abs_tol=2e-6) if isinstance(x, float) and y is not None else x == y, (c, by_key(mine))
