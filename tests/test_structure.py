"""G0-G16 and D2-D4 from the node and token tables equal the features of the syntax worker, chunk by chunk."""

import ast
import random

import pytest

from quillscope import chunk_results
from quillscope.functions import pytables
from quillscope.operators.structure import structure_features, token_features
from quillscope.plans import queries as Q
from snippets import AI_PYTHON, HUMAN_PYTHON, LOW_SIGNAL_PYTHON

SF = "/root/testdata/sf0.001"
ODD = [
    "", "\n", "x = (", "def f(:\n  pass", "  x = 1", "async def f(a: int, *, b=1j) -> None:\n    async for x in a:\n        pass\n",
    "class A:\n    '''doc'''\n    def f(self):\n        '''doc'''\n        def g():\n            return [i for i in range(3) if (n := i) > 37]\n        return f'{g}'\n",
    "try:\n    pass\nexcept:\n    pass\nfinally:\n    pass\n", "try:\n    a\nexcept* ValueError:\n    b\n",
    "if __name__ == '__main__':\n    MAIN()\nif '__main__' == __name__:\n    pass\n", "x = True + 2.5 - 10 + 1e999 + " + "9" * 400 + "\n",
    "while 1:\n    for a in b:\n        @deco\n        def X_Y(tmp, données):\n            return lambda q: q\n", "match x:\n    case {'a': 1}:\n        pass\n", "a = '\0'", None,
]


def code_frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "file_id long, chunk string")


def test_node_rows_are_the_tree(spark):
    rows = pytables.nodes(code_frame(spark, [AI_PYTHON])).orderBy("bfs_pos").collect()
    walked = list(ast.walk(ast.parse(AI_PYTHON)))
    assert [r.kind for r in rows] == [type(n).__name__ for n in walked]
    assert [r.lineno for r in rows] == [getattr(n, "lineno", None) for n in walked]
    assert rows[0].parent_pos is None and all(rows[r.parent_pos].depth == r.depth - 1 for r in rows[1:])
    assert len(rows[0]) == 15  # the key and the table's 14 columns


@pytest.mark.parametrize("source", ["odd", "corpus", "random"])
def test_aggregates_equal_the_worker(spark, source):
    if source == "corpus":
        chunks = Q._python_chunks(spark, SF)
        features = chunk_results(Q.code_files(spark, SF), languages=("python",)).where("chunk_error is null")
    else:
        rng = random.Random(4)
        lines = (AI_PYTHON + HUMAN_PYTHON + LOW_SIGNAL_PYTHON).split("\n")
        texts = ODD if source == "odd" else ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6))) for _ in range(200)]
        files = code_frame(spark, texts).withColumnRenamed("chunk", "code").selectExpr("*", "'python' AS language")
        features = chunk_results(files, languages=("python",)).where("chunk_error is null")
        chunks = features.select("file_id", "chunk_id", "chunk")
    found = structure_features(chunks, ["file_id", "chunk_id"])
    columns = found.columns
    want = {(r.file_id, r.chunk_id): r for r in features.select(columns).collect()}
    got = {(r.file_id, r.chunk_id): r for r in found.collect()}
    assert set(want) <= set(got) and len(want) > 5
    for key, row in want.items():
        for c in columns:
            assert got[key][c] == (pytest.approx(row[c], abs=1e-9) if isinstance(row[c], float) else row[c]), (key, c)
    tokens = {(r.file_id, r.chunk_id): r for r in token_features(chunks, ["file_id", "chunk_id"]).collect()}
    for r in features.select("file_id", "chunk_id", "token_count", "token_entropy").collect():
        assert tokens[r.file_id, r.chunk_id].token_count == r.token_count
        assert tokens[r.file_id, r.chunk_id].token_entropy == pytest.approx(r.token_entropy, abs=1e-9)


def test_lateral_in_sql(spark):
    pytables.register(spark)
    code_frame(spark, ["a = b + 1", "x = ("]).createOrReplaceTempView("qs_code")
    rows = spark.sql("SELECT file_id, count(n.bfs_pos) AS n, count_if(n.name IS NOT NULL) AS names FROM qs_code c LEFT JOIN LATERAL py_nodes(c.chunk) n ON true GROUP BY file_id ORDER BY file_id").collect()
    assert [tuple(r) for r in rows] == [(0, 9, 2), (1, 0, 0)]
    assert [r.token for r in spark.sql("SELECT t.token FROM qs_code c, LATERAL py_tokens(c.chunk) t WHERE file_id = 0 ORDER BY t.pos").collect()] == ["a", "=", "b", "+", "1"]
