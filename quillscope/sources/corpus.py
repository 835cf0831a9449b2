"""Derived code corpus: ``code_files`` built from the ``documents`` table.

The driver tables hold prose, not programs.  Every document becomes three
files: a Python one (id 4 doc_id), a JavaScript one (4 doc_id + 1), and one of an
unsupported language (4 doc_id + 2, the text itself, an error row).  The first
two are a template, by the document's number, in which three words of the
document become identifiers and its first line a comment; below it stands the
whole text, line by line in turn as a comment (as it is, but for control
characters), as an identifier of all its words, and as a string (without quotes
and backslashes), under the text's digest.  So the corpus grows with
``documents``, every document is analysed in both languages, and any change to a
text changes its files.  The same SQL expression text is used by Spark and by the
DuckDB oracle (``render(dialect)``), so both engines see byte-identical inputs.

| template | path | content |
|---|------|---------|
| 0 | .py  | tidy, documented, example names, main guard (AI-like) |
| 1 | .py  | TODO, bare except, prints, commented code, odd numbers, trailing blanks (human-like) |
| 4 | .py  | two lines |
| 5 | .py  | one 275-char top-level function repeated 8 + doc_id % 5 times (multi-chunk, parseable) |
| 6 | .py  | one long function, evenly indented (a chunk that starts in it does not parse) |
| 7 | .py  | syntax error but tokenisable (first chunk: parseable = false) |
| 9 | .py  | later chunk starts deeper than it ends (tokenizer IndentationError → error row) |
| 10 | NULL | template 0 (content detection) |
| 2 | .js  | const / arrow / template literal, example names (AI-like) |
| 3 | .jsx | var, jQuery, alert, nested callbacks, block comment (human-like) |
| 8 | .ts  | templates 2 and 3 repeated (multi-chunk, mixed classes) |
| 12 | NULL | template 2 (content detection) |
| 11 | .rb | the text itself (unsupported language → error row) |
"""

from __future__ import annotations

import string
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import spread

# Identifiers: 'v_' + ASCII letters of a word, padded/truncated to 12 chars
# so that template lengths (and so chunk boundaries) do not depend on words.
NAME_LEN = 12

T_AI_PY = '''"""Utilities for the @A example."""
import json
import os


def load_@A(sample_path: str) -> dict:
    """Load the @A sample data from a file."""
    with open(sample_path) as handle:
        return json.load(handle)


def process_@B(example_data: dict) -> list:
    """Process the @B example data and return the results."""
    results = [value for value in example_data.values()]
    return results


def demo_@C(items: list) -> int:
    """Count the items in the @C demo collection."""
    # @M
    return len(items)


if __name__ == "__main__":
    sample = load_@A("example.json")
    print(process_@B(sample))
'''

T_HUMAN_PY = '''import sys,os
# TODO: @M
def @A(f):
    x = open(f).read()
    # print(x)
    try:
        n = int(x.split()[3]) * 37
    except:
        print("bad", f)
        n = 0
    # if n > 17: return None
    q = [n, 7, 13, 4242]
    return q

for @B in sys.argv[1:]:
    @C = @A(@B)
    print(@C)
'''

T_AI_JS = '''// Example helpers for the @A sample data.
const fetch@A = async (sampleUrl) => {
  const response = await fetch(sampleUrl);
  const sampleData = await response.json();
  return sampleData;
};

const format@B = (items) => {
  return items.map((item) => `Item: ${item.name}`);
};

const process@C = (sampleInput) => {
  const { values, label } = sampleInput;
  return values.filter((value) => value > 0).map((value) => `${label}-${value}`);
};

export const runExample = async () => {
  const exampleData = await fetch@A('/api/example');
  return format@B(exampleData);
};
'''

T_HUMAN_JS = '''var @A = 0;
var @B = [];
// TODO @M
$(document).ready(function() {
  $('#btn').click(function() {
    @A++;
    console.log('clicked', @A);
    // if (@A > 3) alert('too many');
    $.get('/data', function(d) {
      @B = d;
      alert('got ' + d.length);
    });
  });
});
/* old code
function @C(a,b){return a+b}
*/
var y = eval('1+1');
'''

T_TWO_LINES = '''@A = 1
print(@A)'''

# 275 characters: eight blocks fill a 2,200-character chunk exactly, so
# chunk boundaries fall between top-level functions.
T_BLOCK = '''def total_@A(values):
    """Return the total of the values."""
    total = 0
    for value in values:
        total += value
    return total
# padding line that keeps every block at the same length................................................................

'''

T_LONG_HEAD = '''def @A(rows):
'''
T_LONG_LINE = '''    rows.append(len(rows) + 3)  # keep adding items to the list
'''

T_SYNTAX_ERROR = '''def @A(:
    return @B + 1
print(@C)
'''

T_DEEP_HEAD = '''def @A():
    if @B:
'''
T_DEEP_LINE = '''        @C = @C + 1  # accumulate the running value here
'''
T_DEEP_TAIL = '''    return @C
'''


def _lit(text: str) -> str:
    """SQL string literal.  ``${`` would be taken by Spark's variable
    substitution, so it is spelled ``@S{`` and restored by ``replace``."""
    body = "'" + text.replace("'", "''").replace("${", "@S{") + "'"
    return f"replace({body}, '@S', '$')" if "${" in text else body


def _fill(template_sql: str, a: str, b: str, c: str, m: str) -> str:
    return f"replace(replace(replace(replace({template_sql}, '@A', {a}), '@B', {b}), '@C', {c}), '@M', {m})"


PYTHON_TEMPLATES = (0, 1, 4, 5, 6, 7, 9, 10)
JAVASCRIPT_TEMPLATES = (2, 3, 8, 12)


def render(dialect: str = "spark", source: str = "documents") -> str:
    """``SELECT file_id, path, language, code, template FROM <source>`` for
    ``dialect`` in {'spark', 'duckdb'}: the three files of every document."""
    duck = dialect == "duckdb"
    g = ", 'g'" if duck else ""

    def word(n: int) -> str:
        # Spark takes the text's first three words and first line without splitting all of it.
        words = "lower(text)" if duck else "lower(substring_index(text, ' ', 3))"
        letters = f"regexp_replace(split_part({words}, ' ', {n}), '[^a-z]', ''{g})"
        return f"rpad(concat('v_', {letters}), {NAME_LEN}, 'x')"

    line1 = "split_part(text, chr(10), 1)" if duck else "substring_index(text, chr(10), 1)"

    # Characters that end a line somewhere become blanks; \\ is one backslash in either dialect's pattern.
    # Spark cleans the whole text, but for its line feeds, before it is split; it tests listed characters faster than ranges.
    listed = "".join(rf"\\x{c:02X}" for c in (*range(0x20), 0x7F, 0x85) if c != 0x0A)
    ends = r"[\x00-\x1F\x7F\x{85}\x{2028}\x{2029}]" if duck else rf"[{listed}\\x{{2028}}-\\x{{2029}}]"
    quoted = r'["\\]' if duck else r'["\\\\]'
    clean = lambda x: f"regexp_replace({x}, '{ends}', ' '{g})"
    # Spark makes a line's identifier or string here, once for both languages.
    made = f"""CASE i % 3 WHEN 1 THEN concat('v_', lower(regexp_replace(line, '[^{string.ascii_letters}{string.digits}]+', '_')))
      WHEN 2 THEN regexp_replace(line, '{quoted}', ' ') ELSE line END"""
    lines = f"list_transform(string_split(text, chr(10)), lambda line: {clean('line')})" if duck else f"transform(split({clean('text')}, '\\n'), (line, i) -> {made})"

    def whole(mark: str, declare: str, end: str) -> str:
        """The document's cleaned lines: in turn a comment, an identifier of all its words, and a string."""
        low = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        name = f"concat('v_', regexp_replace({low}, '[^a-z0-9]+', '_'{g}))" if duck else "line"
        unquoted = f"regexp_replace(line, '{quoted}', ' '{g})" if duck else "line"
        at = "(i - 1)" if duck else "i"
        each = f"""CASE {at} % 3 WHEN 0 THEN concat('{mark} ', line, chr(10)) WHEN 1 THEN concat('{declare}', {name}, ' = 1{end}', chr(10))
          ELSE concat('{declare}v_line = "', {unquoted}, '"{end}', chr(10)) END"""
        body = f"array_to_string(list_transform(cleaned, lambda line, i: {each}), '')" if duck else f"array_join(transform(cleaned, (line, i) -> {each}), '')"
        return f"concat(chr(10), '{mark} ', digest, chr(10), {body})"

    ai_py, human_py, ai_js, human_js = (_fill(_lit(t), "a", "b", "c", "m") for t in (T_AI_PY, T_HUMAN_PY, T_AI_JS, T_HUMAN_JS))
    python = f"""CASE template
      WHEN 1 THEN {human_py}
      WHEN 4 THEN {_fill(_lit(T_TWO_LINES), "a", "b", "c", "m")}
      WHEN 5 THEN repeat({_fill(_lit(T_BLOCK), "a", "b", "c", "m")}, CAST(8 + doc_id % 5 AS INT))
      WHEN 6 THEN concat({_fill(_lit(T_LONG_HEAD), "a", "b", "c", "m")}, repeat({_lit(T_LONG_LINE)}, 66))
      WHEN 7 THEN {_fill(_lit(T_SYNTAX_ERROR), "a", "b", "c", "m")}
      WHEN 9 THEN concat({_fill(_lit(T_DEEP_HEAD), "a", "b", "c", "m")}, repeat({_fill(_lit(T_DEEP_LINE), "a", "b", "c", "m")}, 60), {_fill(_lit(T_DEEP_TAIL), "a", "b", "c", "m")})
      ELSE {ai_py} END"""
    javascript = f"CASE template WHEN 3 THEN {human_js} WHEN 8 THEN repeat(concat({ai_js}, {human_js}), 3) ELSE {ai_js} END"
    pick = lambda names: "CASE " + " ".join(f"WHEN doc_id % {len(names)} = {i} THEN {t}" for i, t in enumerate(names)) + " END"
    kinds = f"CASE kind WHEN 0 THEN {pick(PYTHON_TEMPLATES)} WHEN 1 THEN {pick(JAVASCRIPT_TEMPLATES)} ELSE 11 END"
    number = "unnest([0, 1, 2])" if duck else "explode(array(0, 1, 2))"
    ext = "CASE template WHEN 2 THEN '.js' WHEN 3 THEN '.jsx' WHEN 8 THEN '.ts' WHEN 11 THEN '.rb' ELSE '.py' END"
    return f"""SELECT doc_id * 4 + kind AS file_id,
      CASE WHEN template IN (10, 12) THEN NULL ELSE concat('src/file_', CAST(doc_id AS STRING), {ext}) END AS path,
      CAST(NULL AS STRING) AS language,
      CASE kind WHEN 0 THEN concat({python}, {whole("#", "", "")}) WHEN 1 THEN concat({javascript}, {whole("//", "const ", ";")}) ELSE text END AS code,
      template
    FROM (SELECT *, CAST({kinds} AS INT) AS template FROM (SELECT *, {number} AS kind FROM (
      SELECT doc_id, text, md5(text) AS digest, {lines} AS cleaned, {word(1)} AS a, {word(2)} AS b, {word(3)} AS c,
        regexp_replace({line1}, '[^A-Za-z ]', ''{g}) AS m FROM {source})))"""


def code_files(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """The derived corpus as a lazy DataFrame (reads ``documents`` at ``sf_dir``), or only these columns of it.

    Documents are dealt out by row number before they are rendered: the table may lie in few
    splits, and its texts are a fraction of the files made of them.

    The columns come out of a one-element array that is generated again:
    filters on them cannot move below that, so the template expression is
    evaluated once per row and never copied into a filter."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    view = f"qs_documents_{zlib.crc32(sf_dir.encode()):08x}"
    docs.createOrReplaceTempView(view)
    df = spark.sql(render("spark", view))
    if columns:
        df = df.select(*columns)
    once = F.explode_outer(F.array(F.struct(*df.columns))).alias("file")
    return df.select(once).select("file.*")
