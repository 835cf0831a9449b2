"""Hand-written snippets of the five kinds the detector's own tests use."""

AI_PYTHON = '''import json
import os


def load_example_records(sample_path: str) -> list:
    """Load the example records from a sample JSON file.

    Args:
        sample_path: Path to the sample file.
    """
    with open(sample_path) as handle:
        return json.load(handle)


def summarize_example_data(records: list) -> dict:
    """Summarize the example data into a dictionary of totals."""
    summary = {"count": 0, "total": 0}
    for record in records:
        summary["count"] += 1
        summary["total"] += record.get("value", 0)
    return summary


def demo_helper(values: list) -> list:
    """Return the doubled values for this demo helper."""
    return [value * 2 for value in values]


if __name__ == "__main__":
    example_records = load_example_records("sample.json")
    print(summarize_example_data(example_records))
'''

HUMAN_PYTHON = '''import sys,os
# TODO: clean this up later
def proc(f):
    x = open(f).read()
    # print(x)
    try:
        n = int(x.split()[3]) * 37
    except:
        print("bad file", f)
        n = 0   
    # FIXME handle 17 case
    if n > 4242: print("big", n)
    q = [n, 7, 13]
    return q

for a in sys.argv[1:]:
    r = proc(a)
    print(r)
'''

AI_JAVASCRIPT = '''const fetchExampleData = async (sampleUrl) => {
  const response = await fetch(sampleUrl);
  const sampleData = await response.json();
  return sampleData;
};

const formatExampleItems = (items) => {
  return items.map((item) => `Item: ${item.name}`);
};

const processSampleInput = (sampleInput) => {
  const { values, label } = sampleInput;
  return values.filter((value) => value > 0).map((value) => `${label}-${value}`);
};

export const runExample = async () => {
  const exampleData = await fetchExampleData('/api/example');
  return formatExampleItems(exampleData);
};
'''

HUMAN_JAVASCRIPT = '''var x = 0;
var items = [];
// TODO remove this hack
$(document).ready(function() {
  $('#btn').click(function() {
    x++;
    console.log('clicked', x);
    // if (x > 3) alert('too many');
    $.get('/data', function(d) {
      items = d;
      alert('got ' + d.length);
    });
  });
});
/* old code
function f(a,b){return a+b}
*/
var y = eval('1+1');
'''

LOW_SIGNAL_PYTHON = '''x = 1
print(x)
'''
