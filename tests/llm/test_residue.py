import numpy as np
import pytest

from chronodex.llm import residue as r

REAL = ["The indexer waits 34 seconds before it flushes the rows, and the cache keeps the last 12.", "We measured the latency after the rebase and it was stable in all of our samples.", "Set the limit to 4550 and rebuild the vector store again before the next release."]
RESIDUE = [
    "404 Not Found\n\nshelf/1.9.9\n\n© 2025 Docs", "You need to enable JavaScript to run this app.", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do.", "# {TITLE}\n\nStatus: {STATUS}\nOwner: {OWNER}", "Hello «name»,\n\nthe index of «project» was rebuilt on «date».\n\n" + REAL[0],
    "<html>\n<head><title>502 Bad Gateway</title></head>\n<body>\n<center><h1>502 Bad Gateway</h1></center>\n</body>\n</html>", "# Notes\n\nTBD\n\nText to follow.", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "Your session has expired. Sign in again to continue.",
]
FINE = [
    REAL[0] + "\n\nUsers reported \"Please enable JavaScript\" in old browsers; 1.8.2 drops that check.", "The formatter replaces `{{ project_name }}` and `{{version}}` with the values of the file.\n\n" + REAL[1], "```html\n<h1>{{ title }}</h1>\n<p>{{ body }}</p>\n```\n\n" + REAL[2],
    REAL[1] + "\n\nA missing file gives a 404 Not Found answer, which the watcher turns into an empty list.", "def f(x):\n    # TODO: measure again\n    return f\"{x} rows\"\n", "", " \n\t", REAL[0] + "\n\nTODO: measure collect_plans again inside a container.", "var label = `${total} rows }`;\nlet a = `${b}${c}`;",
]


def run(spark, texts):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, features string")
    return {x.doc_id for x in r.find_residue(d).collect()}


def test_told_apart(spark):
    texts = RESIDUE + FINE + [None] + REAL * 20
    assert run(spark, texts) == set(range(len(RESIDUE)))


def test_companions_are_learned(spark):
    """A line that stands beside error messages is residue alone, although no form names it."""
    texts = ["404 Not Found\n\nBack to the very start page of docs"] * 20 + REAL * 40 + ["Back to the very start page of docs"]
    assert run(spark, texts) == set(range(20)) | {len(texts) - 1}


def test_edges(spark):
    assert run(spark, []) == set() == run(spark, [None, "", "# Title", "```\ncode\n```"])
    long = "\n".join(REAL * 3000)
    assert run(spark, [long + "\n\n404 Not Found", long]) == set()
    assert run(spark, [RESIDUE[0]] * 3 + REAL) == {0, 1, 2}


@pytest.mark.parametrize("text, n", [("{{ a }} and ${b}", 2), ("`{{ a }}` \"${b}\"", 0), ("__init__ and __NAME__", 1), ("[insert name] <describe it>", 2), ("#[must_use] [x](y)", 0), ("$name$ costs $5", 1), ("%%a%% <%= b %> #{c} {d}", 4)])
def test_placeholders(text, n):
    assert sum(k for _, k in r.passages(text)) == n


def test_decisions():
    assert r.decide(np.array([0.9, 0.1]), np.array([60, 50]), np.array([0, 0])) and not r.decide(np.array([0.9, 0.1]), np.array([40, 50]), np.array([0, 0]))
    assert r.decide(np.array([0.9, 0.1]), np.array([10, 500]), np.array([2, 0])) and not r.decide(np.array([0.1]), np.array([9]), np.array([3])) and not r.decide(np.zeros(0), np.zeros(0), np.zeros(0))
