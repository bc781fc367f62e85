import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from faultlore.catalogue import BUILTIN_RULES
from faultlore.functions.regexes import prefix_tree_regex, required_text, spark_regex, sql_text

ALL = [rx for r in BUILTIN_RULES for rx in r.patterns]


@pytest.mark.parametrize("rx", ALL)
def test_every_match_contains_the_required_text(rx):
    groups = required_text(rx)
    assert groups, "no literal text: would be tried on every line"

    @settings(max_examples=15, deadline=None, database=None,
              suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(rx, re.I | re.A)))
    def holds(line):
        for group in groups:
            assert any(text in line.lower() for text in group)

    holds()


@settings(max_examples=200, deadline=None, database=None)
@given(st.sets(st.text("ab-.c'defgh", min_size=1, max_size=5), min_size=1, max_size=30),
       st.text("ab-.c'defghi", max_size=25))
def test_prefix_tree_finds_the_longest_word_at_each_position(words, text):
    tree = re.compile(f"(?=({prefix_tree_regex(words)}))")
    longest_first = re.compile(
        f"(?=({'|'.join(map(re.escape, sorted(words, key=len, reverse=True)))}))")
    assert tree.findall(text) == longest_first.findall(text)


def test_dialect():
    assert spark_regex(r"a.b\.c[.\s-]") .startswith(r"(?i)a[^\n\r")
    assert r"\.c[.\t" in spark_regex(r"a.b\.c[.\s-]")
    assert sql_text('a"b') == 'r"a\\x22b"'


def test_required_text_of_odd_regexes():
    assert required_text(r"\d+") == []
    assert required_text(r"a1\s+(?:b1|c1)") == [("a1",), ("b1", "c1")]
    assert required_text(r"(?:xx)?yy") == [("yy",)]
    assert required_text(r"(?:aa|\d)zz") == [("zz",)]


def test_only_the_rarest_literals_of_a_regex_are_searched_for():
    """Further literals are looked for in the line itself, where the rarest were found."""
    from faultlore.operators.matching import _search

    _, marks, _, _ = _search(tuple(BUILTIN_RULES))
    assert max(n for bucket in marks for n in bucket) <= len(ALL)
