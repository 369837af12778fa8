"""Cleaning expression: worked cases and properties."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.functions.text import clean_text, removal_words


CASES = [
    ("McDonald's", "mcdonalds"),
    ("The Cheesecake Factory", "cheesecake factory"),
    ("BARNES &amp; NOBLE #2626", "barnes amp noble"),
    ("Café Rio", "caf rio"),
    ("a\tb", "ab"),
    ("5 x 7 in", ""),
    (None, None),
    ("  Hot   plate set for  the STREET ", "hot plate"),
]


def _clean(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(clean_text("t")).collect()]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(spark, text, want):
    assert _clean(spark, [text]) == [want]


SHAPE = re.compile(r"^([a-z]{2,}( [a-z]{2,})*)?$")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40), min_size=1, max_size=20))
def test_shape_and_idempotence(spark, texts):
    once = _clean(spark, texts)
    twice = _clean(spark, once)
    assert once == twice
    drop = set(removal_words())
    for t, out in zip(texts, once):
        assert SHAPE.match(out), (t, out)
        assert not (set(out.split()) & drop)


def python_reference_chain(text, drop):
    """A step-by-step restatement of the documented chain, for comparison."""
    s = re.sub(r"[^a-zA-Z ]", "", text).strip().lower()
    return " ".join(w for w in s.split() if len(w) > 1 and w not in drop)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=20))
def test_matches_python_chain(spark, texts):
    drop = set(removal_words())
    assert _clean(spark, texts) == [python_reference_chain(t, drop) for t in texts]
