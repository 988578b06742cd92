from __future__ import annotations

import ast
import datetime as dt

import pytest
from rows import rows_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonegrain.functions.literals import read_literal
from tonegrain.operators import clean
from tonegrain.schema import NEWS_RAW

RAW = NEWS_RAW.simpleString()
GOOD = "2021-11-05 04:42:00"


def label(klass="positive", polarity="0.5", subjectivity="0.25"):
    return f"{{'class': '{klass}', 'polarity': {polarity}, 'subjectivity': {subjectivity}}}"


def test_only_the_one_date_format_parses(make):
    values = [GOOD, "2021-11-05", "2021-11-05T04:42:00", "05/11/2021", GOOD + "+00:00", None]
    df = make([(i, v) for i, v in enumerate(values)], "row_id bigint, date string")
    got = dict(rows_of(clean.coerce_date(df)))
    assert got[0] == dt.datetime(2021, 11, 5, 4, 42)
    assert all(got[i] is None for i in range(1, 6))
    assert {r[0] for r in rows_of(clean.invalid_dates(df))} == {1, 2, 3, 4, 5}


LITERALS = [
    label(),
    label(polarity="-0.5"),
    label(polarity="None"),
    label(polarity="True"),
    label(polarity="False"),
    label(polarity=".5"),
    label(polarity="+1"),
    label(polarity="1_0"),
    label(polarity="007"),
    label(polarity="00.5"),
    label(polarity="(1, 2)"),
    label(polarity="'0.5'"),
    label(polarity="'1.0d'"),
    label(polarity="'1_0'"),
    label(polarity="' 2 '"),
    label(polarity="1e3"),
    label(polarity="nan"),
    label(klass="it\\'s"),
    label(klass="a\\x41"),
    label(klass="Positive"),
    label(klass=" positive"),
    label(klass=""),
    "{'class': 'positive',}",
    "{'class': 'positive'}",
    "{'class': 'positive'} x",
    "{'class': 'negative', 'class': 'positive'}",
    "{class: 'positive'}",
    "{'class': None}",
    "{'class': 1}",
    "['positive']",
    "  {'class': 'neutral'}",
    '{"class": "neutral", "polarity": 1, "subjectivity": 0}',
    "{'subjectivity': 0.1, 'polarity': 0.2, 'class': 'neutral'}",
    label() + "\n",
    label() + "\u2028",
    label() + "\u0085",
    label(polarity="'True'"),
    label(polarity="'0.2\\n'"),
    "\x01positive\x010.1\x010.2",
    "junk",
    "",
    "(" * 5000,
    "-" * 5000 + "1",
    None,
]


def expected(source):
    """The definition: a Python dict literal, anything else is an empty record."""
    try:
        record = ast.literal_eval(source) if isinstance(source, str) else {}
    except Exception:
        record = {}
    record = record if isinstance(record, dict) else {}
    return tuple(
        None if (v := record.get(k)) is None else str(float(v) if isinstance(v, bool) else v)
        for k in ("class", "polarity", "subjectivity")
    )


def as_number(text):
    try:
        return None if text is None else float(text)
    except ValueError:
        return None


def test_label_literals_read_as_python_does(make):
    df = make(list(enumerate(LITERALS)), "row_id bigint, sentiment string")
    got = {r[0]: r[1:] for r in rows_of(clean.parse_sentiment(df).drop("sentiment"))}
    for i, source in enumerate(LITERALS):
        want = expected(source)
        assert got[i][0] == want[0], source
        # The plain path keeps a number as written, the other as Python prints it.
        assert [as_number(v) for v in got[i][1:]] == [as_number(v) for v in want[1:]], source


def test_read_literal_agrees_with_the_definition():
    for source in LITERALS:
        assert tuple(read_literal(source).values()) == expected(source)


value = st.one_of(
    st.none(), st.booleans(), st.integers(-1000, 1000), st.text(max_size=5),
    st.floats(-10, 10, allow_nan=False).map(lambda x: round(x, 3)),
)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.fixed_dictionaries({"class": value, "polarity": value}), min_size=20, max_size=60))
def test_any_record_python_writes_is_read_back(spark, records):
    rows = [(i, repr(r)) for i, r in enumerate(records) if "\x00" not in repr(r)]
    df = spark.createDataFrame(rows, "row_id bigint, sentiment string")
    got = {r["row_id"]: r for r in clean.parse_sentiment(df).collect()}
    for i, source in rows:
        assert got[i]["class"] == expected(source)[0]


def test_scores_coerce_to_double(make):
    texts = ["0.5", "True", "False", "None", "abc", "1_0", "1.0d", " 2 ", "-1e3", ".5", "5.", None]
    df = make([(i, t, t) for i, t in enumerate(texts)], "row_id bigint, polarity string, subjectivity string")
    got = {r[0]: r[1] for r in rows_of(clean.coerce_scores(df))}
    want = [0.5, None, None, None, None, None, None, 2.0, -1000.0, 0.5, 5.0, None]
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize(
    ("title", "text", "want"),
    [
        (None, "x", "x"),
        ("T", None, "T. "),
        ("...A", "b", "A. b"),
        ("T", "b", "T. b"),
        (". ", ".. b", "b"),
        (None, None, ""),
    ],
)
def test_input_text(make, title, text, want):
    df = make([(title, text)], "title string, text string")
    assert clean.build_input_text(df).first()["input_text"] == want
    joined = f"{title or ''}. {text or ''}"
    assert want == joined.lstrip(". ")


def news(rows):
    """``(row_id, date, sentiment, title, text)`` completed to raw rows."""
    return [(i, d, s, "src", "btc", title, text) for i, d, s, title, text in rows]


def test_clean_news_and_its_rejects(make):
    rows = news(
        [
            (1, GOOD, label(), "t", "x"),
            (2, "2021-11-04 00:00:00", label(), "t", "x"),  # the earlier copy stays
            (3, GOOD, label("negative"), "t", "x"),  # another class is no copy
            (4, "bad", label(), "t", "x"),
            (5, GOOD, label("mixed"), "t", "y"),
            (6, GOOD, None, "t", "y"),
            (7, GOOD, label(), None, None),
            (8, GOOD, label(), None, "n"),
            (9, GOOD, label(), None, "n"),  # null title equals null title
            (10, GOOD, label("NEGATIVE"), "t", "y"),
            (11, GOOD, "junk", "t", "y"),
        ]
    )
    df = make(rows, RAW)
    good, rejects = clean.clean_news(df)
    assert {r[0] for r in rows_of(good, "row_id")} == {2, 3, 8}
    reasons = dict(rows_of(rejects, "row_id", "reject_reason"))
    assert reasons == {
        1: "duplicate", 9: "duplicate", 4: "missing", 6: "missing", 7: "missing",
        5: "invalid_class", 10: "invalid_class", 11: "invalid_class",
    }
    assert dict(rows_of(clean.reject_report(df))) == {
        "duplicate": 2, "missing": 3, "invalid_class": 3,
    }


def test_clean_news_does_not_depend_on_partitions(spark):
    rows = news([(i, GOOD, label(), f"t{i % 7}", f"x{i % 5}") for i in range(200)])
    df = spark.createDataFrame(rows, RAW)
    one, many = (clean.clean_table(df.repartition(n)) for n in (1, 16))
    assert rows_of(one) == rows_of(many)
    assert one.count() == 35


def test_clean_plan_has_one_shuffle_one_python_pass_and_a_map_side_limit(spark):
    df = spark.createDataFrame(news([(1, GOOD, label(), "t", "x")]), RAW)
    plan = clean.clean_table(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.count("ArrowEvalPython") == 1
    assert plan.count("WindowGroupLimit") == 2


def test_drop_rules(make):
    df = make(news([(1, GOOD, label(), None, None), (2, None, label(), "t", None)]), RAW)
    assert [r[0] for r in rows_of(clean.drop_missing_mandatory(df), "row_id")] == [1]
    assert [r[0] for r in rows_of(clean.drop_missing_body(df), "row_id")] == [2]


def test_feature_projection(make):
    df = make([(1, "a", "positive", "z")], "row_id bigint, input_text string, class string, other string")
    assert clean.feature_projection(df).columns == ["row_id", "input_text", "class"]
    assert df.select(F.count("*")).first()[0] == 1
