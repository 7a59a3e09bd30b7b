"""Date forms of text columns: the vote of all values, and what applying it keeps."""

import datetime

import pytest

from tidemark.operators.quality import apply_schema, infer_dates, infer_schema

COLUMNS = {
    "us": ["1/31/2024", "2/1/2024", "12/05/2023 9:05", None],
    "eu": ["31/1/2024", "1/2/2024", "05/12/2023 09:05:07", ""],
    "dots": ["31.01.2024", "1.2.2024", "x", "05.12.2023"],
    "short": ["31 Jan 2024", "1 Feb 2024", "5 May 2024", None],
    "long": ["January 31, 2024", "May 1, 2024", "December 5, 2023", None],
    "either": ["1/2/2024", "3/4/2024", "5/6/2024", None],
    "iso": ["2024-01-31", "2024-02-01 10:00:00", "2024-02-30", None],
    "words": ["May be", "1/2", "13/13/2024", "99.99.9999"],
    "nothing": [None, None, None, None],
}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(zip(*COLUMNS.values(), strict=True)), ", ".join(f"{c} string" for c in COLUMNS))


def test_all_values_settle_the_form(table):
    got = {r["column"]: (r.form, r.parsed, r.filled, r.ambiguous) for r in infer_dates(table).collect()}
    assert got == {
        "us": ("M/d/yyyy", 3, 3, False), "eu": ("d/M/yyyy", 3, 4, False), "dots": ("d.M.yyyy", 3, 4, False),
        "short": ("d MMM yyyy", 3, 3, False), "long": ("MMMM d, yyyy", 3, 3, False), "either": ("M/d/yyyy", 3, 3, True),
        "iso": ("ISO", 2, 3, False), "words": (None, 0, 4, False), "nothing": (None, 0, 0, False),
    }


def test_inference_calls_them_dates(table):
    got = {r["column"]: r.inferred for r in infer_schema(table).collect()}
    assert {c for c, k in got.items() if k == "DateTime"} == {"us", "eu", "dots", "short", "long", "either", "iso"}


def test_applied_forms_keep_moments_and_reject_the_rest(table):
    forms = {r["column"]: r.form for r in infer_dates(table).where("form is not null").collect()}
    rows = apply_schema(table, dict.fromkeys(forms, "DateTime"), dates=forms).collect()
    d = datetime.datetime
    assert [r.us for r in rows] == [d(2024, 1, 31), d(2024, 2, 1), d(2023, 12, 5, 9, 5), None]
    assert [r.eu for r in rows] == [d(2024, 1, 31), d(2024, 2, 1), d(2023, 12, 5, 9, 5, 7), None]
    assert [r.short for r in rows] == [d(2024, 1, 31), d(2024, 2, 1), d(2024, 5, 5), None]
    assert [r.long for r in rows] == [d(2024, 1, 31), d(2024, 5, 1), d(2023, 12, 5), None]
    assert rows[2]._rejected == {"dots": "x", "iso": "2024-02-30"} and rows[3]._rejected == {"eu": ""}


def test_an_empty_table_has_no_form(table):
    got = infer_dates(table.limit(0), ["us"]).collect()
    assert [(r.form, r.parsed, r.ambiguous) for r in got] == [(None, 0, False)]
