"""The merge of dates and observations against the pairs of all of them."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from datelore.operators import asof, splits

DAY = datetime.date(2020, 1, 1)


@pytest.mark.parametrize("seed", range(3))
def test_merge_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    day = lambda: DAY + datetime.timedelta(days=rng.randint(0, 6))
    rows = spark.createDataFrame([(rng.choice("abc"), day()) for _ in range(20)], "company_cik string, as_of date").distinct()
    found = [
        (rng.choice("abcd"), rng.choice("xy"), rng.choice([1.0, 2.0, 2.0, None, float("inf")]), rng.choice(["usd", "usd", "eur"]), rng.choice([None, 2018, 2019]), rng.choice([None, day(), day()]), day(), k)
        for k in range(150)
    ]
    frame = spark.createDataFrame(found, "company_cik string, feature_name string, value double, unit string, reporting_year int, publication_date date, acquired_date date, document_id int")
    for fallback in (False, True):
        want, _ = asof.select_as_of(asof.candidates(rows, frame, fallback=fallback), ["company_cik", "as_of"])
        got = asof.known_as_of(rows, asof.judged(frame, fallback=fallback))
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect())) and got.count() > 5
    assert asof.known_as_of(rows.limit(0), asof.judged(frame)).count() == 0
    assert asof.known_as_of(rows, asof.judged(frame.limit(0))).count() == 0


def test_previous_scores_among_allowed_rows(spark):
    d = lambda n: DAY + datetime.timedelta(days=n)
    rows = spark.createDataFrame([("a", d(3)), ("a", d(1)), ("b", d(9)), ("c", d(9))], "company_cik string, as_of date")
    told = [("a", d(1), 1, 5.0, "train"), ("a", d(1), 2, 4.0, "train"), ("a", d(2), 1, 9.0, "test"), ("a", d(8), 1, 7.0, "train"), ("b", None, 1, 3.0, "train")]
    published = spark.createDataFrame(told, "company_cik string, published_date date, cycle int, score double, fold string")
    got = lambda allowed: {(r.company_cik, r.as_of.day): r.previous_score for r in asof.previous_scores(rows, published, allowed=allowed).collect()}
    assert got(None) == {("a", 4): 9.0, ("a", 2): 4.0, ("b", 10): None, ("c", 10): None}
    assert got(F.col("fold") == "train") == {("a", 4): 4.0, ("a", 2): 4.0, ("b", 10): None, ("c", 10): None}


def test_previous_score_baseline_of_folds(spark):
    d = lambda n: DAY + datetime.timedelta(days=n)
    rows = [("f", "train", "a", 1, d(0), d(1), 5.0), ("f", "validation", "a", 2, d(1), d(2), 6.0), ("f", "validation", "b", 2, d(1), d(2), 6.0), ("g", "train", "a", 2, d(1), d(2), 6.0), ("g", "test", "a", 3, d(2), d(3), 7.0)]
    folds = spark.createDataFrame(rows, "fold string, role string, company_cik string, cycle int, as_of date, published_date date, score double")
    assert {(r.fold, r.company_cik): r.previous_score for r in splits.previous_score_baseline(folds).collect()} == {("f", "a"): 5.0, ("f", "b"): None, ("g", "a"): 6.0}
