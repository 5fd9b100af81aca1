"""Wording of numbers and choices between rows, on cases that the tables do not hold."""

import pytest
from pyspark.sql import functions as F

from datelore.functions import units, wording
from datelore.operators import choices


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "number"),
    [("FY24", 2024.0), ("fy ’07", 2007.0), ("FY2031", 2031.0), ("One", 1.0), ("approx. 3.5", 3.5), ("more than 1,200", 1200.0), ("≥ 7 %", 7.0), ("overall 5", None), ("aboutface 2", None), ("FY123", None), ("", None), (None, None)],
)
def test_hedged_number(spark, raw, number):
    assert one(spark, wording.hedged_number(F.lit(raw).cast("string"))) == number


def test_magnitude_and_factor(spark):
    assert [one(spark, wording.magnitude(F.lit(x))) for x in ("5 Million", "3bn", "7 k", "12", "5 km")] == [1e6, 1e9, 1e3, 1.0, 1.0]
    assert one(spark, wording.agreed_factor(F.lit(1000.0), F.lit(1e6))) is None


def test_quantity_needs_review(spark):
    for raw in ("1,23", "1.2.3", "", ",5", "1,234.5,6"):
        assert one(spark, wording.quantity(F.lit(raw), F.lit("m3"), {"m3": ("m3", "1")}))["status"] == "needs_review", raw


def test_context_of_cuts_lines_and_refuses_two_places(spark):
    text = "a\nb\nc\nthe 77 here\nd\ne\nf"
    assert one(spark, wording.context_of(F.lit(text), F.lit("77"))) == "b\nc\nthe 77 here\nd\ne"
    assert one(spark, wording.context_of(F.lit(text + " 77"), F.lit("77"))) is None
    long = "x" * 2000 + "77" + "y" * 2000
    assert one(spark, wording.context_of(F.lit(long), F.lit("77"))) == "x" * 700 + "77" + "y" * 700


def test_row_supports_dash_only_for_zero(spark):
    row = F.lit("Net | — | 5")
    assert one(spark, wording.row_supports(row, F.lit(0.0), F.lit(1), F.lit(False)))
    assert not one(spark, wording.row_supports(row, F.lit(6.0), F.lit(1), F.lit(False)))


def test_attachment_of_two_links_proves_nothing(spark):
    docs = spark.createDataFrame([(1, "c", "a", "u"), (2, "c", "a", "v")], "document_id int, company string, accession string, url string")
    links = spark.createDataFrame([(9, "c", "a", "u", "Report"), (9, "c", "a", "v", "x"), (8, "c", "a", "v", "y"), (7, "d", "a", "u", "other")], "wrapper_id int, company string, accession string, url string, link_text string")
    assert [tuple(r) for r in choices.attached(docs, links).collect()] == [(1, 9, "Report")]


def test_names_of_one_id_in_two_ways_match(spark):
    names = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c"), (3, "z")], "k int, name string")
    found = spark.createDataFrame([("a", 7), ("b", 7), ("c", 8), ("a", 7)], "name string, pid int")
    assert {tuple(r) for r in choices.any_name_matched(names, found, "k", "name", "pid").collect()} == {(1, 7, "matched"), (2, None, "ambiguous"), (3, None, "unmatched")}


def test_merged_chunks_keep_other_years_apart(spark):
    rows = spark.createDataFrame([("r", "x", 1.0, "t", 2020, "reported"), ("r", "x", 1.0, "t", 2020, "reported"), ("r", "x", 2.0, "t", 2019, "reported"), ("r", "y", 1.0, "t", 2020, "stated"), ("r", "y", 2.0, "t", 2020, "stated")], "k string, name string, value double, unit string, reporting_year int, status string")
    got = {(r["name"], r["value"], r["status"]) for r in choices.merged_chunks(rows, ["k"], "name", F.lit(2020)).collect()}
    assert got == {("x", 1.0, "extracted"), ("x_2019", 2.0, "extracted"), ("y", None, "conflicting")}


def test_sources_without_rows(spark):
    empty = spark.createDataFrame([], "k string, url string, document_id int, title string, freshness string, dated string")
    assert choices.sources_in_order(empty, "k", "url").count() == 0


def test_units_by_their_tokens(spark):
    names = ["metric tons carbon  dioxide equivalent", "metric tons CO2 e", "Metric Tonnes of CO2 - e", "tCO2e", "t CO₂-eq", "in millions of metric tons CO2 equivalents", "metric tons carbon-dioxide equivalents", "tons of apples", None]
    frame = spark.createDataFrame([(n, 1.0, "tCO2e") for n in names], "unit string, v double, target string")
    got = {r["unit"]: r["converted"] for r in units.converted(frame, "v", "unit", "target").collect()}
    assert got == dict(zip(names, [1.0, 1.0, 1.0, 1.0, 1.0, 1e6, 1.0, None, None], strict=True))


def test_scales_years_and_decreases_by_tokens(spark):
    scale = {"In  Millions": 1e6, "(thousands": 1e3, "( dollars in billions )": 1e9, "in $ millions": 1e6, "5 million in all": 1.0, "within millions": 1.0, "in millions or in thousands": None, "in millions, except in thousands": 1e6}
    assert {t: one(spark, wording.currency_scale(F.lit(t), F.lit(None).cast("string")))["scale"] for t in scale} == scale
    years = {"For the Fiscal Year ended  December 31, 2023": 2023, "for the fiscal year ended 2024": 2024, "fiscal year ended 2024": None, "For the fiscal year ended soon, 2024": None, "for the fiscal year ended May 3 2024": None, "for the fiscal year ended 1800": None}
    assert {t: one(spark, wording.fiscal_year(F.lit(t))) for t in years} == years
    assert tuple(one(spark, wording.decrease(F.lit("fell 1,200"), F.lit("-1200"), F.lit(-1200.0)))) == ("1,200", -1.0)
