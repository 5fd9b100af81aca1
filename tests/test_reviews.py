"""Reviews, receipts, links, cohorts, reference rows and comparisons on rows at the boundary of their rules."""

import datetime as dt

from pyspark.sql import functions as F

from datelore.operators import reviews

DAY = dt.datetime(2024, 1, 1)
SHA = "a" * 64


def test_review_window_is_thirty_days_at_most(spark):
    month, late = DAY + dt.timedelta(days=30), DAY + dt.timedelta(days=30, seconds=1)
    rows = [
        ("latest_verified", SHA, DAY, month, None, []), ("latest_verified", SHA, DAY, late, None, ["window"]), ("latest_verified", SHA, DAY, DAY, None, ["window"]),
        ("newer_available", SHA, DAY, month, None, ["candidate"]), ("unknown", SHA.upper(), DAY, month, "u", ["sha256", "candidate"]), (None, None, None, None, None, ["status", "sha256", "window"]),
    ]
    frame = spark.createDataFrame(rows, "status string, sha256 string, checked_at timestamp, valid_until timestamp, candidate_url string, want array<string>")
    assert all(r["got"] == r["want"] for r in frame.select("want", reviews.review_issues().alias("got")).collect())


def test_result_stays_while_a_newer_attempt_runs(spark):
    rows = [(1, 1, DAY, "succeeded", 5), (1, 2, DAY + dt.timedelta(1), "running", None), (2, 3, DAY, "failed", None), (3, 4, DAY, "succeeded", 7), (3, 5, DAY, "failed", None)]
    frame = spark.createDataFrame(rows, "company int, attempt_id int, started_at timestamp, status string, fields int")
    got = {r["company"]: (r["status"], r["last_id"], r["saved_id"]) for r in reviews.processing_status(frame, ["company"]).collect()}
    assert got == {1: ("processing", 2, 1), 2: ("needs_review", 3, None), 3: ("completed", 5, 4)}
    assert reviews.processing_status(frame.limit(0), ["company"]).count() == 0


def test_model_review_only_where_asked_for(spark):
    rows = [
        ("passed", True, False, False, [], True), ("passed", True, False, False, [True] * 3, False), ("passed", True, None, None, [True] * 3, True), ("passed", True, True, True, [True] * 2, False),
        ("passed", True, True, True, [True, None, True], False), ("failed", True, True, True, [True] * 3, False), ("passed", None, True, True, [True] * 3, False), ("passed", True, True, True, None, False),
    ]
    frame = spark.createDataFrame(rows, "s string, c boolean, a boolean, r boolean, j array<boolean>, want boolean")
    got = frame.select("want", reviews.checks_passed(*map(F.col, "scarj"), 3).alias("got")).collect()
    assert all(r["got"] is r["want"] for r in got)


def test_nearest_baseline_takes_zero_and_both_parts(spark):
    rows = [(1, 2017, 9.0, None, None), (1, 2019, None, 1.0, None), (1, 2020, None, 1.0, 2.0), (1, 2021, 0.0, 5.0, 5.0), (1, 2022, None, None, None)]
    frame = spark.createDataFrame(rows, "company int, year int, whole double, part_1 double, part_2 double")
    got = {r["year"]: (r["baseline_year"], r["baseline"]) for r in reviews.baseline_years(frame, "company", 2018).collect()}
    assert got == {2017: (None, None), 2019: (None, None), 2020: (None, None), 2021: (2020, 3.0), 2022: (2021, 0.0)}


def test_links_are_resolved_and_dealt(spark):
    html = '<a href="/r.pdf">Report 2021</a><a class="x" href="https://a.org/x#top">X</a><a href="/r.pdf#p">again</a><a href="//cdn.org/z">z</a><a href="#">top</a><a href="https://b.org/report-2019-2020">Impact report</a><a href="/impact">impact</a>'
    pages = spark.createDataFrame([(1, "https://a.org/home?q=1", html), (2, None, html), (3, "https://a.org", None)], "page_id int, url string, html string")
    links = reviews.anchors(pages, "page_id", "url", "html").where("page_id = 1")
    scope = {r["url"]: r["scope"] for r in reviews.link_scope(links, "page_id", 2).collect()}
    assert scope == {"https://a.org/r.pdf": "read", "https://a.org/x": "read", "https://a.org/impact": "unread", "https://b.org/report-2019-2020": "outside"}
    kinds = {r["url"]: (r["kind"], r["year"]) for r in reviews.relevant_links(links, "impact|report", "report").collect()}
    assert kinds == {"https://a.org/r.pdf": ("report", 2021), "https://b.org/report-2019-2020": ("report", 2020), "https://a.org/impact": ("page", None)}


def test_scenario_makes_ratios_anew(spark):
    long = spark.createDataFrame([(1, "n", 4.0, 2020), (1, "d", 2.0, 2020), (2, "n", 1.0, 2020), (2, "d", 4.0, 2020)], "k int, feature_name string, value double, reporting_year int")
    changes = spark.createDataFrame([(1, "d", 4.0), (2, "n", None)], "k int, feature_name string, new_value double")
    got = {r["k"]: (r["original"], r["scenario"], r["difference"]) for r in reviews.scenario_differences(long, changes, ["k"], [("q", "n", "d")]).collect()}
    assert got == {1: (2.0, 1.0, -1.0), 2: (0.25, None, None)}


def test_missing_and_odd_inputs(spark):
    frame = spark.createDataFrame([(1, "1.5", " A "), (2, None, " "), (3, "abc", None)], "k int, x string, c string")
    got = {r["k"]: (r["x"], r["c"], r["issues"]) for r in reviews.model_inputs(frame, ["x"], ["c"]).collect()}
    assert got == {1: (1.5, "A", []), 2: (None, "Unknown", []), 3: (None, "Unknown", ["x"])}


def test_candidates_of_other_families_come_last(spark):
    rows = [(1, None, 9, 1, "a", 1), (1, "Y", 1, 1, "b", 2), (1, "X", None, 1, "c", 3), (1, "X", 5, 1, "d", 4), (1, "Z", 7, 1, "e", 5)]
    got = reviews.candidates_ranked(spark.createDataFrame(rows, "k int, family string, dated int, year int, title string, asset_id int"), "k", ("X", "Y")).orderBy("place").collect()
    assert [r["asset_id"] for r in got] == [4, 3, 2, 1, 5]


def test_preview_cuts_the_line_that_passes_the_limit(spark):
    frame = spark.createDataFrame([(1, "abc\ndefgh\nij"), (2, ""), (3, None)], "k int, text string")
    got = [(r["k"], r["line_no"], r["line"], r["is_cut"]) for r in reviews.preview_lines(frame, "k", "text", 5, 6).orderBy("k", "line_no").collect()]
    assert got == [(1, 1, "abc", False), (1, 2, "de", True), (2, 1, "", False)]


def test_notes_of_older_listings_go(spark):
    notes = F.array(F.lit(reviews.LISTING_NOTE + "old"), F.lit("kept"), F.lit(None).cast("string"))
    old = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    made = reviews.review_refreshed(F.lit("new"), F.lit(DAY), notes, old, F.create_map(F.lit("b"), F.lit("3")))
    r = spark.range(1).select(made.alias("r")).first()["r"]
    assert (r["notes"], r["assessments"], r["valid_until"]) == (["kept", reviews.LISTING_NOTE + "new"], {"a": "1", "b": "3"}, DAY + dt.timedelta(7))
    nulls = reviews.review_refreshed(F.lit("new"), F.lit(DAY), F.lit(None).cast("array<string>"), F.lit(None).cast("map<string,string>"), F.lit(None).cast("map<string,string>"))
    assert spark.range(1).select(nulls.alias("r")).first()["r"]["assessments"] == {}
