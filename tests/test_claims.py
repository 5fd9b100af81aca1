"""Values against the lines that they were read from, on lines at the boundary of the rules."""

from pyspark.sql import functions as F

from datelore.operators import claims


def test_scopes_named_by_lines(spark):
    rows = [
        ("scope_1", "Scope 1 | 5", "5", None), ("scope_1", "Scope 1 and Scope 2 | 5", "5", "other_scope"), ("scope_1", "Scope 1, scope 2 | 5", "5", "other_scope"), ("scope_1", "Total | 5", "5", "other_scope"),
        ("scope_2_market", "Scope 2 location-based | 5", "5", "other_basis"), ("scope_2_market", "Scope 1 | 1,200\nScope 2 market | 3", "3", None), ("scope_1", "Scope 1 | 1,200\nScope 2 market | 3", "1200", None),
        ("scope_1", "Scope 1 | 3\nScope 2 | 3", "3", "other_scope"), ("scope_1_2_market", "Scope 1 + 2 (market) | 3", "3", None), ("scope_1_2_market", "Scope 1 scope 2 market | 3", "3", "other_scope"),
        ("scope_3_total", "Scope 3 | 3", "3", None), ("scope_3_total", "Scope 3 categories 1-5 | 3", "3", "part_of_scope"), ("scope_3_total", "Total emissions", None, "other_scope"), ("water", None, None, None), ("scope_1", None, "3", "other_scope"),
    ]
    frame = spark.createDataFrame(rows, "field string, quote string, raw string, want string")
    bad = [r for r in frame.withColumn("got", claims.scope_issue(F.col("field"), F.col("quote"), F.col("raw"))).collect() if r["got"] != r["want"]]
    assert not bad


def test_bounds_and_parts_are_no_totals(spark):
    rows = [
        ("total_energy", "Total energy at least 1,000", None, "1000", "bound_is_not_a_point"), ("total_energy", "Total energy 1,000 (more than last year)", None, "1,000", None), ("water", "≥ 7", None, "7", "bound_is_not_a_point"),
        ("total_energy", "Use 7", "Office energy only", "7", "office_is_not_total"), ("renewable_electricity", "Recs: renewable electricity 7", None, "7", "part_is_not_total"),
        ("renewable_electricity", "Total renewable electricity incl. on-site 7", None, "7", None), ("renewable_electricity", None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, "field string, quote string, note string, raw string, want string")
    bad = [r for r in frame.withColumn("got", claims.boundary_issue(*map(F.col, ("field", "quote", "note", "raw")))).collect() if r["got"] != r["want"]]
    assert not bad


def test_first_failing_rule_clears_its_field_only(spark):
    frame = spark.createDataFrame([(1, 5.0), (2, -1.0), (3, None), (4, 500.0)], "k int, v double")
    got = {r["k"]: (r["v"], r["issue"]) for r in claims.validated(frame, "v", {"positive": F.col("v") >= 0, "small": F.col("v").between(0, 100)}).collect()}
    assert got == {1: (5.0, None), 2: (None, "positive"), 3: (None, None), 4: (None, "small")}


def test_values_agree_within_the_tolerance(spark):
    frame = spark.createDataFrame([(1.0, 1.0 + 5e-10, True), (1.0, 1.0 + 5e-9, False), (0.0, 5e-10, True), (None, 1.0, False), (1e12, 1e12 + 100, True)], "a double, b double, want boolean")
    assert all(r["got"] is r["want"] for r in frame.withColumn("got", claims.agrees(F.col("a"), F.col("b"))).collect())
    assert spark.range(1).select(claims.agrees(F.lit(1.5), F.lit(1.5), whole=F.lit(True))).first()[0] is False


def test_repeated_ids_are_invalid(spark):
    frame = spark.createDataFrame([("0000000001", "available", 5.0), ("0000000002", "available", 5.0), ("0000000002", "available", 6.0), ("3", "available", 1.0), (None, "available", 1.0), ("0000000004", "blocked", 9.0)], "cik string, state string, score double")
    got = {r["cik"]: (r["state"], r["score"]) for r in claims.scores_by_company(frame, "cik").collect()}
    assert got == {"0000000001": ("available", 5.0), "0000000002": ("invalid", None), "0000000004": ("blocked", None)}
    assert claims.scores_by_company(frame.limit(0), "cik").count() == 0


def test_newest_document_whose_bytes_are_right(spark):
    docs = spark.createDataFrame([("c", 1, "a", 3), ("c", 2, "b", 3), ("c", 3, "z", 3), ("d", 4, None, 3)], "company string, document_id int, sha256 string, n_bytes int")
    bodies = spark.createDataFrame([("a", 3), ("b", 4), ("a", 3)], "sha256 string, n_bytes int")
    assert [tuple(r) for r in claims.newest_verified(docs, bodies, ["company"]).collect()] == [("c", 1, "a", 3)]


def test_addresses_of_seeds_are_public(spark):
    urls = ["https://a.example.org", "http://a.example.org:80/", "http://127.0.0.1/", "http://10.0.0.1:80/", "http://a.example.org:443/", "http://localhost/"]
    seeds = spark.createDataFrame([(k, u, "hub", 1, "seen") for k, u in enumerate(urls)], "c int, url string, provider string, document_id int, context string")
    got = {r["c"]: r["issues"] for r in claims.seeds_checked(seeds, seeds.select("c"), "c", ("hub",)).collect()}
    assert got == {0: [], 1: [], **{k: ["url"] for k in range(2, 6)}}
