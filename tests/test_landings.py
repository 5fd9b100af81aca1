"""Scans and exports at the boundary of their rules."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from datelore.operators import eligibility
from datelore.plans import landings
from datelore.sources import exports, scans
from datelore.sources.files import ExpectationError


def sheet(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder / name)


def test_rows_of_a_sheet_keep_their_places(spark, tmp_path):
    path = sheet(tmp_path, "a.csv", '﻿id, name ,,"note"\r\n1,"a, b",x,n\r\n\r\n , ,,\n2,c\n')
    rows = scans.sheet_rows(spark, path, ["id", "name"], ["id"])
    assert rows.columns == ["source_row", "id", "name", "note"]
    assert sorted(map(tuple, rows.collect())) == [(2, "1", "a, b", "n"), (5, "2", "c", None)]


@pytest.mark.parametrize(("text", "wrong"), [("id,id\n1,2", "repeated"), ("id\n1", "missing columns: name"), ("id,name\n,a", "has_id"), ("id,name\n", "has_rows"), ("id,name\n1,a,b", "no_overflow"), ("", "missing columns")])
def test_sheets_with_a_fault(spark, tmp_path, text, wrong):
    with pytest.raises(ExpectationError, match=wrong):
        scans.sheet_rows(spark, sheet(tmp_path, "a.csv", text), ["id", "name"], ["id"]).count()


def test_bundles(spark, tmp_path):
    columns = ("Ticker", "Company", "Sector", "Branch")
    good = "Ticker,Company,Sector,Branch,more\nA,a,s,b,1\nB,b,s,b,2"
    about = "Source,Publisher/Host,URL,Use\nx,h,https://a.example.org/,classes\ny classes,h,http://b.example.org/,-\nz,h,nowhere,other"

    def read(classes=good, sources=about, least=2):
        sheet(tmp_path, "classification.csv", classes)
        sheet(tmp_path, "sources.csv", sources)
        return scans.classification_bundle(spark, str(tmp_path), columns, least, 800, "classes")

    rows, sources = read()
    assert sorted(map(tuple, rows.collect())) == [("A", "s", "b"), ("B", "s", "b")] and sources.count() == 2
    for change in ({"classes": good.replace("B,b", "A,b")}, {"least": 3}, {"sources": about.replace("y classes", "y")}, {"sources": about.replace("https://a.example.org/", "ftp://a")}, {"classes": "Company,Ticker,Sector,Branch\nA,a,s,b\nB,b,s,b"}, {"classes": good.replace("A,a,s", "A,a,")}):
        with pytest.raises(ExpectationError):
            read(**change)


def listing(spark, *assets, body=None):
    frame = spark.createDataFrame([(1, body or json.dumps({"GetContentAssetListResult": list(assets)}), "ESG")], "k int, body string, type string")
    return [(r.row, r.issue) for r in scans.asset_listing(frame, ["k"], "body", "type").orderBy("row").collect()]


def test_assets_of_a_listing(spark):
    one = {"Type": "esg", "FilePath": "https://a.example.org/x.PDF?v=1", "Title": "T", "FileType": "PDF", "ContentAssetDate": "3/5/2024 1:2:3"}
    cases = [one, one | {"Type": "other"}, one | {"ContentAssetDate": "2024-03-05"}, one | {"FileType": "doc"}, one | {"Title": " "}, one | {"FilePath": "https://a.example.org/x.html"}, one | {"FilePath": "http://127.0.0.1/x.pdf"}, one | {"FilePath": None}, one | {"ContentAssetDate": "13/45/2024 00:00:00"}]
    assert listing(spark, *cases) == [(0, None), (2, "invalid_date"), *[(k, "invalid_pdf") for k in (3, 4, 5, 6, 7)], (8, "invalid_date")]
    assert listing(spark, body="<html>") == listing(spark, body='{"other": 1}') == [(None, "invalid_listing")] and listing(spark) == []


def test_widgets_of_a_page(spark):
    call = lambda options: f"$('#a').downloads ( {{ {options} }} );"
    script = "<script src='https://widgets.Q4app.com/x.js'>"
    pages = {
        script + call("downloadType: 'ESG', minYear: 2015, fetchAllYears : true") + call('downloadtype:"esg"') + call("downloadType: 'Human-Rights'"): [("ESG", True, 2015), ("Human-Rights", False, None)],
        call("downloadType: 'ESG'"): [], script + call("downloadType: 'Results'") + call("kind: 'ESG'"): [], script + ".downloads({ downloadType: 'ESG'": [], script + call("downloadType: 'Besgo'"): [], "x q4.api.min.js" + call("downloadType: 'Sustainability'"): [("Sustainability", False, None)],
    }
    frame = spark.createDataFrame([(k, h, "https://a.example.org/p") for k, h in enumerate(pages)] + [(99, next(iter(pages)), "http://localhost/")], "k int, html string, url string")
    got = {}
    for r in scans.download_widgets(frame, ["k"], "html", "url").collect():
        got.setdefault(r.k, []).append((r.asset_type, r.all_years, r.min_year))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in enumerate(pages.values()) if v}


def test_profiles_of_pages(spark):
    ld = lambda **of: f'<script type="application/ld+json">{json.dumps(of)}</script>'
    ticker, firm = '<span class="ticker_name">\n AB </span>', {"@type": "Corporation", "name": " Firm ", "url": "https://a.example.org"}
    cases = {
        "<script type='application/ld+json'>{no</script>" + ld(**{"@type": "Person"}) + ld(**firm) + ticker: ("AB", "Firm", "https://a.example.org", None), ticker: (None, None, None, "no_profile"), ld(**firm): (None, None, None, "no_ticker"),
        ld(**{"@type": "Corporation"}) + ticker: (None, None, None, "no_url"), ld(**(firm | {"url": "http://10.0.0.1/"})) + ticker: (None, None, None, "private_url"), None: (None, None, None, "no_profile"),
    }
    frame = spark.createDataFrame([(k, h) for k, h in enumerate(cases)], "k int, html string")
    assert {r.k: tuple(r)[1:] for r in scans.company_profiles(frame, ["k"], "html").collect()} == dict(enumerate(cases.values()))


ROW = {"company_cik": "0000000001", "provider_cid": "7", "provider_company_name": "Firm", "industry": "x", "score_type": "esg_score", "score_value": 50, "score_under_review": None, "last_updated": "2024-01-31", "assessment_year": 2024}


def test_every_issue_of_an_export(spark):
    file = lambda *rows, **other: json.dumps({"provider": "p", "license_reference": "r", "fetched_at": "2024-01-01T00:00:00Z", "rows": list(rows)} | other)
    cases = {
        file(ROW, ROW | {"assessment_year": None}): "", file(): "", file(ROW, extra=1): "fields", file({k: v for k, v in ROW.items() if k != "industry"}): "fields,names", file(ROW, license_reference=" "): "license", file(ROW, fetched_at="2024-01-01T00:00:00"): "fetched_at",
        file(ROW | {"provider_cid": "8"}): "identity", file(ROW | {"company_cik": "1"}): "identity", file(ROW | {"industry": " "}): "names", file(ROW | {"score_type": "x"}): "score_type", file(ROW | {"score_value": 101}): "score_value", file(ROW | {"score_value": "50"}): "score_value",
        file(ROW | {"score_value": True}): "score_value", file(ROW | {"score_under_review": "no"}): "review", file(ROW | {"last_updated": "2024-02-31"}): "last_updated", file(ROW | {"assessment_year": 1998}): "assessment_year", file(ROW, ROW): "repeated", "nothing": "fetched_at,fields,license",
    }
    verified = spark.createDataFrame([("0000000001", "7", "Firm")], "company_cik string, provider_cid string, company_name string")
    frame = spark.createDataFrame([(k, b) for k, b in enumerate(cases)], "k int, body string")
    rows, issues = scans.score_export(frame, ["k"], "body", verified)
    assert {r.k: ",".join(r.issues) for r in issues.collect()} == dict(enumerate(cases.values()))
    assert sorted((r.k, r.score_value, r.assessment_year is None) for r in rows.collect()) == [(0, 50.0, False), (0, 50.0, True)]


def test_rows_of_an_export_are_objects_with_values_of_their_own(spark):
    """A row inside a string is no row, a value inside another one is not the row's; odd rows do not hide the issues of those beside them."""
    file = lambda *rows: json.dumps({"provider": "p", "license_reference": "r", "fetched_at": "2024-01-01T00:00:00Z", "rows": list(rows)})
    odd = "fields,identity,last_updated,names,review,score_type,score_value"
    first = {"industry": {"score_value": 5}}  # stands before the row's own value
    cases = {
        file(json.dumps(ROW)): "fields", file(ROW | {"provider_cid": "8"}, json.dumps(ROW)): "fields,identity", file(first | ROW | first | {"score_value": "50"}): "score_value", file(ROW, 5): odd, file(None): odd,
        file(ROW | {"assessment_year": 1998}, [1]): "assessment_year," + odd, file(ROW, ROW, "x"): "fields,identity,last_updated,names,repeated,review,score_type,score_value", file(ROW | {"assessment_year": "2024"}, ROW | {"assessment_year": 2023.0}): "assessment_year", file(ROW)[:-1]: "fetched_at,fields,license",
    }
    verified = spark.createDataFrame([("0000000001", "7", "Firm"), ("0000000001", "8", None)], "company_cik string, provider_cid string, company_name string")
    frame = spark.createDataFrame([(k, b) for k, b in enumerate(cases)], "k int, body string")
    rows, issues = scans.score_export(frame, ["k"], "body", verified)
    assert {r.k: ",".join(r.issues) for r in issues.collect()} == dict(enumerate(cases.values())) and rows.count() == 0
    nameless = scans.score_export(spark.createDataFrame([(None, file(ROW)), (None, file(ROW | {"score_value": 101}))], "k int, body string"), ["k"], "body", verified)
    assert sorted(",".join(r.issues) for r in nameless[1].collect()) == ["identity", "identity,score_value"] and nameless[0].count() == 0


def test_exports_are_judged_where_they_lie(spark, sf_dir):
    """Orders are read for the exports and for their identities, and no join compares or sorts rows of exports."""
    plan = landings.QUERIES["a35_score_exports"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("o_orderkey") > 0 and len([line for line in plan.splitlines() if "FileScan parquet" in line and "o_custkey" in line]) <= 2
    assert not [line for line in plan.splitlines() if "SortMergeJoin" in line and ("score_type" in line or "assessment_year" in line)]


def test_every_fault_of_a_receipt(spark):
    data = json.dumps({"company": {"ticker": "AB"}})
    sound = {"category": "social", "version": "v", "fresh_original_extraction": True, "document_id": 1, "company_cik": "0" * 10, "company_id": "AB", "source_sha256": "a" * 64, "status": "succeeded", "output_sha256": hashlib.sha256(data.encode()).hexdigest()}
    passed = {"status": "passed", "schema_checks": True, "source_identity_checks": True, "source_quote_checks": True}
    other = json.dumps({"company": {"ticker": "X"}})

    def folder(receipt=sound, data=data, checks=passed, evidence="{}"):
        return {"receipt": json.dumps(receipt) if isinstance(receipt, dict) else receipt, "data": data, "validation": json.dumps(checks), "evidence": evidence}

    cases = {
        "good": (folder(), ("succeeded", None)), "running": (folder(sound | {"status": "running"}, None), ("running", None)), "no_data": (folder(data=None), ("failed", "no_data")), "changed": (folder(data=data + " "), ("failed", "data_changed")),
        "other": (folder(sound | {"output_sha256": hashlib.sha256(other.encode()).hexdigest()}, other), ("failed", "other_company")), "checks": (folder(checks=passed | {"schema_checks": False}), ("failed", "checks_not_passed")), "evidence": (folder(evidence=None), ("failed", "no_evidence")),
        "unreadable": (folder(sound | {"output_sha256": hashlib.sha256(b"{").hexdigest()}, "{"), ("failed", "data_unreadable")), "broken": (folder("{"), None), "old": (folder(sound | {"version": "u"}), None), "kind": (folder(sound | {"category": "x"}), None),
        "id": (folder(sound | {"company_cik": "1"}), None), "hash": (folder(sound | {"source_sha256": "A" * 64}), None), "copied": (folder(sound | {"fresh_original_extraction": False}), None), "none": (folder(None), None),
    }
    files = [(f"a/b/{name}/{role}.json", content.encode()) for name, (contents, _) in cases.items() for role, content in contents.items() if content is not None] + [("a/b/good/other.txt", b"x")]
    found = scans.receipts(spark.createDataFrame(files, "path string, content binary"), ("social",), "v").collect()
    assert {r.folder.split("/")[-1]: (r.status, r.reason) for r in found} == {name: want for name, (_, want) in cases.items() if want}
    assert {r.folder: r.data is not None for r in found if r.status == "succeeded"} == {"a/b/good": True}


def test_labels_that_may_be_used(spark):
    rows = [
        ("a", "c", "y", "2024-01-01", 50.0, "2024-02-01", "r", None), ("b", "c", "y", "2024-01-01", 100.5, "2024-02-01", "r", "missing_or_invalid_label"), ("c", "c", "y", "2024-01-01", None, None, "r", "missing_or_invalid_label"), ("d", "c", "y", "2024-01-01", float("nan"), "2024-02-01", "r", "missing_or_invalid_label"),
        ("e", "c", "y", "2024-01-01", 0.0, "2024-2-1", "r", "missing_label_provenance"), ("f", "c", "y", "soon", 0.0, "2024-02-01", "r", "missing_label_provenance"), ("g", "c", "y", "2024-01-01", 0.0, "2024-02-01", " ", "missing_label_provenance"), ("h", None, "y", "2024-01-01", 0.0, "2024-02-01", "r", "missing_label_provenance"),
        ("i", "c", "", "2024-01-01", 0.0, "2024-02-01", "r", "missing_label_provenance"), ("j", "c", "y", "2024-01-01", 0.0, "2024-02-01", "r", "repeated_row"), ("j", "c", "y", "2024-01-01", 0.0, "2024-02-01", "r", "repeated_row"), (None, "c", "y", "2024-01-01", 0.0, "2024-02-01", "r", "repeated_row"),
    ]
    frame = spark.createDataFrame(rows, "row_id string, company_cik string, assessment_cycle string, prediction_as_of string, score double, published string, reference string, want string")
    judged = eligibility.label_exclusions(frame, "score", "published", "reference")
    assert not [r for r in judged.collect() if r.reason != r.want] and judged.count() == len(rows)
    assert {(r.reason, r.n) for r in eligibility.exclusion_counts(judged, "t").collect()} == {("used", 1), ("missing_or_invalid_label", 3), ("missing_label_provenance", 5), ("repeated_row", 3)}


def test_values_years_and_warnings(spark):
    rows = [
        ("x", False, 1.0, "reported", True, "1", "t", 1.0, None), ("x", False, None, None, None, None, None, None, None), ("x", False, 1.0, "reported", None, "1", "t", 1.0, "no_evidence"), ("x", False, 1.0, "missing", True, "1", "t", 1.0, "status_without_value"), ("x", False, 1.0, None, True, "1", "t", 1.0, "status_without_value"),
        ("x", False, 1.0, "reported", True, None, "t", 1.0, "incomplete_evidence"), ("x", True, 1.0, "reported", True, None, None, None, None), ("x", False, 1.0, "reported", True, "1", "t", 0.0, "scale_sign"), ("x", False, 1.0, "reported", True, "1", "t", -1.0, "scale_sign"), ("a_change_pct", False, 1.0, "reported", True, "1", "t", -1.0, None),
    ]
    names = ["name", "is_boolean", "value", "status", "has", "raw", "unit", "scale"]
    frame = spark.createDataFrame(rows, "name string, is_boolean boolean, value double, status string, has boolean, raw string, unit string, scale double, want string")
    assert not [r for r in frame.withColumn("got", eligibility.evidence_issue(*map(F.col, names))).collect() if r.got != r.want]
    years = spark.createDataFrame([(1, "a_baseline_year", 2020), (1, "a_target_year", 2020), (1, "b_baseline_year", 2020), (1, "b_target_year", 2021), (2, "a_target_year", 2000), (2, "a_baseline_year", None)], "k int, name string, value int")
    assert [tuple(r) for r in eligibility.years_out_of_order(years, ["k"], "name", "value").collect()] == [(1, "a")]
    told = spark.createDataFrame([(1, 3, "x"), (1, 1, "y"), (1, 2, "x"), (1, 4, "y"), (2, 1, None)], "k int, at int, w string")
    assert sorted(map(tuple, eligibility.warnings_once(told, ["k"], "at", "w").collect())) == [(1, 1, "y"), (1, 2, "x")]


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("a", True, 1.5), ("b", None, float("nan")), ("c", False, None)], "id string, flag boolean, v double")
    assert sorted(map(tuple, exports.flat_features(rows, ["id"], ["v", "flag"]).collect())) == [("a", "1.5", "1"), ("b", "", ""), ("c", "", "0")]
    none = exports.repair_summary(spark.createDataFrame([], "issue string"), "2024-01-01").first()
    assert (none.audit_cutoff, none.row_count, none.issue_counts) == ("2024-01-01", 0, {})
    reference = spark.createDataFrame([("a", "A", "s"), ("b", "B", None)], "id string, name string, sector string")
    results = spark.createDataFrame([("a", None, 5)], "id string, name string, n int")
    got = {r.id: json.loads(r.document) for r in exports.company_results(reference, results, "id", "name").collect()}
    assert got == {"a": {"company": {"id": "a", "name": "A", "sector": "s"}, "result": {"status": "extracted", "n": 5}}, "b": {"company": {"id": "b", "name": "B"}, "result": {"status": "not_extracted"}}}
    for odd in ([("a", None, 1), ("a", None, 2)], [("z", None, 1)]):
        with pytest.raises(ExpectationError):
            exports.company_results(reference, spark.createDataFrame(odd, "id string, name string, n int"), "id", "name")
