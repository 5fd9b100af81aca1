"""Grids, headline blocks, climate targets and grounded numbers: rules one at a time, and restatements over random cases."""

import random

import pytest
from pyspark.sql import functions as F

from datelore.operators import grids, grounding, sequences, targets


def grid(spark, html):
    cells = grids.html_grids(spark.createDataFrame([(1, html)], "k int, html string"), "k", "html").collect()
    out = {}
    for c in cells:
        out.setdefault(c.table, {})[c.row, c.column] = c.text
    return out


def test_grids_of_spans_groups_and_inner_tables(spark):
    assert grid(spark, "<table><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>")[0] == {(0, 0): "a", (1, 0): "a", (0, 1): "b", (1, 1): "c", (2, 0): "d", (2, 1): "e"}
    assert grid(spark, "<table><tr><td rowspan=9>a<td>b</table>")[0] == {(0, 0): "a", (0, 1): "b"}
    assert grid(spark, "<table><tr><td>a<td rowspan=2>b<td>c<tr><td colspan=1>d<td>e</table>")[0] == {(0, 0): "a", (0, 1): "b", (0, 2): "c", (1, 0): "d", (1, 1): "b", (1, 2): "e"}
    nested = grid(spark, "<table><tr><td>x<table><tr><td>in</table>y<td>z</table>")
    assert nested == {0: {(0, 0): "xiny", (0, 1): "z"}, 1: {(0, 0): "in"}}
    assert grid(spark, "<table><td>a<td colspan=x>b<td rowspan='-1'>c<br>d</td>lost</table><td>lost")[0] == {(0, 0): "a", (0, 1): "b", (0, 2): "c d"}
    assert grid(spark, None) == {} and grid(spark, "") == {} and grid(spark, "<table></table>") == {}


@pytest.mark.parametrize("seed", range(5))
def test_grid_against_a_field_of_places(spark, seed):
    """Random tables, laid out on a field where each cell takes the first free place of its row."""
    rng, field, html = random.Random(seed), {}, "<table>"
    n_rows = 5
    for r in range(n_rows):
        html += "<tr>"
        for c in range(rng.randint(0, 4)):
            down, across = rng.choice([1, 1, 2, 3, 0]), rng.choice([1, 1, 2])
            at = next(x for x in range(100) if (r, x) not in field)
            for y in range(r, n_rows if down == 0 else min(r + down, n_rows)):
                for x in range(at, at + across):
                    if y == r and (y, x) in field:
                        break
                    field.setdefault((y, x), f"{r}.{c}")
            html += f"<td rowspan={down} colspan={across}>{r}.{c}</td>"
        html += "</tr>"
    found = grid(spark, html + "</table>").get(0, {})
    assert set(field) <= set(found)
    first = {}
    for (y, x), text in sorted(found.items()):
        first.setdefault(text, (y, x))
    want = {}
    for (y, x), text in sorted(field.items()):
        want.setdefault(text, (y, x))
    overlapping = len(found) != len(field)
    assert overlapping or first == want


def test_every_issue_of_a_listing(spark):
    head = "<table><tr><th>S<th>N"
    pages = {
        "good": head + "<tr><td>1<td>a<tr><td>2<td>b", "missing_header,missing_value": "<table><tr><th>S<th>M<tr><td>1<td>a", "repeated_header": "<table><tr><th>S<th>N<th>N<tr><td>1<td>a<td>b", "ragged_rows": head + "<tr><td>1<td>a<td>b",
        "missing_value": head + "<tr><td>1<td> ", "wrong_identifier": head + "<tr><td>x<td>a", "repeated_identifier": head + "<tr><td>1<td>a<tr><td>1<td>b", "no_rows": head,
    }
    frame = spark.createDataFrame(list(pages.items()), "k string, html string")
    records, issues = grids.read_records(grids.html_grids(frame, "k", "html"), ["k", "table"], {"symbol": "S", "name": "N"}, "symbol", "[0-9]+")
    assert {r.k: ",".join(r.issues) for r in issues.collect()} == {k: "" if k == "good" else k for k in pages}
    assert sorted((r.k, r.row, r.symbol, r.name) for r in records.collect()) == [("good", 1, "1", "a"), ("good", 2, "2", "b")]


@pytest.mark.parametrize("seed", range(4))
def test_blocks_of_lines_against_every_window(spark, seed):
    rng, texts = random.Random(seed), []
    headers = ("A", "B", "C")
    for _ in range(40):
        texts.append([rng.choice("ABCABCx") for _ in range(rng.randint(0, 30))])
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t array<string>")
    got = {r.k: r.b for r in frame.select("k", sequences.blocks_of(F.col("t"), headers).alias("b")).collect()}
    assert got == {k: [t[i + 3 : i + 6] for i in range(len(t) - 2) if tuple(t[i : i + 3]) == headers] for k, t in enumerate(texts)}


def test_headline_scores(spark):
    head = "\n".join(sequences.HEADERS)
    block = lambda a, b, review="Yes", day="January 31, 2024": f"{head}\nFirm\nMetals\n{a}\n{b}\n{review}\n{day}\n"
    cases = {
        block(5, 100): "available", block(5, 6) + "x\n" + block(5, 6): "available", block(5, 6) + block(5, 7): "conflicting", block(5, 101): "out_of_range", block(5, 6, "maybe"): "out_of_range", block("n/a", 6): "no_block",
        block(5, 6, day="soon"): "no_block", block(5, 6).replace("Industry\n", "Industry\n\n \n", 1): "available", block(5, 6).replace("Industry\n", "Industry\nmore\n", 1): "no_block", block(5, 6)[:-30]: "no_block",
        f"{head}\nFirm\nMetals\nAvailable via our Premium\tChannels": "not_public", "Available via our premium channels": "no_block", None: "no_block", "": "no_block",
    }
    frame = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.scores for r in sequences.headline_scores(frame, "t").collect()}
    assert {t: s.status for t, s in got.items()} == cases
    first = got[block(5, 100)]
    assert (first.company, first.industry, first.csa_score, first.esg_score, first.under_review, str(first.updated), first.takes_part) == ("Firm", "Metals", 5, 100, True, "2024-01-31", None)


GOOD = "reduce absolute scope 1 and 2 emissions by 5, from 2019, progress"
FAMILY = "scope_1_2_absolute_reduction"


def climate(spark, rows):
    columns = "family string, name string, value double, quote string, context string, reporting_year int"
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + columns)
    return {r.k: r.issue for r in targets.targets_checked(frame, ["k"]).collect()}


def test_every_family_rule_alone(spark):
    cases = [
        (FAMILY, GOOD, None), (FAMILY, "absolute scope 1 and 2 and scope 3 reduction", "several_scopes"), ("scope_1_2_3_absolute_reduction", "absolute scope 1 reduction", "not_scope_1_2_3"), (FAMILY, "absolute scope 1 reduction", "not_scope_1_2"),
        ("scope_1_absolute_reduction", "absolute scope 1 and 2 reduction", "not_scope_1_alone"), ("scope_1_absolute_reduction", "absolute scope 1 reduction", None), ("scope_2_absolute_reduction", "absolute scope 1, scope 2 reduction", "not_scope_2_alone"),
        ("scope_2_absolute_reduction", "absolute scope 2 reduction", None), ("scope_3_absolute_reduction", "absolute reduction", "not_scope_3"), ("scope_3_absolute_reduction", "absolute scope 3 reduction of selected categories", "part_of_scope_3"),
        ("scope_3_absolute_reduction", "reduction of Scope 3 GHG", None), (FAMILY, "scope 1 and 2 reduction of intensity", "not_absolute"), (FAMILY, "scope 1 and 2 reduction", "not_absolute"), ("scope_1_2_intensity_reduction", "scope 1 & 2 absolute reduction", "not_intensity"),
        ("scope_1_2_intensity_reduction", "scope 1 + scope 2 reduction per unit", None), ("net_zero", "carbon neutral reduction", "not_net_zero"), ("net_zero", "Net-Zero reduction", None), ("carbon_neutrality", "net zero reduction", "not_carbon_neutral"),
        ("carbon_neutrality", "carbon neutrality reduction", None), ("renewable_electricity", "carbon-free electricity reduction", "not_renewable_electricity"), ("supplier_engagement", "reduction", "no_supplier"), ("supplier_engagement", "reduction of suppliers", None),
        (FAMILY, GOOD + ", expired", "target_is_over"), (FAMILY, GOOD + ", goal achieved", "target_is_over"), (FAMILY, GOOD + " site-level", "local_target"), (FAMILY, GOOD + " of selected facilities", "local_target"), (FAMILY, GOOD + " sites target", "local_target"),
        (FAMILY, GOOD + " country specific, company-wide", None),
    ]
    got = climate(spark, [(f, "reduction_pct", 5.0, q, None, 2024) for f, q, _ in cases])
    assert {k: (cases[k][1], i) for k, i in got.items()} == {k: (q, i) for k, (_, q, i) in enumerate(cases)}


def test_every_attribute_and_field_rule_alone(spark):
    both = "absolute scope 1 and 2 "
    cases = [
        (FAMILY, "baseline_year", both + "emissions", "no_baseline"), (FAMILY, "baseline_year", both + "from 2019", None), (FAMILY, "reduction_pct", both + "cut", "no_reduction"), (FAMILY, "progress_pct", both + "cut", "no_progress"),
        (FAMILY, "progress_pct", both + "to date", None), (FAMILY, "target_year", both, None), (None, "scope_1_tco2e", "Scope 1 and 2", "not_scope_1_alone"), (None, "scope_1_tco2e", "Scope 1", None), (None, "scope_2_market_tco2e", "scope 2", "not_scope_2_market"),
        (None, "scope_2_market_tco2e", "scope 2 market-based", None), (None, "scope_2_location_tco2e", "scope 2 market", "not_scope_2_location"), (None, "scope_3_tco2e", "scope 2", "not_scope_3"), (None, "scope_1_2_change_pct", "scope 1", "not_scope_1_2"),
        (None, "scope_3_change_pct", "scope 3 per unit", "not_scope_3_change"), (None, "ghg_intensity_change_pct", "intensity", "not_intensity_change"), (None, "ghg_intensity_change_pct", "CO2e per unit", None), (None, "renewable_electricity_pct", "renewable energy", "not_renewable_electricity"),
        (None, "net_zero_target_year", "carbon neutral", "not_net_zero"), (None, "net_zero_target_year", "net zero, superseded", "target_is_over"), (None, "net_zero_target_year", "net zero region target", "local_target"), (None, "sbti_validated", "SBTi", "not_validated"),
        (None, "sbti_validated", "approved by the Science-Based Targets initiative", None), (None, "ghg_inventory_assured", "assurance", "not_assured"), (None, "ghg_inventory_assured", "verified inventory", None), (None, "other", "nothing", None), (None, "scope_1_tco2e", None, "not_scope_1_alone"),
    ]
    got = climate(spark, [(f, n, 2030.0, q, None, 2024) for f, n, q, _ in cases])
    assert {k: (cases[k][1], i) for k, i in got.items()} == {k: (n, i) for k, (_, n, _, i) in enumerate(cases)}
    assert climate(spark, [(None, "net_zero_target_year", 2024.0, "net zero", None, 2024), (None, "scope_1_tco2e", None, "x", None, 2024)]) == {0: "target_year_not_after_report", 1: None}


def test_one_bad_member_clears_its_family(spark):
    columns = "k int, family string, name string, value double, quote string, context string, reporting_year int"
    rows = [
        (1, FAMILY, "target_year", 2030.0, "by 2030", None, 2024), (1, FAMILY, "reduction_pct", 5.0, GOOD, None, 2024), (1, FAMILY, "baseline_year", 2019.0, "a baseline", None, 2024),  # rest on the family's text
        (2, FAMILY, "target_year", 2024.0, GOOD, None, 2024), (2, FAMILY, "reduction_pct", 5.0, GOOD, None, 2024), (3, FAMILY, "reduction_pct", 5.0, GOOD, None, 2024), (3, FAMILY, "progress_pct", 5.0, GOOD + " withdrawn", None, 2024),
        (3, "net_zero", "target_year", 2030.0, "net zero", None, 2024), (4, FAMILY, "reduction_pct", 5.0, "short", GOOD, 2024), (5, FAMILY, "target_year", 2030.0, "by 2030", None, 2024),
    ]
    got = {(r.k, r.family, r.name): (r.value, r.issue) for r in targets.targets_checked(spark.createDataFrame(rows, columns), ["k"]).collect()}
    late, over = (None, "target_year_not_after_report"), (None, "target_is_over")
    assert got == {
        (1, FAMILY, "target_year"): (2030.0, None), (1, FAMILY, "reduction_pct"): (5.0, None), (1, FAMILY, "baseline_year"): (2019.0, None), (2, FAMILY, "target_year"): late, (2, FAMILY, "reduction_pct"): late,
        (3, FAMILY, "reduction_pct"): over, (3, FAMILY, "progress_pct"): over, (3, "net_zero", "target_year"): (2030.0, None), (4, FAMILY, "reduction_pct"): (5.0, None), (5, FAMILY, "target_year"): (None, "not_scope_1_2"),
    }


def test_index_of_numbers(spark):
    text = "Sales 1,234.50 and (1,234.5) v1.2.3 a5 5kg 5.\n\n5 | -5, 1,5"
    rows = grounding.number_index(spark.createDataFrame([(1, text), (2, None), (3, "none")], "d int, t string"), ["d"], "t").collect()
    got = sorted((r.line_no, r.offset, r.token.rstrip(","), float(r["size"])) for r in rows)
    assert got == [(1, 6, "1,234.50", 1234.5), (1, 20, "1,234.5", 1234.5), (1, 39, "5", 5.0), (1, 43, "5", 5.0), (3, 0, "5", 5.0), (3, 5, "5", 5.0), (3, 8, "1,5", 15.0)]
    assert all(text.split("\n")[r.line_no - 1][r.offset :].startswith(r.token) for r in rows)


def test_every_reason_of_a_metric(spark):
    index = grounding.number_index(spark.createDataFrame([("b", "Use 1,200 t\nLoss (7) and 8 8")], "block string, t string"), ["block"], "t")
    cases = [
        ("x", "t", 1.2e6, "1,200", 1e3, False, None), ("x", "t", -7.0, "(7)", 1.0, False, None), ("x", "t", 7.0, "(7)", 1.0, False, "raw_value_and_scale_disagree"), ("x", "t", 8.0, "8", 1.0, False, "number_stands_twice"), ("x", "t", 9.0, "9", 1.0, False, "number_not_in_block"),
        ("x", "t", 9.0, "nine", 1.0, False, "raw_value_is_no_number"), ("x", "t", None, None, None, False, None), ("x", " Year", 1200.0, "1200", 1.0, True, "target_is_a_year"), ("x", "t", None, "1200", 1.0, True, "target_without_quantity"),
        ("x", "t", 1200.0, "1200", 0.0, True, "target_without_quantity"), ("net_zero", "t", 0.0, "0", 1.0, True, "commitment_as_zero"), ("x", "t", 5.0, "five", 1.0, True, "target_without_number"), ("x", "t", 1200.0, "1200", 1.0, True, None),
    ]
    frame = spark.createDataFrame([("b", k, *c) for k, c in enumerate(cases)], "block string, k int, name string, unit string, value double, raw_value string, scale double, is_target boolean, want string")
    got = {r.k: r for r in grounding.metrics_grounded(frame, index, ["block"]).collect()}
    assert {k: r.reason for k, r in got.items()} == {k: c[-1] for k, c in enumerate(cases)}
    assert (got[0].line, got[0].line_no, got[0].offset, got[1].line_no, got[3].line) == ("Use 1,200 t", 1, 4, 2, None)


def test_records_need_each_figure_once_and_their_citations(spark):
    blocks = spark.createDataFrame([(r, b, t) for r in range(9) for b, t in (("a", "1,000"), ("b", "20"), ("c", "3"), ("d", "7 and 8"))], "r int, block_id string, t string")
    index = grounding.number_index(blocks, ["r", "block_id"], "t")
    names = ("revenue", "total_debt")
    fine = ("revenue", "reported", 1e6, 1e3, ["a"])
    cases = [
        ([fine, ("total_debt", "calculated", 1020.0, 1.0, ["a", "b"])], []), ([fine, ("total_debt", "calculated", 1023.0, 1.0, ["a", "b", "c"])], []), ([fine, ("total_debt", "calculated", 1020.0, 1.0, ["a", "b", "c"])], ["total_debt: sum"]),
        ([fine, ("total_debt", "calculated", 28.0, 1.0, ["b", "d"])], []), ([fine, ("total_debt", "calculated", 20.0, 1.0, ["b"])], ["total_debt: citation"]), ([fine, fine, ("total_debt", "none", None, None, [])], ["revenue: repeated"]),
        ([("revenue", "calculated", 1020.0, 1.0, ["a", "b"]), ("total_debt", "none", None, None, None)], ["revenue: calculated"]), ([("revenue", "reported", 1001.0, 1.0, ["a"])], ["revenue: printed", "total_debt: missing"]),
        ([fine, ("total_debt", "none", 5.0, 1.0, []), ("other", "none", None, None, [])], ["other: unknown", "total_debt: citation"]),
    ]
    frame = spark.createDataFrame([(r, *m) for r, (ms, _) in enumerate(cases) for m in ms], "r int, name string, status string, value double, scale double, citations array<string>")
    got = {r.r: r.issues for r in grounding.records_checked(frame, index, ["r"], names).collect()}
    assert got == {r: want for r, (_, want) in enumerate(cases)}


def test_a_record_meets_its_numbers_once(spark):
    blocks = spark.createDataFrame([(1, "a", "2 5"), (1, "b", "3"), (1, "c", "4 4")], "r int, block_id string, t string")
    index = grounding.number_index(blocks, ["r", "block_id"], "t")
    made = [(1, "total_debt", "calculated", v, 1.0, c) for v, c in ((9.0, ["c", "a", "b"]), (5.0, ["a", "b"]), (5.0, ["a", "a"]), (9.0, ["a", "b", None]))] + [(2, "total_debt", "calculated", 1.0, 1.0, ["a", "b"])]
    frame = spark.createDataFrame(made, "r int, name string, status string, value double, scale double, citations array<string>")
    for k, wrong in enumerate([False, False, True, True]):
        one = frame.where("r = 1").where(F.hash("value", "citations") == F.hash(F.lit(made[k][3]), F.array(*[F.lit(c) for c in made[k][5]])))
        assert {r.issues == ["total_debt: sum"] for r in grounding.records_checked(one, index, ["r"], ("total_debt",)).collect()} == {wrong}
    found = grounding.records_checked(frame, index, ["r"], ("total_debt",))
    assert found.where("r = 2").first().issues == ["total_debt: sum"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
