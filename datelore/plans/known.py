"""Queries: as-of selection, quarantine, conflicts, coverage and ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.operators import asof, coverage
from datelore.plans import views

FEATURES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_KEYS = ["company_cik", "as_of"]


def _known(spark: SparkSession, sf_dir: str, fallback: bool = False) -> DataFrame:
    return asof.known_as_of(views.label_rows(spark, sf_dir), asof.judged(views.observations(spark, sf_dir), "usd", fallback))


def known_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known(spark, sf_dir).select(*_KEYS, "feature_name", "value", "status", "available", "basis", "reporting_year", "document_id")


def known_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known(spark, sf_dir, fallback=True).groupBy("as_of", "basis", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def quarantine_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = asof.candidates(views.label_rows(spark, sf_dir).select(*_KEYS), views.observations(spark, sf_dir))
    _, rejected = asof.select_as_of(found, _KEYS)
    return rejected.groupBy("as_of", "feature_name", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("document_id").alias("first_document"))


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = _known(spark, sf_dir)
    rows = views.label_rows(spark, sf_dir).select(*_KEYS, "cycle")
    matrix = coverage.wide(selected, _KEYS, FEATURES).withColumnsRenamed({f: f"f{f[0]}" for f in FEATURES})
    row_id = F.sha2(F.concat_ws("|", "company_cik", F.col("cycle").cast("string"), F.col("as_of").cast("string")), 256)
    return rows.join(matrix, _KEYS, "left").withColumn("row_id", row_id).drop("cycle")


def row_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = feature_matrix(spark, sf_dir)
    cells = coverage.long_cells(matrix, _KEYS, [f"f{f[0]}" for f in FEATURES])
    return coverage.coverage(cells, _KEYS, F.when(F.col("feature_name").isin("f1", "f2"), "urgent").otherwise("normal"))


def feature_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = feature_matrix(spark, sf_dir)
    cells = coverage.long_cells(matrix, _KEYS, [f"f{f[0]}" for f in FEATURES])
    return coverage.support(cells, ["as_of"], 20, 0.1, 5)


def previous_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.label_rows(spark, sf_dir)
    return asof.previous_scores(rows, rows).select(*_KEYS, "score", "previous_score")


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = _known(spark, sf_dir)
    found = asof.derived_ratios(selected, _KEYS, [("urgent_high", "1-URGENT", "2-HIGH"), ("low_medium", "5-LOW", "3-MEDIUM")])
    return found.select(*_KEYS, "feature_name", F.round("value", 6).alias("value"), "status", "reporting_year", "available", "basis")


def availability_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.basis_counts(views.observations(spark, sf_dir), "1999-06-30")


def repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.repair_list(views.observations(spark, sf_dir)).groupBy("feature_name", "issue").agg(F.count(F.lit(1)).alias("n"), F.max("document_id").alias("last_document"))


QUERIES = {
    "c01_known_by_date": known_by_date, "b06_known_with_fallback": known_with_fallback, "b07_quarantine_reasons": quarantine_reasons, "d01_feature_matrix": feature_matrix,
    "d02_row_coverage": row_coverage, "d08_feature_support": feature_support, "c15_previous_score": previous_score, "h24_ratios": ratios,
    "d07_availability_audit": availability_audit, "d10_repairs": repairs,
}


def _judged_sql(fallback: bool = False) -> str:
    date = "coalesce(publication_date, acquired_date)" if fallback else "publication_date"
    basis = f"CASE WHEN publication_date IS NOT NULL THEN '{asof.PUBLISHER}' WHEN {date} IS NOT NULL THEN '{asof.ACQUIRED}' ELSE '{asof.UNAVAILABLE}' END"
    return views.with_views("v_observation", "v_label") + f""",
j0 AS (SELECT l.as_of, o.*, {date} AS available, {basis} AS basis FROM v_label l JOIN v_observation o USING (company_cik)),
j AS (SELECT *, CASE WHEN available IS NULL THEN 'undated' WHEN available > as_of THEN 'after_cutoff' WHEN unit <> 'usd' THEN 'unit_mismatch' END AS reason FROM j0),
e AS (SELECT *, min(value) OVER g AS low, max(value) OVER g AS high FROM
      (SELECT *, rank() OVER (PARTITION BY company_cik, as_of, feature_name ORDER BY available DESC, reporting_year DESC) AS r FROM j WHERE reason IS NULL) WHERE r = 1
      WINDOW g AS (PARTITION BY company_cik, as_of, feature_name)),
s AS (SELECT company_cik, as_of, feature_name, CASE WHEN low = high THEN value END AS value,
      CASE WHEN low <> high THEN 'conflicting' WHEN value IS NULL THEN 'missing' ELSE 'observed' END AS status, available, basis, reporting_year, document_id
      FROM e QUALIFY row_number() OVER (PARTITION BY company_cik, as_of, feature_name ORDER BY document_id DESC) = 1)"""


_MATRIX = ", ".join(f"max(value) FILTER (feature_name = '{f}') AS f{f[0]}" for f in FEATURES)
_CELLS = _judged_sql() + f""",
m AS (SELECT l.company_cik, l.as_of, l.cycle, f1, f2, f3, f4, f5 FROM v_label l LEFT JOIN (SELECT company_cik, as_of, {_MATRIX} FROM s GROUP BY ALL) USING (company_cik, as_of)),
c AS (SELECT company_cik, as_of, 'f1' AS feature_name, f1 AS value FROM m UNION ALL SELECT company_cik, as_of, 'f2', f2 FROM m UNION ALL SELECT company_cik, as_of, 'f3', f3 FROM m
      UNION ALL SELECT company_cik, as_of, 'f4', f4 FROM m UNION ALL SELECT company_cik, as_of, 'f5', f5 FROM m)"""

ORACLE_SQL = {
    "c01_known_by_date": _judged_sql() + " SELECT * FROM s",
    "b06_known_with_fallback": _judged_sql(True) + " SELECT as_of, basis, status, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY ALL",
    "b07_quarantine_reasons": _judged_sql() + """, q AS (SELECT as_of, feature_name, reason, document_id FROM j WHERE reason IS NOT NULL
        UNION ALL SELECT as_of, feature_name, 'conflict', document_id FROM e WHERE low <> high)
        SELECT as_of, feature_name, reason, count(*) AS n, min(document_id) AS first_document FROM q GROUP BY ALL""",
    "d01_feature_matrix": _CELLS + " SELECT company_cik, as_of, f1, f2, f3, f4, f5, sha256(company_cik || '|' || cycle || '|' || strftime(as_of, '%Y-%m-%d')) AS row_id FROM m",
    "d02_row_coverage": _CELLS + """, k AS (SELECT *, CASE WHEN feature_name IN ('f1', 'f2') THEN 'urgent' ELSE 'normal' END AS category FROM c),
        a AS (SELECT company_cik, as_of, category, count(*) AS n_cells, count(value) AS n_values FROM k GROUP BY GROUPING SETS ((company_cik, as_of, category), (company_cik, as_of)))
        SELECT *, round(n_values / n_cells, 6) AS share, CASE WHEN n_values = 0 THEN 'none' WHEN n_values / n_cells < .33 THEN 'low' WHEN n_values / n_cells < .67 THEN 'medium' ELSE 'high' END AS level FROM a""",
    "d08_feature_support": _CELLS + """, a AS (SELECT as_of, feature_name, greatest(20, CAST(ceil(count(*) / 10) AS BIGINT)) AS bar, count(value) AS n_values, count(DISTINCT value) AS n_distinct, count(*) FILTER (value = 0) AS n_zero, count(*) FILTER (value IS NULL) AS n_missing FROM c GROUP BY ALL)
        SELECT * EXCLUDE (bar), concat_ws(',', CASE WHEN n_values < bar THEN 'observed_count_below_minimum' END, CASE WHEN n_distinct < 5 THEN 'distinct_values_below_minimum' END) AS reasons, n_values >= bar AND n_distinct >= 5 AS is_eligible FROM a""",
    "c15_previous_score": views.with_views("v_label") + """ SELECT company_cik, as_of, score, (SELECT max_by(p.score, p.published_date) FROM v_label p WHERE p.company_cik = v_label.company_cik AND p.published_date <= v_label.as_of) AS previous_score FROM v_label""",
    "h24_ratios": _judged_sql() + """, r(feature_name, nf, df) AS (VALUES ('urgent_high', '1-URGENT', '2-HIGH'), ('low_medium', '5-LOW', '3-MEDIUM')),
        n AS (SELECT company_cik, as_of, r.feature_name, value AS n, reporting_year AS ny, available AS na, basis AS nb FROM s JOIN r ON s.feature_name = nf),
        d AS (SELECT company_cik, as_of, r.feature_name, value AS d, reporting_year AS dy, available AS da, basis AS db FROM s JOIN r ON s.feature_name = df),
        b AS (SELECT *, CASE WHEN n IS NULL OR d IS NULL THEN 'missing_input' WHEN d <= 0 THEN 'denominator_not_positive' WHEN ny IS NULL OR ny IS DISTINCT FROM dy THEN 'different_years' ELSE 'derived' END AS status FROM n FULL JOIN d USING (company_cik, as_of, feature_name))
        SELECT company_cik, as_of, feature_name, CASE WHEN status = 'derived' THEN round(n / d, 6) END AS value, status, CASE WHEN status = 'derived' THEN ny END AS reporting_year, CASE WHEN status = 'derived' THEN greatest(na, da) END AS available, CASE WHEN status = 'derived' THEN nb END AS basis FROM b""",
    "d07_availability_audit": views.with_views("v_observation") + """ SELECT feature_name, count(*) FILTER (publication_date <= DATE '1999-06-30') AS n_publisher,
        count(*) FILTER (publication_date IS NULL AND acquired_date <= DATE '1999-06-30') AS n_acquired, count(*) FILTER (coalesce(publication_date, acquired_date) > DATE '1999-06-30') AS n_after_cutoff,
        count(*) FILTER (coalesce(publication_date, acquired_date) IS NULL) AS n_undated FROM v_observation GROUP BY 1""",
    "d10_repairs": views.with_views("v_observation") + """ SELECT feature_name, 'undated_value' AS issue, count(*) AS n, max(document_id) AS last_document FROM v_observation WHERE publication_date IS NULL GROUP BY 1""",
}

_DATES = {
    "c01_known_by_date": ("as_of", "available"), "b06_known_with_fallback": ("as_of",), "b07_quarantine_reasons": ("as_of",), "d01_feature_matrix": ("as_of",),
    "d02_row_coverage": ("as_of",), "d08_feature_support": ("as_of",), "c15_previous_score": ("as_of",), "h24_ratios": ("as_of", "available"),
}
ORACLE_SQL |= {name: views.dated(ORACLE_SQL[name], *columns) for name, columns in _DATES.items()}
