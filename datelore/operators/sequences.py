"""Blocks in the lines of documents: fixed headers in a row and as many values behind them, found by a finite automaton that reads each line once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The headers of a block of headline scores, each on a line, before as many lines of values.
HEADERS = ("Company", "Industry", "CSA Score", "ESG Score", "Score Under Review", "Last Updated")
#: What a page says where its scores are not public, and of a company's part in the assessment, in small letters.
NOT_PUBLIC = "available via our premium channels"
TAKES_PART = "this company is a corporate sustainability assessment (csa) survey respondent."
TAKES_NO_PART = ("this company's esg score is based on publicly available information", "not based on the company's active participation")


def lines_of(text: Column) -> Column:
    """The lines of a text with blanks in one form, without empty ones; of null none."""
    flat = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(flat, lambda x: x != "")


def blocks_of(lines: Column, headers: tuple[str, ...]) -> Column:
    """All blocks in an array of lines: arrays of the lines behind the headers, as many as these, or fewer where the lines end.

    The automaton's state is how many headers in a row the last lines matched; a line that breaks the row may be the first header of another. Headers are different from each
    other, so no other restart is possible. A match's values may hold the headers of another block, which is then found too.
    """
    n = len(headers)
    line = lambda k: F.get(lines, k)
    expected = F.array(*map(F.lit, headers))
    start = F.struct(F.lit(0).alias("met"), F.array().cast("array<int>").alias("ends"))

    def step(state: Column, k: Column) -> Column:
        met = F.when(line(k) == F.get(expected, state["met"]), state["met"] + 1).when(line(k) == headers[0], 1).otherwise(0)
        return F.struct(F.when(met == n, 0).otherwise(met).alias("met"), F.when(met == n, F.concat(state["ends"], F.array(k))).otherwise(state["ends"]).alias("ends"))

    places = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda state: F.transform(state["ends"], lambda k: F.slice(lines, k + 2, F.lit(n))))


def headline_scores(documents: DataFrame, text: str) -> DataFrame:
    """documents with scores: (status, company, industry, csa_score, esg_score, under_review, updated, takes_part).

    A block whose scores are whole numbers and whose date reads as "Month d, yyyy" is complete. Status is available where all complete blocks are the same; conflicting,
    where they differ; out_of_range, where a score is not of 0 to 100 or the review neither yes nor no; not_public, where there is none, the page says so, and a header
    row is followed by a company and an industry; else no_block. takes_part is null where the page says neither. Lines are read where they lie, once.
    """
    whole = lambda x: F.when(F.trim(x).rlike("^[+-]?[0-9]+$"), F.trim(x).try_cast("int"))
    day = lambda x: F.when(x.rlike("^[A-Za-z]+ [0-9]{1,2}, [0-9]{4}$"), F.try_to_timestamp(F.initcap(x), F.lit("MMMM d, yyyy")).cast("date"))
    at = lambda b, k: F.get(b, F.lit(k))
    fields = lambda b: F.struct(
        at(b, 0).alias("company"), at(b, 1).alias("industry"), whole(at(b, 2)).alias("csa_score"), whole(at(b, 3)).alias("esg_score"), F.upper(at(b, 4)).alias("review"), day(at(b, 5)).alias("updated")
    )
    told = documents.withColumn("_lines", lines_of(F.col(text)))
    told = told.withColumns({"_blocks": blocks_of(F.col("_lines"), HEADERS), "_said": F.lower(F.array_join("_lines", " ")), "_small": F.transform("_lines", F.lower)})
    full = F.filter(F.transform(F.filter("_blocks", lambda b: F.size(b) == len(HEADERS)), fields), lambda f: f.csa_score.isNotNull() & f.esg_score.isNotNull() & f.updated.isNotNull())
    told = told.withColumn("_full", full)
    good = lambda f: f.csa_score.between(0, 100) & f.esg_score.between(0, 100) & f.review.isin("YES", "NO")
    named = F.filter("_blocks", lambda b: F.size(b) >= 2)
    status = (
        F.when(F.exists("_full", lambda f: ~good(f)), "out_of_range").when(F.size(F.array_distinct("_full")) > 1, "conflicting").when(F.size("_full") > 0, "available")
        .when(F.contains("_said", F.lit(NOT_PUBLIC)) & (F.size(named) > 0), "not_public").otherwise("no_block")
    )
    one, other = F.get("_full", F.lit(0)), F.get(named, F.lit(0))
    takes = F.when(F.exists("_small", lambda x: F.startswith(x, F.lit(TAKES_PART))), True).when(
        F.exists("_small", lambda x: F.startswith(x, F.lit(TAKES_NO_PART[0])) & F.contains(x, F.lit(TAKES_NO_PART[1]))), False
    )
    told = told.withColumn("_status", status)
    public, closed = F.col("_status") == "available", F.col("_status") == "not_public"
    scores = F.struct(
        F.col("_status").alias("status"), F.when(public, one.company).when(closed, at(other, 0)).alias("company"), F.when(public, one.industry).when(closed, at(other, 1)).alias("industry"),
        F.when(public, one.csa_score).alias("csa_score"), F.when(public, one.esg_score).alias("esg_score"), F.when(public, one.review == "YES").alias("under_review"), F.when(public, one.updated).alias("updated"), takes.alias("takes_part"),
    )
    return told.withColumn("scores", scores).drop("_lines", "_blocks", "_said", "_small", "_full", "_status")
