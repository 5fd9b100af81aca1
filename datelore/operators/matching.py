"""Matching of records by name and id, coverage of a universe, and guards that keep ambiguity visible."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def match_unique(left: DataFrame, right: DataFrame, left_id: str, right_id: str, name: str, overrides: DataFrame | None = None) -> DataFrame:
    """(left_id, right_id, outcome) of every left row.

    An override (left_id, right_id) wins: matched_by_override, or override_missing where its right row does not exist. Else a name that is unique on both
    sides matches; one that several rows bear is ambiguous; others are unmatched. Null names match nothing.
    """
    counted = lambda df, key: df.groupBy(name).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias(key))
    mine, theirs = counted(left, left_id).select(name, F.col("_n").alias("_mine")), counted(right, right_id).select(name, F.col("_n").alias("_theirs"), right_id)
    both = left.select(left_id, name).join(mine, name, "left").join(theirs, name, "left")
    by_name = F.when(F.col(name).isNull() | F.col("_theirs").isNull(), "unmatched").when((F.col("_mine") > 1) | (F.col("_theirs") > 1), "ambiguous").otherwise("matched")
    if overrides is None:
        return both.withColumn("outcome", by_name).select(left_id, F.when(F.col("outcome") == "matched", F.col(right_id)).alias(right_id), "outcome")
    named = overrides.select(F.col(left_id), F.col(right_id).alias("_override")).join(right.select(F.col(right_id).alias("_exists")).distinct(), F.col("_override") == F.col("_exists"), "left")
    out = both.join(named, left_id, "left").withColumn(
        "outcome", F.when(F.col("_override").isNull(), by_name).when(F.col("_exists").isNull(), "override_missing").otherwise("matched_by_override")
    )
    chosen = F.when(F.col("outcome") == "matched_by_override", F.col("_exists")).when(F.col("outcome") == "matched", F.col(right_id))
    return out.select(left_id, chosen.alias(right_id), "outcome")


def agreed_class(members: DataFrame, reference: DataFrame, key: str, member: str, attribute: str) -> DataFrame:
    """(key, attribute, status) of keys with several members: the class on which all known members agree; ambiguous or missing otherwise."""
    found = members.select(key, member).join(reference.select(member, attribute), member, "left")
    low, high = F.min(attribute), F.max(attribute)
    return found.groupBy(key).agg(F.when(low == high, low).alias(attribute), F.when(low.isNull(), "missing").when(low != high, "ambiguous").otherwise("agreed").alias("status"), F.count(F.lit(1)).alias("n_members"))


def coverage_of(universe: DataFrame, verified: DataFrame, key: str, other: str) -> DataFrame:
    """Every key of both sides with its status: covered, missing, reused_id (its id stands for several keys) or outside_universe."""
    ids = verified.select(key, other).withColumn("_uses", F.count(F.lit(1)).over(Window.partitionBy(other)))
    both = universe.select(key, F.lit(True).alias("_in")).join(ids, key, "full_outer")
    status = F.when(F.col("_in").isNull(), "outside_universe").when(F.col(other).isNull(), "missing").when(F.col("_uses") > 1, "reused_id").otherwise("covered")
    return both.select(key, other, status.alias("status"))


def meets_all(long: DataFrame, key: str, ranges: list[tuple[str, float, float]]) -> DataFrame:
    """Keys whose values lie within every range (feature, low, high): one pass and one aggregate for all ranges, no join for each."""
    table = F.broadcast(long.sparkSession.createDataFrame(ranges, "feature_name string, _low double, _high double"))  # a fixed list
    hits = long.join(table, "feature_name").where(F.col("value").between(F.col("_low"), F.col("_high")))
    return hits.groupBy(key).agg(F.countDistinct("feature_name").alias("_n")).where(F.col("_n") == len({r[0] for r in ranges})).select(key)


def latest_by_either_key(sources: DataFrame, documents: DataFrame, key: str, keys: list[str], order: list[str]) -> DataFrame:
    """sources with the newest document that any of several keys joins: a union of equi-joins, where an OR would compare all with all.

    Each key's newest document is found before it is joined, so a key of many sources and documents makes one row for each source, no pair of both.
    """
    newest = F.struct(*order, "document_id")
    joined = None
    for k in keys:
        of_key = documents.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("_doc_key")).agg(F.max(newest).alias("_newest"))
        one = sources.select(F.col(key).alias("_source"), F.col(k).alias("_key")).join(of_key, F.col("_key") == F.col("_doc_key")).select("_source", "_newest")
        joined = one if joined is None else joined.unionByName(one)
    last = joined.groupBy("_source").agg(F.max("_newest").alias("_newest")).select("_source", "_newest.document_id")
    return sources.join(last, F.col(key) == F.col("_source"), "left").drop("_source")


def resolve(requested: DataFrame, companies: DataFrame, given: str, id_col: str, ticker: str) -> DataFrame:
    """(given, id, n_matches): the company that an id or a ticker names; null unless exactly one does."""
    wanted = requested.select(given).distinct()
    hits = wanted.join(companies.select(F.col(id_col), F.col(id_col).alias("_k")), F.col(given) == F.col("_k")).select(given, id_col)
    hits = hits.unionByName(wanted.join(companies.select(F.col(id_col), F.col(ticker).alias("_k")), F.upper(given) == F.upper("_k")).select(given, id_col)).distinct()
    found = hits.groupBy(given).agg(F.count(F.lit(1)).alias("n_matches"), F.min(id_col).alias("_id"))
    return wanted.join(found, given, "left").select(given, F.when(F.col("n_matches") == 1, F.col("_id")).alias(id_col), F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


def child_counts(parents: DataFrame, children: dict[str, DataFrame], key: str) -> DataFrame:
    """parents with the number of rows of each child table, each counted before it is joined."""
    out = parents
    for name, child in children.items():
        out = out.join(child.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def missing_from(universe: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    return universe.select(*keys).join(found.select(*keys), keys, "left_anti")
