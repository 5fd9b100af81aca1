"""A training run against models that are refitted one by one."""

import random

import pytest
from pyspark.sql import functions as F

from datelore.operators import gram, models, splits, training

FEATURES = {"a": "core", "b": "core", "c": "climate", "d": "financial"}
SEARCH = {"bins": [3, 5], "ridge": [0.1, 2.0]}


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(4), []
    for k in range(240):
        a, b, c, d = rng.gauss(0, 1), rng.choice([0.0, 1.0, 2.0]), rng.random(), rng.gauss(5, 2)
        y = 3 * a - b + (5 if c > 0.7 else 0) + rng.gauss(0, 0.3)
        miss = lambda x: None if rng.random() < 0.1 else float("nan") if rng.random() < 0.02 else x
        out.append((k, miss(a), miss(b), miss(c), miss(d), None if k % 37 == 0 else y, ["x", "y", "z", "test"][rng.randrange(4)]))
    return spark.createDataFrame(out, "k long, a double, b double, c double, d double, y double, fold string").cache()


def test_every_set_fold_and_setting_equals_its_refit(rows):
    known = rows.where("y is not null and fold <> 'test'")
    sides = ["x", "y", "z", gram.ALL]
    cuts = gram.side_cuts(known, list(FEATURES), "fold", sides, [3, 5])
    found = gram.side_sums(rows.where("fold <> 'test'"), list(FEATURES), "y", "fold", cuts)
    for side in sides:
        for b in (3, 5):
            of = known.where(F.col("fold") != side)
            for chosen, ridge in ((["a", "b"], 0.1), (["a", "b", "c", "d"], 2.0)):
                terms, intercept = found[side, b].fit(chosen, ridge)
                want, base = models.fit_additive(of, chosen, "y", b, ridge, {f: cuts[side, b][f] for f in chosen})
                got = {(r.feature_name, r.bin): r.term for r in want.collect()}
                assert intercept == pytest.approx(base, abs=1e-6)
                assert {(f, k): pytest.approx(v, abs=1e-6) for f, t in terms.items() for k, v in enumerate(t)} == got
            assert found[side, b].support("a") == of.where("a is not null and not isnan(a)").count()


def test_run_equals_a_loop_of_fits(rows):
    run = training.train(rows, "k", FEATURES, "y", "fold", SEARCH)
    known = rows.where("y is not null and fold <> 'test'")
    cuts = gram.side_cuts(known, list(FEATURES), "fold", ["x", "y", "z", gram.ALL], [3, 5])
    want = {}
    for name, allowed in training.FEATURE_SETS.items():
        chosen = [f for f, c in FEATURES.items() if c in allowed]
        for config, p in training.grid("additive", SEARCH):
            errors = []
            for held in ("x", "y", "z"):
                terms, base = models.fit_additive(known.where(F.col("fold") != held), chosen, "y", p["bins"], p["ridge"], {f: cuts[held, p["bins"]][f] for f in chosen})
                of = known.where(F.col("fold") == held)
                got = of.select("k", "y").join(models.score_additive(of.unpivot("k", chosen, "feature_name", "value"), ["k"], terms, base), "k")
                errors.append(splits.errors(got, [], "y", "score").first()["mae"])
            want[name, config] = sum(errors) / 3
    assert {v[0]: (v[1], v[2]) for v in run.validation} == {name: min(((c, pytest.approx(m, abs=1e-5)) for (n, c), m in want.items() if n == name), key=lambda x: x[1].expected) for name in training.FEATURE_SETS}
    assert run.status == "trained" and run.feature_set in ("core_plus_climate", "core_plus_both")
    assert run.test.count() == rows.where("y is not null and fold = 'test'").count() and run.held_out.count() == 16 * known.count()


def test_number_of_jobs_does_not_grow_with_the_search(spark, rows):
    def jobs(categories):
        spark.sparkContext.setJobGroup(f"run {len(categories)}", "")
        training.train(rows, "k", categories, "y", "fold", SEARCH)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"run {len(categories)}"))

    assert jobs(FEATURES) == jobs({"a": "core", "b": "core"}) <= 14
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_runs_are_blocked_masked_and_reused(rows, tmp_path):
    assert training.train(rows.limit(0), "k", FEATURES, "y", "fold", SEARCH).status == "blocked"
    rare = rows.withColumn("d", F.when(F.col("k") < 5, F.col("d")))
    assert dict((v[0], v[2]) for v in training.train(rare, "k", FEATURES, "y", "fold", SEARCH, least_support=10).validation)["core_plus_financial"] == dict((v[0], v[2]) for v in training.train(rare, "k", FEATURES, "y", "fold", SEARCH, least_support=10).validation)["core"]
    first = training.train(rows, "k", FEATURES, "y", "fold", SEARCH, store=str(tmp_path))
    again = training.train(rows.repartition(3), "k", FEATURES, "y", "fold", SEARCH, store=str(tmp_path))
    assert (first.status, again.status, again.run_id) == ("trained", "reused", first.run_id)
    assert (again.feature_set, again.configuration, again.validation) == (first.feature_set, first.configuration, first.validation)
    assert sorted(map(tuple, again.test.collect())) == sorted(map(tuple, first.test.collect()))
    other = training.train(rows.withColumn("a", F.col("a") + 1), "k", FEATURES, "y", "fold", SEARCH, store=str(tmp_path))
    assert other.status == "trained" and other.run_id != first.run_id
