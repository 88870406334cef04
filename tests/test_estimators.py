import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import estimators
from panelloom.operators.estimators import Spec
from panelloom.plans import longrun, projections


def brute_force(data, x_names, max_lag=None, small_sample=False):
    """Dummy-variable least squares and a loop for the covariance, on rows of dicts."""
    rows = [r for r in data if all(r[c] is not None for c in ("y", *x_names))]
    entities = sorted({r["e"] for r in rows})
    y = np.array([r["y"] for r in rows])
    x = np.array([[r[c] for c in x_names] for r in rows])
    dummies = np.array([[float(r["e"] == e) for e in entities] for r in rows])
    coefs = np.linalg.lstsq(np.hstack([x, dummies]), y, rcond=None)[0]
    k = len(x_names)
    residual = y - np.hstack([x, dummies]) @ coefs
    within = x - dummies @ np.linalg.lstsq(dummies, x, rcond=None)[0]
    times = sorted({r["t"] for r in rows})
    scores = {t: np.zeros(k) for t in times}
    for r, w, u in zip(rows, within, residual):
        scores[r["t"]] = scores[r["t"]] + w * u
    lag = int(len(times) ** 0.25) if max_lag is None else max_lag
    omega = np.zeros((k, k))
    for t in times:
        for s in times:
            if abs(t - s) <= lag:
                omega += (1 - abs(t - s) / (lag + 1)) * np.outer(scores[t], scores[s])
    inverse = np.linalg.inv(within.T @ within)
    cov = inverse @ omega @ inverse
    n, periods = len(rows), len(times)
    if small_sample:
        cov *= periods / (periods - 1) * (n - 1) / (n - k)
    centred = y - dummies @ np.linalg.lstsq(dummies, y, rcond=None)[0]
    return coefs[:k], np.sqrt(np.diag(cov)), 1 - residual @ residual / (centred @ centred), n, cov


def simulated(n_entities=6, n_periods=20, seed=0, missing=True):
    rng = np.random.default_rng(seed)
    data = []
    for e in range(n_entities):
        for t in range(n_periods):
            x = rng.normal(size=3) + e
            y = 3 * e + 2 * x[0] - x[1] + 0.5 * x[2] + rng.normal()
            row = {"e": f"e{e}", "t": t + 100, "y": y, "x1": x[0], "x2": x[1], "x3": x[2]}
            if missing and rng.random() < 0.1:
                row[rng.choice(["y", "x1", "x3"])] = None
            data.append({k: v if v is None or isinstance(v, (str, int)) else float(v) for k, v in row.items()})
    return data


def frame(spark, data):
    schema = "e string, period_idx int, y double, x1 double, x2 double, x3 double"
    return spark.createDataFrame([(r["e"], r["t"], r["y"], r["x1"], r["x2"], r["x3"]) for r in data], schema)


def estimates(fits):
    got = estimators.coefficients(fits).orderBy("spec_id", "pos").collect()
    return {(r["spec_id"], r["term"]): r for r in got}


SPECS = [Spec("one", "y", ("x1",)), Spec("three", "y", ("x1", "x2", "x3")), Spec("swap", "x1", ("y",))]


@pytest.mark.parametrize("max_lag,small_sample", [(None, False), (0, False), (3, True)])
def test_matches_brute_force(spark, max_lag, small_sample):
    data = simulated()
    got = estimates(estimators.fit(frame(spark, data), SPECS[:2], ["e"], (), max_lag, small_sample))
    for spec in SPECS[:2]:
        beta, se, r2, n, _ = brute_force(data, spec.x, max_lag, small_sample)
        for j, term in enumerate(spec.x):
            row = got[(spec.name, term)]
            assert row["estimate"] == pytest.approx(beta[j], rel=1e-9)
            assert row["se"] == pytest.approx(se[j], rel=1e-9)
            assert row["r2"] == pytest.approx(r2, rel=1e-9)
            assert row["n_obs"] == n


def test_exact_fit(spark):
    data = [{"e": e, "t": t, "y": a + 2.0 * t, "x1": float(t), "x2": 0.0, "x3": 0.0} for e, a in (("a", 1.0), ("b", 50.0)) for t in range(4)]
    row = estimates(estimators.fit(frame(spark, data), SPECS[:1], ["e"]))[("one", "x1")]
    assert row["estimate"] == pytest.approx(2.0) and row["r2"] == pytest.approx(1.0)
    assert row["se"] == pytest.approx(0.0, abs=1e-7)


def test_fit_without_residual_is_null(spark):
    # Two entities and one regressor: three rows leave no residual, four do.
    data = simulated(n_entities=2, n_periods=2, seed=2, missing=False)
    for rows, known in ((data, True), (data[:3], False)):
        fitted = estimators.fit(frame(spark, rows), SPECS[:1], ["e"]).first()
        assert fitted["n_obs"] == len(rows) and fitted["n_entities"] == 2
        assert [fitted[c] is not None for c in ("beta", "cov", "aliased", "r2")] == [known] * 4
        row = estimates(estimators.fit(frame(spark, rows), SPECS[:1], ["e"]))[("one", "x1")]
        assert (row["estimate"] is not None, row["se"] is not None) == (known, known)


def test_batch_equals_one_by_one(spark):
    df = frame(spark, simulated(seed=3))
    batch = estimates(estimators.fit(df, SPECS, ["e"]))
    for spec in SPECS:
        for key, row in estimates(estimators.fit(df, [spec], ["e"])).items():
            assert row["estimate"] == pytest.approx(batch[key]["estimate"], rel=1e-12)
            assert row["se"] == pytest.approx(batch[key]["se"], rel=1e-9)


def test_row_order_and_partitioning_change_nothing(spark):
    df = frame(spark, simulated(seed=4))
    a = estimates(estimators.fit(df.coalesce(1), SPECS, ["e"]))
    b = estimates(estimators.fit(df.repartition(7).orderBy(F.rand(1)), SPECS, ["e"]))
    for key in a:
        assert a[key]["estimate"] == pytest.approx(b[key]["estimate"], rel=1e-10)
        assert a[key]["se"] == pytest.approx(b[key]["se"], rel=1e-9)


def test_keys_are_separate_problems(spark):
    first, second = simulated(seed=5), simulated(seed=6, n_periods=14)
    both = frame(spark, first).withColumn("m", F.lit(1)).unionByName(frame(spark, second).withColumn("m", F.lit(2)))
    rows = estimators.coefficients(estimators.fit(both, SPECS[:1], ["e"], ["m"]), ["m"]).collect()
    got = {r["m"]: r["estimate"] for r in rows}
    assert got[1] == pytest.approx(brute_force(first, ["x1"])[0][0], rel=1e-9)
    assert got[2] == pytest.approx(brute_force(second, ["x1"])[0][0], rel=1e-9)


def test_entity_shift_and_scale(spark):
    df = frame(spark, simulated(seed=7))
    base = estimates(estimators.fit(df, SPECS[:1], ["e"]))[("one", "x1")]
    moved = df.withColumn("y", F.col("y") + F.length("e") * 100).withColumn("x1", F.col("x1") * 4 + F.ascii("e"))
    row = estimates(estimators.fit(moved, SPECS[:1], ["e"]))[("one", "x1")]
    assert row["estimate"] == pytest.approx(base["estimate"] / 4, rel=1e-9)
    assert row["se"] == pytest.approx(base["se"] / 4, rel=1e-9)


def test_spanned_regressor_is_aliased(spark):
    df = frame(spark, simulated(seed=8)).withColumn("x3", F.col("x1") - 2 * F.col("x2"))
    got = estimates(estimators.fit(df, SPECS[1:2], ["e"]))
    assert [got[("three", x)]["aliased"] for x in ("x1", "x2", "x3")] == [False, False, True]
    assert got[("three", "x3")]["estimate"] is None and got[("three", "x3")]["se"] is None
    without = estimates(estimators.fit(df, [Spec("two", "y", ("x1", "x2"))], ["e"]))
    assert got[("three", "x1")]["estimate"] == pytest.approx(without[("two", "x1")]["estimate"], rel=1e-8)
    assert got[("three", "x1")]["se"] == pytest.approx(without[("two", "x1")]["se"], rel=1e-8)


def test_constant_regressor_and_empty_spec(spark):
    df = frame(spark, simulated(seed=9)).withColumn("x1", F.lit(3.0)).withColumn("x2", F.lit(None).cast("double"))
    got = estimates(estimators.fit(df, [Spec("flat", "y", ("x1",)), Spec("none", "y", ("x2",))], ["e"]))
    assert got[("flat", "x1")]["aliased"]
    assert not any(name == "none" for name, _ in got)


def test_passing_sums_on_early_changes_nothing(spark, monkeypatch):
    df = frame(spark, simulated(seed=10, n_entities=40))
    whole = estimates(estimators.fit(df, SPECS, ["e"]))
    monkeypatch.setattr(estimators, "SUMS_BUDGET", 64)
    monkeypatch.setattr(estimators, "BLOCK_BUDGET", 2048)
    pieces = estimates(estimators.fit(df, SPECS, ["e"]))
    for key in whole:
        assert pieces[key]["estimate"] == pytest.approx(whole[key]["estimate"], rel=1e-10)
        assert pieces[key]["se"] == pytest.approx(whole[key]["se"], rel=1e-9)


def test_entities_on_different_calendars(spark):
    data = [r for r in simulated(seed=11, n_periods=30) if r["e"] not in ("e1", "e2") or (r["t"] < 108) == (r["e"] == "e1")]
    row = estimates(estimators.fit(frame(spark, data), SPECS[:1], ["e"]))[("one", "x1")]
    beta, se, *_ = brute_force(data, ["x1"])
    assert row["estimate"] == pytest.approx(beta[0], rel=1e-9) and row["se"] == pytest.approx(se[0], rel=1e-9)


def test_repeated_period_is_an_error(spark):
    df = frame(spark, simulated(seed=1))
    with pytest.raises(Exception, match="more than one row"):
        estimators.fit(df.unionByName(df.limit(1)), SPECS[:1], ["e"]).collect()


def test_designs_as_rows(spark):
    data = simulated(seed=12)
    designs = frame(spark, data).select(F.lit("d").alias("spec_id"), F.col("e").alias("entity"), "period_idx", "y", F.array("x1", "x2").alias("x"))
    got = estimators.coefficients(estimators.fit_designs(designs, 2)).orderBy("pos").collect()
    beta, *_ = brute_force(data, ["x1", "x2"])
    assert [r["estimate"] for r in got] == pytest.approx(list(beta), rel=1e-9)


def panel(n_entities=8, n_periods=60, seed=0):
    rng = np.random.default_rng(seed)
    data = []
    for e in range(n_entities):
        shock = rng.normal(size=n_periods)
        change = np.zeros(n_periods)
        steps = np.diff(shock, prepend=0.0)
        for t in range(2, n_periods):
            change[t] = 0.3 * change[t - 1] + 0.02 * steps[t] + 0.01 * steps[t - 1] + 0.001 * rng.normal()
        level = np.exp(np.cumsum(change) + 5 + e)
        data += [(f"e{e}", t, float(level[t]), float(shock[t])) for t in range(n_periods)]
    return data


def test_projection_sample_size(spark):
    """A balanced panel of N entities and T periods leaves N(T-1-H-h) rows at horizon h."""
    df = spark.createDataFrame(panel(7, 85), "e string, period_idx int, gdp double, dev double")
    got = {r["horizon"]: r["nt"] for r in projections.project(df, ["e"], ["gdp"], ["dev"], 8).collect()}
    assert got == {h: 7 * (85 - 1 - 8 - h) for h in range(9)}
    rows = projections.projection_dataset(df, ["e"], "dev", "gdp", 8).groupBy("horizon").count().collect()
    assert {r["horizon"]: r["count"] for r in rows} == got


def test_projection_recovers_the_planted_response(spark):
    df = spark.createDataFrame(panel(), "e string, period_idx int, gdp double, dev double")
    got = {r["horizon"]: r for r in projections.project(df, ["e"], ["gdp"], ["dev"], 4).collect()}
    assert got[0]["estimate"] == pytest.approx(0.02, abs=0.004)
    table = {r["horizon"]: r for r in projections.response_table(projections.project(df, ["e"], ["gdp"], ["dev"], 4)).collect()}
    assert table[0]["estimate"] == pytest.approx(100 * got[0]["estimate"])
    assert table[0]["signif"] == "***"
    assert table[0]["ci_up"] - table[0]["ci_low"] == pytest.approx(2 * 1.96 * table[0]["se"])


def test_projection_of_a_flat_shock_is_zero(spark):
    df = spark.createDataFrame(panel(), "e string, period_idx int, gdp double, dev double").withColumn("dev", F.lit(1.0))
    got = projections.project(df, ["e"], ["gdp"], ["dev"], 2).collect()
    assert {(r["estimate"], r["se"]) for r in got} == {(0.0, 0.0)}
    assert {r["signif"] for r in projections.response_table(projections.project(df, ["e"], ["gdp"], ["dev"], 2)).collect()} == {None}


def long_run_setup(spark, full_delta=False):
    df = spark.createDataFrame(panel(12, 80), "e string, period_idx int, gdp double, dev double")
    wide = longrun.lag_columns(df, ["e"], ["gdp"], ["dev"], 2)
    specs = longrun.model_specs(["gdp"], 2, {8: ("dev",)})
    fits = estimators.fit(wide, specs, ["e"])
    return fits, {r["var"]: r for r in longrun.long_run_effects(fits, full_delta=full_delta).collect()}


def test_long_run_effect_identities(spark):
    fits, got = long_run_setup(spark)
    fit = fits.first()
    beta, k = np.array(fit["beta"]), len(fit["beta"])
    cov = np.array(fit["cov"]).reshape(k, k)
    assert fit["terms"] == ["gdp@1", "gdp@2", "dev@0", "dev@1", "dev@2"]
    assert got["gdp"]["lr_coeff"] == pytest.approx(1 - beta[:2].sum())
    assert got["gdp"]["se"] == pytest.approx(np.sqrt(cov[:2, :2].sum()))
    assert got["dev"]["lr_coeff"] * got["gdp"]["lr_coeff"] == pytest.approx(beta[2:].sum())
    assert got["dev"]["se"] == pytest.approx(np.sqrt(cov[2:, 2:].sum()) / abs(got["gdp"]["lr_coeff"]))
    # Planted: (0.02 + 0.01) / (1 - 0.3).
    assert got["dev"]["lr_coeff"] == pytest.approx(0.03 / 0.7, abs=0.005)


def test_full_delta_adds_the_adjustment_gradient(spark):
    fits, got = long_run_setup(spark, full_delta=True)
    fit = fits.first()
    k = len(fit["beta"])
    cov = np.array(fit["cov"]).reshape(k, k)
    phi, theta = got["gdp"]["lr_coeff"], got["dev"]["lr_coeff"]
    gradient = np.array([theta / phi] * 2 + [1 / phi] * 3)
    assert got["dev"]["se"] == pytest.approx(np.sqrt(gradient @ cov @ gradient))


def test_difference_panel_keeps_each_rows_own_period(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 1.0), ("a", 2, 2.0, 3.0), ("b", 5, 1.0, 1.0), ("b", 6, 1.0, 0.0)], "e string, period_idx int, gdp double, dev double")
    got = longrun.difference_panel(df, ["e"], ["gdp"], ["dev"]).orderBy("e").collect()
    assert [(r["e"], r["period_idx"], r["dev"]) for r in got] == [("a", 2, 2.0), ("b", 6, -1.0)]


def test_model_list_is_complete():
    specs = longrun.model_specs(["gdp"], 8)
    assert [len(s.x) for s in specs] == [8 + 9 * len(v) for v in longrun.MODELS.values()]
    assert max(len(s.x) for s in specs) == 44 and len(specs) == 9


def test_staggered_panels_get_narrow_blocks(monkeypatch):
    """500 entities on disjoint periods: blocks hold no more than the budget, and every entity once."""
    import pyarrow as pa

    width, rows = 4, 10
    series = pa.array([[{"p": rows * e + i, "v": [1.0] * width} for i in range(rows)] for e in range(500)])
    monkeypatch.setattr(estimators, "BLOCK_BUDGET", 64 << 10)
    blocks = list(estimators._block_rows(series, list(range(500)), width))
    assert sorted(i for b in blocks for i in b) == list(range(500))
    held = [estimators._Block(series.take(pa.array(b)), width).values.nbytes for b in blocks]
    assert max(held) <= 64 << 10 and len(blocks) > 10


def test_many_designs_stream(spark):
    designs = spark.range(50_000).selectExpr("id AS spec_id", "explode(sequence(0, 5)) AS p").selectExpr(
        "spec_id", "p % 2 AS entity", "CAST(p DIV 2 AS INT) AS period_idx", "CAST(p * p + spec_id AS DOUBLE) AS y", "array(CAST(p AS DOUBLE)) AS x"
    )
    fits = estimators.fit_designs(designs, 1)
    assert fits.count() == 50_000 and fits.where("beta[0] IS NULL OR n_obs <> 6").isEmpty()


def test_bandwidth_counts_all_periods(spark):
    """On a staggered panel T is the number of periods over all entities."""
    rows = [(e, e * 5 + t, float((e * 7 + t * t) % 11), float(t)) for e in range(4) for t in range(10)]
    panel = spark.createDataFrame(rows, "entity int, period_idx int, y double, x double")
    fit = estimators.fit(panel, [Spec("s", "y", ("x",))], ["entity"]).first()
    assert fit.n_periods == 25
    same = estimators.fit(panel, [Spec("s", "y", ("x",))], ["entity"], max_lag=2).first()
    assert fit.cov == same.cov


def test_nearly_collinear_regressors_agree_with_least_squares(spark):
    """At a condition number of 1e6, where cross products lose all but four digits."""
    rng = np.random.default_rng(8)
    entities, periods = 12, 40
    rows = []
    for e in range(entities):
        x1 = rng.normal(size=periods) + e
        x2 = x1 + 1e-6 * rng.normal(size=periods)
        y = 2 * x1 - x2 + e + rng.normal(size=periods)
        rows += [(e, t, float(y[t]), float(x1[t]), float(x2[t])) for t in range(periods)]
    panel = spark.createDataFrame(rows, "e int, period_idx int, y double, x1 double, x2 double").repartition(4)
    got = estimators.fit(panel, [estimators.Spec("s", "y", ("x1", "x2"))], ["e"]).first()
    data = np.array([r[2:] for r in rows])
    dummies = np.repeat(np.eye(entities), periods, axis=0)
    wanted = np.linalg.lstsq(np.column_stack([data[:, 1], data[:, 2] - data[:, 1], dummies]), data[:, 0], rcond=None)[0]
    # The second design spans the same space and is well conditioned after scaling.
    small, wide = wanted[1], wanted[0] - wanted[1]
    assert got.aliased == [False, False]
    assert np.allclose(got.beta, [wide, small], rtol=1e-7)


def test_triangles_merge_in_any_order():
    rng = np.random.default_rng(9)
    rows = rng.normal(size=(50, 5))
    parts = [estimators._triangle(p) for p in np.split(rows, [2, 3, 20, 41])]
    for order in ([0, 1, 2, 3, 4], [4, 2, 0, 3, 1]):
        merged = np.zeros((5, 5))
        for i in order:
            merged = estimators._merged_triangle(merged, parts[i])
        assert np.allclose(merged.T @ merged, rows.T @ rows)
        assert np.allclose(estimators._unpacked_triangle(merged[np.triu_indices(5)]), merged)


@pytest.mark.parametrize("max_lag", [None, 0, 3, 40])
def test_covariance_by_blocks_of_periods_equals_a_loop(spark, monkeypatch, max_lag):
    """Blocks of eight periods, with gaps in the calendar, periods below zero and bandwidths beyond a block."""
    rnd = np.random.Generator(np.random.PCG64(12))
    periods = np.sort(rnd.choice(np.arange(-30, 90), 70, replace=False)).tolist()
    rows = [(g, e, p, *rnd.normal(size=3).tolist()) for g in (1, None) for p in periods for e in range(4)]
    panel = spark.createDataFrame(rows, "g int, e int, period_idx int, y double, a double, b double").withColumn("twice", F.col("a") * 2)
    specs = [Spec("one", "y", ("a", "b")), Spec("two", "y", ("a", "twice", "b"))]
    wide = {(r.g, r.spec_id): r for r in estimators.fit(panel, specs, ["e"], ["g"], max_lag, True).collect()}
    monkeypatch.setattr(estimators, "PERIOD_BLOCK", 8)
    monkeypatch.setattr(estimators, "_BLOCK", "CAST(floor(period_idx / 8) AS INT)")
    cut = {(r.g, r.spec_id): r for r in estimators.fit(panel, specs, ["e"], ["g"], max_lag, True).collect()}
    assert set(cut) == set(wide) == {(g, s) for g in (1, None) for s in ("one", "two")}
    for (g, name), found in cut.items():
        mine = np.array([r[1:] for r in rows if r[0] == g])
        x, y = mine[:, 3:].copy(), mine[:, 2].copy()
        for e in range(4):
            at = mine[:, 0] == e
            x[at] -= x[at].mean(axis=0)
            y[at] -= y[at].mean()
        inverse = np.linalg.inv(x.T @ x)
        beta = inverse @ x.T @ y
        score = {p: (x * (y - x @ beta)[:, None])[mine[:, 1] == p].sum(axis=0) for p in periods}
        lags = int(len(periods) ** 0.25) if max_lag is None else max_lag
        omega = sum(
            (1 - abs(s - t) / (lags + 1)) * np.outer(score[s], score[t]) for s in periods for t in periods if abs(s - t) <= lags
        )
        n, t = len(mine), len(periods)
        want = inverse @ omega @ inverse * t / (t - 1) * (n - 1) / (n - 2)
        at = [0, 1] if name == "one" else [0, 2]
        k = len(found.terms)
        for r in (found, wide[g, name]):
            assert [r.beta[i] for i in at] == pytest.approx(beta, rel=1e-9)
            assert np.array(r.cov).reshape(k, k)[np.ix_(at, at)] == pytest.approx(want, rel=1e-8)
            assert r.aliased == [i not in at for i in range(k)] and (r.n_obs, r.n_periods) == (n, t)


def test_long_calendar_spreads_over_blocks(spark):
    """100,000 periods: each task sees one block and its halo, and the blocks' parts add up to the whole covariance."""
    n, k = 100_000, 6
    panel = spark.range(0, 2 * n, 1, 8).selectExpr(
        "CAST(id % 2 AS INT) AS e", "CAST(id DIV 2 AS INT) AS period_idx", *[f"sin(id * {j + 1.37}) AS x{j}" for j in range(k)], "cos(id * 0.7) AS y"
    )
    spec = Spec("s", "y", tuple(f"x{j}" for j in range(k)))
    sums = estimators._sums(panel, [spec], ["e"], []).checkpoint()
    heads = estimators._solved_heads(sums, [], None, False)
    scores = estimators._period_scores(sums, heads, [])
    sizes = [r["count"] for r in scores.groupBy("spec_id", "block").count().collect()]
    lag = int(n**0.25)
    assert len(sizes) == -(-n // estimators.PERIOD_BLOCK) and max(sizes) <= estimators.PERIOD_BLOCK + lag
    rows = scores.where(estimators._BLOCK + " = block").orderBy("period_idx").toPandas()
    whole = estimators.block_autocovariance(np.stack(rows["score"]), 0, lag)
    found = estimators.fit(panel, [spec], ["e"]).collect()[0]
    assert len(rows) == n and np.array(found.cov).reshape(k, k) == pytest.approx(whole, rel=1e-9, abs=1e-18)
