"""Closed forms, boundaries and invariants on small tables."""

from __future__ import annotations

import datetime as dt
import math
import pickle
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quartzvol.config import DEFAULT
from quartzvol.functions import scalars as S
from quartzvol.operators import align, boosting, compare, nullgen, premium, score, series, simulation, trading, walkforward
from quartzvol.sources import snapshots, stores


def days(n: int, start: str = "2000-01-03") -> list[dt.date]:
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def months(n: int) -> list[dt.date]:
    return [d.date() for d in pd.date_range("2000-01-01", periods=n, freq="MS")]


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame({"series_id": "s", **columns}))


def collected(df, value, order="d"):
    return [r[value] for r in df.orderBy(order).collect()]


def test_regime_has_a_closed_middle(spark):
    rows = spark.createDataFrame([(14.99,), (15.0,), (25.0,), (25.01,)], "v double").select(S.regime(F.col("v")).alias("r")).collect()
    assert [r["r"] for r in rows] == ["calm", "normal", "normal", "stressed"]


def test_regime_of_a_missing_level_raises(spark):
    with pytest.raises(Exception, match="no regime"):
        spark.createDataFrame([(None,)], "v double").select(S.regime(F.col("v"))).collect()


def test_losses(spark):
    r = spark.createDataFrame([(2.0, 1.0, -1.0, 0.0)], "y double, f double, a double, b double").select(
        S.qlike(F.col("y"), F.col("f")).alias("q"), S.direction_match(F.col("a"), F.col("b")).alias("zero"), S.direction_match(F.col("a"), F.col("y")).alias("apart")
    ).first()
    assert r["q"] == pytest.approx(2 - math.log(2) - 1) and r["zero"] and not r["apart"]


def test_tail_probabilities():
    assert S.normal_sf_value(1.6448536269514722) == pytest.approx(0.05)
    assert S.t_two_sided_value(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert S.t_two_sided_value(12.706204736432095, 1) == pytest.approx(0.05, abs=1e-10)


def test_block_length_cuts_the_float_root():
    assert [S.block_length(n) for n in (1, 64, 216, 222)] == [1, 3, 5, 6]


def test_windows_are_complete_or_missing(spark):
    r = np.random.default_rng(1).normal(0, 0.01, 60)
    rows = frame(spark, d=days(60), r=r, rn=range(60))
    target = collected(series.forward_variance(rows), "target")
    assert target[0] == pytest.approx(252 * np.mean(r[1:22] ** 2)) and target[38] is not None and target[39:] == [None] * 21
    vol = collected(series.realised_vol(rows), "vol")
    assert len(vol) == 40 and vol[0] == pytest.approx(np.std(r[:21], ddof=1) * math.sqrt(252) * 100)
    x3 = collected(series.har_regressors(rows), "x3")
    assert x3[:21] == [None] * 21 and x3[21] == pytest.approx(np.mean(r[:22] ** 2))


def test_first_return_is_dropped(spark):
    rows = series.log_returns(frame(spark, d=days(3), close=[1.0, math.e, 1.0]))
    assert collected(rows, "r") == pytest.approx([1.0, -1.0]) and collected(rows, "rn") == [0, 1]


def test_month_start_keeps_missing_values(spark):
    rows = spark.createDataFrame([("s", dt.date(2000, 1, 5), None), ("s", dt.date(2000, 1, 6), 1.0), ("s", dt.date(2000, 2, 1), 2.0)], "series_id string, d date, v double")
    assert collected(series.month_start(rows), "v") == [None, 2.0]


def test_as_of_takes_the_last_value_before(spark):
    right = spark.createDataFrame([("s", dt.date(2000, 1, 3), 1.0), ("s", dt.date(2000, 1, 10), 2.0)], "series_id string, d date, v double")
    left = spark.createDataFrame([("s", dt.date(2000, 1, n)) for n in (1, 3, 9, 12)], "series_id string, d date")
    assert collected(series.as_of(left, right, "v"), "v") == [None, 1.0, 1.0, 2.0]


def test_lags_are_positional(spark):
    """A premium whose value is its place shows every shift: lags 0, 2, 5 and a lead of 1, before any row goes."""
    n = 30
    table = frame(spark, d=months(n), vrp=[float(k) for k in range(n)], vix=20.0, skew=130.0)
    returns = frame(spark, d=days(900, "1999-06-01"), r=np.random.default_rng(0).normal(0, 0.01, 900), rn=range(900))
    out = premium.model_dataset(premium.features(table, returns)).toPandas().sort_values("d")
    assert (out["vrp_h1m"] - out["vrp_h3m"] == 2).all() and (out["vrp_h1m"] - out["vrp_h6m"] == 5).all() and (out["y"] - out["vrp_h1m"] == 1).all()
    assert len(out) == n - 6 and list(out["row"]) == list(range(n - 6))


def _har_by_hand(r: np.ndarray, p: int) -> float:
    sq = r**2
    mean = lambda i, w: sq[i - w + 1 : i + 1].mean()
    rows = [i for i in range(21, p - 20) if i + 21 < len(r)]
    x = np.array([[1, sq[i], mean(i, 5), mean(i, 22)] for i in rows])
    y = np.array([252 * sq[i + 1 : i + 22].mean() for i in rows])
    beta = np.linalg.lstsq(x * [1, 1e4, 1e4, 1e4], y, rcond=None)[0]
    return float(np.array([1, sq[p] * 1e4, mean(p, 5) * 1e4, mean(p, 22) * 1e4]) @ beta)


def test_har_forecast_equals_a_regression_by_hand_and_sees_no_future(spark):
    r = np.random.default_rng(3).normal(0, 0.01, 400)
    d = days(400)
    whole = premium.har_forecast(frame(spark, d=d, r=r, rn=range(400))).toPandas().set_index("d")["forecast"]
    for day in whole.index[[0, 5, -1]]:
        assert whole[day] == pytest.approx(_har_by_hand(r, d.index(day)), rel=1e-7)
    cut = 300
    part = premium.har_forecast(frame(spark, d=d[:cut], r=r[:cut], rn=range(cut))).toPandas().set_index("d")["forecast"]
    assert len(part) and all(part[k] == pytest.approx(whole[k], rel=1e-9) for k in part.index)


def test_expanding_mean_of_a_ramp(spark):
    ds = frame(spark, d=months(50), y=[float(k) for k in range(50)], row=range(50))
    cut = spark.createDataFrame([("s", 9)], "series_id string, cut int")
    out = walkforward.mean_forecasts(ds, cut)
    assert collected(out, "y_pred")[:3] == [4.5, 5.0, 5.5] and out.count() == 40
    again = walkforward.walk_forward(ds.withColumn("x", F.lit(0.0)), cut, ("x",), walkforward.factory(walkforward.ConstantMean))
    assert collected(again, "y_pred") == pytest.approx(collected(out, "y_pred"))


def test_cut_on_the_last_row_is_refused(spark):
    ds = frame(spark, d=months(5), y=[0.0] * 5, row=range(5))
    with pytest.raises(ValueError, match="no row to predict"):
        walkforward.check_cut(ds, spark.createDataFrame([("s", 4)], "series_id string, cut int"))


def _dataset(spark, n=80, seed=7):
    g = np.random.default_rng(seed)
    return frame(spark, d=months(n), row=range(n), y=g.normal(size=n), a=g.normal(size=n), b=g.normal(size=n), regime=g.choice(["calm", "normal", "stressed"], n, p=[0.45, 0.45, 0.1]))


def test_linear_forecasts_equal_least_squares(spark):
    ds = _dataset(spark)
    out = walkforward.linear_forecasts(ds, spark.createDataFrame([("s", 30)], "series_id string, cut int"), ("a", "b")).toPandas().sort_values("row")
    p = ds.toPandas().sort_values("row")
    x = np.column_stack([np.ones(len(p)), p["a"], p["b"]])
    for _, r in out.iloc[[0, 20, -1]].iterrows():
        beta = np.linalg.lstsq(x[: r["row"]], p["y"][: r["row"]], rcond=None)[0]
        assert r["y_pred"] == pytest.approx(x[r["row"]] @ beta)


def test_fallback_replay_equals_the_model(spark):
    ds, cut = _dataset(spark), spark.createDataFrame([("s", 20)], "series_id string, cut int")
    model = walkforward.regime_forecasts(ds, cut, ("a", "b")).toPandas().sort_values("d")
    counts = ds.toPandas().sort_values("row")
    want = [(counts["regime"][: r] == counts["regime"].iloc[r]).sum() < 2 * 3 for r in range(21, 80)]
    assert list(model["fallback"]) == want and any(want) and not all(want)


def test_masks_are_disjoint_and_complete(spark):
    n = 12
    wf = frame(spark, d=months(n), model="m", y_true=[0.01] * n, y_pred=[0.05 if k % 3 == 0 else 0.001 for k in range(n)])
    outcomes = frame(spark, d=months(n), vix=[20.0] * n, vix_next=[20.0] * n, realised_next=[0.02] * 9 + [None] * 3)
    outcomes = outcomes.withColumn("realised_next", F.nanvl("realised_next", F.lit(None).cast("double")))
    r = score.scorecard(score.observations(wf, outcomes)).first()
    assert (r["n_valid"], r["n_guard_excluded"], r["n_tail_excluded"], r["n_obs"]) == (6, 4, 2, 12)


def test_diagnostics_known_case(spark):
    obs = frame(spark, d=months(4), model="m", y_true=[1.0, 2.0, 3.0, 4.0], y_pred=[2.0] * 4, regime=["calm", "calm", "normal", "stressed"])
    r = score.diagnostics(obs).first()
    assert r["mean_error"] == -0.5 and r["mae"] == 1.0 and r["rmse"] == pytest.approx(math.sqrt(1.5)) and r["r2"] == pytest.approx(-0.2) and (r["worst_regime"], r["worst_mae"]) == ("stressed", 2.0)


def test_router_is_unordered_and_not_transitive():
    assert compare.is_nested("har", "constant") and compare.nested_order("har", "constant") == ("constant", "har") and not compare.is_nested("har", "regime_switching")


def test_long_run_variances(spark):
    x = np.random.default_rng(2).normal(size=40)
    c = x - x.mean()
    g = [c[k:] @ c[: len(c) - k] / 40 for k in range(4)]
    r = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(*[compare.long_run_variance(F.col("x"), F.lit(3), t).alias(f"t{t}") for t in (True, False)]).first()
    assert r[1] == pytest.approx(g[0] + 2 * sum(g[1:])) and r[0] == pytest.approx(g[0] + 2 * sum((1 - k / 4) * g[k] for k in (1, 2, 3)))


def test_small_and_flat_groups_have_reasons(spark):
    rows = spark.createDataFrame([("short", [1.0, 2.0]), ("tie", [0.0] * 9), ("flat", [1.0] * 9)], "k string, x array<double>")
    got = {r["k"]: (r["stat"], r["p_value"], r["reason"]) for r in compare.diebold_mariano(rows).collect()}
    assert got == {"short": (None, None, compare.SMALL_SAMPLE), "tie": (0.0, 1.0, None), "flat": (None, None, compare.NO_VARIANCE)}


def test_bootstrap_p_values():
    assert compare.bootstrap_p(np.full(50, 3.0) + np.linspace(-0.1, 0.1, 50), 499, 1) == pytest.approx(1 / 500)
    x = np.random.default_rng(0).normal(size=100)
    assert compare.bootstrap_p(x - x.mean(), 999, 5) == pytest.approx(0.5, abs=0.1)
    assert compare.bootstrap_p(x, 200, 5) == compare.bootstrap_p(x, 200, 5)


def test_wald_of_an_exact_null(spark):
    g = np.random.default_rng(4)
    x = g.uniform(0.01, 0.09, 60)
    e = g.normal(size=60)
    design = np.column_stack([np.ones(60), x])
    e -= design @ np.linalg.lstsq(design, e, rcond=None)[0]
    r = compare.mincer_zarnowitz(frame(spark, d=months(60), realised=x + 0.01 * e, forecast=x), ["series_id"]).first()
    assert r["wald"] == pytest.approx(0, abs=1e-12) and r["wald_p"] == pytest.approx(1) and r["beta"] == pytest.approx(1)


def test_costs_fall_on_every_transition(spark):
    d = months(4)
    pos = frame(spark, d=d, position_naive=[1, 1, 0, 1], position_conditioned=[0, 1, 1, 0])
    outcomes = frame(spark, d=d, vix=[20.0] * 4, realised=[0.03] * 4)
    rows = trading.profit_and_loss(pos, outcomes).toPandas().sort_values("d")
    cost = rows["gross_naive"] - rows["net_naive_base"]
    assert cost.tolist() == pytest.approx([0.0004, 0, 0.0004, 0.0004]) and (rows["gross_naive"] - rows["net_naive_stress"]).tolist() == pytest.approx([0.0008, 0, 0.0008, 0.0008])


def test_drawdown_starts_at_the_first_value(spark):
    out = series.drawdown(frame(spark, d=months(4), v=[-1.0, 2.0, -3.0, 1.0]), "v", "series_id")
    assert collected(out, "underwater") == [0.0, 0.0, 3.0, 2.0]


def test_folds_never_validate_the_last_row():
    folds = walkforward.cv_folds(100, 60, 4)
    assert folds[0][1] == 60 and folds[-1][2] == 99 and all(a[2] == b[1] for a, b in zip(folds, folds[1:]))


def test_grid_order():
    points = boosting.default_grid()
    assert len(points) == 54 and points[0] == {"depth": 2, "rate": 0.01, "trees": 100, "min_child": 1, "grid_idx": 0} and points[1]["min_child"] == 5


def test_attributions_add_up():
    g = np.random.default_rng(0)
    x = pd.DataFrame(g.normal(size=(80, 3)), columns=list("abc")).assign(regime=g.choice(["calm", "normal", "stressed"], 80))
    model = boosting.Boosted(3, 0.1, 30, 2)
    model.fit(x, x["a"] * x["b"])
    base, shap = model.attributions(x.iloc[5:6])
    assert base + shap.sum() == pytest.approx(model.predict(x.iloc[5:6])[0])
    with pytest.raises(ValueError, match="unknown regimes"):
        model.predict(x.assign(regime="other"))


def test_nested_forecasts_equal_regressions():
    h = simulation.history(0.05, 90, np.random.default_rng(1))
    log_rv, x = np.log(h["rv"]), h["x"]
    small, big = simulation.nested_forecasts(log_rv[None], x[None], 40)
    for i, t in ((0, 40), (30, 70), (49, 89)):
        design = np.column_stack([np.ones(t - 1), log_rv[: t - 1], x[: t - 1]])
        now = np.array([1, log_rv[t - 1], x[t - 1]])
        assert big[0, i] == pytest.approx(now @ np.linalg.lstsq(design, log_rv[1:t], rcond=None)[0])
        assert small[0, i] == pytest.approx(now[:2] @ np.linalg.lstsq(design[:, :2], log_rv[1:t], rcond=None)[0])


def test_replications_follow_from_their_numbers(spark):
    cell = simulation.Cell("c", t_train=40, t_oos=40, draws=19)
    rows = {r["rep_id"]: r["p_boot"] for r in simulation.run_cells(spark, [cell], 4, per_task=1).collect()}
    assert rows == {k: simulation.replication(cell, k)["p_boot"] for k in range(4)}


def test_arma_fit_recovers_its_parameters():
    e = np.random.default_rng(0).normal(size=4000)
    shocks = e.copy()
    shocks[1:] += 0.4 * e[:-1]
    fit = simulation.fit_arma11(simulation.autoregression(shocks, 0.7))
    assert fit["converged"] and fit["phi"] == pytest.approx(0.7, abs=0.05) and fit["theta"] == pytest.approx(0.4, abs=0.06)
    best = nullgen.best_arma(simulation.autoregression(e, 0.7), (2, 2), "bic")
    assert (len(best.phi), len(best.theta)) == (1, 0) and nullgen.spectral_radius({1: 0.5, 2: 0.0}) == pytest.approx(0.5)


def test_snapshots(spark, tmp_path):
    path = snapshots.snapshot_path(f"file://{tmp_path}", "2026-01-01")
    with pytest.raises(snapshots.MissingSnapshot):
        snapshots.closes(spark, path, "^VIX")
    fresh = lambda *v: spark.createDataFrame([(dt.date(2000, 1, k), x) for k, x in v], "d date, close double")
    snapshots.upsert(spark, path, "SPY", fresh((3, 1.0), (4, 2.0)))
    snapshots.upsert(spark, path, "^VIX", fresh((4, 20.0), (5, 21.0)))
    snapshots.upsert(spark, path, "^VIX", fresh((5, 22.0)))
    assert collected(snapshots.closes(spark, path, "^^VIX"), "close") == [22.0] and collected(snapshots.closes(spark, path, "SPY", "2000-01-04"), "close") == [2.0]
    with pytest.raises(snapshots.MissingSnapshot):
        snapshots.closes(spark, path, "SKEW")
    assert snapshots.long_closes(spark, path).count() == 3
    # A swap that ended between its two moves leaves the old table aside; the next call starts from it.
    (tmp_path / "raw_snapshot_2026-01-01.parquet").rename(tmp_path / "raw_snapshot_2026-01-01.parquet.old")
    snapshots.upsert(spark, path, "SKEW", fresh((3, 120.0)))
    assert sorted(snapshots.read_snapshot(spark, path).columns) == ["SKEW", "SPY", "VIX", "date"] and not snapshots.exists(spark, path + ".old")


def test_stores_resume(spark, tmp_path):
    path = f"file://{tmp_path}/facts"
    schema = "cell_key string, rep_id long, v double"
    assert stores.load_or_empty(spark, path, schema).count() == 0
    stores.append_facts(spark.createDataFrame([("a", 0, 1.0), ("a", 2, 1.0)], schema), path)
    stores.append_facts(spark.createDataFrame([("a", 0, 1.0), ("a", 2, 1.0)], schema), path)  # a repeated append
    assert stores.load_or_empty(spark, path, schema).count() == 2
    wanted = spark.createDataFrame([("a", k) for k in range(4)], "cell_key string, rep_id long")
    left = stores.remaining(wanted, stores.load_or_empty(spark, path, schema), ["cell_key", "rep_id"])
    assert sorted(r["rep_id"] for r in left.collect()) == [1, 3]
    assert '"x": null' in stores.metadata(DEFAULT, [], {"x": float("nan")})


def test_strict_alignment(spark):
    a = frame(spark, d=months(3), v=[1.0, 2.0, 3.0])
    with pytest.raises(align.MissingRows):
        align.reindex_strict(a.select("series_id", "d"), a.where("v < 3"))
    assert not align.same_keys(a, a.where("v < 3")) and align.same_keys(a, a)
    hit = align.in_windows(a, (("w", "2000-02-01", "2000-03-01"), ("w2", "2000-03-01", "2000-03-31")))
    assert sorted((r["label"], r["v"]) for r in hit.collect()) == [("w", 2.0), ("w", 3.0), ("w2", 3.0)]


def test_nulls_cover_every_series_pair_and_draw(spark):
    rng = np.random.default_rng(4)
    cfg = replace(DEFAULT, bootstrap_draws=30, gate_trials=6)
    seen = {}
    for name in ("a", "b"):
        vrp, place = rng.normal(0.01, 0.003, 70), np.arange(6, 69)
        seen[name] = nullgen.Observed(vrp, place, rng.normal(size=(63, 3)), np.full(63, 20.0), rng.uniform(0.02, 0.04, 63), vrp[place + 1], 20)
    bundles = spark.createDataFrame([(k, bytearray(pickle.dumps(v))) for k, v in seen.items()], "series_id string, bundle binary")
    models = nullgen.fitted(bundles)
    rows = nullgen.null_draws(models, cfg, per_task=8).collect()
    assert sorted((r["series_id"], r["generator"], r["draw"]) for r in rows) == [(s, g, d) for s in "ab" for g in sorted(nullgen.GENERATORS) for d in range(-1, 30)]
    drawn = nullgen.HarNull(seen["b"]).simulate(np.random.default_rng(np.random.SeedSequence(cfg.bootstrap_seed, spawn_key=(17,))))
    got = {(r["series_id"], r["generator"], r["draw"]): r["stat"] for r in rows}
    assert got["b", "har", 17] == pytest.approx(nullgen.draw_statistic(seen["b"], *drawn, "har", cfg))
    table = nullgen.null_p_values(spark.createDataFrame(rows)).collect()
    assert len(table) == 6 and all(r["used"] + r["failed"] == 30 for r in table)
    for r in table:
        mine = [got[r["series_id"], r["generator"], d] for d in range(-1, 30)]
        assert r["p_value"] == pytest.approx(np.mean([x >= mine[0] for x in mine[1:] if x is not None]))
    assert nullgen.gate(models, cfg).count() == 6 * len(cfg.acf_lags)


def test_walk_forward_takes_each_series_best_point(spark):
    rng = np.random.default_rng(5)
    rows = [(s, k, dt.date(2000 + k // 12, k % 12 + 1, 1), float(a), float(a + b)) for s in ("a", "b", "c") for k, (a, b) in enumerate(rng.normal(size=(30, 2)))]
    ds = spark.createDataFrame(rows, "series_id string, row int, d date, x double, y double")
    cut = spark.createDataFrame([(s, 26) for s in "abc"], "series_id string, cut int")
    points = [{"grid_idx": 0, "depth": 1, "rate": 0.5, "trees": 3, "min_child": 1}, {"grid_idx": 1, "depth": 2, "rate": 0.1, "trees": 5, "min_child": 5}]
    tuned = spark.createDataFrame([("a", 1, 1), ("a", 0, 2), ("b", 0, 1)], "series_id string, grid_idx int, place int")
    got = {(r["series_id"], r["row"]): r["y_pred"] for r in boosting.attributed_forecasts(ds, cut, ("x",), boosting.best_points(tuned, points)).collect()}
    assert len(got) == 9
    for series_id, settings in (("a", {"depth": 2, "rate": 0.1, "trees": 5, "min_child": 5}), ("b", {"depth": 1, "rate": 0.5, "trees": 3, "min_child": 1}), ("c", {})):
        frame = pd.DataFrame([r for r in rows if r[0] == series_id], columns=["s", "row", "d", "x", "y"])
        model = boosting.Boosted(**settings)
        model.fit(frame[["x"]].iloc[:28], frame["y"].iloc[:28])
        assert got[series_id, 28] == pytest.approx(model.predict(frame[["x"]].iloc[28:29])[0])


def test_boosting_queries_score_the_whole_grid(spark, monkeypatch):
    from quartzvol.plans import registry, studies  # noqa: F401

    seen = []
    monkeypatch.setattr(boosting, "tune", lambda dataset, outcomes, columns, points, cfg: seen.append(points))
    empty = spark.createDataFrame([], "series_id string, row int, cut int, cut_day date")
    studies._tuned(type("M", (), {"dataset": empty.select("series_id", "row"), "cut": empty.select("series_id", "cut", "cut_day"), "outcomes": None, "cfg": DEFAULT})())
    assert seen == [boosting.default_grid(DEFAULT)]


def test_study_queries_run_the_reference_sizes(spark, monkeypatch):
    from quartzvol.plans import registry, studies  # noqa: F401

    ran = {}
    monkeypatch.setattr(simulation, "run_cells", lambda session, cells, reps: ran.update({c.key: (c.t_train, c.t_oos, c.draws, reps) for c in cells}) or session.range(0))
    for name in ("mc_size_cell", "mc_power_cells", "mc_calibration_cells", "mc_sensitivity_cells", "mc_loss_bootstrap"):
        registry.QUERIES[name](spark, "none")
    assert ran["size_toos220"] == (140, 220, 299, 2000) and ran["size_toos250"] == (140, 250, 299, 2000)
    assert [ran[f"beta{b}_toos{n}"] for b in ("0p03", "0p05") for n in (220, 250)] == [(140, n, 299, 1000) for n in (220, 250)] * 2
    assert sum(v == (140, 220, 0, 300) for v in ran.values()) == 8
    assert [ran[k] for k in ("reference", "ar1_generator", "many_draws", "residual_blocks_3")] == [(140, 220, n, 1000) for n in (299, 299, 999, 299)]
    assert ran["loss"] == (140, 220, 999, 2000) and ran["data"] == (140, 220, 299, 500)


def test_study_tables_report_their_own_cells(spark, monkeypatch):
    from quartzvol.plans import registry, studies

    small = {k: ([replace(c, t_train=40, t_oos=40, draws=min(c.draws, 19)) for c in cells], 4) for k, (cells, _) in studies.STUDY.items()}
    null_t = {c.key: c.t_oos for c in studies.STUDY["power"][0]}
    small["power"] = ([replace(c, t_oos=null_t[c.key], draws=9) for c in small["power"][0]], 2)
    monkeypatch.setattr(studies, "STUDY", small)
    table = registry.QUERIES["mc_size_power_table"](spark, "none").collect()
    assert len(table) == 12 and sum(r["power_boot"] is not None for r in table) == 8
    assert registry.QUERIES["mc_calibration_table"](spark, "none").count() == 8
    assert {r["cell_key"] for r in registry.QUERIES["mc_sensitivity_table"](spark, "none").collect()} == {c.key for c in studies.STUDY["sensitivity"][0]}


def test_block_resamples():
    rng = np.random.default_rng(3)
    fixed = simulation.resamples(10, 4, 50, rng, "fixed")
    assert fixed.shape == (50, 10) and all(((row[k + 1] - row[k]) % 10 == 1) for row in fixed for k in range(9) if (k + 1) % 4)
    free = simulation.resamples(400, 5, 200, rng)
    assert free.min() >= 0 and free.max() < 400 and 0.17 < np.mean((np.diff(free, axis=1) % 400) != 1) < 0.23
    with pytest.raises(ValueError, match="unknown"):
        simulation.resamples(5, 2, 1, rng, "other")
