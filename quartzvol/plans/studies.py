"""Queries of the simulation study, boosting, generators, stores and streaming operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import boosting, nullgen, report, simulation
from ..sources import snapshots, stores
from ..sources.scratch import written
from ..streaming import closes
from .market import Market
from .registry import fixed, query

#: Small cells for the check that a resumed run agrees.
CELLS = [simulation.Cell("size_toos60", t_train=60, t_oos=60, draws=99), simulation.Cell("beta0p05_toos60", "power", 0.05, t_train=60, t_oos=60, draws=99)]

#: Cells and replications of the whole study, at the reference's sizes.
STUDY = {
    "size": (simulation.size_cells(), 2000),
    "power": (simulation.power_cells(), 1000),
    "calibration": (simulation.calibration_cells(), 300),
    "sensitivity": (simulation.sensitivity_cells(), 1000),
    "loss": ([simulation.Cell("loss", draws=999, bootstrap="loss", block=5)], 2000),
    "data": ([simulation.Cell("data", draws=299, bootstrap="data", block=5)], 500),
}

#: Facts of a finished study for the report operators, out of the order table.
FACTS_SQL = """SELECT o_orderpriority AS cell_key, o_orderkey AS rep_id, ln(o_totalprice) AS s_obs, (o_orderkey * 7919 % 1000) / 1000.0::DOUBLE AS p_norm,
    (o_custkey * 104729 % 997) / 997.0::DOUBLE AS p_boot, CAST(o_orderkey % 3 AS INTEGER) AS gen_code, 1 + o_orderkey % 17 / 17.0::DOUBLE AS qlike_small, 1 + o_custkey % 13 / 13.0::DOUBLE AS qlike_big FROM orders"""
NULL_OF = {"1-URGENT": "5-LOW", "2-HIGH": "5-LOW"}


def facts(m: Market) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return m.spark.read.parquet(f"{m.dir}/orders.parquet").select(
        F.col("o_orderpriority").alias("cell_key"), key.alias("rep_id"), F.ln("o_totalprice").alias("s_obs"), ((key * 7919 % 1000) / F.lit(1000.0)).alias("p_norm"),
        ((cust * 104729 % 997) / F.lit(997.0)).alias("p_boot"), (key % 3).cast("int").alias("gen_code"), (1 + key % 17 / F.lit(17.0)).alias("qlike_small"), (1 + cust % 13 / F.lit(13.0)).alias("qlike_big"),
    )


@query("mc_histories")
def _(m: Market):
    return simulation.histories(m.spark, 0.03, 200, 8)


@query("mc_size_cell")
def _(m: Market):
    return simulation.run_cells(m.spark, *STUDY["size"])


@query("mc_power_cells")
def _(m: Market):
    return simulation.run_cells(m.spark, *STUDY["power"])


@query("mc_calibration_cells")
def _(m: Market):
    return simulation.run_cells(m.spark, *STUDY["calibration"])


@query("mc_sensitivity_cells")
def _(m: Market):
    return simulation.run_cells(m.spark, *STUDY["sensitivity"])


@query("mc_loss_bootstrap")
def _(m: Market):
    return simulation.run_cells(m.spark, *STUDY["loss"]).unionByName(simulation.run_cells(m.spark, *STUDY["data"]))


def _study(m: Market, *names: str) -> DataFrame:
    """Facts of the named cell sets, run once and written."""
    return written(reduce(DataFrame.unionByName, [simulation.run_cells(m.spark, *STUDY[n]) for n in names]), "facts")


@query("mc_size_power_table")
def _(m: Market):
    """The study's own size, and its power at the null cells' cutoffs."""
    null_of = {c.key: f"size_toos{c.t_oos}" for c in STUDY["power"][0]}
    return report.size_and_power(_study(m, "size", "power"), null_of)


@query("mc_rejection_rates")
def _(m: Market):
    return simulation.rejections(_study(m, "size", "power", "loss", "data"))


@query("mc_calibration_table")
def _(m: Market):
    return simulation.calibration(_study(m, "calibration"))


@query("mc_sensitivity_table")
def _(m: Market):
    return simulation.sensitivity_table(_study(m, "sensitivity"))


@query("mc_resume", f"SELECT {len(CELLS) * 12} AS n_rows, 0 AS n_changed")
def _(m: Market):
    """A run of the replications that an earlier one left out agrees with one run of all; both halves add up."""
    light = [simulation.Cell(c.key, c.stream, c.beta, 60, c.t_oos, draws=0) for c in CELLS]
    full = simulation.run_cells(m.spark, light, 12)
    half = full.where("rep_id % 2 = 0")
    rest = simulation.run_cells(m.spark, light, 12, done=half)
    both = half.unionByName(rest)
    changed = simulation.consistency(both, full).agg(F.count("*").cast("int").alias("n_changed"))
    return both.agg(F.count("*").cast("int").alias("n_rows")).join(changed, how="cross")


@query(
    "rejection_rates",
    f"SELECT cell_key, test, alpha, n, {fixed('rate', 'se=sqrt(rate * (1 - rate) / n)')} FROM r",
    facts=FACTS_SQL,
    r="""SELECT cell_key, test, CAST(alpha AS DOUBLE) AS alpha, count(*) AS n, avg(CASE WHEN p <= CAST(alpha AS DOUBLE) THEN 1.0 ELSE 0.0 END) AS rate FROM
        (SELECT cell_key, 'normal' AS test, p_norm AS p FROM facts UNION ALL SELECT cell_key, 'bootstrap', p_boot FROM facts), (VALUES (0.05), (0.10)) t(alpha) GROUP BY 1, 2, 3""",
)
def _(m: Market):
    return simulation.rejections(facts(m))


@query(
    "null_cutoffs",
    f"SELECT cell_key, CAST(a AS DOUBLE) AS alpha, {fixed('s_cut=quantile_cont(s_obs, 1 - a::DOUBLE)', 'p_cut=quantile_cont(p_boot, a::DOUBLE)')} FROM (SELECT cell_key, s_obs, p_boot, 0.05 AS a FROM facts) GROUP BY cell_key, a UNION ALL SELECT cell_key, CAST(a AS DOUBLE), {fixed('s_cut=quantile_cont(s_obs, 0.9)', 'p_cut=quantile_cont(p_boot, 0.1)')} FROM (SELECT cell_key, s_obs, p_boot, 0.10 AS a FROM facts) GROUP BY cell_key, a".replace("1 - a::DOUBLE", "0.95").replace("a::DOUBLE", "0.05"),
    facts=FACTS_SQL,
)
def _(m: Market):
    return simulation.null_cutoffs(facts(m))


@query("generator_usage", "SELECT cell_key, gen_code, count(*) AS n FROM facts GROUP BY 1, 2", facts=FACTS_SQL)
def _(m: Market):
    return simulation.generator_usage(facts(m))


@query(
    "beta_calibration",
    f"SELECT cell_key, {fixed('mean_gain=avg(g)', 'p10=quantile_cont(g, 0.1)', 'p50=quantile_cont(g, 0.5)', 'p90=quantile_cont(g, 0.9)', 'win_rate=avg(CASE WHEN g > 0 THEN 1.0 ELSE 0.0 END)')} FROM f GROUP BY 1",
    facts=FACTS_SQL,
    f="SELECT cell_key, 100 * (qlike_small - qlike_big) / qlike_small AS g FROM facts",
)
def _(m: Market):
    return simulation.calibration(facts(m))


@query(
    "size_power_table",
    f"SELECT r.cell_key, r.alpha, {fixed('normal', 'bootstrap', 'power_stat', 'power_boot')} FROM r LEFT JOIN p ON r.cell_key = p.cell_key AND r.alpha = p.alpha",
    facts=FACTS_SQL,
    lv="SELECT CAST(a AS DOUBLE) AS alpha FROM (VALUES (0.05), (0.10)) t(a)",
    r="SELECT cell_key, alpha, avg(CASE WHEN p_norm <= alpha THEN 1.0 ELSE 0.0 END) AS normal, avg(CASE WHEN p_boot <= alpha THEN 1.0 ELSE 0.0 END) AS bootstrap FROM facts, lv GROUP BY 1, 2",
    c="SELECT 0.05::DOUBLE AS alpha, quantile_cont(s_obs, 0.95) AS s_cut, quantile_cont(p_boot, 0.05) AS p_cut FROM facts WHERE cell_key = '5-LOW' UNION ALL SELECT 0.1::DOUBLE, quantile_cont(s_obs, 0.9), quantile_cont(p_boot, 0.1) FROM facts WHERE cell_key = '5-LOW'",
    p="SELECT cell_key, alpha, avg(CASE WHEN s_obs >= s_cut THEN 1.0 ELSE 0.0 END) AS power_stat, avg(CASE WHEN p_boot <= p_cut THEN 1.0 ELSE 0.0 END) AS power_boot FROM facts, c WHERE cell_key IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2",
)
def _(m: Market):
    return report.size_and_power(facts(m), NULL_OF)


@query(
    "sensitivity_table",
    f"SELECT a.cell_key, a.n, {fixed('rate=a.rate', 'se=a.se', 'rate_ref=b.rate', 'se_ref=b.se', 'difference=a.rate - b.rate', 'se_difference=sqrt(a.se * a.se + b.se * b.se)')} FROM s a JOIN s b ON b.cell_key = '5-LOW'",
    facts=FACTS_SQL,
    s="SELECT *, sqrt(rate * (1 - rate) / n) AS se FROM (SELECT cell_key, count(*) AS n, avg(CASE WHEN p_boot <= 0.05::DOUBLE THEN 1.0 ELSE 0.0 END) AS rate FROM facts GROUP BY 1)",
)
def _(m: Market):
    return simulation.sensitivity_table(facts(m), "5-LOW")


@query("resume_antijoin", "SELECT cell_key, rep_id FROM facts WHERE rep_id % 3 <> 0", facts=FACTS_SQL)
def _(m: Market):
    """Work that a store of every third replication leaves to do."""
    wanted = facts(m).select("cell_key", "rep_id")
    return stores.remaining(wanted, wanted.where("rep_id % 3 = 0"), ["cell_key", "rep_id"])


@query(
    "snapshot_upsert",
    f"SELECT date, {fixed('AUTOMOBILE', 'BUILDING')} FROM (SELECT d AS date, max(close) FILTER (series_id = 'AUTOMOBILE') AS AUTOMOBILE, max(2 * vix) FILTER (series_id = 'BUILDING') AS BUILDING FROM snap WHERE series_id IN ('AUTOMOBILE', 'BUILDING') GROUP BY 1)",
)
def _(m: Market):
    """A wide snapshot whose second column is replaced by another series, over the union of days."""
    pick = lambda name, c: m.daily.where(F.col("series_id") == name).select("d", c.alias("close"))
    wide = snapshots.with_column(pick("AUTOMOBILE", F.col("close")).select(F.col("d").alias("date"), F.col("close").alias("AUTOMOBILE")), "^BUILDING", pick("BUILDING", F.col("close")))
    return snapshots.with_column(wide, "^^BUILDING", pick("BUILDING", 2 * F.col("vix"))).select("date", "AUTOMOBILE", "BUILDING")


def _tuned(m: Market) -> DataFrame:
    """Every point of the grid scored on each series' training rows."""
    inside = m.dataset.join(m.cut, "series_id").where("row <= cut").drop("cut", "cut_day")
    return boosting.tune(inside, m.outcomes, m.cfg.features, boosting.default_grid(m.cfg), m.cfg)


def _boosted(m: Market) -> DataFrame:
    """The walk-forward with each series' best point."""
    best = written(boosting.best_points(_tuned(m), boosting.default_grid(m.cfg)), "points")
    return boosting.attributed_forecasts(m.dataset, m.cut, m.cfg.features, best)


@query("gbt_walk_forward")
def _(m: Market):
    return _boosted(m)


@query("gbt_additivity", "SELECT count(*) AS n, 0 AS n_off FROM ds JOIN cut USING (series_id) WHERE row > cut")
def _(m: Market):
    """Attributions and base add up to every prediction."""
    rows = _boosted(m)
    total = sum((F.col(f"shap_{c}") for c in m.cfg.features), F.col("base"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.abs(total - F.col("y_pred")) > 1e-9).cast("int").alias("n_off"))


@query("gbt_tuning")
def _(m: Market):
    return _tuned(m)


ATTRIBUTIONS = "SELECT series_id, d, regime, vix_level - 20 AS shap_vix_level, cboe_skew - 150 AS shap_cboe_skew, 100 * vrp_h1m AS shap_vrp_h1m FROM ds"
IMPORTANCE = """SELECT series_id, feature, r AS regime, avg(abs(v)) AS importance FROM
    (SELECT series_id, regime, 'vix_level' AS feature, shap_vix_level AS v FROM sh UNION ALL SELECT series_id, regime, 'cboe_skew', shap_cboe_skew FROM sh UNION ALL SELECT series_id, regime, 'vrp_h1m', shap_vrp_h1m FROM sh) x,
    LATERAL (SELECT unnest([x.regime, 'all']) AS r) GROUP BY 1, 2, 3"""


@query(
    "importance_ranks",
    f"SELECT series_id, feature, regime, place, rank_changes, {fixed('importance')} FROM p JOIN c USING (series_id, feature)",
    sh=ATTRIBUTIONS,
    imp=IMPORTANCE,
    p="SELECT *, rank() OVER (PARTITION BY series_id, regime ORDER BY importance DESC) AS place FROM imp",
    c="SELECT series_id, feature, count(DISTINCT place) > 1 AS rank_changes FROM p WHERE regime <> 'all' GROUP BY 1, 2",
)
def _(m: Market):
    shap = m.dataset.select("series_id", "d", (F.col("vix_level") - 20).alias("shap_vix_level"), (F.col("cboe_skew") - 150).alias("shap_cboe_skew"), (100 * F.col("vrp_h1m")).alias("shap_vrp_h1m"))
    table = boosting.mean_attributions(shap, m.dataset, ("vix_level", "cboe_skew", "vrp_h1m"))
    return boosting.importance_ranks(table)


def _nulls(m: Market) -> DataFrame:
    """Every generator fitted to every series."""
    return written(nullgen.fitted(nullgen.observed_bundles(m.vrp, m.dataset, m.outcomes, m.cut)), "nulls")


@query("generator_gate")
def _(m: Market):
    return nullgen.gate(_nulls(m), m.cfg)


@query("null_bootstrap")
def _(m: Market):
    return nullgen.null_p_values(nullgen.null_draws(_nulls(m), m.cfg))


@query(
    "daily_bars",
    f"SELECT event_type AS series_id, CAST(ts AS DATE) AS d, count(*) AS n, {fixed('open=min((ts, value))[2]', 'close=max((ts, value))[2]', 'high=max(value)', 'low=min(value)')} FROM events WHERE value IS NOT NULL GROUP BY 1, 2",
)
def _(m: Market):
    ticks = m.spark.read.parquet(f"{m.dir}/events.parquet").select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price")).where("price IS NOT NULL")
    return closes.daily_bars(ticks)
