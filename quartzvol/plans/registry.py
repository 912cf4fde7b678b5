"""All queries of the engine's own operators, by name, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import compare, premium, score, series, trading, walkforward
from . import sql as Q
from .market import CONFIG, Market, shared_market

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PLACES = 7
PAIRS = [("constant", "har"), ("constant", "extended_ols"), ("har", "extended_ols"), ("extended_ols", "regime_switching"), ("constant", "regime_switching"), ("har", "regime_switching")]
WINDOWS = (("1998 first half", "1998-01-01", "1998-06-30"), ("1999-03", "1999-03-01", "1999-03-31"), ("2005", "2005-01-01", "2005-12-31"))


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to a fixed number of places, so that sums in another order compare equal."""
    return df.select(*[(F.round(c, PLACES) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def fixed(*columns: str) -> str:
    """SQL of ``rounded`` for the named columns; ``name=expression`` gives an expression."""
    parts = [c.partition("=") for c in columns]
    return ", ".join(f"round(CAST({e or n} AS DOUBLE), {PLACES}) + 0.0 AS {n}" for n, _, e in parts)


def query(name: str, sql: str | None = None, **pieces: str):
    def register(build: Callable[[Market], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(build(shared_market(spark, sf_dir)))
        if sql is not None:
            ORACLE_SQL[name] = Q.query(sql, **pieces)
        return build

    return register


# Series


@query("log_returns", f"SELECT series_id, d, rn, {fixed('r')} FROM ret")
def _(m: Market):
    return m.returns.select("series_id", "d", F.col("rn").cast("long").alias("rn"), "r")


@query("realised_vol_21", f"SELECT series_id, d, {fixed('vol')} FROM v WHERE vol IS NOT NULL", v=f"SELECT series_id, d, {Q._gated('stddev_samp(r)', Q._back(21), 21)} * sqrt(252) * 100 AS vol FROM ret")
def _(m: Market):
    return series.realised_vol(m.returns, m.cfg).select("series_id", "d", "vol")


@query("fwd_realised_var", f"SELECT series_id, d, {fixed('target')} FROM days")
def _(m: Market):
    return series.forward_variance(m.returns, m.cfg).select("series_id", "d", "target")


@query("har_regressors", f"SELECT series_id, d, {fixed('x1', 'x2', 'x3')} FROM days")
def _(m: Market):
    return series.har_regressors(m.returns, m.cfg).select("series_id", "d", "x1", "x2", "x3")


@query("month_start", f"SELECT series_id, d, {fixed('close', 'vix', 'skew')} FROM mon")
def _(m: Market):
    return m.months.select("series_id", "d", "close", "vix", "skew")


@query("regime_labels", f"SELECT series_id, d, {Q._regime('vix')} AS regime FROM snap")
def _(m: Market):
    return m.daily.select("series_id", "d", S.regime(F.col("vix"), m.cfg).alias("regime"))


@query("realised_skew", f"SELECT series_id, d, {fixed('skew_21d')} FROM days WHERE skew_21d IS NOT NULL")
def _(m: Market):
    return series.trailing_skew(m.returns, m.cfg).where("skew_21d IS NOT NULL").select("series_id", "d", "skew_21d")


@query(
    "as_of_skew",
    f"SELECT a.series_id, a.d, {fixed('skew_21d=(SELECT max_by(b.skew_21d, b.d) FROM days b WHERE b.series_id = a.series_id AND b.d <= a.d AND b.skew_21d IS NOT NULL)')} FROM firsts a",
    firsts="SELECT DISTINCT series_id, CAST(date_trunc('month', d) AS DATE) AS d FROM snap",
)
def _(m: Market):
    firsts = m.daily.select("series_id", F.trunc("d", "month").alias("d")).distinct()
    return series.as_of(firsts, series.trailing_skew(m.returns, m.cfg), "skew_21d").select("series_id", "d", "skew_21d")


@query("expanding_median", f"SELECT series_id, d, {fixed('med=median(close) OVER (PARTITION BY series_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} FROM mon")
def _(m: Market):
    return series.expanding_median(m.months, "close", "med").select("series_id", "d", "med")


@query("series_checks", "SELECT series_id, count(*) AS n, count(*) FILTER (close IS NULL) AS n_missing, count(*) - count(DISTINCT d) AS n_repeated FROM snap GROUP BY 1")
def _(m: Market):
    return series.validate_series(m.daily, "close")


@query(
    "block_starts",
    "SELECT series_id, pos, max(CASE WHEN coin THEN pos ELSE 0 END) OVER (PARTITION BY series_id ORDER BY pos) AS block_start FROM coins",
    coins="SELECT series_id, rn AS pos, (CAST(round(close) AS BIGINT) % 5 = 0) AS coin FROM ret",
)
def _(m: Market):
    coins = m.returns.select("series_id", F.col("rn").cast("long").alias("pos"), (F.round("close").cast("long") % 5 == 0).alias("coin"))
    return series.block_starts(coins).select("series_id", "pos", F.col("block_start").cast("long").alias("block_start"))


# Premium and dataset


@query("har_rv_forecast", f"SELECT series_id, d, {fixed('forecast')} FROM har")
def _(m: Market):
    return m.har


@query("vrp_series", f"SELECT series_id, d, {fixed('vrp')} FROM prem")
def _(m: Market):
    return m.vrp.select("series_id", "d", "vrp")


@query("feature_matrix", f"SELECT series_id, d, regime, {fixed(*Q.NUMERIC)} FROM feat")
def _(m: Market):
    return m.features.select("series_id", "d", "regime", *Q.NUMERIC)


@query("model_dataset", f"SELECT series_id, d, row, regime, {fixed(*Q.NUMERIC, 'y')} FROM ds")
def _(m: Market):
    return m.dataset.select("series_id", "d", F.col("row").cast("long").alias("row"), "regime", *Q.NUMERIC, "y")


@query("train_cut", "SELECT series_id, cut_day, cut FROM cut")
def _(m: Market):
    return m.cut.select("series_id", "cut_day", F.col("cut").cast("long").alias("cut"))


@query("frame_reconstruction", "SELECT 0 AS n_different")
def _(m: Market):
    """The dataset rebuilt from the premium path and the exogenous columns is the dataset."""
    rebuilt = premium.frame_from_premium(m.vrp.select("series_id", "d", "vrp"), m.dataset, m.cfg)
    return premium.reconstruction_differences(m.dataset, rebuilt.select(*m.dataset.columns)).agg(F.count("*").cast("int").alias("n_different"))


# Walk-forward


def _wf(name: str, model: str) -> None:
    @query(name, f"SELECT series_id, d, {fixed('y_true', 'y_pred')} FROM wf_{model}")
    def _(m: Market):
        return m.forecasts(model).select("series_id", "d", "y_true", "y_pred")


for _name, _model in (("wf_constant", "constant"), ("wf_har", "har"), ("wf_extended", "extended_ols"), ("wf_regime", "regime_switching")):
    _wf(_name, _model)


@query("wf_engine", f"SELECT series_id, d, {fixed('y_true', 'y_pred')} FROM wf_har")
def _(m: Market):
    """The general engine with a linear model on the premium's lags."""
    return walkforward.walk_forward(m.dataset, m.cut, m.cfg.vrp_columns, walkforward.factory(walkforward.LinearModel)).select("series_id", "d", "y_true", "y_pred")


@query(
    "regime_fallback",
    "SELECT series_id, d, regime, n AS n_regime, n < 14 AS fallback FROM b JOIN cut USING (series_id) WHERE row > cut",
    b="SELECT *, count(*) OVER (PARTITION BY series_id, regime ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM ds",
)
def _(m: Market):
    return walkforward.regime_fallbacks(m.dataset, m.cut, m.cfg)


@query(
    "cv_folds",
    """SELECT series_id, f AS fold, CAST(floor(24 + f * (n - 25) / 4.0) AS BIGINT) AS train_stop, CAST(floor(24 + (f + 1) * (n - 25) / 4.0) AS BIGINT) AS valid_stop
    FROM (SELECT series_id, count(*) AS n FROM ds GROUP BY 1), range(4) t(f) WHERE floor(24 + (f + 1) * (n - 25) / 4.0) > floor(24 + f * (n - 25) / 4.0)""",
)
def _(m: Market):
    sizes = m.dataset.groupBy("series_id").agg(F.count("*").alias("n"))
    k, low = m.cfg.cv_folds, m.cfg.cv_min_train
    at = lambda f: F.floor(low + f * (F.col("n") - 1 - low) / float(k))
    folds = sizes.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<long>")))
    return folds.select("series_id", "fold", at(F.col("fold")).alias("train_stop"), at(F.col("fold") + 1).alias("valid_stop")).where("valid_stop > train_stop")


# Scores

SCORE_SQL = f"""SELECT series_id, model, count(*) AS n_obs, count(*) FILTER (valid) AS n_valid, count(*) FILTER (NOT guard) AS n_guard_excluded,
    count(*) FILTER (guard AND NOT tail) AS n_tail_excluded, min(d) AS first_day, max(d) AS last_day,
    {fixed('qlike=avg(qlike)', 'mse=avg((y_true - y_pred) * (y_true - y_pred))', 'directional_accuracy=avg(CASE WHEN sign(y_true) = sign(y_pred) OR y_true = 0 OR y_pred = 0 THEN 1.0 ELSE 0.0 END)')}
    FROM obs{{where}} GROUP BY 1, 2"""


@query("scorecard_constant", SCORE_SQL.format(where=" WHERE model = 'constant'"))
def _(m: Market):
    return score.scorecard(m.observed("constant"))


@query("scorecard", SCORE_SQL.format(where=""))
def _(m: Market):
    return score.scorecard(m.obs)


@query("score_observations", f"SELECT series_id, model, d, regime, guard, tail, valid, {fixed('implied', 'realised', 'qlike')} FROM obs")
def _(m: Market):
    return m.obs.select("series_id", "model", "d", "regime", "guard", "tail", "valid", "implied", "realised", "qlike")


@query("guard_violations", f"SELECT series_id, model, d, {fixed('implied')} FROM obs WHERE NOT guard")
def _(m: Market):
    return score.guard_violations(m.obs)


@query(
    "diagnostics",
    f"""SELECT a.series_id, a.model, n_under, n_over, regime AS worst_regime, {fixed('mean_error', 'mae', 'rmse', 'r2', 'worst_mae=w')} FROM a JOIN b USING (series_id, model) WHERE k = 1""",
    a="""SELECT series_id, model, avg(y_pred - y_true) AS mean_error, avg(abs(y_pred - y_true)) AS mae, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse,
        1 - sum((y_pred - y_true) * (y_pred - y_true)) / nullif(var_pop(y_true) * count(*), 0) AS r2,
        count(*) FILTER (y_pred < y_true) AS n_under, count(*) FILTER (y_pred > y_true) AS n_over FROM obs GROUP BY 1, 2""",
    b="SELECT *, row_number() OVER (PARTITION BY series_id, model ORDER BY w DESC, regime) AS k FROM c",
    c="SELECT series_id, model, regime, avg(abs(y_pred - y_true)) AS w FROM obs GROUP BY 1, 2, 3",
)
def _(m: Market):
    return score.diagnostics(m.obs)


@query(
    "top_errors",
    f"SELECT series_id, model, place, d, regime, {fixed('abs_error')} FROM e WHERE place <= 5",
    e="SELECT *, abs(y_pred - y_true) AS abs_error, row_number() OVER (PARTITION BY series_id, model ORDER BY abs(y_pred - y_true) DESC, d) AS place FROM obs",
)
def _(m: Market):
    return score.largest_errors(m.obs, 5)


@query(
    "per_regime_qlike",
    f"SELECT series_id, model, regime, ord, coalesce(n, 0) AS n, {fixed('qlike')} FROM g LEFT JOIN h USING (series_id, model, regime)",
    g="SELECT DISTINCT series_id, model, r AS regime, k AS ord FROM obs, (VALUES ('calm', 0), ('normal', 1), ('stressed', 2), ('all_regimes', 3)) t(r, k)",
    h="SELECT series_id, model, coalesce(regime, 'all_regimes') AS regime, count(*) AS n, avg(qlike) AS qlike FROM obs JOIN common USING (series_id, d) GROUP BY GROUPING SETS ((series_id, model, regime), (series_id, model))",
)
def _(m: Market):
    return score.regime_losses(m.obs, m.cfg)


@query(
    "qlike_decomposition",
    f"""SELECT series_id, model, regime, count(*) AS n, max_day, {fixed('mean_qlike=avg(qlike)', 'median_qlike=median(qlike)', 'max_share=max(qlike) / sum(qlike)', 'mean_without_max=(sum(qlike) - max(qlike)) / nullif(count(*) - 1, 0)')}
    FROM z GROUP BY series_id, model, regime, max_day""",
    z="SELECT *, first_value(d) OVER (PARTITION BY series_id, model, regime ORDER BY qlike DESC, d) AS max_day FROM obs WHERE valid",
)
def _(m: Market):
    return score.loss_decomposition(m.obs)


@query("loss_ranks", f"SELECT series_id, model, d, loss_rank, {fixed('qlike', 'ratio')} FROM z", z="SELECT *, rank() OVER (PARTITION BY series_id, model ORDER BY qlike DESC) AS loss_rank, qlike / avg(qlike) OVER (PARTITION BY series_id, model) AS ratio FROM obs WHERE valid")
def _(m: Market):
    return score.loss_ranks(m.obs)


@query("top_losses", f"SELECT series_id, model, d, {fixed('qlike')} FROM (SELECT * FROM obs WHERE valid ORDER BY qlike DESC, series_id, model, d LIMIT 10)")
def _(m: Market):
    return score.top_losses(m.obs)


@query("plot_losses", f"SELECT series_id, d, model, {fixed('qlike')}, bool_or(NOT valid) OVER (PARTITION BY series_id, d) AS excluded FROM obs")
def _(m: Market):
    return score.plot_losses(m.obs)


@query(
    "spearman",
    f"SELECT series_id, count(*) AS n, {fixed('rho=corr(ra, rb)')} FROM z GROUP BY 1",
    z="""SELECT series_id, rank() OVER (PARTITION BY series_id ORDER BY vix_level) + (count(*) OVER (PARTITION BY series_id, vix_level) - 1) / 2.0 AS ra,
        rank() OVER (PARTITION BY series_id ORDER BY y) + (count(*) OVER (PARTITION BY series_id, y) - 1) / 2.0 AS rb FROM ds""",
)
def _(m: Market):
    return score.spearman(m.dataset, "vix_level", "y", "series_id")


# Comparisons


@query("pair_qlike", f"SELECT series_id, pair, count(*) AS n, {fixed('qlike_small=avg(q_small)', 'qlike_large=avg(q_large)')} FROM pairs GROUP BY 1, 2")
def _(m: Market):
    return compare.model_pairs(m.obs, PAIRS).groupBy("series_id", "pair").agg(F.count("*").alias("n"), F.avg("q_small").alias("qlike_small"), F.avg("q_large").alias("qlike_large"))


def _stat_sql(value: str, where: str, paired: bool) -> tuple[str, dict[str, str]]:
    """The test's statistic, its p by a series of its own, and what follows from both."""
    tie = "n >= 8 AND lrv <= 0 AND mean_diff = 0" if paired else "false"
    scale = " * sqrt((n - 1.0) / n)" if paired else ""
    stat = f"CASE WHEN {tie} THEN 0 WHEN n >= 8 AND lrv > 0 THEN mean_diff / sqrt(lrv / n){scale} END"
    p = f"CASE WHEN {tie} THEN 1 WHEN stat IS NOT NULL THEN {Q.t_two_sided('stat', '(n - 1)') if paired else Q.normal_tail('stat')} END"
    reason = f"CASE WHEN n < 8 THEN '{compare.SMALL_SAMPLE}' WHEN lrv <= 0 AND NOT ({tie}) THEN '{compare.NO_VARIANCE}' END AS reason"
    side = ", CASE WHEN p_value < 0.05 THEN CASE WHEN stat < 0 THEN 'model_a' ELSE 'model_b' END WHEN p_value IS NOT NULL THEN 'tie' END AS favoured" if paired else ""
    final = f"SELECT series_id, pair, regime, n, {reason}{side}, {fixed('mean_diff', 'lrv', 'stat', 'p_value')} FROM p"
    pieces = {"p": f"SELECT *, {p} AS p_value FROM t", "t": f"SELECT *, {stat} AS stat FROM s", "s": "SELECT series_id, pair, regime, count(*) AS n, avg(x) AS mean_diff, var_pop(x) AS lrv FROM x GROUP BY 1, 2, 3", "x": f"SELECT *, {value} AS x FROM pairx WHERE {where}"}
    return final, dict(reversed(pieces.items()))


_KEYS = ["series_id", "pair", "regime"]
_dm, _dm_own = _stat_sql("q_small - q_large", "true", True)
_cw, _cw_own = _stat_sql("realised / f_small - ln(realised / f_small) - (realised / f_large - ln(realised / f_large)) + f_small / f_large - ln(f_small / f_large) - 1", "nested", False)
_ms, _ms_own = _stat_sql("(y_true - y_small) ** 2 - (y_true - y_large) ** 2 + (y_small - y_large) ** 2", "nested", False)
_TESTED = (*_KEYS, "n", "reason", "mean_diff", "lrv", "stat", "p_value")


def _tested(df: DataFrame, *more: str) -> DataFrame:
    return df.withColumn("n", F.col("n").cast("long")).select(*_TESTED, *more)


@query("dm_stat", _dm, **_dm_own)
def _(m: Market):
    x = compare.ordered_values(compare.with_total(compare.model_pairs(m.obs, PAIRS)), F.col("q_small") - F.col("q_large"), _KEYS)
    return _tested(compare.diebold_mariano(x), "favoured")


@query("cw_stat_qlike", _cw, **_cw_own)
def _(m: Market):
    rows = compare.with_total(compare.model_pairs(m.obs, PAIRS)).where("nested")
    return _tested(compare.clark_west(compare.ordered_values(rows, compare.qlike_difference(F.col("realised"), F.col("f_small"), F.col("f_large")), _KEYS)))


@query("cw_stat_mspe", _ms, **_ms_own)
def _(m: Market):
    rows = compare.with_total(compare.model_pairs(m.obs, PAIRS)).where("nested")
    return _tested(compare.clark_west(compare.ordered_values(rows, compare.mspe_difference(F.col("y_true"), F.col("y_small"), F.col("y_large")), _KEYS)))


_LAGGED = "SELECT a.series_id, a.pair, b.i - a.i AS k, sum(a.c * b.c) AS p FROM c a JOIN c b ON a.series_id = b.series_id AND a.pair = b.pair AND b.i BETWEEN a.i AND a.i + 4 GROUP BY 1, 2, 3"


@query(
    "dm_stat_lagged",
    f"SELECT series_id, pair, n, {fixed('mean_diff', 'lrv', 'stat', 'p_value=' + Q.t_two_sided('stat', '(n - 1)'))} FROM t",
    x="SELECT series_id, pair, d, q_small - q_large AS x FROM pairs",
    c="SELECT *, x - avg(x) OVER (PARTITION BY series_id, pair) AS c, row_number() OVER (PARTITION BY series_id, pair ORDER BY d) AS i FROM x",
    s="SELECT series_id, pair, count(*) AS n, avg(x) AS mean_diff FROM c GROUP BY 1, 2",
    g=_LAGGED,
    v="SELECT series_id, pair, n, mean_diff, sum(CASE WHEN k = 0 THEN p WHEN k <= 2 THEN 2 * p ELSE 0 END) / n AS lrv FROM s JOIN g USING (series_id, pair) GROUP BY series_id, pair, n, mean_diff",
    t="SELECT *, CASE WHEN n >= 8 AND lrv > 0 THEN mean_diff / sqrt(lrv / n) * sqrt((n - 5 + 6.0 / n) / n) END AS stat FROM v",
)
def _(m: Market):
    """Horizon three: two lags of autocovariance and the small-sample factor."""
    x = compare.ordered_values(compare.model_pairs(m.obs, PAIRS), F.col("q_small") - F.col("q_large"), ["series_id", "pair"])
    out = compare.diebold_mariano(x, horizon=3)
    return out.select("series_id", "pair", F.col("n").cast("long").alias("n"), "mean_diff", "lrv", "stat", "p_value")


@query(
    "cw_corrected_stat",
    f"SELECT series_id, pair, n, lag, {fixed('mean_diff', 'lrv', 'stat=CASE WHEN n >= 8 AND lrv > 0 THEN mean_diff / sqrt(lrv / n) END')} FROM t",
    x="""SELECT series_id, pair, d, realised / f_small - ln(realised / f_small) - (realised / f_large - ln(realised / f_large)) + 0.5::DOUBLE * realised / f_small * (ln(f_small) - ln(f_large)) ** 2 AS x FROM pairs WHERE nested""",
    c="SELECT *, x - avg(x) OVER (PARTITION BY series_id, pair) AS c, row_number() OVER (PARTITION BY series_id, pair ORDER BY d) AS i FROM x",
    s="SELECT series_id, pair, count(*) AS n, avg(x) AS mean_diff, CAST(floor(4 * (count(*) / 100.0) ** (2 / 9.0)) AS INTEGER) AS lag FROM c GROUP BY 1, 2",
    g="SELECT a.series_id, a.pair, b.i - a.i AS k, sum(a.c * b.c) AS p FROM c a JOIN c b ON a.series_id = b.series_id AND a.pair = b.pair AND b.i BETWEEN a.i AND a.i + 12 GROUP BY 1, 2, 3",
    t="SELECT series_id, pair, n, lag, mean_diff, sum(CASE WHEN k = 0 THEN p WHEN k <= lag THEN 2 * (1 - k / (lag + 1.0)) * p ELSE 0 END) / n AS lrv FROM s JOIN g USING (series_id, pair) GROUP BY series_id, pair, n, lag, mean_diff",
)
def _(m: Market):
    rows = compare.model_pairs(m.obs, PAIRS).where("nested")
    x = compare.ordered_values(rows, S.corrected_differential(F.col("realised"), F.col("f_small"), F.col("f_large"), m.cfg), ["series_id", "pair"])
    return compare.corrected_clark_west(x, m.cfg).select("series_id", "pair", F.col("n").cast("long").alias("n"), "lag", "mean_diff", "lrv", "stat")


@query(
    "regime_pair_table",
    f"SELECT series_id, pair, nested, regime, n, winner, n < 50 AS low_power, direction, coalesce(direction <> 'none' AND direction <> winner, false) AS conflict, {fixed('qlike_small', 'qlike_large', 'stat', 'p_value')} FROM w",
    x="""SELECT *, CASE WHEN nested THEN realised / f_small - ln(realised / f_small) - (realised / f_large - ln(realised / f_large)) + f_small / f_large - ln(f_small / f_large) - 1 ELSE q_small - q_large END AS x FROM pairx""",
    s="SELECT series_id, pair, nested, regime, count(*) AS n, avg(q_small) AS qlike_small, avg(q_large) AS qlike_large, avg(x) AS mean, var_pop(x) AS v FROM x GROUP BY 1, 2, 3, 4",
    u="""SELECT *, CASE WHEN qlike_small < qlike_large THEN 'small' WHEN qlike_large < qlike_small THEN 'large' ELSE 'none' END AS winner,
        CASE WHEN n >= 8 AND v > 0 THEN mean / sqrt(v / n) * CASE WHEN nested THEN 1 ELSE sqrt((n - 1.0) / n) END END AS stat FROM s""",
    p=f"SELECT *, CASE WHEN stat IS NOT NULL THEN CASE WHEN nested THEN {Q.normal_tail('stat')} ELSE {Q.t_two_sided('stat', '(n - 1)')} END END AS p_value FROM u",
    w="""SELECT *, CASE WHEN p_value IS NULL THEN NULL WHEN p_value >= 0.05 THEN 'none' WHEN nested OR stat > 0 THEN 'large' ELSE 'small' END AS direction FROM p""",
)
def _(m: Market):
    table = compare.regime_pair_table(m.obs, PAIRS, m.cfg)
    return table.select("series_id", "pair", "nested", "regime", F.col("n").cast("long").alias("n"), "winner", "low_power", "direction", "conflict", "qlike_small", "qlike_large", "stat", "p_value")


@query("regime_pair_bootstrap")
def _(m: Market):
    return compare.regime_pair_table(m.obs, PAIRS, m.cfg, with_bootstrap=True)


@query("block_bootstrap")
def _(m: Market):
    rows = compare.model_pairs(m.obs, PAIRS).where("nested")
    x = compare.ordered_values(rows, compare.qlike_difference(F.col("realised"), F.col("f_small"), F.col("f_large")), ["series_id", "pair"])
    return compare.block_bootstrap(x)


@query(
    "acf",
    f"SELECT series_id, lag, {fixed('acf=p / p0')} FROM h JOIN z USING (series_id)",
    c="SELECT series_id, vrp - avg(vrp) OVER (PARTITION BY series_id) AS c, row_number() OVER (PARTITION BY series_id ORDER BY d) AS i FROM prem",
    z="SELECT series_id, sum(c * c) AS p0 FROM c GROUP BY 1",
    h="SELECT a.series_id, b.i - a.i AS lag, sum(a.c * b.c) AS p FROM c a JOIN c b ON a.series_id = b.series_id AND b.i - a.i IN (1, 3, 6, 12) GROUP BY 1, 2",
)
def _(m: Market):
    return compare.acf(compare.ordered_values(m.vrp, F.col("vrp"), ["series_id"]), m.cfg.acf_lags)


MZ_PIECES = {
    "mz": """SELECT series_id, d, regime, realised, forecast FROM (SELECT h.series_id, h.d, vix * vix / 10000 - (vix * vix / 10000 - forecast) AS forecast, forecast AS f0, realised,
        CASE WHEN vix < 15 THEN 'calm' WHEN vix > 25 THEN 'stressed' ELSE 'normal' END AS regime FROM har h JOIN outc USING (series_id, d)) WHERE realised IS NOT NULL""",
    "mzx": "SELECT * FROM mz UNION ALL SELECT * REPLACE ('full' AS regime) FROM mz",
    "fit": "SELECT series_id, regime, count(*) AS n, avg(forecast) AS mx, avg(realised) AS my, covar_pop(realised, forecast) / nullif(var_pop(forecast), 0) AS beta, var_pop(forecast) AS vx, corr(forecast, realised) ** 2 AS r2, CAST(floor(4 * (count(*) / 100.0) ** (2 / 9.0)) AS INTEGER) AS lag FROM mzx GROUP BY 1, 2",
    "sc": """SELECT series_id, regime, realised - my - beta * (forecast - mx) AS e, forecast - mx AS x, row_number() OVER (PARTITION BY series_id, regime ORDER BY d) AS i FROM mzx JOIN fit USING (series_id, regime) WHERE n >= 3""",
    "cr": """SELECT a.series_id, a.regime, b.i - a.i AS k, sum(a.e * b.e) AS p00, sum(a.e * b.e * b.x + b.e * a.e * a.x) / 2 AS p01, sum(a.e * a.x * b.e * b.x) AS p11
        FROM sc a JOIN sc b ON a.series_id = b.series_id AND a.regime = b.regime AND b.i BETWEEN a.i AND a.i + 12 GROUP BY 1, 2, 3""",
    "hac": """SELECT series_id, regime, sum(w * p00) / (n * n) AS v00, sum(w * p01) / (n * n * vx) AS v01, sum(w * p11) / (n * vx * n * vx) AS v11 FROM
        (SELECT c.*, n, vx, CASE WHEN k = 0 THEN 1 WHEN k <= lag THEN 2 * (1 - k / (lag + 1.0)) ELSE 0 END AS w FROM cr c JOIN fit USING (series_id, regime)) GROUP BY series_id, regime, n, vx""",
    "res": """SELECT f.*, my - beta * mx AS intercept, ((my - mx) ** 2 * v11 - 2 * (my - mx) * (beta - 1) * v01 + (beta - 1) ** 2 * v00) / nullif(v00 * v11 - v01 * v01, 0) AS wald,
        sqrt(v00 - 2 * mx * v01 + mx * mx * v11) AS se_intercept, sqrt(v11) AS se_beta FROM fit f LEFT JOIN hac USING (series_id, regime)""",
}


@query("mz_regression", f"SELECT series_id, regime, n, lag, {fixed('intercept', 'beta', 'se_intercept', 'se_beta', 'wald', 'wald_p=exp(-wald / 2)')} FROM res WHERE n >= 3", **MZ_PIECES)
def _(m: Market):
    rows = m.vrp.select("series_id", "d", "vix", F.col("forecast")).join(m.outcomes.select("series_id", "d", "realised"), ["series_id", "d"])
    rows = compare.with_total(rows.withColumn("regime", S.regime(F.col("vix"), m.cfg)), label="full")
    out = compare.mincer_zarnowitz(rows, ["series_id", "regime"], m.cfg).where("n >= 3")
    return out.select("series_id", "regime", "n", "lag", "intercept", "beta", "se_intercept", "se_beta", "wald", "wald_p")


@query(
    "ar1_fit",
    f"SELECT series_id, {fixed('phi=regr_slope(y, x)', 'level=regr_intercept(y, x)')} FROM z GROUP BY 1",
    z="SELECT series_id, vrp AS y, lag(vrp) OVER (PARTITION BY series_id ORDER BY d) AS x FROM prem",
)
def _(m: Market):
    rows = m.vrp.select("series_id", F.col("vrp").alias("y"), F.lag("vrp").over(series.ordered()).alias("x"))
    return rows.groupBy("series_id").agg(F.regr_slope("y", "x").alias("phi"), F.regr_intercept("y", "x").alias("level"))


# Trading


def _pnl(m: Market) -> DataFrame:
    rows = m.observed("har").select("series_id", "d", F.col("y_pred").alias("forecast"), "regime")
    return trading.profit_and_loss(trading.positions(rows, m.cfg), m.outcomes, m.cfg)


@query("positions", "SELECT series_id, d, position_naive, position_conditioned FROM pos")
def _(m: Market):
    rows = m.observed("har").select("series_id", "d", F.col("y_pred").alias("forecast"), "regime")
    return trading.positions(rows, m.cfg).select("series_id", "d", "position_naive", "position_conditioned")


_NETS = tuple(f"net_{s}_{c}" for s in ("naive", "conditioned") for c in ("base", "stress"))


@query("pnl", f"SELECT series_id, d, {fixed('strike', 'realised', 'gross_naive', 'gross_conditioned', *_NETS)} FROM pnl")
def _(m: Market):
    return _pnl(m).select("series_id", "d", "strike", "realised", "gross_naive", "gross_conditioned", *_NETS)


@query(
    "tail_metrics",
    f"""SELECT series_id, strategy, cost, count(*) AS n_months, CAST(sum(position) AS BIGINT) AS n_held, {fixed('total_net=sum(net)', 'annual_mean=avg(net) * 12', 'annual_vol=stddev_samp(net) * sqrt(12)',
    'sharpe=sqrt(12) * avg(net) / nullif(stddev_samp(net), 0)', 'skew=skewness(net)', 'worst_month=min(net)', 'worst_rolling=min(rolling)', 'max_drawdown=max(underwater)', 'hit_rate=avg(CASE WHEN position = 1 THEN CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END END)')}
    FROM under GROUP BY 1, 2, 3""",
)
def _(m: Market):
    return trading.tail_metrics(_pnl(m), m.cfg)


@query(
    "episodes",
    f"SELECT series_id, label, from_day, n_months, flat_net, {fixed(*_NETS)} FROM (SELECT * FROM named UNION ALL SELECT * FROM single)",
    win="SELECT * FROM (VALUES ('1998 first half', DATE '1998-01-01', DATE '1998-06-30'), ('1999-03', DATE '1999-03-01', DATE '1999-03-31'), ('2005', DATE '2005-01-01', DATE '2005-12-31')) t(label, a, b)",
    named=f"SELECT s.series_id, label, a AS from_day, count(p.d) AS n_months, 0.0::DOUBLE AS flat_net, {', '.join(f'coalesce(sum({c}), 0) AS {c}' for c in _NETS)} FROM (SELECT DISTINCT series_id FROM pnl) s JOIN win ON true LEFT JOIN pnl p ON p.series_id = s.series_id AND p.d BETWEEN a AND b GROUP BY 1, 2, 3",
    single=f"SELECT series_id, 'spike ' || strftime(d, '%Y-%m') AS label, d AS from_day, 1 AS n_months, 0.0::DOUBLE AS flat_net, {', '.join(_NETS)} FROM pnl WHERE vix > 34 AND NOT EXISTS (SELECT 1 FROM win WHERE d BETWEEN a AND b)",
)
def _(m: Market):
    from dataclasses import replace

    return trading.episodes(_pnl(m), WINDOWS, replace(m.cfg, spike_level=34.0)).select("series_id", "label", "from_day", "n_months", "flat_net", *_NETS)


@query(
    "strategy_totals",
    f"SELECT series_id, strategy, cost, {fixed('total_net=sum(net)')}, CAST(sum(position) AS BIGINT) AS n_held, CAST(sum(moved) AS BIGINT) AS n_moves FROM z GROUP BY 1, 2, 3",
    z="SELECT *, abs(position - coalesce(lag(position) OVER (PARTITION BY series_id, strategy, cost ORDER BY d), 0)) AS moved FROM arms",
)
def _(m: Market):
    return trading.totals(_pnl(m))


def _ratio(s: str, q: str, n: str) -> str:
    return f"(CASE WHEN ({q}) - ({s}) * ({s}) / ({n}) > 0 THEN sqrt(12) * (({s}) / ({n})) / sqrt((({q}) - ({s}) * ({s}) / ({n})) / (({n}) - 1)) END)"


@query(
    "sharpe_jackknife",
    f"SELECT series_id, cost, d, n, {fixed('full=whole', 'loo', 'pseudo=n * whole - (n - 1) * loo')} FROM k WHERE n > 2",
    ab="SELECT series_id, d, 'base' AS cost, net_conditioned_base AS a, net_naive_base AS b FROM pnl UNION ALL SELECT series_id, d, 'stress', net_conditioned_stress, net_naive_stress FROM pnl",
    t="SELECT *, count(*) OVER w AS n, sum(a) OVER w AS sa, sum(a * a) OVER w AS qa, sum(b) OVER w AS sb, sum(b * b) OVER w AS qb FROM ab WINDOW w AS (PARTITION BY series_id, cost)",
    k=f"SELECT *, {_ratio('sa', 'qa', 'n')} - {_ratio('sb', 'qb', 'n')} AS whole, {_ratio('sa - a', 'qa - a * a', 'n - 1')} - {_ratio('sb - b', 'qb - b * b', 'n - 1')} AS loo FROM t",
)
def _(m: Market):
    return trading.sharpe_jackknife(_pnl(m), m.cfg)
