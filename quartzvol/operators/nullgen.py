"""Null generators fitted to an observed premium, their autocorrelation gate, and the bootstrap over simulated paths.

An observed bundle is one small table a series (months); it is packed into one
row, fitted once for each generator, and dealt out with slices of draws; a
draw's seed is its number. A draw whose simulation or refit fails numerically counts as
failed; any other error stops the run.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from .simulation import newey_west_lag, studentised
from .walkforward import RunningOls

#: Largest orders for exogenous series (by AIC) and for residuals (by BIC).
EXOGENOUS_ORDERS, RESIDUAL_ORDERS = (4, 2), (2, 2)
FAILURES = (ValueError, np.linalg.LinAlgError)


def arma_errors(z: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    u = z.copy()
    for i, c in enumerate(phi, 1):
        u[i:] -= c * z[:-i]
    if not len(theta):
        return u
    e = np.zeros(len(u) + len(theta))
    back = theta[::-1]
    for t in range(len(u)):
        e[t + len(theta)] = u[t] - back @ e[t : t + len(theta)]
    return e[len(theta) :]


def spectral_radius(coefficients: dict[int, float]) -> float:
    """Largest root of the recursion with the given coefficients by lag; below 1 it is stationary."""
    order = max(coefficients, default=0)
    if not order:
        return 0.0
    companion = np.eye(order, k=-1)
    for lag, c in coefficients.items():
        companion[0, lag - 1] = c
    return float(np.abs(np.linalg.eigvals(companion)).max())


@dataclass
class Arma:
    mean: float
    phi: np.ndarray
    theta: np.ndarray
    resid: np.ndarray
    criterion: float

    def simulate(self, n: int, rng: np.random.Generator, burn_in: int = DEFAULT.burn_in) -> np.ndarray:
        """A path about zero from resampled innovations."""
        e = rng.choice(self.resid, size=n + burn_in)
        out = np.zeros(n + burn_in)
        for t in range(n + burn_in):
            out[t] = e[t] + sum(c * out[t - i] for i, c in enumerate(self.phi, 1) if t >= i) + sum(c * e[t - j] for j, c in enumerate(self.theta, 1) if t >= j)
        return out[burn_in:]


def fit_arma(x: np.ndarray, p: int, q: int, rounds: int = 25) -> Arma | None:
    """Conditional least squares by Gauss-Newton; None where the result is not stationary and invertible."""
    mean = x.mean()
    z = x - mean
    params = np.zeros(p + q)

    def errors(v: np.ndarray) -> np.ndarray:
        return arma_errors(z, v[:p], v[p:])

    e = errors(params)
    for _ in range(rounds if p + q else 0):
        step = 1e-5
        jac = np.stack([(errors(params + step * row) - e) / step for row in np.eye(p + q)], axis=1)
        move, size, moved = np.linalg.lstsq(jac, -e, rcond=None)[0], 1.0, False
        while size > 1e-3 and not moved:
            trial = params + size * move
            roots = max(spectral_radius({i: c for i, c in enumerate(part, 1)}) for part in (trial[:p], -trial[p:]))
            got = errors(trial) if roots < 0.999 else None
            moved = got is not None and got @ got < e @ e
            size /= 2
        if not moved:
            break
        gain = 1 - (got @ got) / (e @ e)
        params, e = trial, got
        if gain < 1e-9:
            break
    return Arma(mean, params[:p], params[p:], e - e.mean(), np.inf)


def best_arma(x: np.ndarray, orders: tuple[int, int], rule: str) -> Arma:
    """The order with the smallest AIC or BIC (smaller orders first on ties)."""
    n, best = len(x), None
    for p in range(orders[0] + 1):
        for q in range(orders[1] + 1):
            fit = fit_arma(x, p, q)
            weight = 2.0 if rule == "aic" else np.log(n)
            fit.criterion = n * np.log(max(fit.resid @ fit.resid / n, 1e-300)) + weight * (p + q + 1)
            best = fit if best is None or fit.criterion < best.criterion - 1e-9 else best
    return best


@dataclass
class Observed:
    """One series: its whole premium path, and the dataset's rows with their places on that path."""

    vrp: np.ndarray
    place: np.ndarray
    exogenous: np.ndarray
    vix_next: np.ndarray
    realised: np.ndarray
    y: np.ndarray
    cut: int
    lags: tuple[int, ...] = (0, 2, 5)

    def features(self, path: np.ndarray, exogenous: np.ndarray | None = None) -> np.ndarray:
        """Exogenous columns, then the path's lags, at the dataset's places."""
        lagged = np.stack([path[self.place - k] for k in self.lags], axis=1)
        return np.concatenate([self.exogenous if exogenous is None else exogenous, lagged], axis=1)

    def target(self, path: np.ndarray) -> np.ndarray:
        return path[self.place + 1]


@dataclass
class Generator:
    """A null fitted to an observed series; ``simulate`` gives a premium path and exogenous columns (or None for the observed)."""

    observed: Observed
    spec: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        """Subclasses fit ``spec`` here."""

    def simulate(self, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray | None]:
        raise NotImplementedError


class ConstantNull(Generator):
    """The premium is its level plus independent residuals."""

    def __post_init__(self) -> None:
        level = self.observed.vrp.mean()
        self.spec = {"level": level, "resid": self.observed.vrp - level}

    def simulate(self, rng):
        return self.spec["level"] + rng.choice(self.spec["resid"], size=len(self.observed.vrp)), None


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    design = np.column_stack([np.ones(len(y)), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    return beta, y - design @ beta


class HarNull(Generator):
    """The premium follows its own lags with ARMA shocks; exogenous series follow their own ARMA models."""

    def __post_init__(self) -> None:
        o = self.observed
        beta, resid = _ols(o.features(o.vrp)[:, o.exogenous.shape[1] :], o.target(o.vrp))
        by_lag = {k + 1: float(b) for k, b in zip(o.lags, beta[1:], strict=True)}
        self.spec = {"const": float(beta[0]), "by_lag": by_lag, "radius": spectral_radius(by_lag), "shocks": best_arma(resid, RESIDUAL_ORDERS, "bic"), "exogenous": [best_arma(c, EXOGENOUS_ORDERS, "aic") for c in o.exogenous.T]}

    def simulate(self, rng):
        o, s = self.observed, self.spec
        n, start = len(o.vrp), max(s["by_lag"])
        shocks = s["shocks"].simulate(n, rng)
        path = o.vrp.copy()
        for t in range(start, n):
            path[t] = s["const"] + sum(b * path[t - k] for k, b in s["by_lag"].items()) + shocks[t]
        return path, np.column_stack([f.mean + f.simulate(len(o.place), rng) for f in s["exogenous"]])


class PooledNull(Generator):
    """The premium follows the pooled equation with observed exogenous columns; places without them keep their observed value."""

    def __post_init__(self) -> None:
        o = self.observed
        beta, resid = _ols(o.features(o.vrp), o.target(o.vrp))
        self.spec = {"beta": beta, "shocks": best_arma(resid, RESIDUAL_ORDERS, "bic")}

    def simulate(self, rng):
        o, beta, k = self.observed, self.spec["beta"], self.observed.exogenous.shape[1]
        path, shocks = o.vrp.copy(), self.spec["shocks"].simulate(len(o.place), rng)
        for i, t in enumerate(o.place):
            lagged = [path[t - lag] for lag in o.lags]
            path[t + 1] = beta[0] + o.exogenous[i] @ beta[1 : k + 1] + np.dot(lagged, beta[k + 1 :]) + shocks[i]
        return path, None


GENERATORS = {"constant": ConstantNull, "har": HarNull, "pooled": PooledNull}


def expanding_forecasts(x: np.ndarray, y: np.ndarray, cut: int) -> np.ndarray:
    """Forecasts after the cut; no columns means the expanding mean."""
    fit, out = RunningOls(x.shape[1]), []
    for i in range(len(y)):
        if i > cut:
            out.append(fit.predict(x[i]))
        fit.add(x[i], y[i])
    return np.array(out)


def draw_statistic(o: Observed, path: np.ndarray, exogenous: np.ndarray | None, pair: str, cfg: EngineConfig = DEFAULT) -> float:
    """Corrected Clark-West statistic of a pair refitted on a (simulated) path; ValueError where too little is valid."""
    x, y, k = o.features(path, exogenous), o.target(path), o.exogenous.shape[1]
    columns = {"constant": (x[:, :0], x[:, k:]), "har": (x[:, k:], x), "pooled": (x[:, k:], x)}[pair]
    small, large = (o.vix_next[o.cut + 1 :] ** 2 / cfg.variance_scale - expanding_forecasts(c, y, o.cut) for c in columns)
    realised = o.realised[o.cut + 1 :] + (o.y - y)[o.cut + 1 :]
    ok = (small > 0) & (large > 0) & np.isfinite(realised) & (realised > 0)
    if ok.sum() < cfg.min_paired:
        raise ValueError("too few valid months")
    s, b, r = small[ok], large[ok], realised[ok]
    d = (r / s - np.log(r / s)) - (r / b - np.log(r / b)) + cfg.cw_scale * r / s * np.square(np.log(s) - np.log(b))
    if newey_west_lag(len(d)) >= len(d):
        raise ValueError("too few months for the lag")
    return float(studentised(d[None])[0])


def observed_bundles(vrp: DataFrame, dataset: DataFrame, outcomes: DataFrame, cut: DataFrame) -> DataFrame:
    """(series_id, bundle): the pickled bundle of every series of ``dataset``; each holds months, so it is small."""
    fields = ["d", "y", "vix_level", "cboe_skew", "realised_skew_21d", "vix_next", "realised_next"]
    pack = lambda df, names, to: df.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias(to))
    rows = dataset.join(outcomes.select("series_id", "d", "vix_next", "realised_next"), ["series_id", "d"], "left")
    packs = pack(vrp, ["d", "vrp"], "path").join(pack(rows, fields, "pack"), "series_id").join(cut.select("series_id", "cut"), "series_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for series, path, rows, last in zip(batch["series_id"], batch["path"], batch["pack"], batch["cut"], strict=True):
                path, rows = pd.DataFrame(list(path), columns=["d", "vrp"]), pd.DataFrame(list(rows), columns=fields)
                where = dict(zip(path["d"], path.index, strict=True))
                number = lambda *c, rows=rows: rows[list(c)].to_numpy(float)
                seen = Observed(path["vrp"].to_numpy(float), rows["d"].map(where).to_numpy(), number(*fields[2:5]), number("vix_next")[:, 0], number("realised_next")[:, 0], number("y")[:, 0], int(last))
                out.append((series, pickle.dumps(seen)))
            yield pd.DataFrame(out, columns=["series_id", "bundle"])

    return packs.mapInPandas(run, "series_id string, bundle binary")


def fitted(bundles: DataFrame) -> DataFrame:
    """(series_id, generator, model): every generator fitted to every bundle, pickled."""
    parts = int(bundles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = bundles.withColumn("generator", F.explode(F.array(*[F.lit(g) for g in GENERATORS]))).repartition(parts, "series_id", "generator")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            models = [pickle.dumps(GENERATORS[g](pickle.loads(b))) for g, b in zip(batch["generator"], batch["bundle"], strict=True)]
            yield batch[["series_id", "generator"]].assign(model=models)

    return work.mapInPandas(run, "series_id string, generator string, model binary")


def _numbered(models: DataFrame, n: int, per_task: int) -> DataFrame:
    """Models beside the first number of each slice of ``n`` trials or draws, a task a slice."""
    firsts = F.sequence(F.lit(0), F.lit(n - 1), F.lit(per_task))
    parts = int(models.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return models.withColumn("first", F.explode(firsts)).repartition(4 * parts, "series_id", "generator", "first")


def _generator_of(seed: int, number: int) -> np.random.Generator:
    return np.random.default_rng(np.random.SeedSequence(seed, spawn_key=(number,)))


def _acf(path: np.ndarray, k: int) -> float:
    c = path - path.mean()
    return float(c[k:] @ c[:-k] / (c @ c))


def trials(models: DataFrame, cfg: EngineConfig = DEFAULT, per_task: int = 25) -> DataFrame:
    """Autocorrelations of simulated paths beside the observed one: (series_id, generator, trial, lag, acf, observed_acf, n)."""
    columns = ["series_id", "generator", "trial", "lag", "acf", "observed_acf", "n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for series, name, model, first in batch[["series_id", "generator", "model", "first"]].itertuples(index=False):
                model = pickle.loads(model)
                seen = model.observed.vrp
                for trial in range(first, min(first + per_task, cfg.gate_trials)):
                    path, _ = model.simulate(_generator_of(cfg.bootstrap_seed, trial))
                    out += [(series, name, trial, k, _acf(path, k), _acf(seen, k), len(seen)) for k in cfg.acf_lags]
            yield pd.DataFrame(out, columns=columns)

    return _numbered(models, cfg.gate_trials, per_task).mapInPandas(run, "series_id string, generator string, trial long, lag int, acf double, observed_acf double, n int")


def gate(models: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Per series, generator and lag whether it passes: the constant null's mean lies within the white-noise band, others' trials near the observed value."""
    out = trials(models, cfg).groupBy("series_id", "generator", "lag").agg(F.avg("acf").alias("mean_acf"), F.stddev_samp("acf").alias("sd_acf"), F.max("observed_acf").alias("observed_acf"), F.max("n").alias("n"))
    # Paths that hardly differ (few months drawn) tell nothing; their spread is rounding.
    out = out.withColumn("z", F.when(F.col("sd_acf") > 1e-12, (F.col("observed_acf") - F.col("mean_acf")) / F.col("sd_acf")))
    passed = F.when(F.col("generator") == "constant", F.abs("mean_acf") <= 2.0 / F.sqrt("n")).otherwise(F.abs("z") <= cfg.gate_z)
    return out.withColumn("passed", passed).drop("n")


def null_draws(models: DataFrame, cfg: EngineConfig = DEFAULT, per_task: int = 100) -> DataFrame:
    """(series_id, generator, draw, stat): each generator's pair on each of ``cfg.bootstrap_draws`` simulated paths, NULL for a failed draw.

    Draw -1 is the statistic of the observed path.
    """

    def stat(observed: Observed, path: tuple, pair: str) -> float | None:
        try:
            return draw_statistic(observed, *path, pair, cfg)
        except FAILURES:
            return None

    def simulated(model: Generator, draw: int, pair: str) -> float | None:
        try:
            return stat(model.observed, model.simulate(_generator_of(cfg.bootstrap_seed, draw)), pair)
        except FAILURES:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for series, pair, model, first in batch[["series_id", "generator", "model", "first"]].itertuples(index=False):
                model, out = pickle.loads(model), []
                if first == 0:
                    out.append((series, pair, -1, stat(model.observed, (model.observed.vrp, None), pair)))
                out += [(series, pair, draw, simulated(model, draw, pair)) for draw in range(first, min(first + per_task, cfg.bootstrap_draws))]
                yield pd.DataFrame(out, columns=["series_id", "generator", "draw", "stat"]).astype({"stat": float})

    out = _numbered(models, cfg.bootstrap_draws, per_task).mapInPandas(run, "series_id string, generator string, draw long, stat double")
    return out.withColumn("stat", F.nanvl("stat", F.lit(None).cast("double")))


def null_p_values(draws: DataFrame) -> DataFrame:
    """Per series and generator: plain share of used draws at or above the observed statistic."""
    own, drawn = F.col("draw") < 0, F.col("draw") >= 0
    seen = F.max(F.when(own, F.col("stat"))).over(Window.partitionBy("series_id", "generator"))
    used, stat = F.count(F.when(drawn, F.col("stat"))), F.when(drawn, F.col("stat"))
    return draws.withColumn("s_obs", seen).groupBy("series_id", "generator").agg(
        F.max("s_obs").alias("s_obs"), F.avg((stat >= F.col("s_obs")).cast("double")).alias("p_value"), used.alias("used"), (F.count(F.when(drawn, F.lit(1))) - used).alias("failed"), F.stddev_samp(stat).alias("draw_sd")
    )
