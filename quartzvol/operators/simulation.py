"""Monte Carlo study of the Clark-West test: simulated histories, nested forecasts, bootstraps and cells.

A replication is a row of ``spark.range``; its seed follows from the cell's
stream and its own number, so any task can compute it, in any order, again.
Inside a replication all bootstrap draws run at once as array rows: expanding
regressions are running sums, so a draw costs a few passes over its path.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import normal_sf_value

#: Root of all seeds, and the number of each study's stream.
ROOT_SEED = 20260707
STREAMS = {"size": 0, "power": 1, "calibration": 2, "sensitivity": 3}
GENERATOR_CODES = {"arma": 0, "ar1:nonconvergence": 1, "ar1:nonstationary": 2, "ar1:specified": 3}
ALPHAS = (0.05, 0.10)
SLICE = 64


@dataclass(frozen=True)
class World:
    """Fixed values of the data-generating process."""

    level: float = -0.5
    phi: float = 0.95
    shock: float = 0.3
    shock_df: int = 5
    noise_df: int = 8
    psi: float = 0.9
    x_scale: float = 1.0
    burn_in: int = 200


@dataclass(frozen=True)
class Cell:
    key: str
    stream: str = "size"
    beta: float = 0.0
    t_train: int = 140
    t_oos: int = 220
    draws: int = 299
    bootstrap: str = "model"
    generator: str = "arma"
    block: int = 1
    common_seeds: bool = False
    first_child: int = 0


def autoregression(shocks: np.ndarray, phi: float, drift: np.ndarray | float = 0.0, first: np.ndarray | None = None) -> np.ndarray:
    """y_t = phi y_{t-1} + drift_t + shock_t along the last axis; y_0 is ``first`` or the first shock."""
    out = np.array(shocks, dtype=float)
    out += drift
    out[..., 0] = shocks[..., 0] if first is None else first
    for t in range(1, out.shape[-1]):
        out[..., t] += phi * out[..., t - 1]
    return out


def history(beta: float, total: int, rng: np.random.Generator, world: World = World()) -> dict[str, np.ndarray]:
    """One simulated history; shocks are drawn for the predictor, then the log variance, then the noise."""
    n = world.burn_in + total
    x = autoregression(world.x_scale * rng.standard_normal(n), world.psi)
    eta = world.shock * rng.standard_t(world.shock_df, size=n)
    pull = world.level + beta * np.concatenate([[0.0], x[:-1]])
    log_h = autoregression(eta, world.phi, pull, world.level + eta[0])
    h = np.exp(log_h)
    rv = h * (rng.chisquare(world.noise_df, size=n) / world.noise_df)
    keep = slice(world.burn_in, None)
    return {"h": h[keep], "rv": rv[keep], "x": x[keep]}


def nested_forecasts(log_rv: np.ndarray, x: np.ndarray, t_train: int) -> tuple[np.ndarray, np.ndarray]:
    """Log forecasts of the small (lag) and big (lag and x) model for every target from t_train on, rows at once.

    The regression for target t uses responses 1 .. t-1; its moments are running
    sums about the first value of each path.
    """
    base_l, base_x = log_rv[:, :1], x[:, :1]
    y, lag, z = log_rv[:, 1:] - base_l, log_rv[:, :-1] - base_l, x[:, :-1] - base_x
    stop = slice(t_train - 2, -1)
    n = np.arange(1, y.shape[1] + 1, dtype=float)[stop]

    def total(v: np.ndarray) -> np.ndarray:
        return np.cumsum(v, axis=1)[:, stop]

    sl, sx, sy = total(lag), total(z), total(y)
    cll, cxx, clx = total(lag * lag) - sl * sl / n, total(z * z) - sx * sx / n, total(lag * z) - sl * sx / n
    cly, cxy = total(lag * y) - sl * sy / n, total(z * y) - sx * sy / n
    now_l, now_x = lag[:, t_train - 1 :], z[:, t_train - 1 :]
    small = sy / n + cly / cll * (now_l - sl / n) + base_l
    det = cll * cxx - clx * clx
    b1, b2 = (cly * cxx - cxy * clx) / det, (cxy * cll - cly * clx) / det
    return small, sy / n + b1 * (now_l - sl / n) + b2 * (now_x - sx / n) + base_l


def adjusted_differences(log_rv: np.ndarray, x: np.ndarray, t_train: int) -> np.ndarray:
    """Loss differences plus the weighted adjustment, a row for each path."""
    small, big = nested_forecasts(log_rv, x, t_train)
    actual = log_rv[:, t_train:]
    us, ub = actual - small, actual - big
    return (np.exp(us) - us) - (np.exp(ub) - ub) + 0.5 * np.exp(us) * np.square(small - big)


def newey_west_lag(n: int) -> int:
    return int(np.floor(4.0 * (n / 100.0) ** (2.0 / 9.0)))


def studentised(d: np.ndarray) -> np.ndarray:
    """Mean over its tapered HAC standard error, for each row."""
    n = d.shape[1]
    lag, c = newey_west_lag(n), d - d.mean(axis=1, keepdims=True)
    lrv = np.einsum("ij,ij->i", c, c) / n
    for k in range(1, lag + 1):
        lrv += 2.0 * (1.0 - k / (lag + 1.0)) * np.einsum("ij,ij->i", c[:, k:], c[:, :-k]) / n
    return d.mean(axis=1) / np.sqrt(lrv / n)


def statistic(rv: np.ndarray, x: np.ndarray, t_train: int) -> np.ndarray:
    return studentised(adjusted_differences(np.log(np.atleast_2d(rv)), np.atleast_2d(x), t_train))


def resamples(n: int, length: int, draws: int, rng: np.random.Generator, scheme: str = "stationary") -> np.ndarray:
    """Places of ``draws`` circular block resamples of n rows, a row for each.

    ``fixed`` blocks have the given length; ``stationary`` ones have it in the
    mean, as every place begins a new block by the fall of a coin.
    """
    place = np.arange(n)
    if scheme == "fixed":
        blocks = place // length
        return (rng.integers(0, n, size=(draws, blocks[-1] + 1))[:, blocks] + place % length) % n
    if scheme != "stationary":
        raise ValueError(f"unknown scheme {scheme}")
    new = rng.random((draws, n)) * length < 1
    new[:, 0] = True
    age = place - np.maximum.accumulate(new * place, axis=1)
    heads = rng.integers(0, n, size=(draws, n))
    return (np.take_along_axis(heads, place - age, axis=1) + age) % n


def loss_bootstrap(d: np.ndarray, seen: float, length: int, draws: int, rng: np.random.Generator, scheme: str = "stationary") -> tuple[float, float]:
    """p and spread of the statistic over resamples of the centred differences."""
    pool = d - d.mean()
    stats = studentised(pool[resamples(len(d), length, draws, rng, scheme)])
    return float(np.mean(stats >= seen)), float(stats.std())


def data_bootstrap(rv: np.ndarray, x: np.ndarray, t_train: int, length: int, draws: int, rng: np.random.Generator) -> tuple[float, float]:
    """Pairs are resampled and the whole forecast is run again; draws are centred at their own mean."""
    index = resamples(len(rv), length, draws, rng)
    stats = np.concatenate([statistic(rv[part], x[part], t_train) for part in np.array_split(index, -(-draws // SLICE))])
    return float(np.mean(stats - stats.mean() >= statistic(rv, x, t_train)[0])), float(stats.std())


def fit_ar1(series: np.ndarray) -> dict:
    lag, y = series[:-1], series[1:]
    phi = np.cov(lag, y, bias=True)[0, 1] / lag.var()
    c = y.mean() - phi * lag.mean()
    e = y - c - phi * lag
    return {"c": c, "phi": phi, "theta": 0.0, "resid": e - e.mean(), "converged": True}


def _arma_errors(z: np.ndarray, phi: float, theta: float) -> np.ndarray:
    u = z.copy()
    u[1:] -= phi * z[:-1]
    e, last = np.empty_like(u), 0.0
    for t, value in enumerate(u.tolist()):
        last = value - theta * last
        e[t] = last
    return e


def fit_arma11(series: np.ndarray, rounds: int = 40) -> dict:
    """ARMA(1,1) about a mean by conditional least squares (Gauss-Newton with halved steps)."""

    def errors(p: np.ndarray) -> np.ndarray:
        return _arma_errors(series - p[0], p[1], p[2])

    p = np.array([series.mean(), 0.8, -0.2])
    e, converged = errors(p), False
    for _ in range(rounds):
        steps = 1e-5 * np.maximum(1.0, np.abs(p))
        jac = np.stack([(errors(p + np.eye(3)[k] * steps[k]) - e) / steps[k] for k in range(3)], axis=1)
        move, size = np.linalg.lstsq(jac, -e, rcond=None)[0], 1.0
        while size > 1e-4:
            q = p + size * move
            q[2] = np.clip(q[2], -0.99, 0.99)
            with np.errstate(over="ignore", invalid="ignore"):
                trial = errors(q)
            if np.isfinite(trial).all() and trial @ trial <= e @ e:
                break
            size /= 2
        else:
            converged = True
            break
        done = e @ e - trial @ trial < 1e-10 * (e @ e)
        p, e = q, trial
        if done:
            converged = True
            break
    return {"c": p[0] * (1 - p[1]), "phi": float(p[1]), "theta": float(p[2]), "resid": e - e.mean(), "converged": converged}


def residual_draws(resid: np.ndarray, shape: tuple[int, int], block: int, rng: np.random.Generator) -> np.ndarray:
    if block <= 1:
        return resid[rng.integers(0, len(resid), size=shape)]
    starts = rng.integers(0, len(resid), size=(shape[0], -(-shape[1] // block)))
    return resid[((starts[:, :, None] + np.arange(block)) % len(resid)).reshape(shape[0], -1)[:, : shape[1]]]


def simulated_paths(fit: dict, first: float, n: int, draws: int, block: int, rng: np.random.Generator) -> np.ndarray:
    e = residual_draws(fit["resid"], (draws, n - 1), block, rng)
    shocks = np.concatenate([np.zeros((draws, 1)), e], axis=1)
    shocks[:, 2:] += fit["theta"] * e[:, :-1]
    return autoregression(shocks, fit["phi"], fit["c"], np.full(draws, first))


def null_generator(log_rv: np.ndarray, spec: str) -> tuple[dict, str]:
    """The fitted null and its code's name; an ARMA fit that fails gives way to AR(1)."""
    if spec == "ar1":
        return fit_ar1(log_rv), "ar1:specified"
    if spec != "arma":
        raise ValueError(f"unknown generator {spec}")
    fit = fit_arma11(log_rv)
    if not fit["converged"]:
        return fit_ar1(log_rv), "ar1:nonconvergence"
    if abs(fit["phi"]) >= 1:
        return fit_ar1(log_rv), "ar1:nonstationary"
    return fit, "arma"


def model_bootstrap(rv: np.ndarray, x: np.ndarray, t_train: int, draws: int, rng: np.random.Generator, spec: str = "arma", block: int = 1, seen: float | None = None) -> dict:
    """Histories simulated under a fitted null in which x plays no part; the draws need no centring."""
    log_rv = np.log(rv)
    fit, code = null_generator(log_rv, spec)
    x_fit = fit_ar1(x)
    seen = statistic(rv, x, t_train)[0] if seen is None else seen
    stats = []
    for at in range(0, draws, SLICE):
        k = min(SLICE, draws - at)
        paths = simulated_paths(fit, log_rv[0], len(rv), k, block, rng)
        stats.append(studentised(adjusted_differences(paths, simulated_paths(x_fit, x[0], len(x), k, block, rng), t_train)))
    flat = np.concatenate(stats) if stats else np.zeros(0)
    return {"p": float(np.mean(flat >= seen)) if len(flat) else np.nan, "draw_std": float(flat.std()) if len(flat) else np.nan, "code": code, "phi": fit["phi"], "theta": fit["theta"]}


def child(stream: str, number: int, part: int) -> np.random.Generator:
    """Generator of a replication's history (0) or bootstrap (1), from numbers alone."""
    return np.random.default_rng(np.random.SeedSequence(ROOT_SEED, spawn_key=(STREAMS[stream], number, part)))


FACTS = "cell_key string, rep_id long, s_obs double, p_norm double, p_boot double, draw_std double, skew double, phi double, theta double, gen_code int, qlike_small double, qlike_big double"


def replication(cell: Cell, rep: int) -> dict:
    number = cell.first_child + rep
    past = history(cell.beta, cell.t_train + cell.t_oos, child(cell.stream, number, 0))
    rv, x, rng = past["rv"], past["x"], child(cell.stream, number, 1)
    d = adjusted_differences(np.log(rv)[None], x[None], cell.t_train)[0]
    seen = float(studentised(d[None])[0])
    c = d - d.mean()
    small, big = nested_forecasts(np.log(rv)[None], x[None], cell.t_train)
    loss = lambda f: float(np.mean(np.exp(u := np.log(rv)[cell.t_train :] - f[0]) - u - 1))
    row = {"cell_key": cell.key, "rep_id": rep, "s_obs": seen, "p_norm": normal_sf_value(seen), "skew": float((c**3).mean() / c.std() ** 3), "phi": None, "theta": None, "gen_code": None, "p_boot": None, "draw_std": None, "qlike_small": loss(small), "qlike_big": loss(big)}
    if cell.draws and cell.bootstrap == "model":
        out = model_bootstrap(rv, x, cell.t_train, cell.draws, rng, cell.generator, cell.block, seen)
        row |= {"p_boot": out["p"], "draw_std": out["draw_std"], "phi": out["phi"], "theta": out["theta"], "gen_code": GENERATOR_CODES[out["code"]]}
    elif cell.draws:
        run = loss_bootstrap(d, seen, cell.block, cell.draws, rng) if cell.bootstrap == "loss" else data_bootstrap(rv, x, cell.t_train, cell.block, cell.draws, rng)
        row |= {"p_boot": run[0], "draw_std": run[1]}
    return row


def run_cells(spark: SparkSession, cells: list[Cell], reps: int, done: DataFrame | None = None, per_task: int = 8) -> DataFrame:
    """Fact rows of all cells' replications; those in ``done`` (cell_key, rep_id) are left out, so runs resume."""
    keyed = {c.key: c for c in cells}
    names = F.array(*[F.lit(c.key) for c in cells])
    work = spark.range(reps).select(F.explode(names).alias("cell_key"), F.col("id").alias("rep_id"))
    if done is not None:
        work = work.join(done.select("cell_key", "rep_id"), ["cell_key", "rep_id"], "left_anti")
    tasks = max(1, min(10_000, len(cells) * reps // per_task))
    columns = [x.split()[0] for x in FACTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), per_task):
                part = batch.iloc[at : at + per_task]
                yield pd.DataFrame([replication(keyed[k], int(r)) for k, r in zip(part["cell_key"], part["rep_id"], strict=True)], columns=columns)

    return work.repartition(tasks, "cell_key", "rep_id").mapInPandas(run, FACTS)


def histories(spark: SparkSession, beta: float, total: int, reps: int, stream: str = "size") -> DataFrame:
    """Simulated histories, long: (rep_id, t, h, rv, x)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rep in batch["id"]:
                yield pd.DataFrame(history(beta, total, child(stream, int(rep), 0))).assign(rep_id=int(rep), t=np.arange(total))[["rep_id", "t", "h", "rv", "x"]]

    return spark.range(reps).mapInPandas(run, "rep_id long, t int, h double, rv double, x double")


def size_cells(draws: int = 299, t_oos: tuple[int, ...] = (220, 250), reps: int = 2000) -> list[Cell]:
    return [Cell(f"size_toos{n}", "size", 0.0, t_oos=n, draws=draws, first_child=k * reps) for k, n in enumerate(t_oos)]


def power_tag(beta: float, t_oos: int) -> str:
    return f"beta{str(beta).replace('.', 'p')}_toos{t_oos}"


def power_cells(draws: int = 299, betas: tuple[float, ...] = (0.03, 0.05), t_oos: tuple[int, ...] = (220, 250), reps: int = 1000) -> list[Cell]:
    points = [(b, n) for b in betas for n in t_oos]
    return [Cell(power_tag(b, n), "power", b, t_oos=n, draws=draws, first_child=k * reps) for k, (b, n) in enumerate(points)]


def calibration_cells(betas: tuple[float, ...] = (0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.10, 0.20)) -> list[Cell]:
    """Every beta sees the same random numbers; nothing is bootstrapped."""
    return [Cell(f"cal_{str(b).replace('.', 'p')}", "calibration", b, draws=0) for b in betas]


def sensitivity_cells(draws: int = 299, many: int = 999) -> list[Cell]:
    return [
        Cell("reference", "sensitivity", draws=draws),
        Cell("ar1_generator", "sensitivity", draws=draws, generator="ar1"),
        Cell("many_draws", "sensitivity", draws=many),
        Cell("residual_blocks_3", "sensitivity", draws=draws, block=3),
    ]


def cell_table(spark: SparkSession, cells: list[Cell]) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame([asdict(c) for c in cells]))


def rejections(facts: DataFrame, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """Rejection rates of both p-values with their binomial errors."""
    kinds = F.array(*[F.struct(F.lit(k).alias("test"), F.col(c).alias("p")) for k, c in (("normal", "p_norm"), ("bootstrap", "p_boot"))])
    rows = facts.select("cell_key", F.explode(kinds).alias("t")).select("cell_key", "t.*", F.explode(F.array(*[F.lit(a) for a in alphas])).alias("alpha"))
    rate = F.avg((F.col("p") <= F.col("alpha")).cast("double"))
    out = rows.where("p IS NOT NULL").groupBy("cell_key", "test", "alpha").agg(F.count("*").alias("n"), rate.alias("rate"))
    return out.withColumn("se", F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n")))


def null_cutoffs(facts: DataFrame, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """Per null cell and level: the statistic's upper and the p-value's lower quantile (linear between ranks)."""
    parts = [facts.groupBy("cell_key").agg(F.percentile("s_obs", F.lit(1 - a)).alias("s_cut"), F.percentile("p_boot", F.lit(a)).alias("p_cut")).withColumn("alpha", F.lit(a)) for a in alphas]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("cell_key", "alpha", "s_cut", "p_cut")


def adjusted_power(facts: DataFrame, cutoffs: DataFrame, null_of: dict[str, str]) -> DataFrame:
    """Power at the null cells' own cutoffs; ``null_of`` names each cell's null cell."""
    pairs = F.create_map(*[F.lit(v) for kv in null_of.items() for v in kv])
    rows = facts.withColumn("null_key", pairs[F.col("cell_key")]).join(cutoffs.withColumnRenamed("cell_key", "null_key"), "null_key")
    hit = lambda c: F.avg(c.cast("double"))
    return rows.groupBy("cell_key", "alpha").agg(hit(F.col("s_obs") >= F.col("s_cut")).alias("power_stat"), hit(F.col("p_boot") <= F.col("p_cut")).alias("power_boot"))


def calibration(facts: DataFrame) -> DataFrame:
    gain = 100 * (F.col("qlike_small") - F.col("qlike_big")) / F.col("qlike_small")
    rows = facts.withColumn("gain", gain)
    return rows.groupBy("cell_key").agg(F.avg("gain").alias("mean_gain"), F.percentile("gain", F.lit(0.1)).alias("p10"), F.percentile("gain", F.lit(0.5)).alias("p50"), F.percentile("gain", F.lit(0.9)).alias("p90"), F.avg((F.col("gain") > 0).cast("double")).alias("win_rate"))


def generator_usage(facts: DataFrame) -> DataFrame:
    return facts.groupBy("cell_key", "gen_code").agg(F.count("*").alias("n"))


def sensitivity_table(facts: DataFrame, reference: str = "reference", alpha: float = 0.05) -> DataFrame:
    """Each cell's bootstrap rate against the reference cell's, with the error of their unpaired difference."""
    rates = rejections(facts, (alpha,)).where("test = 'bootstrap'").select("cell_key", "n", "rate", "se")
    ref = rates.where(F.col("cell_key") == reference).select(F.col("rate").alias("rate_ref"), F.col("se").alias("se_ref"))
    one = ref.withColumn("__k", F.lit(1))
    return rates.withColumn("__k", F.lit(1)).join(one, "__k").drop("__k").withColumns({"difference": F.col("rate") - F.col("rate_ref"), "se_difference": F.sqrt(F.col("se") * F.col("se") + F.col("se_ref") * F.col("se_ref"))})


def consistency(facts: DataFrame, earlier: DataFrame) -> DataFrame:
    """Replications whose statistic differs between two runs; empty when the runs agree."""
    both = facts.select("cell_key", "rep_id", "s_obs").join(earlier.select("cell_key", "rep_id", F.col("s_obs").alias("s_before")), ["cell_key", "rep_id"])
    return both.where(F.abs(F.col("s_obs") - F.col("s_before")) > 1e-9)


def budgeted(seconds_per_rep: float, cells: int, reps: int, fewer: int, hours: float, parallel: int) -> int:
    """The number of replications that a time budget allows: all, or the reduced number."""
    return reps if seconds_per_rep * cells * reps / parallel <= hours * 3600 else fewer


def qq_positions(facts: DataFrame) -> DataFrame:
    """Sorted statistics beside the normal quantiles of (i - 0.5) / n, by cell."""
    from pyspark.sql import Window

    from ..functions.scalars import normal_quantile

    w = Window.partitionBy("cell_key")
    return facts.select("cell_key", "s_obs", ((F.row_number().over(w.orderBy("s_obs")) - 0.5) / F.count("*").over(w)).alias("p")).withColumn("normal", normal_quantile("p"))
