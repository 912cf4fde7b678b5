"""DuckDB SQL of the engine's stages, as named pieces that a query strings together."""

from __future__ import annotations

import re

NUMERIC = ("vix_level", "cboe_skew", "vrp_h1m", "vrp_h3m", "vrp_h6m", "realised_skew_21d")
LAGS = NUMERIC[2:5]
BY_DAY = "PARTITION BY series_id ORDER BY d"


def _gated(value: str, frame: str, size: int) -> str:
    return f"CASE WHEN count(*) OVER ({BY_DAY} {frame}) = {size} THEN {value} OVER ({BY_DAY} {frame}) END"


def _regime(level: str) -> str:
    return f"CASE WHEN {level} < 15 THEN 'calm' WHEN {level} > 25 THEN 'stressed' ELSE 'normal' END"


def _back(days: int) -> str:
    return f"ROWS BETWEEN {days - 1} PRECEDING AND CURRENT ROW"


PIECES: dict[str, str] = {
    "seg": "SELECT o.*, c_mktsegment AS series_id FROM orders o JOIN customer ON o_custkey = c_custkey",
    "px": "SELECT series_id, CAST(o_orderdate AS DATE) AS d, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100.0::DOUBLE) AS close FROM seg GROUP BY 1, 2",
    "lv": """SELECT series_id, CAST(l_shipdate AS DATE) AS d, 10 + 0.5::DOUBLE * min((l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity))[5] AS vix,
        100 + 10.0::DOUBLE * (CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*)) AS skew
        FROM lineitem JOIN seg ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "snap": "SELECT series_id, d, close, vix, skew FROM px JOIN lv USING (series_id, d)",
    "ret": f"""SELECT *, row_number() OVER ({BY_DAY}) - 1 AS rn FROM
        (SELECT *, 0.02::DOUBLE * ln(close / lag(close) OVER ({BY_DAY})) AS r FROM snap) WHERE r IS NOT NULL""",
    "days": f"""SELECT *, {_gated("avg(r * r)", "ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING", 21)} * 252 AS target,
        r * r AS x1, {_gated("avg(r * r)", _back(5), 5)} AS x2, {_gated("avg(r * r)", _back(22), 22)} AS x3,
        {_gated("skewness(r)", _back(21), 21)} AS skew_21d FROM ret""",
    "mon": """SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY series_id, year(d), month(d) ORDER BY d) AS k FROM days) WHERE k = 1""",
    "outc": f"SELECT series_id, d, vix, skew, target AS realised, lead(vix) OVER ({BY_DAY}) AS vix_next, lead(target) OVER ({BY_DAY}) AS realised_next FROM mon",
    "hard": """SELECT m.series_id, m.d AS day, m.rn AS p, t.rn AS i, CASE WHEN t.rn <= m.rn - 21 AND t.target IS NOT NULL THEN 1 ELSE 0 END AS train,
        t.x1 * 1e4 AS z1, t.x2 * 1e4 AS z2, t.x3 * 1e4 AS z3, t.target * 1e4 AS y
        FROM mon m JOIN days t ON m.series_id = t.series_id AND (t.rn <= m.rn - 21 AND t.x3 IS NOT NULL AND t.target IS NOT NULL OR t.rn = m.rn)
        WHERE m.rn >= 21 AND m.x3 IS NOT NULL""",
}


def least_squares(source: str, name: str, keys: str, xs: list[str], y: str = "y", order: str = "1") -> dict[str, str]:
    """Pieces that predict the row(s) with train = 0 of each group from its rows with train = 1.

    Columns are made orthogonal one after another (modified Gram-Schmidt, with
    the intercept first), using sums over training rows only; piece ``name`` has
    ``pred`` on every row of the source.
    """
    over = f"OVER (PARTITION BY {keys})"
    out, before = {}, source
    cols = ", ".join([f"{x} - avg({x}) FILTER (train = 1) {over} AS q{k}" for k, x in enumerate(xs)])
    out[f"{name}_0"] = f"SELECT *, {cols}, avg({y}) FILTER (train = 1) {over} AS fit0 FROM {before}"
    before = f"{name}_0"
    fit = "fit0"
    for k in range(len(xs)):
        norm = f"nullif(sum(q{k} * q{k}) FILTER (train = 1) {over}, 0)"
        later = ", ".join(f"q{j} - q{k} * (sum(q{j} * q{k}) FILTER (train = 1) {over}) / {norm} AS q{j}" for j in range(k + 1, len(xs)))
        beta = f"(sum(({y} - {fit}) * q{k}) FILTER (train = 1) {over}) / {norm}"
        drop = ", ".join([f"q{j}" for j in range(k + 1, len(xs))] + [fit])
        out[f"{name}_{k + 1}"] = f"SELECT * EXCLUDE ({drop}), {later + ', ' if later else ''}{fit} + {beta} * q{k} AS fit{k + 1} FROM {before}"
        before, fit = f"{name}_{k + 1}", f"fit{k + 1}"
    out[name] = f"SELECT * EXCLUDE ({fit}), {fit} AS pred FROM {before}"
    return out


PIECES |= least_squares("hard", "harf", "series_id, p", ["z1", "z2", "z3"])
PIECES |= {
    "har": "SELECT h.series_id, h.day AS d, pred / 1e4 AS forecast FROM harf h JOIN (SELECT series_id, p, sum(train) AS n FROM hard GROUP BY 1, 2) c USING (series_id, p) WHERE h.i = h.p AND n >= 5 AND pred IS NOT NULL",
    "prem": "SELECT series_id, d, vix, skew, forecast, vix * vix / 10000 - forecast AS vrp FROM har JOIN (SELECT series_id, d, vix, skew FROM mon) USING (series_id, d)",
    "feat": f"""SELECT p.series_id, p.d, vrp, vix AS vix_level, skew AS cboe_skew, vrp AS vrp_h1m, lag(vrp, 2) OVER w AS vrp_h3m, lag(vrp, 5) OVER w AS vrp_h6m,
        s.skew_21d AS realised_skew_21d, {_regime("vix")} AS regime FROM prem p LEFT JOIN (SELECT series_id, d, skew_21d FROM days) s USING (series_id, d)
        WINDOW w AS (PARTITION BY p.series_id ORDER BY p.d)""",
    "ds": f"""SELECT *, row_number() OVER ({BY_DAY}) - 1 AS row FROM (SELECT *, lead(vrp) OVER ({BY_DAY}) AS y FROM feat)
        WHERE y IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL" for c in NUMERIC)}""",
    "cut": """SELECT series_id, max(d) AS cut_day, max(row) AS cut FROM (SELECT *, min(year(d)) OVER (PARTITION BY series_id) AS y0 FROM ds) WHERE year(d) <= y0 + 2 GROUP BY 1""",
    "wf_constant": """SELECT series_id, d, y AS y_true, m AS y_pred FROM (SELECT *, avg(y) OVER (PARTITION BY series_id ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ds) JOIN cut USING (series_id) WHERE row > cut""",
    "stp": f"""SELECT s.series_id, s.row AS step, s.d AS day, t.row AS i, CASE WHEN t.row < s.row THEN 1 ELSE 0 END AS train, s.regime AS now, t.regime AS then_, t.y, {", ".join("t." + c for c in NUMERIC)}
        FROM ds s JOIN cut c ON s.series_id = c.series_id AND s.row > c.cut JOIN ds t ON t.series_id = s.series_id AND t.row <= s.row""",
}
PIECES |= least_squares("stp", "harm", "series_id, step", list(LAGS))
PIECES |= least_squares("stp", "extm", "series_id, step", list(NUMERIC))
PIECES["own"] = "SELECT * FROM stp WHERE now = then_"
PIECES |= least_squares("own", "ownm", "series_id, step", list(NUMERIC))
PIECES |= {
    "wf_har": "SELECT series_id, day AS d, y AS y_true, pred AS y_pred FROM harm WHERE i = step",
    "wf_extended_ols": "SELECT series_id, day AS d, y AS y_true, pred AS y_pred FROM extm WHERE i = step",
    "nown": "SELECT series_id, step, sum(train) AS n FROM own GROUP BY 1, 2",
    "wf_regime_switching": """SELECT e.series_id, e.day AS d, e.y AS y_true, CASE WHEN n.n >= 14 THEN o.pred ELSE e.pred END AS y_pred, n.n < 14 AS fallback, e.now AS regime
        FROM extm e JOIN nown n USING (series_id, step) JOIN ownm o ON o.series_id = e.series_id AND o.step = e.step AND o.i = e.step WHERE e.i = e.step""",
    "wf": " UNION ALL ".join(f"SELECT series_id, '{m}' AS model, d, y_true, y_pred FROM wf_{m}" for m in ("constant", "har", "extended_ols", "regime_switching")),
    "obs0": f"""SELECT w.series_id, model, w.d, y_true, y_pred, vix_next * vix_next / 10000 - y_pred AS implied, realised_next AS realised, {_regime("vix")} AS regime
        FROM wf w LEFT JOIN outc o USING (series_id, d)""",
    "obs": """SELECT *, CASE WHEN valid THEN realised / implied - ln(CASE WHEN valid THEN realised / implied END) - 1 END AS qlike FROM
        (SELECT *, coalesce(implied > 0, false) AS guard, realised IS NOT NULL AS tail, coalesce(implied > 0, false) AND realised IS NOT NULL AS valid FROM obs0)""",
    "common": "SELECT series_id, d FROM obs GROUP BY 1, 2 HAVING bool_and(valid)",
    "pairs": """SELECT a.model || '|' || b.model AS pair, (a.model, b.model) IN (('constant', 'har'), ('constant', 'extended_ols'), ('har', 'extended_ols'), ('extended_ols', 'regime_switching')) AS nested,
        a.series_id, a.d, a.regime, a.realised, a.y_true, a.implied AS f_small, b.implied AS f_large, a.qlike AS q_small, b.qlike AS q_large, a.y_pred AS y_small, b.y_pred AS y_large
        FROM obs a JOIN obs b ON a.series_id = b.series_id AND a.d = b.d AND a.valid AND b.valid
        AND (a.model, b.model) IN (('constant', 'har'), ('constant', 'extended_ols'), ('har', 'extended_ols'), ('extended_ols', 'regime_switching'), ('constant', 'regime_switching'), ('har', 'regime_switching'))""",
    "pairx": "SELECT * FROM pairs UNION ALL SELECT * REPLACE ('all_regimes' AS regime) FROM pairs",
    "pos": """SELECT *, CASE WHEN forecast > med THEN 1 ELSE 0 END AS position_naive, CASE WHEN forecast > med AND regime <> 'stressed' THEN 1 ELSE 0 END AS position_conditioned FROM
        (SELECT series_id, d, y_pred AS forecast, regime, median(y_pred) OVER (PARTITION BY series_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS med FROM obs WHERE model = 'har')""",
    "pnl0": """SELECT p.*, o.vix, o.realised, o.vix * o.vix / 10000 AS strike,
        abs(position_naive - coalesce(lag(position_naive) OVER w, 0)) AS t_naive, abs(position_conditioned - coalesce(lag(position_conditioned) OVER w, 0)) AS t_conditioned
        FROM pos p LEFT JOIN outc o USING (series_id, d) WINDOW w AS (PARTITION BY p.series_id ORDER BY p.d)""",
    "pnl": "SELECT *, "
    + ", ".join(f"position_{s} * (strike - realised) AS gross_{s}" for s in ("naive", "conditioned"))
    + ", "
    + ", ".join(f"position_{s} * (strike - realised) - t_{s} * strike * {rate} AS net_{s}_{c}" for s in ("naive", "conditioned") for c, rate in (("base", "0.01::DOUBLE"), ("stress", "0.02::DOUBLE")))
    + " FROM pnl0 WHERE realised IS NOT NULL",
    "arms": " UNION ALL ".join(f"SELECT series_id, d, '{s}' AS strategy, '{c}' AS cost, position_{s} AS position, net_{s}_{c} AS net FROM pnl" for s in ("naive", "conditioned") for c in ("base", "stress")),
    "under": """SELECT *, max(cumulative) OVER (PARTITION BY series_id, strategy, cost ORDER BY d) - cumulative AS underwater,
        CASE WHEN count(*) OVER w3 = 3 THEN sum(net) OVER w3 END AS rolling FROM
        (SELECT *, sum(net) OVER (PARTITION BY series_id, strategy, cost ORDER BY d) AS cumulative FROM arms)
        WINDOW w3 AS (PARTITION BY series_id, strategy, cost ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
}


def _needs(text: str, known: dict[str, str]) -> list[str]:
    lists = re.findall(r"\b(?:FROM|JOIN)\s+(\w+(?:\s*,\s*\w+)*)", text)
    return [w for w in dict.fromkeys(w for x in lists for w in re.findall(r"\w+", x)) if w in known]


def query(final: str, **own: str) -> str:
    """``final`` with the pieces it needs (and those they need) in order; ``own`` adds pieces of its own."""
    known = PIECES | own
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for other in _needs(known[name], known):
                visit(other)
            order.append(name)

    for name in _needs(final, known):
        visit(name)
    return (f"WITH {', '.join(f'{n} AS MATERIALIZED ({known[n]})' for n in order)} " if order else "") + final


def normal_tail(z: str) -> str:
    """P(Z > z): half less the density times z (1 + z^2/3 (1 + z^2/5 (...)))."""
    folded = f"list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(200, 0, -1), lambda k: k::DOUBLE)), lambda s, k: 1 + s * ({z}) ** 2 / (2 * k + 1))"
    return f"(0.5 - exp(-0.5 * ({z}) * ({z})) / sqrt(2 * pi()) * ({z}) * {folded})"


def t_two_sided(t: str, nu: str) -> str:
    """P(|T| > |t|) for a whole number of degrees of freedom: the finite series in the cosine of atan(t / sqrt(nu))."""
    c2 = f"({nu} / ({nu} + ({t}) ** 2))"
    fold = lambda terms, ratio: f"list_reduce(list_prepend(1.0::DOUBLE, list_transform(range({terms}, 0, -1), lambda k: k::DOUBLE)), lambda s, k: 1 + s * {c2} * {ratio})"
    even = f"sqrt(1 - {c2}) * {fold(f'CAST({nu} // 2 - 1 AS BIGINT)', '(2 * k - 1) / (2 * k)')}"
    odd = f"2 / pi() * (atan(abs({t}) / sqrt({nu})) + CASE WHEN {nu} > 1 THEN sqrt((1 - {c2}) * {c2}) * {fold(f'CAST(({nu} - 3) // 2 AS BIGINT)', '(2 * k) / (2 * k + 1)')} ELSE 0 END)"
    return f"(1 - CASE WHEN {nu} % 2 = 0 THEN {even} ELSE {odd} END)"
