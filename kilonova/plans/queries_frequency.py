"""Registered frequency set."""
from __future__ import annotations

import math

from ..functions.core import BAND_LETTERS, BANDS
from ..operators import frequency as fr
from ..sources.adapters import lc_event_groups, with_ctes
from .catalog import register
from .queries_spectral import grid_cte, power_ctes, rows_cte
from .sqlgen import rounded, snap_sql

S = "object_id, passband"
H = fr.HARMONICS
N = fr.SIZE


def _peak_ctes(src: str, i: str) -> list[tuple[str, str]]:
    pk = (f"SELECT {S}, freq, top AS power, n FROM (SELECT *, max(power) OVER (PARTITION BY {S}) AS top, row_number() OVER "
          f"(PARTITION BY {S} ORDER BY {snap_sql('power')} DESC, freq ASC) AS rn FROM {i}pw WHERE power IS NOT NULL) WHERE rn = 1")
    return [*power_ctes(src, i), (f"{i}pk", pk)]


def _fit_ctes(src: str, peaks: str, freq: str, i: str) -> list[tuple[str, str]]:
    """CTE ``<i>fit``: the normal equations written out from basis functions, and eliminated step by step."""
    tw = 2 * math.pi
    basis = ["1e0"] + [f"{f}({tw!r} * {h} * freq * t)" for h in range(1, H + 1) for f in ("cos", "sin")]
    at = ", ".join(f"{b} AS b{k}" for k, b in enumerate(basis))
    rows = f"SELECT r.*, p.{freq} AS freq FROM {src} r JOIN {peaks} p ON p.object_id = r.object_id AND p.passband = r.passband"
    sums = ", ".join(f"sum(w * b{a} * b{b}) / sum(w) AS m{a}_{b}" for a in range(N) for b in range(a, N))
    right = ", ".join(f"sum(w * y * b{a}) / sum(w) AS y{a}" for a in range(N))
    entry = lambda a, b: f"m{min(a, b)}_{max(a, b)}" + (" + ridge" if a == b and a else "")
    matrix = "[" + ", ".join("[" + ", ".join([*(entry(a, b) for b in range(N)), f"y{a}", *("1e0" if a == b else "0e0" for b in range(N))]) + "]" for a in range(N)) + "]"
    ctes = [
        (f"{i}b", f"SELECT *, {at} FROM ({rows})"),
        (f"{i}s", f"SELECT {S}, any_value(freq) AS freq, count(*) AS n, sum(w * y * y) / sum(w) AS YY, {sums}, {right} FROM {i}b GROUP BY {S} "
                  f"HAVING count(*) >= {fr.LEAST}"),
        (f"{i}e0", f"SELECT {S}, freq, n, YY, ridge, [{', '.join(f'y{a}' for a in range(N))}] AS b, {matrix} AS m FROM {i}s, "
                   f"(SELECT unnest([{', '.join(f'{r!r}::DOUBLE' for r in fr.RIDGES)}]) AS ridge)"),
    ]
    for k in range(1, N + 1):
        step = (f"list_transform(m, lambda r, i: CASE WHEN i = {k} THEN r ELSE list_transform(r, lambda x, j: "
                f"x - m[{k}][j] * (r[{k}] / m[{k}][{k}])) END)")
        ctes.append((f"{i}e{k}", f"SELECT * REPLACE ({step} AS m) FROM {i}e{k - 1}"))
    x = "[" + ", ".join(f"m[{a}][{N + 1}] / m[{a}][{a}]" for a in range(1, N + 1)) + "]"
    trace = f"{N} - ridge * (" + " + ".join(f"m[{a}][{N + 1 + a}] / m[{a}][{a}]" for a in range(2, N + 1)) + ")"
    rss = "YY - (" + " + ".join(f"x[{a}] * b[{a}]" for a in range(1, N + 1)) + ") - ridge * (" + " + ".join(f"x[{a}] * x[{a}]" for a in range(2, N + 1)) + ")"
    names = ["c"] + [f"{f}{h}" for h in range(1, H + 1) for f in "ab"]
    ctes += [
        (f"{i}x", f"SELECT *, {x} AS x, {trace} AS trace FROM {i}e{N}"),
        (f"{i}g", f"SELECT *, ({rss}) / power(1 - trace / n, 2) AS gcv FROM {i}x"),
        (f"{i}fit", f"SELECT {S}, freq, n, ridge, {', '.join(f'x[{k}] AS {n}' for k, n in enumerate(names, 1))} FROM (SELECT *, row_number() OVER "
                    f"(PARTITION BY {S} ORDER BY round(gcv / nullif(YY, 0), 6), ridge) AS rn FROM {i}g) WHERE rn = 1"),
    ]
    return ctes


def _left(src: str, fit: str) -> str:
    tw = 2 * math.pi
    curve = " + ".join(f"a{h} * cos({h} * {tw!r} * freq * t) + b{h} * sin({h} * {tw!r} * freq * t)" for h in range(1, H + 1))
    return (f"SELECT r.object_id, r.passband, r.t, r.y - (c + {curve}) AS y, r.w FROM {src} r JOIN {fit} f ON f.object_id = r.object_id "
            "AND f.passband = r.passband")


def _frequency_sql() -> str:
    tw = 2 * math.pi
    trend = (f"SELECT {S}, CASE WHEN hi > lo THEN (TY - T * Y) / (TT - T * T) END AS slope, Y, T FROM (SELECT {S}, sum(w * t) / sum(w) AS T, "
             f"sum(w * y) / sum(w) AS Y, sum(w * t * t) / sum(w) AS TT, sum(w * t * y) / sum(w) AS TY, max(t) AS hi, min(t) AS lo FROM wrows GROUP BY {S})")
    r0 = ("SELECT r.object_id, r.passband, r.t, r.y - (l.Y - l.slope * l.T) - l.slope * r.t AS y, r.w FROM wrows r JOIN trend l "
          "ON l.object_id = r.object_id AND l.passband = r.passband WHERE l.slope IS NOT NULL")
    ctes = [grid_cte(), rows_cte(), ("trend", trend), ("r0", r0)]
    for i in (1, 2, 3):
        ctes += _peak_ctes(f"r{i - 1}", f"q{i}") + _fit_ctes(f"r{i - 1}", f"q{i}pk", "freq", f"q{i}")
        ctes.append((f"r{i}", _left(f"r{i - 1}", f"q{i}fit")))
    rel = lambda h: f"(atan2(b{h}, a{h}) - {h} * atan2(b1, a1))"
    for i in (1, 2, 3):
        amps = ", ".join(f"sqrt(a{h} * a{h} + b{h} * b{h}) AS freq{i}_amplitude{h}" for h in range(1, H + 1))
        phase = ", ".join(f"{rel(h)} - {tw!r} * ceil({rel(h)} / {tw!r} - 0.5) AS freq{i}_rel_phase{h}" for h in range(2, H + 1))
        ctes.append((f"o{i}", f"SELECT f.object_id, f.passband, f.freq AS freq{i}_freq, {amps}, {phase}, CASE WHEN p.power < 1 THEN "
                              f"-(f.n - 3) / 2e0 * log10(1 - p.power) END AS signif{i} FROM q{i}fit f JOIN q{i}pk p USING ({S})"))
    curve = " + ".join(f"a{h} * cos({h} * {tw / fr.CURVE!r} * i) + b{h} * sin({h} * {tw / fr.CURVE!r} * i)" for h in range(1, H + 1))
    ctes.append(("curve", f"SELECT {S}, i, {curve} AS v FROM q1fit, (SELECT unnest(range(0, {fr.CURVE})) AS i)"))
    ctes.append(("turns", f"SELECT {S}, i, v, coalesce(lag(v) OVER p, last_value(v) OVER a) AS before, coalesce(lead(v) OVER p, first_value(v) OVER a) AS after "
                          f"FROM curve WINDOW p AS (PARTITION BY {S} ORDER BY i), a AS (PARTITION BY {S} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING "
                          "AND UNBOUNDED FOLLOWING)"))
    ctes.append(("bends", f"SELECT {S}, list(v ORDER BY v DESC) FILTER (WHERE v > before AND v >= after) AS highs, list(v ORDER BY v) FILTER "
                          f"(WHERE v < before AND v <= after) AS lows, ((arg_max(i, v) - arg_min(i, v) + {fr.CURVE}) % {fr.CURVE}) / {fr.CURVE}::DOUBLE AS gap "
                          f"FROM turns GROUP BY {S}"))
    ctes.append(("spread0", f"SELECT {S}, sum(w * y * y) / sum(w) - power(sum(w * y) / sum(w), 2) AS before FROM r0 GROUP BY {S}"))
    ctes.append(("spread1", f"SELECT {S}, sum(w * y * y) / sum(w) - power(sum(w * y) / sum(w), 2) AS after FROM r1 GROUP BY {S}"))
    ctes.append(("fold", f"SELECT r.*, f.freq AS f, t * f.freq - floor(t * f.freq) AS ph1, t * f.freq / 2 - floor(t * f.freq / 2) AS ph2 "
                         f"FROM wrows r JOIN q1fit f USING ({S})"))
    win = lambda o: f"(PARTITION BY {S} ORDER BY {o})"
    circ = lambda c, o: f"coalesce(lag({c}) OVER {win(o)}, last_value({c}) OVER (PARTITION BY {S} ORDER BY {o} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
    ctes.append(("steps", f"SELECT *, y - lag(y) OVER {win('t')} AS d0, y - {circ('y', 'ph1, t')} AS d1, y - {circ('y', 'ph2, t')} AS d2, "
                          f"ph2 - {circ('ph2', 'ph2, t')} AS g2, median(y) OVER (PARTITION BY {S}) AS med FROM fold"))
    ctes.append(("stepf", f"SELECT {S}, median(abs(y - med)) AS mad, sum(d2 * d2) / nullif(sum(d0 * d0), 0) AS p2p_scatter_2praw, "
                          "sum(d0 * d0) / (count(*) - 1) / nullif(var_pop(y), 0) AS p2p_ssqr_diff_over_var, median(abs(d0)) AS m0, median(abs(d1)) AS m1, "
                          "quantile_cont(d2 / nullif((g2 - floor(g2)) * 2 / f, 0), 0.1) AS s0, quantile_cont(d2 / nullif((g2 - floor(g2)) * 2 / f, 0), 0.9) AS s1 "
                          f"FROM steps GROUP BY {S}"))
    ctes.append(("halves", f"SELECT {S}, freq / 2 AS half FROM q1fit"))
    ctes += _fit_ctes("r0", "halves", "half", "h")
    ctes.append(("rh", _left("r0", "hfit")))
    ctes.append(("two", f"SELECT {S}, quantile_cont(abs(y), 0.9) AS two FROM rh GROUP BY {S}"))
    ctes.append(("one", f"SELECT {S}, quantile_cont(abs(y), 0.9) AS one, median(abs(y - med)) AS rmad FROM (SELECT *, median(y) OVER (PARTITION BY {S}) AS med "
                        f"FROM r1) GROUP BY {S}"))
    near = lambda i: "CASE WHEN " + " OR ".join(f"abs(1 / freq{i}_freq - {p!r}) < 0.005 * {p!r}" for p in fr.ALIASES) + " THEN 1 ELSE 0 END"
    ratio = lambda a, b: f"{a} / nullif({b}, 0)"
    named = {
        "fold2P_slope_10percentile": "s0", "fold2P_slope_90percentile": "s1", "freq1_lambda": "q1fit.ridge", "freq1_signif": "signif1",
        "freq_amplitude_ratio_21": ratio("freq2_amplitude1", "freq1_amplitude1"), "freq_amplitude_ratio_31": ratio("freq3_amplitude1", "freq1_amplitude1"),
        "freq_frequency_ratio_21": ratio("freq2_freq", "freq1_freq"), "freq_frequency_ratio_31": ratio("freq3_freq", "freq1_freq"),
        "freq_model_max_delta_mags": "highs[1] - highs[2]", "freq_model_min_delta_mags": "lows[2] - lows[1]",
        "freq_model_phi1_phi2": ratio("gap", "(1 - gap)"), "freq_n_alias": f"CAST({near(1)} + {near(2)} + {near(3)} AS DOUBLE)",
        "freq_signif_ratio_21": ratio("signif2", "signif1"), "freq_signif_ratio_31": ratio("signif3", "signif1"),
        "freq_varrat": ratio("after", "before"), "freq_y_offset": "q1fit.c", "linear_trend": "slope", "medperc90_2p_p": ratio("two", "one"),
        "p2p_scatter_over_mad": ratio("m0", "mad"), "p2p_scatter_pfold_over_mad": ratio("m1", "mad"), "scatter_res_raw": ratio("rmad", "mad"),
    }
    cols = ", ".join(f"{named.get(n, n)} AS {n}" for n in fr.FREQUENCY)
    joins = " ".join(f"LEFT JOIN {t} USING ({S})" for t in ("o2", "o3", "bends", "spread0", "spread1", "stepf", "two", "one", "trend"))
    ctes.append(("flong", f"SELECT {S}, {cols} FROM q1fit JOIN o1 USING ({S}) {joins}"))
    wide = ", ".join(f"max({n}) FILTER (WHERE passband = {b}) AS {n}_{x}" for n in fr.FREQUENCY for b, x in zip(BANDS, BAND_LETTERS))
    body = f"SELECT m.object_id, {wide} FROM (SELECT DISTINCT object_id FROM lc) m LEFT JOIN flong s ON s.object_id = m.object_id GROUP BY m.object_id"
    return rounded(with_ctes(body, lc="event_groups", ctes=[(n, f"{q}") for n, q in ctes]))


@register("series_frequency", _frequency_sql())
def q_series_frequency(spark, sf_dir):
    """Three prewhitened frequencies, harmonic fits, folded order (282 columns)."""
    lc = lc_event_groups(spark, sf_dir)
    return fr.series_frequency(lc, lc.select("object_id").distinct())
