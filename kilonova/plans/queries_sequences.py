"""Registered sequence-preparation queries (Q1-Q5)."""
from __future__ import annotations

from ..operators import sequences
from ..sources.adapters import lc_events, with_ctes
from .catalog import register
from .sqlgen import snap_sql


def _lsnap(c: str) -> str:
    return f"list_transform({c}, lambda v: {snap_sql('v')})"


def _seq_sql(chans: list[str], src: str, pad: str) -> str:
    lists = ", ".join(f"list({c} ORDER BY mjd) AS {c}" for c in chans)
    s = f"SELECT object_id, passband, CAST(count(*) AS INTEGER) AS length, {lists} FROM {src} GROUP BY 1, 2"
    outs = ", ".join(_lsnap(f"list_resize(s.{c}, ml.max_len{', ' + pad if pad else ''})") + f" AS {c}"
                     for c in chans)
    return (f"SELECT s.object_id, s.passband, s.length, {outs} FROM s JOIN "
            f"(SELECT passband, max(length) AS max_len FROM s GROUP BY 1) ml ON ml.passband = s.passband"), s


def _sequences_sql() -> str:
    body, s = _seq_sql(["t", "flux", "flux_err"], "(SELECT *, mjd AS t FROM lc)", "")
    return with_ctes(body, lc="events", ctes=[("s", s)])


def _long_sql(chans: list[str], src: str, ctes: list | None = None) -> str:
    outs = ", ".join(snap_sql(c) + f" AS {c}" for c in chans)
    return with_ctes(f"SELECT object_id, passband, row_number() OVER (PARTITION BY object_id, passband ORDER BY mjd) AS slot, {outs} "
                     f"FROM {src}", lc="events", ctes=ctes)


def _scaled_ctes() -> list[tuple[str, str]]:
    r0 = ("SELECT object_id, passband, mjd, (CASE WHEN flux < 1 THEN 2.5 * log10(2 - flux) ELSE -2.5 * log10(flux) END)"
          " - 0.0 AS flux, flux_err, coalesce(mjd - lag(mjd) OVER (PARTITION BY object_id, passband ORDER BY mjd), 0) "
          "AS lag FROM lc")
    st = "SELECT passband, avg(flux) AS fm, stddev_pop(flux) AS fs FROM r0 GROUP BY 1"
    r1 = ("SELECT r0.object_id, r0.passband, r0.mjd, coalesce((r0.flux - st.fm) / nullif(st.fs, 0), 0) AS flux, "
          "coalesce((lag - avg(lag) OVER w2) / nullif(stddev_pop(lag) OVER w2, 0), 0) AS lag, "
          "coalesce(flux_err, 0) AS flux_err FROM r0 JOIN st ON st.passband = r0.passband "
          "WINDOW w2 AS (PARTITION BY r0.object_id, r0.passband)")
    return [("r0", r0), ("st", st), ("r1", r1)]


def _scaled_sql() -> str:
    body, s = _seq_sql(["lag", "flux", "flux_err"], "r1", "0.0")
    return with_ctes(body, lc="events", ctes=[*_scaled_ctes(), ("s", s)])


@register("sequences", _sequences_sql())
def q_sequences(spark, sf_dir):
    """Q1: per (object, band) time-ordered t / flux / flux_err arrays, NULL-padded to the band max length."""
    return sequences.to_sequences(lc_events(spark, sf_dir))


@register("scaled_sequences", _scaled_sql())
def q_scaled_sequences(spark, sf_dir):
    """Q2-Q5: magnitude, time lags, band / object scaling, zero padding."""
    return sequences.scaled_sequences(lc_events(spark, sf_dir), None)


@register("sequence_rows", _long_sql(["t", "flux", "flux_err"], "(SELECT *, mjd AS t FROM lc)"))
def q_sequence_rows(spark, sf_dir):
    """Q1 in long form: t / flux / flux_err by (object, band, slot), no arrays."""
    return sequences.sequence_rows(lc_events(spark, sf_dir))


@register("scaled_sequence_rows", _long_sql(["lag", "flux", "flux_err"], "r1", _scaled_ctes()))
def q_scaled_sequence_rows(spark, sf_dir):
    """Q2-Q5 in long form: scaled lag, flux and error by (object, band, slot)."""
    return sequences.scaled_rows(lc_events(spark, sf_dir))
