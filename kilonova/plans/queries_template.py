"""Registered template-fit query."""
from __future__ import annotations

from ..operators import template
from ..sources.adapters import lc_lineitem, meta_part, with_ctes
from .catalog import register
from .sqlgen import rounded, snap_sql

_PEAK = ("SELECT *, first_value(mjd) OVER (PARTITION BY object_id ORDER BY flux DESC, mjd ASC) AS pk, "
         "max(flux) OVER (PARTITION BY object_id) AS pf FROM lc")
_OBS = ("SELECT *, CAST(object_id % 5 AS INTEGER) AS fold, power(1 / nullif(flux_err, 0), 2) AS w2 FROM pk "
        "WHERE nullif(flux_err, 0) IS NOT NULL AND flux IS NOT NULL "
        "AND object_id IN (SELECT object_id FROM meta WHERE hostgal_photoz != 0)")
_REL = ("SELECT CAST(p.object_id % 5 AS INTEGER) AS fold, m.target AS template, p.passband, "
        "CAST(floor((p.mjd - p.pk - -50.0) / 10.0) AS INTEGER) AS bin, p.flux / p.pf AS r FROM pk p "
        "JOIN meta m ON m.object_id = p.object_id WHERE p.pf > 0 "
        "AND floor((p.mjd - p.pk - -50.0) / 10.0) >= 0 AND floor((p.mjd - p.pk - -50.0) / 10.0) < 20")
# a template of a fold: the mean over the rows of all other folds
_TPL = ("SELECT f.fold, r.template, r.passband, r.bin, avg(r.r) AS m FROM rel r JOIN (SELECT unnest(range(5)) AS fold) f "
        "ON f.fold <> r.fold GROUP BY 1, 2, 3, 4")
# every observation answers for every candidate of its object: 0 where the template has no value
_CAND = ("SELECT DISTINCT o.object_id, t.template, s.shift FROM obs o JOIN (SELECT unnest([-20.0, -10.0, 0.0, 10.0, 20.0])::DOUBLE AS shift) s "
         "ON TRUE JOIN tpl t ON t.fold = o.fold AND t.passband = o.passband AND t.bin = CAST(floor((o.mjd - o.pk - s.shift - -50.0) / 10.0) AS INTEGER)")
_ALL = ("SELECT c.object_id, c.template, c.shift, o.flux, o.w2, coalesce(t.m, 0) AS m, t.m IS NOT NULL AS hit FROM cand c "
        "JOIN obs o ON o.object_id = c.object_id LEFT JOIN tpl t ON t.fold = o.fold AND t.template = c.template AND t.passband = o.passband "
        "AND t.bin = CAST(floor((o.mjd - o.pk - c.shift - -50.0) / 10.0) AS INTEGER)")
_FIT = ("SELECT *, ff - coalesce(x0 * fm, 0) AS chi2, (ff - coalesce(x0 * fm, 0)) / (n_obs - 1) AS rchi2 FROM ("
        "SELECT object_id, template, shift, sum(flux * m * w2) AS fm, sum(flux * m * w2) / nullif(sum(m * m * w2), 0) AS x0, "
        "sum(flux * flux * w2) AS ff, count(*) FILTER (WHERE hit) AS n_used, count(*) AS n_obs FROM alls GROUP BY 1, 2, 3) WHERE n_obs >= 2")
_BODY = ("SELECT m.object_id, b.template AS best_template, b.shift AS best_shift, b.x0, b.chi2, b.n_used, b.n_obs FROM meta m "
         "LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY "
         f"{snap_sql('rchi2')} ASC, template ASC, shift ASC) AS rn FROM fit) WHERE rn = 1) b "
         "ON b.object_id = m.object_id")


@register("template_fit", rounded(with_ctes(_BODY, meta=True, ctes=[
    ("pk", _PEAK), ("obs", _OBS), ("rel", _REL), ("tpl", _TPL), ("cand", _CAND), ("alls", _ALL), ("fit", _FIT)]),
    keys=("object_id", "best_template", "n_used", "n_obs")))
def q_template_fit(spark, sf_dir):
    """Class templates learned around the peak, best template, shift and amplitude per object."""
    lc, meta = lc_lineitem(spark, sf_dir), meta_part(spark, sf_dir)
    return template.template_fit(lc, meta, template.learn_templates(lc, meta))
