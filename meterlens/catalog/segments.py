"""Client profile and segmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlens import schema as S
from meterlens.catalog.registry import query
from meterlens.catalog.reports import _round
from meterlens.catalog.views import cte, readings
from meterlens.operators import segment
from meterlens.operators.density import density_clusters

L = "readings_l"

_PROFILE = f"""{cte(L)}, pf AS (SELECT client_id, quantile_cont(volume, 0.5) AS vol_med, quantile_cont(volume, 0.9) AS vol_p90,
    quantile_cont(pressure, 0.5) AS pres_med, quantile_cont(pressure, 0.9) AS pres_p90, count(*) AS n_obs FROM {L} GROUP BY client_id)"""
# A grouping that both engines can compute; every seventh client stands for noise.
_GROUPED = f"""{_PROFILE}, gr AS (SELECT *, CASE WHEN CAST(client_id AS INTEGER) % 7 = 0 THEN NULL
    ELSE 'c' || CAST(CAST(client_id AS INTEGER) % 5 AS VARCHAR) END AS cluster FROM pf)"""
_CENTRES = f"""{_GROUPED}, ce AS (SELECT cluster, avg(vol_med) AS vol_med, avg(vol_p90) AS vol_p90, avg(pres_med) AS pres_med,
    avg(pres_p90) AS pres_p90 FROM gr WHERE cluster IS NOT NULL GROUP BY cluster),
    cs AS (SELECT *, CASE WHEN vol_p90 > (SELECT median(vol_p90) FROM ce) THEN 'Industrial' ELSE 'Comercial' END AS segment FROM ce)"""


def _grouped(spark, sf):
    return segment.client_profiles(readings(spark, sf, L)).withColumn(
        "cluster", F.expr("CASE WHEN CAST(client_id AS INT) % 7 = 0 THEN NULL ELSE concat('c', CAST(client_id AS INT) % 5) END")
    )


@query(
    "client_profiles",
    f"WITH {_PROFILE} SELECT client_id, round(vol_med, 5) AS vol_med, round(vol_p90, 5) AS vol_p90, round(pres_med, 5) AS pres_med, round(pres_p90, 5) AS pres_p90, n_obs FROM pf",
)
def _(spark, sf):
    return _round(segment.client_profiles(readings(spark, sf, L)), 5)


def _z(c: str) -> str:
    return f"({c} - (SELECT avg({c}) FROM pf)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM pf)"


@query(
    "standardised_profiles",
    f"WITH {_PROFILE} SELECT client_id, " + ", ".join(f"round({_z(c)}, 5) AS x{i}" for i, c in enumerate(segment.FEATURES)) + " FROM pf",
)
def _(spark, sf):
    profiles = segment.client_profiles(readings(spark, sf, L))
    df = segment.standardise(profiles, segment._spread(profiles))
    return _round(df.select("client_id", "x0", "x1", "x2", "x3"), 5)


@query(
    "cluster_centres",
    f"WITH {_CENTRES} SELECT cluster, round(vol_med, 5) AS vol_med, round(vol_p90, 5) AS vol_p90, round(pres_med, 5) AS pres_med, round(pres_p90, 5) AS pres_p90 FROM ce",
)
def _(spark, sf):
    return _round(segment.cluster_centres(_grouped(spark, sf)), 5)


@query("centre_segments", f"WITH {_CENTRES} SELECT cluster, segment FROM cs")
def _(spark, sf):
    return segment.centre_segments(segment.cluster_centres(_grouped(spark, sf))).select("cluster", "segment")


@query(
    "nearest_centre",
    f"""WITH {_CENTRES}, nz AS (SELECT client_id, {', '.join(f'{_z(c)} AS x{i}' for i, c in enumerate(segment.FEATURES))} FROM gr WHERE cluster IS NULL),
        cz AS (SELECT cluster, segment, {', '.join(f'{_z(c)} AS x{i}' for i, c in enumerate(segment.FEATURES))} FROM cs)
        SELECT client_id, arg_min(segment, (d, cluster)) AS segment FROM (
            SELECT client_id, cluster, segment, round({' + '.join(f'(n.x{i} - c.x{i}) * (n.x{i} - c.x{i})' for i in range(4))}, 9) AS d
            FROM nz n, cz c) GROUP BY client_id""",
)
def _(spark, sf):
    grouped = _grouped(spark, sf)
    spread = segment._spread(grouped)
    centres = segment.centre_segments(segment.cluster_centres(grouped))
    return segment.nearest_centre(
        segment.standardise(grouped.where("cluster IS NULL"), spread),
        segment.standardise(centres, spread).select("cluster", S.SEGMENT, "x0", "x1", "x2", "x3"),
    )


@query(
    "attach_segments",
    f"""WITH {_CENTRES}, sg AS (SELECT gr.client_id, cs.segment AS seg FROM gr JOIN cs USING (cluster))
        SELECT l.client_id, l.src_ord, coalesce(sg.seg, 'Comercial') AS segment FROM {L} l LEFT JOIN sg USING (client_id)""",
)
def _(spark, sf):
    grouped = _grouped(spark, sf)
    by_cluster = segment.centre_segments(segment.cluster_centres(grouped)).select("cluster", S.SEGMENT)
    segments = grouped.join(by_cluster, "cluster").select("client_id", S.SEGMENT)
    return segment.attach_segments(readings(spark, sf, L), segments).select("client_id", "src_ord", "segment")


_NEIGHBOURS = f"""{_PROFILE}, xz AS (SELECT client_id, {', '.join(f'{_z(c)} AS x{i}' for i, c in enumerate(segment.FEATURES))} FROM pf),
    pr AS (SELECT a.client_id AS a, b.client_id AS b FROM xz a JOIN xz b ON
        {' + '.join(f'(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})' for i in range(4))} <= 0.3425 * 0.3425),
    co AS (SELECT a FROM pr GROUP BY a HAVING count(*) >= 3)"""


@query(
    "density_clusters",
    f"""WITH RECURSIVE {_NEIGHBOURS}, ed AS (SELECT a, b FROM pr WHERE a IN (SELECT a FROM co) AND b IN (SELECT a FROM co)),
        rc(root, node) AS (SELECT a, a FROM co UNION SELECT rc.root, ed.b FROM rc JOIN ed ON ed.a = rc.node),
        lb AS (SELECT node, min(root) AS label FROM rc GROUP BY node),
        bd AS (SELECT pr.a AS node, min(lb.label) AS label FROM pr JOIN lb ON lb.node = pr.b WHERE pr.a NOT IN (SELECT a FROM co) GROUP BY pr.a)
        SELECT xz.client_id AS id, coalesce(lb.label, bd.label) AS cluster FROM xz
        LEFT JOIN lb ON lb.node = xz.client_id LEFT JOIN bd ON bd.node = xz.client_id""",
)
def _(spark, sf):
    profiles = segment.client_profiles(readings(spark, sf, L))
    points = segment.standardise(profiles, segment._spread(profiles))
    return density_clusters(points.select(F.col("client_id").alias("id"), "x0", "x1", "x2", "x3"), 0.3425, 3, 4)


@query("segment_clients")
def _(spark, sf):
    return segment.segment_profiles(segment.client_profiles(readings(spark, sf, L)))
