"""Skeleton and contact geometry: J20, J22-J24, A33-A37."""

from pyspark.sql import functions as F

from tractum.catalog.base import query
from tractum.catalog.joins import KEY3
from tractum.operators import aggs as A
from tractum.operators import skeleton as S
from tractum.operators.ordered import order_statistics

D3 = "({0}.x - {1}.x) * ({0}.x - {1}.x) + ({0}.y - {1}.y) * ({0}.y - {1}.y) + ({0}.z - {1}.z) * ({0}.z - {1}.z)"
SEG = f"""(SELECT c.neuron, c.node_id, c.x AS ax, c.y AS ay, c.z AS az, p.x AS bx, p.y AS by_, p.z AS bz, sqrt({D3.format("c", "p")}) AS len
           FROM tree c JOIN tree p ON c.neuron = p.neuron AND c.parent_id = p.node_id)"""
TOPO = f"""(SELECT t.neuron, count(*) AS n_nodes, count(*) FILTER (WHERE t.parent_id = -1) AS n_roots,
           count(*) FILTER (WHERE t.parent_id <> -1 AND s.node_id IS NULL) AS n_orphans, count(s.node_id) AS n_segments,
           coalesce(CAST(sum(CAST(s.len AS DECIMAL(18, 4))) AS DOUBLE), 0.0) AS cable
           FROM tree t LEFT JOIN {SEG} s ON t.neuron = s.neuron AND t.node_id = s.node_id GROUP BY 1)"""


@query("skeleton_topology", "tree", f"SELECT neuron, n_nodes, n_roots, n_orphans, n_segments FROM {TOPO} s")
def skeleton_topology(t):
    return S.topology(t.tree()).drop("cable")


@query("cable_length", "tree", f"SELECT neuron, n_segments, cable FROM {TOPO} s")
def cable_length(t):
    return S.topology(t.tree()).select("neuron", "n_segments", "cable")


@query("skeleton_geometry", "tree", """
    SELECT *, sqrt(span_x * span_x + span_y * span_y + span_z * span_z) AS diagonal FROM (SELECT neuron, count(*) AS n_nodes, min(radius) AS radius_min, max(radius) AS radius_max,
      count(*) FILTER (WHERE radius = 0) AS radius_zero, count(*) FILTER (WHERE radius < 0) AS radius_negative, max(x) - min(x) AS span_x, max(y) - min(y) AS span_y,
      max(z) - min(z) AS span_z FROM tree GROUP BY 1) s""")
def skeleton_geometry(t):
    return S.geometry(t.tree())


SITE_ID = ["okey", "ln", "x", "y", "z"]


@query("point_to_segment", "tree sites", f"""
    SELECT neuron, okey, ln, x, y, z, arg_min(node_id, (d, node_id)) AS near_id, min(d) AS near_dist FROM
     (SELECT neuron, okey, ln, x, y, z, node_id, sqrt((x - (ax + f * (bx - ax))) * (x - (ax + f * (bx - ax))) + (y - (ay + f * (by_ - ay))) * (y - (ay + f * (by_ - ay)))
             + (z - (az + f * (bz - az))) * (z - (az + f * (bz - az)))) AS d FROM
       (SELECT s.*, g.node_id, ax, ay, az, bx, by_, bz, least(greatest(coalesce(((s.x - ax) * (bx - ax) + (s.y - ay) * (by_ - ay) + (s.z - az) * (bz - az))
          / nullif((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) + (bz - az) * (bz - az), 0), 0.0), 0.0), 1.0) AS f
        FROM (SELECT DISTINCT * FROM sites) s LEFT JOIN {SEG} g USING (neuron)) q) r GROUP BY 1, 2, 3, 4, 5, 6""")
def point_to_segment(t):
    return S.nearest_segment(t.sites().distinct(), t.tree(), SITE_ID)


@query("point_to_node", "tree sites", f"""
    SELECT s.neuron, s.okey, s.ln, s.x, s.y, s.z, arg_min(n.node_id, (sqrt({D3.format("s", "n")}), n.node_id)) AS near_id, min(sqrt({D3.format("s", "n")})) AS near_dist
    FROM (SELECT DISTINCT * FROM sites) s LEFT JOIN tree n ON s.neuron = n.neuron GROUP BY 1, 2, 3, 4, 5, 6""")
def point_to_node(t):
    return S.nearest_node(t.sites().distinct(), t.tree(), SITE_ID)


RMS = " + ".join(f"(a.{e}_{x} - b.{e}_{x}) * (a.{e}_{x} - b.{e}_{x})" for e in ("pre", "post") for x in "xyz")
CONTACT = ("SELECT DISTINCT pre, post, region, okey * 10 + ln AS rid, pre_x, pre_y, pre_z, post_x, post_y, post_z FROM pts WHERE ")
NEAR = f"""(SELECT a.pre, a.post, a.region, a.rid, a.pre_x, a.pre_y, arg_min(b.rid, (sqrt(({RMS}) / 2), b.rid)) AS near_id, min(sqrt(({RMS}) / 2)) AS near_dist
    FROM ({CONTACT} ln <= 4) a LEFT JOIN ({CONTACT} ln >= 3) b ON a.pre = b.pre AND a.post = b.post AND a.region = b.region GROUP BY 1, 2, 3, 4, 5, 6)"""


def _nearest_contacts(t):
    rid = (F.col("okey") * 10 + F.col("ln")).alias("rid")
    coords = [f"{e}_{x}" for e in ("pre", "post") for x in "xyz"]
    def contacts(where):
        return t.pts().where(where).select(*KEY3, rid, *coords).distinct()
    a, b = contacts("ln <= 4"), contacts("ln >= 3")
    return S.nearest_contact(a, b, KEY3, ["rid", *coords], "rid").select(*KEY3, "rid", "pre_x", "pre_y", "near_id", "near_dist")


@query("nearest_in_key", "pts", f"SELECT * FROM {NEAR} n")
def nearest_in_key(t):
    return _nearest_contacts(t)


RADII = [100, 1000, 5000, 20000]


@query("distance_thresholds", "pts", f"""
    SELECT region, count(*) AS n_rows, {", ".join(f"count(*) FILTER (WHERE near_dist <= {r}) AS within_{r}" for r in RADII)}, max(near_dist) AS largest FROM {NEAR} n GROUP BY 1""")
def distance_thresholds(t):
    return A.threshold_counts(_nearest_contacts(t), ["region"], "near_dist", RADII, below=True, prefix="within_")


@query("tail_flags", "tree", f"""
    SELECT neuron, cable, n_orphans, array_to_string([f FOR f IN [CASE WHEN cable <= c1 THEN 'short_cable' END, CASE WHEN cable >= c99 THEN 'long_cable' END,
      CASE WHEN n_orphans <= o1 THEN 'few_orphans' END, CASE WHEN n_orphans >= o99 THEN 'many_orphans' END] IF f IS NOT NULL], ';') AS flags
    FROM {TOPO} s, (SELECT quantile_cont(cable, 0.05) AS c1, quantile_cont(cable, 0.95) AS c99, quantile_cont(n_orphans, 0.05) AS o1, quantile_cont(n_orphans, 0.95) AS o99 FROM {TOPO} q) l""")
def tail_flags(t):
    from tractum.session import stage

    topo = stage(S.topology(t.tree()))
    limits = {}
    for c in ("cable", "n_orphans"):
        row = order_statistics(topo, [], c, {"lo": 0.05, "hi": 0.95}).first()  # one row of limits
        limits[c] = (row["lo"], row["hi"])
    flags = F.array_compact(F.array(
        F.when(F.col("cable") <= limits["cable"][0], "short_cable"), F.when(F.col("cable") >= limits["cable"][1], "long_cable"),
        F.when(F.col("n_orphans") <= limits["n_orphans"][0], "few_orphans"), F.when(F.col("n_orphans") >= limits["n_orphans"][1], "many_orphans")))
    return topo.select("neuron", "cable", "n_orphans", F.array_join(flags, ";").alias("flags"))
