"""The catalogue's queries in SQL, each a chain of named parts that later ones build on."""

from __future__ import annotations

from lattica.plans.catalogue import CHANNELS, FAR, NEAR, NEAR_2D, PREFILTER, PREFILTER_2D, RIM

VZ, VY, VX, PX = 0.56, 0.28, 0.28, 0.1085
SIZE = f"({VZ}::DOUBLE * {VY}::DOUBLE * {VX}::DOUBLE)"


def _square(a: str, b: str) -> str:
    """Squared distance of places a and b (table names), added up in the order z, y, x."""
    return " + ".join(f"(({a}.{k} - {b}.{k}) * {s}::DOUBLE) * (({a}.{k} - {b}.{k}) * {s}::DOUBLE)" for k, s in zip("zyx", (VZ, VY, VX)))


_EXTENT = "z0, z1, y0, y1, x0, x1"
_BOUNDS = "min(z) z0, max(z) + 1 z1, min(y) y0, max(y) + 1 y1, min(x) x0, max(x) + 1 x1"
_IN = "{p}.z >= {b}.z0 AND {p}.z < {b}.z1 AND {p}.y >= {b}.y0 AND {p}.y < {b}.y1 AND {p}.x >= {b}.x0 AND {p}.x < {b}.x1"
_OFF26 = "(SELECT dz, dy, dx FROM range(-1, 2) a(dz), range(-1, 2) b(dy), range(-1, 2) c(dx) WHERE NOT (dz = 0 AND dy = 0 AND dx = 0))"

PARTS = {
    "gg": "SELECT CAST(ceil(round(cbrt(count(*)), 9) - 1e-9) AS BIGINT) g FROM supplier",
    "seeds": """SELECT s_suppkey + 1 cell_id, r_name cell_type, 6 * (s_suppkey // (g * g)) + 3 cz, 6 * ((s_suppkey // g) % g) + 3 cy, 6 * (s_suppkey % g) + 3 cx,
        s_nationkey % 2 ex, (s_nationkey // 2) % 2 ey, (s_nationkey // 4) % 2 ez FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, gg""",
    "vox": """SELECT CAST(cz + dz AS INT) z, CAST(cy + dy AS INT) y, CAST(cx + dx AS INT) x, cell_id AS label FROM seeds, range(-3, 3) a(dz), range(-3, 3) b(dy), range(-3, 3) c(dx)
        WHERE dz >= -2 - ez AND dy >= -2 - ey AND dx >= -2 - ex AND abs(dz) + abs(dy) + abs(dx) <= 6""",
    "cells": "SELECT cell_id, cell_type, cx2 centroid_x, cy2 centroid_y, cz2 centroid_z FROM seeds JOIN (SELECT label, avg(x) cx2, avg(y) cy2, avg(z) cz2 FROM vox GROUP BY label) ON label = cell_id",
    "bounds": f"SELECT label, {_BOUNDS} FROM vox GROUP BY label",
    "halo": "SELECT label, CAST(greatest(0, z0 - 1) AS INT) z0, CAST(least(6 * g, z1 + 1) AS INT) z1, CAST(greatest(0, y0 - 2) AS INT) y0, CAST(least(6 * g, y1 + 2) AS INT) y1, CAST(greatest(0, x0 - 2) AS INT) x0, CAST(least(6 * g, x1 + 2) AS INT) x1 FROM bounds, gg",
    "inner26": f"SELECT v.z, v.y, v.x FROM vox v, {_OFF26} o JOIN vox w ON w.z = v.z + dz AND w.y = v.y + dy AND w.x = v.x + dx GROUP BY ALL HAVING count(*) = 26",
    "skin": "SELECT * FROM vox v WHERE NOT EXISTS (SELECT 1 FROM inner26 i WHERE i.z = v.z AND i.y = v.y AND i.x = v.x)",
    "faces": " UNION ALL ".join(f"SELECT a.label la, b.label lb, a.z, a.y, a.x, b.z bz, b.y \"by\", b.x bx FROM vox a JOIN vox b ON b.z = a.z + {z} AND b.y = a.y + {y} AND b.x = a.x + {x}" for z, y, x in ((1, 0, 0), (0, 1, 0), (0, 0, 1))),
    "skin6": "SELECT v.z, v.y, v.x, v.label FROM vox v LEFT JOIN (SELECT z, y, x, count(*) n FROM (SELECT z, y, x FROM faces WHERE la = lb UNION ALL SELECT bz, \"by\", bx FROM faces WHERE la = lb) GROUP BY ALL) f USING (z, y, x) WHERE coalesce(n, 0) < 6",
    "touch": "SELECT DISTINCT least(la, lb) cell_id_a, greatest(la, lb) cell_id_b FROM faces WHERE la <> lb",
    "cand": f"""SELECT a.cell_id cell_id_a, b.cell_id cell_id_b FROM cells a JOIN cells b ON a.cell_id < b.cell_id WHERE
        (a.centroid_z * {VZ}::DOUBLE - b.centroid_z * {VZ}::DOUBLE) ** 2 + (a.centroid_y * {VY}::DOUBLE - b.centroid_y * {VY}::DOUBLE) ** 2 + (a.centroid_x * {VX}::DOUBLE - b.centroid_x * {VX}::DOUBLE) ** 2 <= {PREFILTER}::DOUBLE ** 2""",
    "open": "SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM touch t WHERE t.cell_id_a = c.cell_id_a AND t.cell_id_b = c.cell_id_b)",
    "exact": f"SELECT cell_id_a, cell_id_b, min(sqrt({_square('s', 't')})) surface_distance_um FROM open JOIN skin6 s ON s.label = cell_id_a JOIN skin6 t ON t.label = cell_id_b GROUP BY ALL HAVING min(sqrt({_square('s', 't')})) <= {NEAR}",
    "boxed": f"""SELECT cell_id_a, cell_id_b FROM open JOIN halo h ON h.label = cell_id_a WHERE EXISTS (SELECT 1 FROM skin s WHERE s.label = cell_id_b AND {_IN.format(p='s', b='h')})
        AND EXISTS (SELECT 1 FROM skin s WHERE s.label = cell_id_a AND {_IN.format(p='s', b='h')})""",
    "edges": """SELECT row_number() OVER (ORDER BY k, cell_id_a, cell_id_b) pair_id, cell_id_a, cell_id_b, a.cell_type cell_type_a, b.cell_type cell_type_b, surface_distance_um
        FROM (SELECT cell_id_a, cell_id_b, 0.0::DOUBLE surface_distance_um, 0 k FROM touch UNION ALL SELECT cell_id_a, cell_id_b, surface_distance_um, 1 FROM exact) JOIN cells a ON a.cell_id = cell_id_a JOIN cells b ON b.cell_id = cell_id_b""",
    "edgesp": """SELECT row_number() OVER (ORDER BY k, cell_id_a, cell_id_b) pair_id, cell_id_a, cell_id_b, a.cell_type cell_type_a, b.cell_type cell_type_b
        FROM (SELECT cell_id_a, cell_id_b, 0 k FROM touch UNION ALL SELECT cell_id_a, cell_id_b, 1 FROM boxed) JOIN cells a ON a.cell_id = cell_id_a JOIN cells b ON b.cell_id = cell_id_b""",
    "pairs": "SELECT pair_id, cell_id_a cell_a_id, cell_id_b cell_b_id, cell_type_a cell_a_type, cell_type_b cell_b_type FROM edgesp",
    "wanted": "SELECT cell_a_id cell FROM pairs UNION SELECT cell_b_id FROM pairs",
    "spots": "SELECT label cell, z, y, CAST(unnest(range(x0, x1)) AS INT) x FROM (SELECT label, z, CAST(unnest(range(y0, y1)) AS INT) y, x0, x1 FROM (SELECT label, CAST(unnest(range(z0, z1)) AS INT) z, y0, y1, x0, x1 FROM halo)) WHERE label IN (SELECT cell FROM wanted)",
    "dist": f"""SELECT cell, z, y, x, d FROM (SELECT cell, p.z, p.y, p.x, min(sqrt({_square('p', 's')})) d FROM spots p JOIN skin s ON s.label = cell GROUP BY ALL)
        JOIN (SELECT cell, p.z, p.y, p.x, min(abs(v.z - p.z) + abs(v.y - p.y) + abs(v.x - p.x)) n FROM spots p JOIN vox v ON v.label = cell GROUP BY ALL) USING (cell, z, y, x) WHERE d <= {FAR} AND n <= 11""",
    "gap0": f"""SELECT pair_id, a.z, a.y, a.x, a.d + b.d AS d, coalesce(v.label, 0) AS label FROM pairs JOIN dist a ON a.cell = cell_a_id JOIN dist b ON b.cell = cell_b_id AND a.z = b.z AND a.y = b.y AND a.x = b.x
        LEFT JOIN vox v ON v.z = a.z AND v.y = a.y AND v.x = a.x WHERE a.d + b.d <= {FAR} AND coalesce(v.label, 0) NOT IN (cell_a_id, cell_b_id)""",
    "gap": "SELECT pair_id, z, y, x FROM gap0 WHERE label = 0",
    "contact": """SELECT DISTINCT pair_id, z, y, x FROM pairs JOIN (SELECT least(la, lb) p, greatest(la, lb) q, z, y, x FROM faces WHERE la <> lb UNION ALL SELECT least(la, lb), greatest(la, lb), bz, "by", bx FROM faces WHERE la <> lb) ON p = cell_a_id AND q = cell_b_id""",
    "rim": f"""SELECT pair_id, v.z, v.y, v.x FROM pairs JOIN vox v ON v.label IN (cell_a_id, cell_b_id) WHERE EXISTS (SELECT 1 FROM gap0 s WHERE s.pair_id = pairs.pair_id AND abs(v.z - s.z) <= 1 AND abs(v.y - s.y) <= 3 AND abs(v.x - s.x) <= 3 AND sqrt({_square('v', 's')}) <= {RIM})""",
    "held": "SELECT * FROM gap UNION ALL SELECT * FROM rim UNION ALL SELECT * FROM contact",
    "mesh": "SELECT z, y, x, max(pair_id) pair_id FROM held GROUP BY ALL",
    "rest": "SELECT * FROM vox v WHERE NOT EXISTS (SELECT 1 FROM mesh m WHERE m.z = v.z AND m.y = v.y AND m.x = v.x)",
    # face-connected parts of each pair's gap: what every voxel reaches, and the least voxel of that
    "spot": "SELECT pair_id, z, y, x, (z * 100000::BIGINT + y) * 100000 + x AS c FROM gap",
    "step": "SELECT a.pair_id, a.c AS p, b.c AS q FROM spot a JOIN spot b ON a.pair_id = b.pair_id AND abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1",
    "reach": "SELECT pair_id, c AS p, c AS q FROM spot UNION SELECT r.pair_id, r.p, s.q FROM reach r JOIN step s ON s.pair_id = r.pair_id AND s.p = r.q",
    "comps": "SELECT pair_id, count(*) num_components, max(n) largest FROM (SELECT pair_id, root, count(*) n FROM (SELECT pair_id, p, min(q) root FROM reach GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY 1",
    "vol": f"""SELECT p.*, (coalesce(g.n, 0) + coalesce(r.n, 0) + coalesce(c.n, 0)) * {SIZE} total_intercell_volume_um3, coalesce(g.n, 0) + coalesce(r.n, 0) + coalesce(c.n, 0) total_intercell_volume_voxels,
        coalesce(g.n, 0) * {SIZE} edt_volume_um3, coalesce(g.n, 0) edt_volume_voxels, coalesce(r.n, 0) * {SIZE} intracellular_volume_um3, coalesce(r.n, 0) intracellular_volume_voxels,
        coalesce(c.n, 0) * {SIZE} touching_surface_area_um2, coalesce(c.n, 0) touching_surface_area_voxels, coalesce(m.mean_d, 0.0) mean_distance_um, coalesce(m.max_d, 0.0) max_distance_um,
        {SIZE} voxel_volume_um3, {FAR}::DOUBLE max_distance_threshold_um, {RIM}::DOUBLE intracellular_threshold_um, coalesce(u.n, 0) union_voxels, coalesce(k.num_components, 0) num_components, coalesce(k.largest, 0) * {SIZE} largest_component_volume_um3
        FROM pairs p LEFT JOIN (SELECT pair_id, count(*) n FROM gap GROUP BY 1) g USING (pair_id) LEFT JOIN (SELECT pair_id, count(*) n FROM rim GROUP BY 1) r USING (pair_id) LEFT JOIN (SELECT pair_id, count(*) n FROM contact GROUP BY 1) c USING (pair_id)
        LEFT JOIN (SELECT pair_id, avg(d) mean_d, max(d) max_d FROM gap0 GROUP BY 1) m USING (pair_id) LEFT JOIN (SELECT pair_id, count(DISTINCT (z, y, x)) n FROM held GROUP BY 1) u USING (pair_id) LEFT JOIN comps k USING (pair_id)""",
    "gp": "SELECT CAST(ceil(round(sqrt(count(*)), 9) - 1e-9) AS BIGINT) g FROM supplier",
    "pseeds": """SELECT s_suppkey + 1 cell_id, r_name cell_type, 6 * (s_suppkey // g) + 3 cy, 6 * (s_suppkey % g) + 3 cx, s_nationkey % 2 ex, (s_nationkey // 2) % 2 ey
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, gp""",
    "pix": "SELECT CAST(cy + dy AS INT) y, CAST(cx + dx AS INT) x, cell_id AS label FROM pseeds, range(-3, 3) b(dy), range(-3, 3) c(dx) WHERE dy >= -2 - ey AND dx >= -2 - ex",
    "pfaces": "SELECT a.label la, b.label lb FROM pix a JOIN pix b ON (b.y = a.y + 1 AND b.x = a.x) UNION ALL SELECT a.label, b.label FROM pix a JOIN pix b ON b.y = a.y AND b.x = a.x + 1",
    "ptouch": "SELECT DISTINCT least(la, lb) cell_id_a, greatest(la, lb) cell_id_b FROM pfaces WHERE la <> lb",
    "near8": "SELECT dy, dx FROM range(-1, 2) b(dy), range(-1, 2) c(dx) WHERE NOT (dy = 0 AND dx = 0)",
    "pown": "SELECT v.y, v.x, v.label FROM pix v LEFT JOIN (SELECT v.y, v.x FROM pix v, near8 JOIN pix w ON w.y = v.y + dy AND w.x = v.x + dx WHERE w.label = v.label GROUP BY ALL HAVING count(*) = 8) i USING (y, x) WHERE i.y IS NULL",
    "pskin": "SELECT v.y, v.x, v.label FROM pix v LEFT JOIN (SELECT v.y, v.x FROM pix v, near8 JOIN pix w ON w.y = v.y + dy AND w.x = v.x + dx GROUP BY ALL HAVING count(*) = 8) i USING (y, x) WHERE i.y IS NULL",
    "pcand": f"SELECT a.cell_id cell_id_a, b.cell_id cell_id_b FROM pseeds a JOIN pseeds b ON a.cell_id < b.cell_id WHERE (a.cy * {PX}::DOUBLE - b.cy * {PX}::DOUBLE) ** 2 + (a.cx * {PX}::DOUBLE - b.cx * {PX}::DOUBLE) ** 2 <= {PREFILTER_2D}::DOUBLE ** 2 AND (a.cell_id, b.cell_id) NOT IN (SELECT (cell_id_a, cell_id_b) FROM ptouch)",
    "pnear": f"SELECT cell_id_a, cell_id_b, min(sqrt(((s.y - t.y) * {PX}::DOUBLE) * ((s.y - t.y) * {PX}::DOUBLE) + ((s.x - t.x) * {PX}::DOUBLE) * ((s.x - t.x) * {PX}::DOUBLE))) surface_distance_um FROM pcand JOIN pown s ON s.label = cell_id_a JOIN pskin t ON t.label = cell_id_b GROUP BY ALL",
}


def _sql(select: str, last: str) -> str:
    """`select` after all parts up to `last`, of its dimension."""
    plane = last in list(PARTS)[list(PARTS).index("gp") :]
    names = list(PARTS)[list(PARTS).index("gp") :] if plane else list(PARTS)
    names = names[: names.index(last) + 1]
    return "WITH RECURSIVE " + ", ".join(f"{n} AS {'' if n == 'reach' else 'MATERIALIZED '}({PARTS[n]})" for n in names) + " " + select


def _zonal(value: str, name: str) -> str:
    return f"round(sum({value}), 6) {name}_sum, round(avg({value}), 6) {name}_mean, round(stddev_pop({value}), 6) {name}_std, round(min({value}), 6) {name}_min, round(max({value}), 6) {name}_max, round(count(*) FILTER ({value} <> 0) / count({value}), 6) {name}_nonzero_fraction"


V = "total_intercell_volume_um3"
_DEG = "SELECT cell_id_a c, cell_id_b o FROM edges UNION SELECT cell_id_b, cell_id_a FROM edges"
ORACLES = {
    "zonal_stats": f"SELECT l_suppkey + 1 AS label, count(*) voxel_count, {', '.join(_zonal(c, c) for c in CHANNELS)} FROM lineitem GROUP BY 1",
    "zonal_stats_background": f"SELECT l_suppkey AS label, count(*) voxel_count, {_zonal('l_quantity', 'q')}, {_zonal('l_extendedprice', 'price')} FROM lineitem GROUP BY 1",
    "zonal_of_grid": _sql(f"SELECT label, count(*) voxel_count, {', '.join(_zonal(f'((z * 31 + y * 17 + x * 7 + {13 * c}) % 11)::DOUBLE', f'c{c}') for c in (0, 1))} FROM vox GROUP BY 1", "vox"),
    "label_boxes": _sql("SELECT * FROM bounds", "bounds"),
    "halo_boxes": _sql("SELECT * FROM halo", "halo"),
    "halo_boxes_open": _sql("SELECT label, CAST(greatest(0, z0 - 1) AS INT) z0, z1 + 2 z1, CAST(greatest(0, y0 - 2) AS INT) y0, y1 + 3 y1, CAST(greatest(0, x0 - 2) AS INT) x0, x1 + 3 x1 FROM bounds", "bounds"),
    "surface_voxels": _sql("SELECT * FROM skin", "skin"),
    "surface_counts": _sql("SELECT count(*) surface_voxels, count(DISTINCT label) labels FROM skin", "skin"),
    "cell_surface_6n": _sql("SELECT * FROM skin6", "skin6"),
    "touching_pairs": _sql("SELECT * FROM touch", "touch"),
    "candidate_pairs": _sql("SELECT * FROM cand", "cand"),
    "radius_lookup": _sql("SELECT CASE WHEN cell_id_a = 5 THEN cell_id_b ELSE cell_id_a END cell_id FROM cand WHERE 5 IN (cell_id_a, cell_id_b)", "cand"),
    "near_pairs_exact": _sql("SELECT cell_id_a, cell_id_b, round(surface_distance_um, 6) surface_distance_um FROM exact", "exact"),
    "near_pairs_parity": _sql("SELECT * FROM boxed", "boxed"),
    "neighbor_edges": _sql("SELECT * REPLACE (round(surface_distance_um, 6) AS surface_distance_um) FROM edges", "edges"),
    "neighbor_edges_parity": _sql("SELECT * FROM edgesp", "edgesp"),
    "neighbors_touching_only": _sql("SELECT row_number() OVER (ORDER BY cell_id_a, cell_id_b) pair_id, cell_id_a, cell_id_b, a.cell_type cell_type_a, b.cell_type cell_type_b FROM touch JOIN cells a ON a.cell_id = cell_id_a JOIN cells b ON b.cell_id = cell_id_b", "touch"),
    "renumbered": _sql("SELECT row_number() OVER (ORDER BY pair_id) pair_id, 3 * pair_id + 4 AS old_id, cell_id_a, cell_id_b FROM edges", "edges"),
    "type_pair_filter": _sql("SELECT * REPLACE (round(surface_distance_um, 6) AS surface_distance_um) FROM edges WHERE (cell_type_a, cell_type_b) IN (('ASIA', 'EUROPE'), ('EUROPE', 'ASIA'))", "edges"),
    "cell_connectivity": _sql(f"""SELECT cell_id, cell_type, round(centroid_x, 6) centroid_x, round(centroid_y, 6) centroid_y, round(centroid_z, 6) centroid_z, count(a.cell_id_b) + count(b.cell_id_a) total_neighbors,
        count(DISTINCT a.cell_id_b) + count(DISTINCT b.cell_id_a) unique_neighbors, (SELECT count(*) FROM ({_DEG}) WHERE c = cell_id) AS degree
        FROM cells LEFT JOIN edges a ON a.cell_id_a = cell_id LEFT JOIN edges b ON b.cell_id_b = cell_id GROUP BY ALL""", "edges"),
    "graph_totals": _sql("SELECT (SELECT count(*) FROM cells) total_cells, (SELECT count(*) FROM edges) total_pairs, (SELECT count(DISTINCT cell_type) FROM cells) unique_cell_types", "edges"),
    "export_metadata": _sql("SELECT 'total_cells' AS key, (SELECT count(*)::VARCHAR FROM cells) AS value UNION ALL SELECT 'total_pairs', (SELECT count(*)::VARCHAR FROM edges) UNION ALL SELECT 'unique_cell_types', (SELECT count(DISTINCT cell_type)::VARCHAR FROM cells)", "edges"),
    "top_connected": _sql(f"SELECT cell_id, cell_type, coalesce(n, 0) AS degree FROM cells LEFT JOIN (SELECT c, count(*) n FROM ({_DEG}) GROUP BY 1) ON c = cell_id ORDER BY 3 DESC, 1 LIMIT 10", "edges"),
    "type_distribution": _sql("SELECT cell_type, count(*) n FROM cells GROUP BY 1", "cells"),
    "type_pair_counts": _sql("SELECT cell_type_a, cell_type_b, count(*) n FROM edges GROUP BY 1, 2", "edges"),
    "distance_stats": _sql("SELECT round(min(surface_distance_um), 6) min_distance, round(max(surface_distance_um), 6) max_distance, round(avg(surface_distance_um), 6) mean_distance FROM edges WHERE surface_distance_um > 0", "edges"),
    "cell_type_interactions": _sql("SELECT cell_type_a, cell_type_b, count(*) interaction_count, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM edges), 6) percentage FROM edges GROUP BY 1, 2", "edges"),
    "spatial_analysis": _sql("""SELECT pair_id, cell_id_a, cell_id_b, cell_type_a, cell_type_b, round(a.centroid_x, 6) x_a, round(a.centroid_y, 6) y_a, round(a.centroid_z, 6) z_a, round(b.centroid_x, 6) x_b, round(b.centroid_y, 6) y_b, round(b.centroid_z, 6) z_b,
        round(sqrt((a.centroid_x - b.centroid_x) ** 2 + (a.centroid_y - b.centroid_y) ** 2 + (a.centroid_z - b.centroid_z) ** 2), 6) euclidean_distance FROM edges JOIN cells a ON a.cell_id = cell_id_a JOIN cells b ON b.cell_id = cell_id_b""", "edges"),
    "adjacency_coo": _sql("SELECT cell_id_a AS row, cell_id_b AS col, 1 AS value FROM edges UNION SELECT cell_id_b, cell_id_a, 1 FROM edges", "edges"),
    "gap_voxels": _sql("SELECT * FROM gap", "gap"),
    "contact_voxels": _sql("SELECT * FROM contact", "contact"),
    "rim_voxels": _sql("SELECT * FROM rim", "rim"),
    "mesh": _sql("SELECT * FROM mesh", "mesh"),
    "cell_only": _sql("SELECT * FROM rest", "rest"),
    "volume_table": _sql("SELECT " + "pair_id, cell_a_id, cell_b_id, cell_a_type, cell_b_type, total_intercell_volume_voxels, edt_volume_voxels, intracellular_volume_voxels, touching_surface_area_voxels, num_components, union_voxels, " + ", ".join(f"round({c}, 6) {c}" for c in (V, "edt_volume_um3", "intracellular_volume_um3", "touching_surface_area_um2", "largest_component_volume_um3", "mean_distance_um", "max_distance_um", "voxel_volume_um3", "max_distance_threshold_um", "intracellular_threshold_um")) + " FROM vol", "vol"),
    "volume_components": _sql("SELECT * FROM comps", "comps"),
    "volume_table_components": _sql("SELECT pair_id, num_components, round(largest_component_volume_um3, 6) largest_component_volume_um3 FROM vol", "vol"),
    "cell_only_volumes": _sql(f"SELECT label cell_id, count(*) cell_only_volume_voxels, round(count(*) * {SIZE}, 6) cell_only_volume_um3, cell_type FROM rest JOIN cells ON cell_id = label GROUP BY ALL", "rest"),
    "volume_stats": _sql(f"SELECT cell_a_type, cell_b_type, count(*) pair_count, round(avg({V}), 6) mean_volume, round(min({V}), 6) min_volume, round(max({V}), 6) max_volume, round(sum({V}), 6) total_volume, round(avg(mean_distance_um), 6) mean_distance, round(avg(num_components), 6) mean_components FROM vol GROUP BY 1, 2", "vol"),
    "volume_distribution": _sql(f"""SELECT pair_id, cell_a_id, cell_b_id, cell_a_type, cell_b_type, round({V}, 6) {V}, round(edt_volume_um3, 6) edt_volume_um3, round(intracellular_volume_um3, 6) intracellular_volume_um3, round(touching_surface_area_um2, 6) touching_surface_area_um2,
        round(mean_distance_um, 6) mean_distance_um, round(max_distance_um, 6) max_distance_um, num_components, round(edt_volume_um3 / nullif({V}, 0) * 100, 6) edt_percentage, round(intracellular_volume_um3 / nullif({V}, 0) * 100, 6) intracellular_percentage, round(touching_surface_area_um2 / nullif({V}, 0) * 100, 6) surface_percentage FROM vol""", "vol"),
    "high_volume": _sql(f"SELECT pair_id, cell_a_id, cell_b_id, cell_a_type, cell_b_type, round({V}, 6) {V}, round(mean_distance_um, 6) mean_distance_um, num_components FROM vol WHERE {V} > (SELECT avg({V}) + 2 * stddev({V}) FROM vol)", "vol"),
    "weighted_coo": _sql("".join(f"SELECT {a} AS row, {b} AS col, round({V}::FLOAT, 6) total, round(edt_volume_um3::FLOAT, 6) edt, round(intracellular_volume_um3::FLOAT, 6) intracellular, round(touching_surface_area_um2::FLOAT, 6) touching FROM vol {u}" for a, b, u in (("cell_a_id", "cell_b_id", "UNION ALL "), ("cell_b_id", "cell_a_id", ""))), "vol"),
    "volume_info": _sql(f"SELECT count(*) total_pairs, round(avg({V}), 6) mean_volume_um3, round(sum({V}), 6) total_volume_um3, {FAR}::DOUBLE max_distance_threshold_um, {RIM}::DOUBLE intracellular_threshold_um, (SELECT count(*) FROM wanted) total_cells FROM vol", "vol"),
    "resume_remaining": _sql("SELECT * FROM pairs WHERE cell_a_type <> 'ASIA'", "pairs"),
    "upsert_keep_last": _sql("SELECT * REPLACE (CASE WHEN cell_b_type = 'ASIA' THEN 'new' ELSE cell_a_type END AS cell_a_type) FROM pairs", "pairs"),
    "cells_of_pairs": _sql("SELECT cell cell_id, s.cell_type, 0.0::DOUBLE centroid_x, 0.0::DOUBLE centroid_y, 0.0::DOUBLE centroid_z FROM wanted JOIN seeds s ON s.cell_id = cell", "wanted"),
    "selected_pairs": _sql("SELECT z, y, x, label FROM vox WHERE label IN (SELECT unnest([cell_a_id, cell_b_id]) FROM pairs WHERE pair_id IN (1, 2, 5))", "pairs"),
    "pair_crop": _sql("SELECT CAST(z - greatest(0, (SELECT min(z) FROM vox WHERE label IN (2, 3)) - 10) AS INT) z, CAST(y - greatest(0, (SELECT min(y) FROM vox WHERE label IN (2, 3)) - 10) AS INT) y, CAST(x - greatest(0, (SELECT min(x) FROM vox WHERE label IN (2, 3)) - 10) AS INT) x, label FROM vox WHERE label IN (2, 3)", "vox"),
    "downsample": _sql("SELECT CAST(z // 2 AS INT) z, CAST(y // 2 AS INT) y, CAST(x // 2 AS INT) x, label FROM vox WHERE z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0", "vox"),
    "polygon_valid": _sql("SELECT cell_id::VARCHAR cell_key, 4 AS vertices FROM pseeds WHERE cell_id % 5 NOT IN (0, 1)", "pseeds"),
    "polygon_raster_rect": _sql("SELECT y, x, label FROM pix", "pix"),
    "touching_2d": _sql("SELECT * FROM ptouch", "ptouch"),
    "neighbors_2d": _sql(f"""SELECT row_number() OVER (ORDER BY k, cell_id_a, cell_id_b) pair_id, cell_id_a, cell_id_b, a.cell_type cell_type_a, b.cell_type cell_type_b, round(surface_distance_um, 6) surface_distance_um
        FROM (SELECT cell_id_a, cell_id_b, 0.0::DOUBLE surface_distance_um, 0 k FROM ptouch UNION ALL SELECT cell_id_a, cell_id_b, surface_distance_um, 1 FROM pnear WHERE surface_distance_um <= {NEAR_2D}) JOIN pseeds a ON a.cell_id = cell_id_a JOIN pseeds b ON b.cell_id = cell_id_b""", "pnear"),
}
