"""Statistics and views of the cell graph and of volume tables, and adjacency in coordinate form.

edges(pair_id, cell_id_a, cell_id_b, cell_type_a, cell_type_b[, surface_distance_um]); cells(cell_id, cell_type, centroid_*).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Measures of a volume table that become weights, by their layers' names.
LAYERS = {"total": "total_intercell_volume_um3", "edt": "edt_volume_um3", "intracellular": "intracellular_volume_um3", "touching": "touching_surface_area_um2"}


def totals(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """total_cells, total_pairs, unique_cell_types in one row."""
    one = cells.agg(F.count("*").alias("total_cells"), F.countDistinct("cell_type").alias("unique_cell_types"))
    return one.crossJoin(edges.agg(F.count("*").alias("total_pairs")))  # a row each


def type_distribution(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cell_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cell_type")


def type_pair_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("cell_type_a", "cell_type_b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cell_type_a", "cell_type_b")


def distance_stats(edges: DataFrame) -> DataFrame:
    """Least, greatest and mean surface distance of pairs that don't touch."""
    d = "surface_distance_um"
    return edges.filter(F.col(d) > 0).agg(F.min(d).alias("min_distance"), F.max(d).alias("max_distance"), F.avg(d).alias("mean_distance"))


def type_pair_filter(edges: DataFrame, one: str, two: str) -> DataFrame:
    """Pairs of the two types, whichever way round, by pair id."""
    a, b = F.col("cell_type_a"), F.col("cell_type_b")
    return edges.filter(((a == one) & (b == two)) | ((a == two) & (b == one))).orderBy("pair_id")


def connectivity(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """total_neighbors and unique_neighbors as the established view has them, and degree. The view joins out- and in-edges
    side by side, so that p of one and q of the other count as p * max(q, 1) + q * max(p, 1); here without that join."""
    ends = edges.select(F.col("cell_id_a").alias("cell_id"), F.lit(1).alias("_p"), F.lit(0).alias("_q"), F.col("cell_id_b").alias("_o")).union(edges.select("cell_id_b", F.lit(0), F.lit(1), "cell_id_a"))
    n = ends.groupBy("cell_id").agg(F.sum("_p").alias("_p"), F.sum("_q").alias("_q"), F.countDistinct(F.when(F.col("_p") == 1, F.col("_o"))).alias("_up"), F.countDistinct(F.when(F.col("_q") == 1, F.col("_o"))).alias("_uq"), F.countDistinct("_o").alias("_d"))
    out = cells.join(n, "cell_id", "left").fillna(0, ["_p", "_q", "_up", "_uq", "_d"])
    total = F.col("_p") * F.greatest("_q", F.lit(1)) + F.col("_q") * F.greatest("_p", F.lit(1))
    return out.select(*cells.columns, total.cast("long").alias("total_neighbors"), (F.col("_up") + F.col("_uq")).cast("long").alias("unique_neighbors"), F.col("_d").cast("long").alias("degree"))


def type_interactions(edges: DataFrame) -> DataFrame:
    """Pairs by their two types, with their share of all pairs in percent."""
    n = edges.groupBy("cell_type_a", "cell_type_b").agg(F.count("*").alias("interaction_count"))
    whole = edges.agg(F.count("*").alias("_all"))
    return n.crossJoin(F.broadcast(whole)).select("cell_type_a", "cell_type_b", "interaction_count", (F.col("interaction_count") * 100.0 / F.col("_all")).alias("percentage")).orderBy(F.desc("interaction_count"), "cell_type_a", "cell_type_b")


def spatial_analysis(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs with both centroids and their distance, in the units of the centroids."""
    out = edges.select("pair_id", "cell_id_a", "cell_id_b", "cell_type_a", "cell_type_b")
    for side in ("a", "b"):
        out = out.join(cells.select(F.col("cell_id").alias(f"cell_id_{side}"), *(F.col(f"centroid_{k}").alias(f"{k}_{side}") for k in "xyz")), f"cell_id_{side}")
    square = sum(((F.col(f"{k}_a") - F.col(f"{k}_b")) * (F.col(f"{k}_a") - F.col(f"{k}_b")) for k in "xyz"), F.lit(0.0))
    return out.select("pair_id", "cell_id_a", "cell_id_b", "cell_type_a", "cell_type_b", *(f"{k}_{s}" for s in "ab" for k in "xyz"), F.sqrt(square).alias("euclidean_distance"))


def adjacency(edges: DataFrame) -> DataFrame:
    """row, col, value = 1 of the symmetric binary matrix, by cell ids; each place once."""
    there = edges.select(F.col("cell_id_a").alias("row"), F.col("cell_id_b").alias("col"))
    return there.union(there.select("col", "row")).distinct().withColumn("value", F.lit(1))


def weighted_adjacency(volumes: DataFrame) -> DataFrame:
    """row, col and one float weight a layer of the symmetric matrix of a volume table."""
    there = volumes.select(F.col("cell_a_id").alias("row"), F.col("cell_b_id").alias("col"), *(F.col(c).cast("float").alias(k) for k, c in LAYERS.items()))
    return there.union(there.select("col", "row", *LAYERS))


def volume_statistics(volumes: DataFrame) -> DataFrame:
    v = "total_intercell_volume_um3"
    out = volumes.groupBy("cell_a_type", "cell_b_type").agg(
        F.count("*").alias("pair_count"), F.avg(v).alias("mean_volume"), F.min(v).alias("min_volume"), F.max(v).alias("max_volume"),
        F.sum(v).alias("total_volume"), F.avg("mean_distance_um").alias("mean_distance"), F.avg("num_components").alias("mean_components"),
    )
    return out.orderBy(F.desc("total_volume"), "cell_a_type", "cell_b_type")


def volume_distribution(volumes: DataFrame) -> DataFrame:
    """Measures with the share of each part in the total, in percent; null where the total is 0."""
    whole = F.nullif(F.col("total_intercell_volume_um3"), F.lit(0.0))
    share = lambda c, name: (F.col(c) / whole * 100).alias(name)
    return volumes.select(
        "pair_id", "cell_a_id", "cell_b_id", "cell_a_type", "cell_b_type", *LAYERS.values(), "mean_distance_um", "max_distance_um", "num_components",
        share(LAYERS["edt"], "edt_percentage"), share(LAYERS["intracellular"], "intracellular_percentage"), share(LAYERS["touching"], "surface_percentage"),
    )


def high_volume(volumes: DataFrame) -> DataFrame:
    """Pairs above the mean by more than two sample standard deviations; none where there is but one pair."""
    v = F.col("total_intercell_volume_um3")
    edge = volumes.agg((F.avg(v) + 2 * F.stddev_samp(v)).alias("_edge"))
    out = volumes.crossJoin(F.broadcast(edge)).filter(v > F.col("_edge"))
    return out.select("pair_id", "cell_a_id", "cell_b_id", "cell_a_type", "cell_b_type", "total_intercell_volume_um3", "mean_distance_um", "num_components").orderBy(F.desc("total_intercell_volume_um3"), "pair_id")


def top_connected(cells: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """The k cells with the most neighbours."""
    return connectivity(cells, edges).select("cell_id", "cell_type", "degree").orderBy(F.desc("degree"), "cell_id").limit(k)


def export_metadata(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """key, value pairs that go with an export."""
    row = totals(cells, edges)
    return row.select(F.explode(F.create_map(*[x for c in ("total_cells", "total_pairs", "unique_cell_types") for x in (F.lit(c), F.col(c).cast("string"))])).alias("key", "value"))


def volume_info(volumes: DataFrame) -> DataFrame:
    """What goes with a weighted matrix: pairs, cells, mean and total volume, thresholds of the first pair."""
    v = "total_intercell_volume_um3"
    ends = volumes.select(F.explode(F.array("cell_a_id", "cell_b_id")).alias("c")).agg(F.countDistinct("c").alias("total_cells"))
    one = volumes.agg(F.count("*").alias("total_pairs"), F.avg(v).alias("mean_volume_um3"), F.sum(v).alias("total_volume_um3"), F.min_by("max_distance_threshold_um", "pair_id").alias("max_distance_threshold_um"), F.min_by("intracellular_threshold_um", "pair_id").alias("intracellular_threshold_um"))
    return one.crossJoin(ends)  # a row each


def cells_of_pairs(pairs: DataFrame) -> DataFrame:
    """cells(cell_id, cell_type, centroids 0) from pairs alone: the type of the last pair that has one, b after a."""
    ends = pairs.select(F.col("cell_a_id").alias("cell_id"), F.col("cell_a_type").alias("t"), (F.col("pair_id") * 2).alias("o")).union(pairs.select("cell_b_id", "cell_b_type", F.col("pair_id") * 2 + 1))
    out = ends.groupBy("cell_id").agg(F.max_by("t", F.when(F.col("t").isNotNull(), F.col("o"))).alias("cell_type"))
    return out.select("cell_id", F.coalesce("cell_type", F.lit("unknown")).alias("cell_type"), *(F.lit(0.0).alias(f"centroid_{k}") for k in "xyz"))
