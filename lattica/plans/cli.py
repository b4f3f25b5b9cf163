"""Command line: features of labels, and the voxels that a viewer would show."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lattica.operators import voxels
from lattica.plans.api import extract_features_3d
from lattica.session import ship
from lattica.sources import metadata, zarr
from lattica.sources.paths import cleaned, store_root
from lattica.sources.sinks import save_csv, save_tables
from lattica.sources.tables import Grid


def pair_ids(text: str) -> list[int]:
    """Positive whole numbers, separated by commas without spaces."""
    parts = text.split(",")
    if not all(p.isdigit() and int(p) > 0 for p in parts):
        raise argparse.ArgumentTypeError(f"not a list of pair ids: {text!r}")
    return [int(p) for p in parts]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    top = argparse.ArgumentParser(prog="lattica")
    subs = top.add_subparsers(dest="command", required=True)
    f = subs.add_parser("features")
    f.add_argument("--segmentation-zarr", required=True)
    f.add_argument("--raw-expression-zarr", required=True)
    f.add_argument("--raw-key")
    f.add_argument("--raw-resolution-level", type=int)
    f.add_argument("--channel-names")
    f.add_argument("--include-background", action="store_true")
    f.add_argument("--object-id-column", default="pair_id")
    f.add_argument("--output-csv", required=True)
    for name in ("all", "pair", "multi"):
        s = subs.add_parser(f"select-{name}")
        s.add_argument("--zarr", required=True)
        s.add_argument("--output", required=True)
        if name != "all":
            s.add_argument("--pairs", help="table of pairs or volumes (CSV, SQLite or Parquet) that names the pairs' cells")
            s.add_argument("--cell-only-zarr", help="volume of cells, for the voxels of the pairs' cells")
        if name == "multi":
            s.add_argument("--pair-ids", type=pair_ids, required=True)
        if name == "pair":
            s.add_argument("--pair-id", type=int, required=True)
            s.add_argument("--pad", type=int, default=10)
    args = top.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    ship(spark)
    if args.command == "features":
        names = [n.strip() for n in args.channel_names.split(",")] if args.channel_names else None
        save_csv(extract_features_3d(spark, cleaned(args.segmentation_zarr), cleaned(args.raw_expression_zarr), raw_key=args.raw_key, raw_resolution_level=args.raw_resolution_level, channel_names=names, include_background=args.include_background, object_id_column=args.object_id_column), args.output_csv, one_file=True)
        return
    top_zarr = store_root(args.zarr)
    a = zarr.label_array(zarr.arrays(spark, top_zarr), ["0", "labels", "0/0"])
    out = zarr.labels(spark, top_zarr, a)
    one = args.command == "select-pair"
    if args.command != "select-all" and (args.pairs or args.cell_only_zarr):
        if not (args.pairs and args.cell_only_zarr):
            top.error("--pairs and --cell-only-zarr go together")
        pairs = metadata.cells_of(metadata.pair_table(spark, cleaned(args.pairs)), [args.pair_id] if one else args.pair_ids)
        cells = zarr.label_array(zarr.arrays(spark, store_root(args.cell_only_zarr)))
        zarr.compatible(a, cells)
        layers = voxels.pair_layers(out, zarr.labels(spark, store_root(args.cell_only_zarr), cells), pairs)
        if one:
            layers = voxels.cropped(layers, args.pad, Grid(*a.spatial))
        save_tables({"voxels": layers, "counts": layers.groupBy("layer", "label").agg(F.count("*").alias("voxels"))}, args.output)
        return
    if one:
        out = voxels.pair_crop(out, [args.pair_id], args.pad, Grid(*a.spatial))
    if args.command == "select-multi":
        out = voxels.selected(out, spark.createDataFrame([(i,) for i in args.pair_ids], "label long"))
    out.write.mode("overwrite").parquet(args.output)


if __name__ == "__main__":
    main()
