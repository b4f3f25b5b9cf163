"""The catalogue's queries against their SQL on the smallest tables, and the driver's contract."""
import math

import duckdb
import pytest

from lattica.plans.catalogue import QUERIES
from lattica.plans.oracles import ORACLES

DIR = "/root/testdata/sf0.001"
#: The slower half shares its parts with these.
NAMES = ["zonal_stats", "zonal_of_grid", "halo_boxes", "surface_voxels", "cell_surface_6n", "candidate_pairs", "near_pairs_exact", "near_pairs_parity", "neighbor_edges", "cell_connectivity", "volume_table", "volume_components", "volume_stats", "volume_distribution", "high_volume", "cell_only_volumes", "renumbered", "resume_remaining", "upsert_keep_last", "pair_crop", "neighbors_2d"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "supplier", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def flat(rows):
    return sorted(repr([None if isinstance(v, float) and math.isnan(v) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DIR), duck.execute(ORACLES[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(got.columns)
    assert flat(got.select(*names).collect()) == flat(want.fetchall())


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


def test_rest_stands_without_the_training_data_operators(tmp_path):
    """The library and the registry import where that subpackage isn't there."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    shutil.copytree(top / "lattica", tmp_path / "lattica", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
