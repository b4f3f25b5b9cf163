"""lattica: cell-interaction analytics over sparse voxel tables, built on PySpark DataFrames."""
