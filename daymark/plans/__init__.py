"""End-to-end jobs: transfer matrices, in-distribution tables, leave-one-out folds, grids and ablations."""
