"""Datasets, the split-fit-score planner, prediction, run records and the query catalogue."""
