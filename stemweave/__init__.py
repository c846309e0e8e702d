"""stemweave: Spark operators for vector structures traced from images.

Annotations, polylines, points and cut lines become DataFrames; audits, spatial joins, graph
computations, feature tables, leakage-safe splits, model fits and ranking metrics are
DataFrame-in, DataFrame-out functions that process many samples per job.
"""
