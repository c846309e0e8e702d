"""All registered queries, by topic."""

from __future__ import annotations

import importlib

from stemweave.catalog.base import Query

TOPICS = ["ranking", "splits", "records", "geometry", "spatial", "graph", "rooted", "pixels", "features", "greedy", "models"]


def all_queries() -> list[Query]:
    found: list[Query] = []
    for topic in TOPICS:
        found.extend(importlib.import_module(f"stemweave.catalog.{topic}").QUERIES)
    names = [q.name for q in found]
    if len(names) != len(set(names)):
        raise ValueError("duplicate query names")
    return found
