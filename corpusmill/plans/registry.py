"""Named queries of the engine's own operators, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


from . import augment_queries, extra_queries, media_queries, pixel_queries, source_queries, text_queries, vision_queries  # noqa: E402,F401  the queries register themselves
