"""A small registry: a plan is a function of the frames, with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.views import Frames, with_views


class Plans:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable:
        """Register a function of :class:`Frames` under ``name``; ``sql`` may use the named views."""

        def register(build: Callable[[Frames], DataFrame]) -> Callable[[Frames], DataFrame]:
            self.queries[name] = lambda spark, sf_dir: build(Frames(spark, sf_dir))
            if sql is not None:
                self.oracles[name] = with_views(sql, *views) if views else sql
            return build

        return register
