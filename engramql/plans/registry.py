"""Queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from engramql.plans import model


class Registry:
    def __init__(self):
        self.functions: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None, views: str = "") -> Callable:
        """Register a query; ``views`` names the model views that its SQL uses."""

        def put(f: Callable) -> Callable:
            self.functions[name] = f
            if sql is not None:
                self.sql[name] = model.with_views(views.split(), sql)
            return f

        return put
