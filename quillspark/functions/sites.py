"""Plug-in surface: column functions registered by site and stage, with generic ones behind them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

Stage = Callable[[dict[str, Column]], Column]


class Registry:
    """Site functions override a stage's generic function where they give a value; null means "as usual"."""

    def __init__(self):
        self.generic: dict[str, Stage] = {}
        self.sites: dict[tuple[str, str], Stage] = {}
        self.alias: dict[str, str] = {}

    def stage(self, name: str, site: str | None = None) -> Callable[[Stage], Stage]:
        def keep(f: Stage) -> Stage:
            if site is None:
                self.generic[name] = f
            else:
                self.sites[site, name] = f
            return f

        return keep

    def column(self, stage: str, host: Column, given: dict[str, Column]) -> Column:
        """One expression for all hosts; a stage that nobody knows gives null."""
        stage = self.alias.get(stage, stage)
        usual = self.generic[stage](given) if stage in self.generic else F.lit(None)
        own = F.lit(None)
        for (site, name), f in self.sites.items():
            if name == stage:
                own = F.when((host == site) | host.endswith(f".{site}"), f(given)).otherwise(own)
        return F.coalesce(own, usual)
