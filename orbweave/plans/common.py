"""Registering queries next to their SQL."""

from __future__ import annotations

from collections.abc import Callable

from orbweave.sources import fixtures

#: Common table expressions by the name that a query's SQL uses.
TABLES = {"obs": fixtures.OBSERVATIONS, "scenes": fixtures.SCENES, "sites": fixtures.SITES, "ais": fixtures.POSITIONS, "pix": fixtures.PIXELS, "tracks": fixtures.TRACKS, "links": fixtures.LINKS, "ev": fixtures.SITE_EVENTS, "bandpix": fixtures.BAND_PIXELS}


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, uses: str = "obs", recursive: bool = False) -> Callable:
        """Register a query; its SQL sees the fixtures named in ``uses`` and may go on with more CTEs."""

        def wrap(f: Callable) -> Callable:
            self.queries[name] = f
            if sql is not None:
                names = [n for n in uses.split() if n]
                if {"scenes", "tracks", "links", "ev"} & set(names) and "obs" not in names:
                    names = ["obs", *names]
                head = ",\n".join(TABLES[n] for n in names)
                body = sql.strip()
                more = body.startswith("WITH ")
                word = "WITH RECURSIVE " if recursive else "WITH "
                if not head:
                    self.sql[name] = body
                elif more:
                    self.sql[name] = f"{word}{head},\n{body[5:]}"
                else:
                    self.sql[name] = f"{word}{head}\n{body}"
            return f

        return wrap
