"""Sources: a registry of loaders, the selection of sources, and error isolation between them."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from ..operators.families import stored
from ..operators.items import normalize

TOGETHER = 18  # fixed value: sources that are read at a time
Loader = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Named loaders in a fixed order; some are used only when asked for."""

    def __init__(self):
        self.loaders: dict[str, Loader] = {}
        self.labels: dict[str, str] = {}
        self.opt_in: set[str] = set()

    def add(self, name: str, label: str, loader: Loader, opt_in: bool = False) -> None:
        self.loaders[name], self.labels[name] = loader, label
        if opt_in:
            self.opt_in.add(name)

    def select(self, names: str | None, allow_empty: bool = False) -> list[str]:
        """The names of a comma-separated list, in its order and once each; none means the default ones."""
        chosen = list(dict.fromkeys(x.strip() for x in (names or "").split(",") if x.strip()))
        if unknown := [x for x in chosen if x not in self.loaders]:
            raise ValueError(f"unknown sources: {', '.join(unknown)}")
        return chosen if chosen or allow_empty else [x for x in self.loaders if x not in self.opt_in]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, name, self.labels[name], name not in self.opt_in) for k, name in enumerate(self.loaders)]
        return spark.createDataFrame(rows, "ordinal int, source string, label string, is_default boolean")

    def load(self, spark: SparkSession, query: str, names: list[str], lazy: bool = False) -> tuple[DataFrame | None, dict[str, str]]:
        """The union of all sources' items; a source that fails is an entry among the errors and leaves the others alone.
        Sources are read side by side, each into a table of its own, as only a run shows whether a source can be read; `lazy`
        makes plans alone, which catches what fails in making them."""

        def one(name: str) -> DataFrame:
            items = normalize(self.loaders[name](spark, query))
            return items if lazy else stored(items)

        out, errors = None, {}
        with ThreadPoolExecutor(max_workers=max(1, min(len(names), TOGETHER))) as pool:
            waiting = {name: pool.submit(one, name) for name in names}
        for name in names:
            try:
                items = waiting[name].result()
            except Exception as e:  # one source must not stop the others
                errors[name] = str(e)
                continue
            out = items if out is None else out.unionByName(items)
        return out, errors
