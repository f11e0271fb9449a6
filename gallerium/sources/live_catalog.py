"""A catalog that follows its provider: probed, refreshed by what changed, and refreshed after a search that found it stale."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog
from ..operators.items import upsert
from . import stores

STALE_SECONDS = 30 * 60  # fixed value
STATE = "records long, updated_at double, latest string, total long, mode string, error string"


class LiveCatalog:
    """Records (key, stamp, ...) in a shared folder. probe() tells the provider's latest stamp and how many records it has;
    fetch(after) gives all records, or those stamped after a time. Records with one key are one: the last stamped."""

    def __init__(self, spark: SparkSession, folder: str, probe: Callable[[], tuple[str, int]], fetch: Callable[[str | None], DataFrame], key: str = "id", stamp: str = "modified"):
        self.spark, self.folder, self.probe, self.fetch, self.key, self.stamp = spark, folder.rstrip("/"), probe, fetch, key, stamp
        self._one, self._worker = threading.Lock(), None

    def records(self) -> DataFrame | None:
        return stores.load(self.spark, f"{self.folder}/records")

    def status(self) -> dict:
        """How many records there are, how they came and when, and what went wrong last."""
        state = stores.load(self.spark, f"{self.folder}/state")
        row = state.first().asDict() if state is not None else dict.fromkeys(part.split()[0] for part in STATE.split(", "))
        return row | {"refreshing": bool(self._worker and self._worker.is_alive())}

    def _state(self, **values) -> None:
        row = {k: v for k, v in self.status().items() if k != "refreshing"} | values
        stores.save(self.spark.createDataFrame([tuple(row.values())], STATE).coalesce(1), f"{self.folder}/state")

    def _once(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != self.key]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(self.stamp, F.xxhash64(*rest))).alias("r")).select(self.key, "r.*")

    def overlap(self, latest: str) -> str:
        """A little before a stamp, so that what was written in its second isn't missed."""
        at = self.spark.range(1).select(F.date_format(catalog.overlap(F.to_timestamp(F.lit(latest))), "yyyy-MM-dd'T'HH:mm:ss"))
        return at.first()[0] or latest

    def refresh(self, now: float) -> str:
        """`unchanged` if the provider's count and latest stamp are the catalog's; `incremental` if what changed since makes
        its count; else `full`, as something was deleted. A failure leaves the records as they are."""
        try:
            latest, total = self.probe()
            have, was = self.records(), self.status()
            if have is not None and (was["records"], was["latest"]) == (total, latest):
                self._state(updated_at=now, total=total, mode="unchanged", error="")
                return "unchanged"
            mode, rows = "full", None
            if have is not None and was["records"] and was["latest"]:
                rows = self._save(upsert(have, self._once(self.fetch(self.overlap(was["latest"]))).select(*have.columns), self.key), total)
                mode = "incremental"
            if rows is None:
                mode, rows = "full", self._save(self._once(self.fetch(None)), None)
            found = rows.agg(F.count("*").alias("n"), F.max(self.stamp).alias("latest")).first()
            self._state(records=found.n, latest=latest if mode == "incremental" else found.latest, updated_at=now, total=total if mode == "incremental" else found.n, mode=mode, error="")
            return mode
        except Exception as e:
            self._state(error=f"{type(e).__name__}: {str(e)[:300]}")
            raise

    def _save(self, rows: DataFrame, total: int | None) -> DataFrame | None:
        """The saved rows, if they are as many as they should be."""
        if total is not None and rows.count() != total:
            return None
        stores.save(rows, f"{self.folder}/records")
        return self.records()

    def refresh_if_stale(self, now: float, wait: bool = False) -> bool:
        """Begins one refresh in the background if the last is too old and none runs."""
        with self._one:
            updated = self.status()["updated_at"]
            if (updated and now - updated < STALE_SECONDS) or (self._worker and self._worker.is_alive()):
                return False

            def work():
                try:
                    self.refresh(now)
                except Exception:  # its state tells
                    pass

            self._worker = threading.Thread(target=work, name="catalog-refresh", daemon=True)
            self._worker.start()
        if wait:
            self._worker.join()
        return True

    def search(self, fields: list[str], query: str, limit: int, now: float) -> DataFrame | None:
        """The best records as they are now; a stale catalog is refreshed meanwhile, never by a timer."""
        have = self.records()
        self.refresh_if_stale(now)
        return None if have is None else catalog.fuzzy_search(have, self.key, fields, query, limit)
