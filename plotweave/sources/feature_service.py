"""A feature service as a batch source: ``spark.read.format("feature_service")``.

A task fetches a block of pages, and they come back as landed text. How a URL is fetched is given
by the caller (option ``fetcher``, ``module:function``); the function takes a URL and a dictionary of
parameters and returns status and text.

Options: ``url``, ``fetcher``, ``where`` (default all rows), ``out_sr`` (default 4326).
"""

from __future__ import annotations

import importlib
import json
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

# What a layer that does not say otherwise can do, and how its ids are called.
DEFAULT_MAX_RECORDS = 1000
DEFAULT_ID_FIELD = "OBJECTID"
#: Pages one task fetches one after the other.
PAGES_PER_TASK = 20


@dataclass
class Block(InputPartition):
    """Successive pages of a layer. Ids start at ``low`` where the layer is read by ranges of ids; the last block of a paging
    layer reads on until a page is not full. An ``answer`` is a page already there: that of a layer that cannot be planned."""

    layer_id: int
    layer_name: str
    first: int = 0
    pages: int = 1
    size: int = DEFAULT_MAX_RECORDS
    last: bool = False
    id_field: str | None = None
    low: int = 0
    answer: tuple[int, str] | None = None


class LayerFailure(Exception):
    """A layer answered with an error; carries the answer."""


class FeatureServiceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feature_service"

    def schema(self) -> str:
        return "layer_id INT, layer_name STRING, page_no BIGINT, status INT, body STRING"

    def reader(self, schema) -> DataSourceReader:
        return FeatureServiceReader(dict(self.options))


class FeatureServiceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url = options["url"].rstrip("/")
        self.fetcher = options["fetcher"]
        self.query = {"where": options.get("where", "1=1"), "outFields": "*", "returnGeometry": "true",
                      "f": "pjson", "outSR": options.get("out_sr", "4326")}
        self.only_layer: int | None = None

    def _fetch(self, path: str, params: dict) -> tuple[int, str]:
        module, function = self.fetcher.split(":")
        return getattr(importlib.import_module(module), function)(self.url + path, params)

    def _document(self, path: str, params: dict) -> dict:
        """A JSON object without an error, or the failing answer as an exception."""
        status, text = self._fetch(path, params)
        try:
            found = json.loads(text)
        except ValueError:
            found = None
        if status >= 400 or not isinstance(found, dict) or "error" in found:
            raise LayerFailure(status, text)
        return found

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A filter on the layer id spares the requests of all other layers."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("layer_id",):
                self.only_layer = f.value
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        """The plan of requests: layers, their abilities and extents, nothing of the data itself.

        A layer that fails to say what it holds becomes one landed page with its answer; the others are read in full.
        """
        try:
            layers = self._document("", {"f": "json"}).get("layers", [])
        except LayerFailure as failure:
            raise RuntimeError(f"no answer from {self.url}: status {failure.args[0]}") from failure
        if not layers:
            raise ValueError(f"no layers in service {self.url}")
        planned: list[InputPartition] = []
        for layer in layers:
            if self.only_layer is not None and layer["id"] != self.only_layer:
                continue
            try:
                planned += self._blocks(layer["id"], layer["name"])
            except LayerFailure as failure:
                planned.append(Block(layer["id"], layer["name"], answer=failure.args))
        return planned

    def _blocks(self, layer_id: int, name: str) -> list[Block]:
        info = self._document(f"/{layer_id}", {"f": "json"})
        size = info.get("maxRecordCount") or DEFAULT_MAX_RECORDS
        if info.get("supportsPagination", False):
            asked = {"where": self.query["where"], "returnCountOnly": "true", "f": "json"}
            counted = self._document(f"/{layer_id}/query", asked)
            if not isinstance(counted.get("count"), int):
                raise LayerFailure(200, json.dumps(counted))
            pages = -(-counted["count"] // size)
            starts = range(0, max(pages, 1), PAGES_PER_TASK)
            return [Block(layer_id, name, n, min(PAGES_PER_TASK, max(pages, 1) - n), size, n == starts[-1]) for n in starts]
        field = info.get("objectIdField") or DEFAULT_ID_FIELD
        wanted = [{"statisticType": kind, "onStatisticField": field, "outStatisticFieldName": kind} for kind in ("min", "max")]
        asked = {"where": self.query["where"], "outStatistics": json.dumps(wanted), "f": "json"}
        extent = self._document(f"/{layer_id}/query", asked)
        try:
            row = extent["features"][0]["attributes"]
            low, high = row["min"], row["max"]
        except (KeyError, IndexError, TypeError):
            raise LayerFailure(200, json.dumps(extent)) from None
        if low is None:
            return []
        # A range of as many ids as a page holds rows is never cut short by the service.
        pages = (high - low) // size + 1
        return [Block(layer_id, name, n, min(PAGES_PER_TASK, pages - n), size, False, field, low) for n in range(0, pages, PAGES_PER_TASK)]

    def read(self, partition: Block) -> Iterator[tuple]:
        p = partition
        if p.answer is not None:
            yield p.layer_id, p.layer_name, 0, *p.answer
            return
        page = p.first
        while page < p.first + p.pages or p.last:
            if p.id_field:
                low = p.low + page * p.size
                ids = f"{p.id_field} >= {low} AND {p.id_field} < {low + p.size}"
                params = {"where": ids if self.query["where"] == "1=1" else f"({self.query['where']}) AND {ids}"}
            else:
                params = {"resultOffset": page * p.size, "resultRecordCount": p.size}
            status, text = self._fetch(f"/{p.layer_id}/query", self.query | params)
            beyond = page >= p.first + p.pages
            rows = self._rows(status, text)
            # Rows added after planning are on pages beyond the plan; an empty one there is no page of the layer.
            if not (beyond or p.first + p.pages == 1) or rows != 0:
                yield p.layer_id, p.layer_name, page, status, text
            if p.last and page >= p.first + p.pages - 1 and (rows is None or rows < p.size):
                return
            page += 1

    @staticmethod
    def _rows(status: int, text: str) -> int | None:
        """Features of a page; None if it is no good page."""
        try:
            found = json.loads(text)
            return None if status >= 400 or "error" in found else len(found.get("features") or [])
        except (ValueError, TypeError, AttributeError):
            return None


def register(spark: SparkSession) -> None:
    """Make the format known to a session. Its code travels with the job."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(FeatureServiceSource)
