"""A Python data source that lists paged services: one input partition per part, pages read by offset.

``spark.dataSource.register(PagedListing)``, then
``spark.read.format("paged_listing").option("root", folder).load()`` reads the parts
that are folders of ``page-<offset>.json`` files below ``root``. Other transports
subclass it and give ``fetch``. Rows say whether their part was read to its end.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A part is cut off, and marked incomplete, beyond this offset.
LAST_OFFSET = 20_000
RETRIES, PAUSE = 3, 0.5


class NotFound(Exception):
    """What was asked for does not exist; asking again is of no use."""


class RequestFailed(Exception):
    """The service did not answer, even after some more attempts."""


class StatusError(Exception):
    """An answer with a status that is no success."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def passing(error: Exception) -> bool:
    """Whether a failure may go by itself: of the transport, too many requests, or on the other side."""
    return not isinstance(error, StatusError) or error.status == 429 or error.status >= 500


def with_retries(call, retries: int = RETRIES, pause: float = PAUSE, sleep=time.sleep):
    """``call()`` again after passing failures, waiting twice as long each time; ``NotFound``, which status 404
    is too, and other statuses that won't change end it at once."""
    for attempt in range(retries + 1):
        try:
            return call()
        except NotFound:
            raise
        except (OSError, RequestFailed, StatusError) as e:
            if isinstance(e, StatusError) and e.status == 404:
                raise NotFound(str(e)) from e
            if attempt == retries or not passing(e):
                raise RequestFailed(str(e)) from e
            sleep(pause * 2**attempt)
    raise AssertionError


def folder_fetch(root: str, part: str, offset: int) -> dict:
    """One recorded page; a missing first page means there is no such part."""
    path = Path(root, part, f"page-{offset}.json")
    if not path.exists():
        raise NotFound(str(path))
    return json.loads(path.read_text())


def pages(fetch, root: str, part: str) -> tuple[list[tuple[int, str]], bool]:
    """``(id, date text)`` of a part's features, and whether all were read."""
    rows, offset = [], 0
    while True:
        try:
            page = with_retries(lambda: fetch(root, part, offset), pause=0)  # noqa: B023
        except (NotFound, RequestFailed):
            return rows, False
        features = page.get("features")
        if "error" in page or features is None:
            return rows, False
        rows += [(f["attributes"].get("OBJECTID"), f["attributes"].get("SRC_DATE2")) for f in features]
        if not features or not page.get("exceededTransferLimit"):
            return rows, not (page.get("exceededTransferLimit") and not features)
        offset += len(features)
        if offset > LAST_OFFSET:
            return rows, False


class _Part(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, options: dict, fetch):
        self.root, self.fetch = options["root"], fetch
        self.parts = [p for p in options.get("parts", "").split(",") if p]

    def partitions(self) -> list[InputPartition]:
        names = self.parts or sorted(p.name for p in Path(self.root).iterdir() if p.is_dir())
        return [_Part(n) for n in names]

    def read(self, partition: _Part) -> Iterator[tuple]:
        rows, complete = pages(self.fetch, self.root, partition.name)
        for object_id, day in rows:
            if object_id is not None and day is not None:
                yield partition.name, int(object_id), str(day), complete
        if not complete:  # the part is known to be short even where it has no rows
            yield partition.name, None, None, False


class PagedListing(DataSource):
    fetch = staticmethod(folder_fetch)

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "part string, object_id long, day string, complete boolean"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), type(self).fetch)
