"""A paged, area-limited search service as a batch data source.

The service answers for a box at most some thousand results, in pages. The
reader's partitions are boxes, split in four until each is small enough; every
partition is paged by its own task, with bounded retries. The service is a picklable
object with ``total(box)`` and ``page(box, number)``, so tests and other
services plug in without a network.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from waymark.functions.geo import quarters


class Area(InputPartition):
    def __init__(self, box: tuple, pages: int):
        self.box, self.pages = box, pages


def areas(service, box: tuple, most: int, least: int, per_page: int, level: int = 0, deepest: int = 20) -> list[Area]:
    """Boxes with at most ``most`` results; those with ``least`` or fewer are dropped."""
    n = service.total(box)
    if n <= least:
        return []
    if n > most and level < deepest:
        return [a for part in quarters(box) for a in areas(service, part, most, least, per_page, level + 1, deepest)]
    return [Area(box, -(-n // per_page))]


def fetched(service, box: tuple, number: int, tries: int = 3) -> list:
    """A page after at most ``tries`` attempts; the last failure is raised."""
    for left in reversed(range(tries)):
        try:
            return service.page(box, number)
        except OSError:
            if not left:
                raise
    return []


class RateLimit:
    """At most ``most`` requests in any window of ``window_s`` seconds: a request beyond waits until the window's first one is old enough.

    Each task counts for itself, so ``most`` is the service's limit divided by the tasks that run at once.
    """

    def __init__(self, most: int = 3_600, window_s: float = 3_600, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.most, self.window, self.clock, self.sleep = most, window_s, clock, sleep
        self.made: list[float] = []

    def left(self) -> int:
        """How many requests may be made now."""
        now = self.clock()
        self.made = [t for t in self.made if now - t < self.window]
        return self.most - len(self.made)

    def wait(self) -> float:
        """Waits if it must, notes a request, and returns the seconds waited."""
        pause = 0.0
        if self.left() <= 0:
            pause = self.made[len(self.made) - self.most] + self.window - self.clock()
            self.sleep(pause)
            self.left()
        self.made.append(self.clock())
        return pause


class PagedReader(DataSourceReader):
    def __init__(self, service, box: tuple, most: int, least: int, per_page: int, per_hour: int | None):
        self.service, self.box, self.most, self.least, self.per_page, self.per_hour = service, box, most, least, per_page, per_hour

    def partitions(self) -> list[Area]:
        return areas(self.service, self.box, self.most, self.least, self.per_page) or [Area(self.box, 0)]

    def read(self, partition: Area) -> Iterator[tuple]:
        limit = RateLimit(self.per_hour) if self.per_hour else None
        for number in range(1, partition.pages + 1):
            if limit:
                limit.wait()
            yield from fetched(self.service, partition.box, number)


def paged_source(service, box: tuple, schema_text: str, source_name: str = "paged", most: int = 4_000, least: int = 5, per_page: int = 250, per_hour: int | None = None) -> type[DataSource]:
    """A data source class to register: ``spark.dataSource.register(cls)``, then ``spark.read.format(source_name).load()``; ``per_hour`` limits each task's requests."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return source_name

        def schema(self) -> str:
            return schema_text

        def reader(self, schema) -> PagedReader:
            return PagedReader(service, box, most, least, per_page, per_hour)

    return Paged
