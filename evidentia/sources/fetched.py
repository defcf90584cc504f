"""Entries' content over a transport that the caller gives: a Python data source whose partitions are runs of entries, with bounded retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "entry_id string, url string, raw string, attempts int"
# Answers, and words in names of errors, after which another try may succeed.
RETRYABLE_STATUS = frozenset((408, 409, 425, 429, 500, 502, 503, 504))
RETRYABLE_NAMES = ("timeout", "ratelimit", "apiconnection", "connectionerror", "overloaded", "serviceunavailable", "internalserver")


def is_retryable(error: BaseException) -> bool:
    """Whether the error looks like one that passes: by kind, status or name."""
    if isinstance(error, (TimeoutError, ConnectionError)):
        return True
    status = getattr(error, "status_code", None)
    return status in RETRYABLE_STATUS if isinstance(status, int) and not isinstance(status, bool) and status in RETRYABLE_STATUS else any(x in type(error).__name__.casefold() for x in RETRYABLE_NAMES)


@dataclass(frozen=True)
class Retry:
    """attempts: at most. first, most: seconds of the first pause, which doubles, and of the longest."""

    attempts: int = 3
    first: float = 0.5
    most: float = 4.0

    def __post_init__(self):
        if self.attempts < 1:
            raise ValueError("at least one attempt")

    def pause(self, attempt: int) -> float:
        """Seconds after so many attempts."""
        return min(self.first * 2 ** (attempt - 1), self.most)

    def run(self, call: Callable[[], str], sleep: Callable[[float], None] = time.sleep) -> tuple[str, int]:
        """What call returns, and after how many attempts. An error that doesn't pass, or the last one, is raised."""
        for attempt in range(1, self.attempts + 1):
            try:
                return call(), attempt
            except Exception as e:
                if attempt == self.attempts or not is_retryable(e):
                    raise
                sleep(self.pause(attempt))
        raise AssertionError("unreachable")


@dataclass
class _Part(InputPartition):
    entries: list[tuple[str, str]]


def source_of(transport: Callable[[str], str], retry: Retry = Retry()) -> type[DataSource]:
    """A data source named `entries` that reads each entry's url over the transport (a function from a url to text)."""

    class Reader(DataSourceReader):
        def __init__(self, entries: list[tuple[str, str]], each: int):
            self.entries, self.each = entries, each

        def partitions(self) -> Sequence[InputPartition]:
            return [_Part(self.entries[i : i + self.each]) for i in range(0, len(self.entries), self.each)] or [_Part([])]

        def read(self, partition: _Part) -> Iterator[tuple]:
            for entry, url in partition.entries:
                try:
                    raw, attempts = retry.run(lambda url=url: transport(url))
                except Exception as e:
                    raise RuntimeError(f"entry {entry} failed while its content was fetched: {e}") from e
                yield entry, url, raw, attempts

    class Entries(DataSource):
        @classmethod
        def name(cls) -> str:
            return "entries"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            lines = [x for x in self.options.get("entries", "").split("\n") if x]
            return Reader([tuple(x.split("\t", 1)) for x in lines], int(self.options.get("each", "1")))

    return Entries


def fetch(spark: SparkSession, entries: Sequence[tuple[str, str]], transport: Callable[[str], str], retry: Retry = Retry(), each: int = 1) -> DataFrame:
    """entry_id, url, raw, attempts of a manifest's entries (id and url), `each` of them per partition.

    An entry that can't be fetched is an error that names it; Spark tries its partition again as it does with any task.
    """
    if any("\t" in x or "\n" in x for pair in entries for x in pair):
        raise ValueError("ids and urls have no tabs and line ends")
    spark.dataSource.register(source_of(transport, retry))
    return spark.read.format("entries").option("entries", "\n".join(map("\t".join, entries))).option("each", str(each)).load()
