"""A caller's own parsers, rerankers and extractors.

A parser is a Python function from raw content to rows of a section; Spark runs it as a table function beside each document (LATERAL).
Rerankers and extractors are DataFrame transforms that say which columns they take and give; both are checked before anything runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a parser's rows are.
SECTION = "section_index int, title string, location string, text string"


def register_parser(spark: SparkSession, name: str, parse: Callable[[str], Iterable[dict]]) -> None:
    """Make parse (raw content to dicts with text, perhaps title and location) the table function of that name, in SQL too."""

    @F.udtf(returnType=SECTION)
    class Sections:
        def eval(self, raw: str) -> Iterator[tuple]:
            if raw is not None:
                for i, s in enumerate(parse(raw)):
                    yield i, s.get("title"), s.get("location"), s["text"]

    spark.udtf.register(name, Sections)


def parse_with(docs: DataFrame, name: str) -> DataFrame:
    """Sections (document_id, section_index, title, location, text) of docs (document_id, raw) by a registered parser."""
    return docs.sparkSession.sql(f"SELECT d.document_id, s.* FROM {{docs}} d, LATERAL {name}(d.raw) s", docs=docs.select("document_id", "raw"))


@dataclass(frozen=True)
class Transform:
    """run: rows with the columns of `takes`, to rows with those of `gives` besides, or only them if `keeps` is off; both as DDL."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    takes: str
    gives: str
    keeps: bool = True

    def __call__(self, rows: DataFrame) -> DataFrame:
        self._check(rows, self.takes, "takes")
        out = self.run(rows)
        self._check(out, self.gives, "gives")
        names = [f.name for f in T.StructType.fromDDL(self.gives).fields]
        kept = [c for c in rows.columns if c not in names] if self.keeps else []
        lost = [c for c in kept if c not in out.columns]
        if lost:
            raise ValueError(f"{self.name} lost {', '.join(lost)}")
        return out.select(*kept, *names)

    def _check(self, rows: DataFrame, ddl: str, word: str) -> None:
        held = {f.name: f.dataType for f in rows.schema.fields}
        for f in T.StructType.fromDDL(ddl).fields:
            if held.get(f.name) != f.dataType:
                found = held[f.name].simpleString() if f.name in held else "nothing"
                raise TypeError(f"{self.name} {word} {f.name} {f.dataType.simpleString()}, not {found}")
