"""Dump XML: one `row` element per record, everything in attributes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

POSTS = ["Id", "PostTypeId", "AcceptedAnswerId", "ParentId", "CreationDate", "Score", "ViewCount", "Body", "OwnerUserId", "OwnerDisplayName", "LastActivityDate", "Title", "Tags", "AnswerCount", "CommentCount", "LastEditDate", "ClosedDate", "ContentLicense"]
COMMENTS = ["Id", "PostId", "Score", "Text", "CreationDate", "UserId", "ContentLicense"]
VOTES = ["Id", "PostId", "VoteTypeId", "CreationDate"]


def snake(name: str) -> str:
    return "".join("_" + ch.lower() if ch.isupper() and i else ch.lower() for i, ch in enumerate(name))


def read_rows(spark: SparkSession, path: str, attributes: Sequence[str]) -> DataFrame:
    """Typed scan: the named attributes as strings, absent ones null, blanks kept, malformed files an error. Splits by row."""
    schema = T.StructType([T.StructField(f"_{a}", T.StringType()) for a in attributes])
    rows = spark.read.format("xml").option("rowTag", "row").option("ignoreSurroundingSpaces", "false").option("mode", "FAILFAST").schema(schema).load(path)
    return rows.select(*[F.col(f"_{a}").alias(snake(a)) for a in attributes])


class _Files(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _RowReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> Sequence[InputPartition]:
        return [_Files(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from xml.etree.ElementTree import iterparse

        place = 0
        parser = iterparse(partition.path, events=("start", "end"))
        _, root = next(parser)
        for event, element in parser:
            if event == "end" and element.tag == "row":
                yield partition.path, place, list(element.attrib.items())
                place += 1
                root.clear()  # what was read is not kept


class RowDataSource(DataSource):
    """`threadloom_rows`: every attribute of every row in source order, absent and empty kept apart. One task per file."""

    @classmethod
    def name(cls) -> str:
        return "threadloom_rows"

    def schema(self) -> str:
        return "file string, place bigint, attrs array<struct<name:string,value:string>>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        import glob
        import os

        path = self.options["path"]
        paths = sorted(glob.glob(os.path.join(path, "*.xml")) if os.path.isdir(path) else glob.glob(path))
        if not paths:
            raise FileNotFoundError(path)
        return _RowReader(paths)


def read_all_attributes(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(RowDataSource)
    return spark.read.format("threadloom_rows").load(path)


def attribute(name: str):
    """The value of one attribute of a lossless row; null where it is absent."""
    return F.try_element_at(F.transform(F.filter("attrs", lambda a: a["name"] == name), lambda a: a["value"]), F.lit(1))
