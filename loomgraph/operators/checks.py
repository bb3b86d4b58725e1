"""Checks of a user's own: table functions registered by name, called from SQL or by ``rules.diagnose``.

A check sees the rows of a table, partitioned and ordered as it says, and gives out issues. It becomes a Python table
function whose ``analyze`` refuses tables without the columns it needs and has Spark partition and sort the table, so
one partition's rows come to one instance in order and none is held beyond what the check itself keeps.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import StringType, StructType

SCHEMA = StructType().add("category", StringType()).add("severity", StringType()).add("anchor", StringType())
PREFIX = "check_"


class Check:
    """``needs``: columns of its table; ``partition_by`` and ``order_by`` are among them (no partitioning: one instance
    sees all rows). An instance is made for each partition."""

    needs: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()

    def row(self, row: Row) -> Iterable[tuple[str, str]]:
        """(severity, anchor) of issues that a row shows."""
        return ()

    def end(self) -> Iterable[tuple[str, str]]:
        """Issues that show when the partition has been seen."""
        return ()


def register_check(spark: SparkSession, name: str, check: type[Check]) -> None:
    """Make ``check`` callable as ``check_<name>(TABLE(...))``; the name is its issues' category. A name that is
    registered again is the later check."""
    wanted = {*check.needs, *check.partition_by, *check.order_by}

    class Function:
        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError(f"{PREFIX}{name} takes TABLE(...)")
            absent = sorted(wanted - set(table.dataType.names))
            if absent:
                raise ValueError(f"{PREFIX}{name} needs the columns {', '.join(absent)}")
            return AnalyzeResult(SCHEMA, withSinglePartition=not check.partition_by, partitionBy=[PartitioningColumn(c) for c in check.partition_by], orderBy=[OrderingColumn(c) for c in check.order_by])

        def __init__(self):
            self.check = check()

        def eval(self, row: Row):
            for severity, anchor in self.check.row(row) or ():
                yield name, severity, anchor

        def terminate(self):
            for severity, anchor in self.check.end() or ():
                yield name, severity, anchor
    spark.udtf.register(PREFIX + name, udtf(Function))


def run_check(name: str, table: DataFrame) -> DataFrame:
    """(category, severity, anchor) of a registered check over a table."""
    return table.sparkSession.sql(f"SELECT category, severity, anchor FROM {PREFIX}{name}(TABLE({{table}}))", table=table)
