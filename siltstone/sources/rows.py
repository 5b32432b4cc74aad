"""A data source of synthetic rows that takes filters: the extension point for sources with pushdown."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition, LessThan


class SyntheticRows(DataSource):
    """Options: rows, parts, values. Columns: id bigint, value bigint (id modulo values). Ranges of id are read as ranges, not filtered."""

    @classmethod
    def name(cls) -> str:
        return "siltstone_rows"

    def schema(self) -> str:
        return "id bigint, value bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(int(self.options.get("rows", 1000)), int(self.options.get("parts", 4)), int(self.options.get("values", 10)))


class _Reader(DataSourceReader):
    def __init__(self, rows: int, parts: int, values: int):
        self.lo, self.hi, self.parts, self.values = 0, rows, parts, values

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("id",):
                self.lo = max(self.lo, f.value)
            elif isinstance(f, LessThan) and f.attribute == ("id",):
                self.hi = min(self.hi, f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("id",):
                self.lo, self.hi = max(self.lo, f.value), min(self.hi, f.value + 1)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        n = max(0, self.hi - self.lo)
        cuts = [self.lo + n * i // self.parts for i in range(self.parts + 1)]
        return [InputPartition((a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        lo, hi = partition.value
        ids = pa.array(range(lo, hi), pa.int64())
        yield pa.RecordBatch.from_arrays([ids, pa.array([i % self.values for i in range(lo, hi)], pa.int64())], ["id", "value"])
