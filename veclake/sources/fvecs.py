"""Data source for fvecs and ivecs files: int32 width, then that many 4-byte values, per row.

All rows of a file have one width, so files are split by row and partitions
read their own ranges.  Files must be readable by the workers by their path.
"""

from __future__ import annotations

import os
import struct

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class VecsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecs"

    def schema(self) -> str:
        kind = "int" if self.options["path"].endswith(".ivecs") else "float"
        return f"row long, vector array<{kind}>"

    def reader(self, schema) -> VecsReader:
        return VecsReader(self.options["path"], int(self.options.get("rows", "65536")))


class VecsReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def _shape(self) -> tuple[int, int]:
        size = os.path.getsize(self.path)
        if not size:
            return 0, 0
        with open(self.path, "rb") as f:
            (width,) = struct.unpack("<i", f.read(4))
        if width <= 0 or size % (4 * width + 4):
            raise ValueError(f"{self.path} has no rows of one width")
        return size // (4 * width + 4), width

    def partitions(self) -> list[InputPartition]:
        n, _ = self._shape()
        return [InputPartition((a, min(a + self.rows, n))) for a in range(0, n, self.rows)] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition):
        import numpy as np

        a, b = partition.value
        if a == b:
            return
        _, width = self._shape()
        kind = "<i4" if self.path.endswith(".ivecs") else "<f4"
        with open(self.path, "rb") as f:
            f.seek(a * (4 * width + 4))
            raw = np.frombuffer(f.read((b - a) * (4 * width + 4)), "<i4").reshape(b - a, width + 1)
        if (raw[:, 0] != width).any():
            raise ValueError(f"{self.path} has rows of different width")
        for k, row in enumerate(raw[:, 1:].copy().view(kind).tolist()):
            yield a + k, row
