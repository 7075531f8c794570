"""Workbooks as a data source: `spark.read.format("workbook").load(path)` after register().

A partition is a sheet of a file, so sheets are read side by side. Filters on sheet, row and col are pushed: other sheets have no
partition, and a sheet's stream ends behind the last row that is asked for. Files are opened through Arrow's file systems; for a
store that only Spark reads there is workbooks.cells().
"""

from __future__ import annotations

import math
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as DS

from strandwise.sources import workbooks as W
from strandwise.sources.files import InputError


@dataclass
class Wanted:
    """What pushed filters leave: sheets (None: all) and inclusive ranges of rows and columns."""

    sheets: set[str] | None = None
    ranges: dict[str, tuple[float, float]] = field(default_factory=lambda: {"row": (-math.inf, math.inf), "col": (-math.inf, math.inf)})

    def take(self, f: DS.Filter) -> bool:
        """Whether a filter is one that this can hold by itself."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if name == "sheet" and isinstance(f, (DS.EqualTo, DS.In)):
            values = {f.value} if isinstance(f, DS.EqualTo) else set(f.value)
            self.sheets = values if self.sheets is None else self.sheets & values
            return True
        low, high = self.ranges.get(name, (None, None))
        if low is None:
            return False
        bounds = {DS.EqualTo: (0, 0), DS.GreaterThan: (1, None), DS.GreaterThanOrEqual: (0, None), DS.LessThan: (None, -1), DS.LessThanOrEqual: (None, 0)}.get(type(f))
        if bounds is None or not isinstance(f.value, int):
            return isinstance(f, DS.IsNotNull)  # no cell has a null place
        self.ranges[name] = (low if bounds[0] is None else max(low, f.value + bounds[0]), high if bounds[1] is None else min(high, f.value + bounds[1]))
        return True


@dataclass
class Sheet(DS.InputPartition):
    path: str
    name: str


class WorkbookReader(DS.DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path, Wanted()
        self.parsed = 0  # cells that a task has looked at

    def pushFilters(self, filters: list[DS.Filter]) -> Iterable[DS.Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def _files(self) -> tuple[pafs.FileSystem, list[str]]:
        files, root = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path.removeprefix("file:"))
        info = files.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise InputError(f"{self.path}: no such file")
        found = [root] if info.is_file else sorted(i.path for i in files.get_file_info(pafs.FileSelector(root)) if i.is_file and i.path.endswith((".xlsx", ".xlsm")))
        return files, found

    def partitions(self) -> list[Sheet]:
        files, found = self._files()
        out = []
        for path in found:
            with files.open_input_file(path) as source, _opened(source, path) as book:
                names = [s.get("name", "") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if W._local(s.tag) == "sheet"]
            out += [Sheet(path, n) for n in names if self.wanted.sheets is None or n in self.wanted.sheets]
        return out

    def read(self, partition: Sheet | None) -> Iterator[tuple]:
        if partition is None:  # no sheet is asked for
            return
        (first, last), (left, right) = self.wanted.ranges["row"], self.wanted.ranges["col"]
        files, _ = self._files()
        with files.open_input_file(partition.path) as source, _opened(source, partition.path) as book:
            for row, col, kind, value in W.sheet_cells(book, partition.name, last):
                self.parsed += row > 0
                if first <= row <= last and left <= col <= right:
                    yield partition.path, partition.name, row, col, kind, value


def _opened(source, path: str) -> zipfile.ZipFile:
    try:
        book = zipfile.ZipFile(source)
    except (zipfile.BadZipFile, ValueError) as e:  # a file that is shorter than a zip's end can't be sought in
        raise InputError(f"{path}: no workbook") from e
    if "xl/workbook.xml" not in book.namelist():
        raise InputError(f"{path}: no workbook")
    if sum(i.file_size for i in book.infolist()) > W.UNPACKED:
        raise InputError(f"{path}: a workbook of more than {W.UNPACKED} bytes")
    return book


class WorkbookSource(DS.DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return W.CELLS

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with its filters pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)
