"""Scans: CSV with untidy headers, JSON trees and settings, XML records, archives, workbooks, paged services."""

from __future__ import annotations

import csv
import functools
import io
import time
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def csv_table(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A CSV file with a header; blanks around the names are dropped, all columns are text."""
    df = spark.read.csv(path, header=True, inferSchema=False, **options)
    return df.toDF(*[c.strip() for c in df.columns])


def canonical_headers(df: DataFrame, fields: Mapping[str, Sequence[str]]) -> DataFrame:
    """Columns by the canonical names whose marks they contain: the first column wins, each name is used once."""
    return df.select(*[F.col(f"`{df.columns[i]}`").alias(n) for n, i in chosen_columns(df.columns, fields).items()])


def chosen_columns(header: Sequence[str], fields: Mapping[str, Sequence[str]]) -> dict[str, int]:
    """The column of each canonical name: the first whose header contains one of its marks; a column has one name."""
    chosen: dict[str, int] = {}
    for i, column in enumerate(header):
        for name, marks in fields.items():
            if name not in chosen and any(m in column.lower() for m in marks):
                chosen[name] = i
                break
    return chosen


def json_nodes(spark: SparkSession, path: str, schema: str, field: str = "nodes", by_line: bool = False) -> DataFrame:
    """The records of an array in JSON documents, one to a row; a file is a document, or with `by_line` each of its lines is."""
    return spark.read.json(path, schema=f"{field} array<struct<{schema}>>", multiLine=not by_line).select(F.inline(field))


def xml_records(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The elements of one name in XML files."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def _members(content: bytes, suffix: str) -> Iterator[tuple[str, list[str], Iterator[list[str]]]]:
    """The CSV members of an archive: name, header without blanks around its names, records."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for name in sorted(n for n in archive.namelist() if n.lower().endswith(suffix)):
            with archive.open(name) as raw:
                records = csv.reader(io.TextIOWrapper(raw, "utf-8-sig", newline=""))
                if (header := next(records, None)) is not None:
                    yield name, [c.strip() for c in header], records


def zip_csv(files: DataFrame, suffix: str = ".csv", rows: int = 10_000) -> DataFrame:
    """The records of CSV files in archives, all columns text, blanks around their names dropped.

    `files` has `content`, as spark.read.format("binaryFile") gives it: a task has
    one archive, which must be below 2 GB, and unpacks it record by record. Each
    member's columns go by the names in its own header, in whatever order: the columns
    are those of the first member, in its order; a member without one of them gives
    nulls. A column that the first member does not have, a name that is there twice and
    a record with more values than its header are errors. A short record has nulls;
    an archive without members has no rows.
    """

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = next((header for c in batch["content"] for _, header, _ in _members(c, suffix)), None)
            yield pd.DataFrame({"names": pd.Series([found] if found else [], dtype=object)})

    found = files.select("content").mapInPandas(headers, "names array<string>").first()
    names = found["names"] if found else []

    def placed(name: str, header: list[str]) -> list[int | None]:
        """The place of each column in a member."""
        if len(set(header)) < len(header) or not set(header) <= set(names):
            raise ValueError(f"{name} has the columns {header}, not those of {names}")
        return [header.index(n) if n in header else None for n in names]

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                for name, header, cells in _members(content, suffix):
                    places, held = placed(name, header), []
                    for record in cells:
                        if any(record[len(header) :]):
                            raise ValueError(f"{name} has a record of {len(record)} values under {len(header)} names")
                        held.append([record[i] if i is not None and i < len(record) else None for i in places])
                        if len(held) == rows:
                            yield pd.DataFrame(held, columns=names)
                            held = []
                    yield pd.DataFrame(held, columns=names, dtype=object)

    return files.select("content").mapInPandas(records, ", ".join(f"`{n}` string" for n in names)) if names else files.sparkSession.range(0).select()


def zip_xml(files: DataFrame, tag: str, schema: str, suffix: str = ".xml") -> DataFrame:
    """The elements of one name in XML files in archives (`content`, below 2 GB each), read one after the other; Spark parses their fields."""

    def elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in sorted(n for n in archive.namelist() if n.lower().endswith(suffix)):
                        held = []
                        with archive.open(name) as raw:
                            for _, element in ElementTree.iterparse(raw):
                                if element.tag == tag:
                                    held.append(ElementTree.tostring(element, encoding="unicode"))
                                    element.clear()
                                if len(held) == 10_000:
                                    yield pd.DataFrame({"xml": held}, dtype=object)
                                    held = []
                        yield pd.DataFrame({"xml": held}, dtype=object)  # without the type, none are numbers

    return files.select("content").mapInPandas(elements, "xml string").select(F.from_xml("xml", schema).alias("x")).select("x.*")


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """The rows of a workbook's first sheet, as text."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        with book.open(min(n for n in names if n.startswith("xl/worksheets/") and n.endswith(".xml"))) as raw:
            for _, element in ElementTree.iterparse(raw):
                if element.tag != f"{_SHEET}row":
                    continue
                cells: dict[int, str | None] = {}
                for place, cell in enumerate(element.iter(f"{_SHEET}c")):
                    letters = "".join(x for x in cell.get("r", "") if x.isalpha())
                    at = functools.reduce(lambda n, x: n * 26 + ord(x) - 64, letters, 0) - 1 if letters else place
                    value = cell.find(f"{_SHEET}v")
                    text = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t")) if cell.get("t") == "inlineStr" else value.text if value is not None else None
                    cells[at] = shared[int(text)] if cell.get("t") == "s" and text is not None else text
                yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]
                element.clear()


def workbook_rows(files: DataFrame, fields: Mapping[str, Sequence[str]], least: int = 4, needed: str | None = None) -> DataFrame:
    """The rows of workbooks' first sheets (`content`), by the canonical names of `fields`, as text.

    The header is the first row with `least` cells that are not empty; a field has
    the first column whose header contains one of its marks, or nulls. Rows above
    the header go, as do rows without the `needed` field.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                columns, out = None, []
                for cells in _sheet_rows(content):
                    if columns is None:
                        if sum(bool(c and c.strip()) for c in cells) >= least:
                            columns = chosen_columns([c or "" for c in cells], fields)
                        continue
                    out.append({f: (cells[i] or "").strip() or None if i < len(cells) else None for f, i in columns.items()})
                yield pd.DataFrame(out, columns=list(fields), dtype=object)

    found = files.select("content").mapInPandas(rows, ", ".join(f"`{f}` string" for f in fields))
    return found.filter(F.col(needed).isNotNull()) if needed else found


class Page(InputPartition):
    """One page of one part of a paged service."""

    def __init__(self, part: str | None, number: int):
        super().__init__((part, number))
        self.part, self.number = part, number


def paged_source(name: str, schema: str, count: Callable[[str | None], int], fetch: Callable[[str | None, int, int], Sequence[tuple]], per_page: int, cap: int, parts: Sequence[str] = ()) -> type[DataSource]:
    """A data source for a service that gives its records in pages; register it with `spark.dataSource.register`.

    `count(part)` is the number of records and `fetch(part, page, per_page)` gives
    those of a page; part None asks for everything. A service that shows no more
    than `cap` records of one query is asked part by part where there are more; a
    part that has more itself is an error, as its last records cannot be read.
    Each page is a partition, so pages are read side by side and a lost one is
    read again.
    """

    class Reader(DataSourceReader):
        def partitions(self) -> Sequence[InputPartition]:
            total = count(None)
            asked = [(None, total)] if total <= cap or not parts else [(p, count(p)) for p in parts]
            for p, n in asked:
                if n > cap:
                    raise ValueError(f"{name}: {'the service' if p is None else f'part {p!r}'} has {n} records and shows {cap}; finer parts are needed")
            return [Page(p, k) for p, n in asked for k in range(-(-n // per_page))]

        def read(self, page: InputPartition | None) -> Iterator[tuple]:
            if page is not None:  # Spark reads an empty list of pages as one nothing
                yield from fetch(page.part, page.number, per_page)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader()

    return Source


class BadRequest(Exception):
    """A service refuses a request as it is; the same one will not do later."""


def persistent(call: Callable[..., object], endpoints: Sequence[str] = ("",), attempts: int = 4, wait: float = 0.0) -> Callable[..., object]:
    """call(endpoint, attempt, ...) until it succeeds: each attempt at the endpoint that has failed least; the last failure is raised.

    Failures are remembered for as long as the task lives; a success takes one
    back. Spark runs a task that failed again, which is the second pass.
    """
    fails = dict.fromkeys(endpoints, 0)

    def run(*args: object) -> object:
        for attempt in range(attempts):
            endpoint = min(endpoints, key=fails.get)
            try:
                answer = call(endpoint, attempt, *args)
            except BadRequest:
                raise
            except Exception:
                fails[endpoint] += 1
                if attempt + 1 == attempts:
                    raise
                time.sleep(wait * (attempt + 1))
            else:
                fails[endpoint] = max(0, fails[endpoint] - 1)
                return answer
        raise AssertionError("unreachable")

    return run


def unwrap(answer: object, path: str) -> object:
    """What an answer holds under a path of names, as `_embedded.items`; None if it is not there."""
    for name in path.split("."):
        answer = answer.get(name) if isinstance(answer, Mapping) else None
    return answer


def offset_source(name: str, schema: str, fetch: Callable[..., Sequence[tuple]], limit: int, parts: Sequence[str], endpoints: Sequence[str] = ("",), attempts: int = 4, wait: float = 5.0) -> type[DataSource]:
    """A data source for a service that is read by offset and does not say how much it has; each part is a partition.

    `fetch(endpoint, attempt, part, offset, limit, ordered)` gives records, fewer
    than `limit` at the end. A service that refuses an order (BadRequest) is asked
    without one from there on. Other failures are tried again, at the endpoint
    that has failed least; what cannot be read is an error, not a gap.
    """

    class Reader(DataSourceReader):
        def partitions(self) -> Sequence[InputPartition]:
            return [Page(p, 0) for p in parts]

        def read(self, page: InputPartition | None) -> Iterator[tuple]:
            if page is None:
                return
            ask, offset, ordered = persistent(fetch, endpoints, attempts, wait), 0, True
            while True:
                try:
                    records = ask(page.part, offset, limit, ordered)
                except BadRequest:
                    if not ordered:
                        raise
                    ordered = False
                    continue
                yield from records
                if len(records) < limit:
                    return
                offset += limit

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader()

    return Source


def linked_source(name: str, schema: str, fetch: Callable[..., Mapping], parts: Sequence[str], records: str = "_embedded.items", pages: str = "page.totalPages", fields: Sequence[str] = (), attempts: int = 4, wait: float = 5.0) -> type[DataSource]:
    """A data source for a service whose answers say how many pages there are and hold their records under a path.

    `fetch(endpoint, attempt, part, page)` gives an answer; a part's first one
    tells its pages, and each page is a partition. Records become rows of `fields`,
    names or paths, null where a record lacks one.
    """

    class Reader(DataSourceReader):
        def partitions(self) -> Sequence[InputPartition]:
            ask = persistent(fetch, attempts=attempts, wait=wait)
            return [Page(p, k) for p in parts for k in range(int(unwrap(ask(p, 0), pages) or 0))]

        def read(self, page: InputPartition | None) -> Iterator[tuple]:
            if page is not None:
                answer = persistent(fetch, attempts=attempts, wait=wait)(page.part, page.number)
                for record in unwrap(answer, records) or []:
                    yield tuple(unwrap(record, f) for f in fields)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader()

    return Source
