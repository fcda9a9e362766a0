"""Catalog files: CSV by Spark's reader, workbooks opened on executors."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursewright.operators.columns import null_tokens

#: Name spaces of the workbook format.
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_csv(spark: SparkSession, path: str, source: str | None = None, multi_line: bool = True) -> DataFrame:
    """A CSV file with a header, all columns as text, missing values null, tagged with its source.

    Values may hold line breaks, so a file is read by one task; with
    ``multi_line`` false they may not, and large files are split.
    """
    d = null_tokens(spark.read.csv(path, header=True, escape='"', multiLine=multi_line))
    name = F.lit(source) if source else F.element_at(F.split(F.input_file_name(), "/"), -1)
    return d.withColumn("data_source", name) if "data_source" not in d.columns else d


def read_catalog(spark: SparkSession, paths: list[str]) -> tuple[list[tuple[str, DataFrame]], list[tuple[str, str]]]:
    """(name, frame) of each CSV file and of the workbooks of each header, and (name, error) of each file that cannot be read; ValueError if none can.

    Workbooks are read by ``read_workbooks``, all at once. Every frame tells its rows' files as ``data_source``.
    """
    good, bad = [], []
    for p in (p for p in paths if p.lower().endswith(".csv")):
        name = p.rsplit("/", 1)[-1]
        try:
            good.append((name, read_csv(spark, p, name)))
        except Exception as e:
            bad.append((name, str(e).splitlines()[0][:300]))
    books = [p for p in paths if not p.lower().endswith(".csv")]
    if books:
        frames, failed = read_workbooks(spark, books)
        good += [(n, d.drop("sheet")) for n, d in frames]
        bad += [(p.rsplit("/", 1)[-1], e) for p, e in failed]
    if not good:
        raise ValueError(f"no file could be read: {bad}")
    return good, bad


def _shared(z: zipfile.ZipFile) -> list[str]:
    """The workbook's shared texts, which its cells name by number."""
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == f"{_NS}si":
                out.append("".join(t.text or "" for t in e.iter(f"{_NS}t")))
                e.clear()
    return out


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and file of each sheet, in the workbook's order."""
    links = {e.get("Id"): e.get("Target", "") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    out = []
    for e in book.iter(f"{_NS}sheet"):
        target = links[e.get(f"{_REL}id")]
        out.append((e.get("name", ""), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def _place(ref: str, before: int) -> int:
    """The column of a cell's reference such as ``AB12``, from 0; without one, that after the last."""
    at = 0
    for x in ref:
        if not "A" <= x <= "Z":
            break
        at = at * 26 + ord(x) - 64
    return at - 1 if at else before


def sheet_rows(z: zipfile.ZipFile, file: str, shared: list[str]) -> Iterator[list[str | None]]:
    """A sheet's rows as texts, streamed from its XML: what is read is let go row by row."""
    with z.open(file) as f:
        parents: list[ElementTree.Element] = []
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                parents.append(e)
                continue
            parents.pop()
            if e.tag != f"{_NS}row":
                continue
            out: list[str | None] = []
            for c in e.iter(f"{_NS}c"):
                at = _place(c.get("r", ""), len(out))
                out += [None] * (at - len(out))
                v = c.find(f"{_NS}v")
                if c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                elif v is None:
                    value = None
                else:
                    value = shared[int(v.text)] if c.get("t") == "s" else v.text
                out[at:] = [value]
            yield out
            if parents:
                parents[-1].clear()


_ROWS = "path string, sheet string, sheet_no int, row long, cells array<string>, error string"


def workbook_rows(spark: SparkSession, paths: list[str], every_sheet: bool = False) -> DataFrame:
    """``path, sheet, sheet_no, row, cells, error``: the rows of workbooks, from 0, as texts.

    Spark's reader deals the files to executors, from any store that it
    reads, and there each is opened and its rows are streamed; nothing of
    them passes through the driver. A file that cannot be read, or not to its
    end, gives a row with ``error``. Only the first sheet is read unless
    ``every_sheet``. A file is one zip of less than 2 GB; larger exports
    should be CSV.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                shared = _shared(z)
                for k, (name, file) in enumerate(_sheets(z)[: None if every_sheet else 1]):
                    for n, cells in enumerate(sheet_rows(z, file, shared)):
                        yield path, name, k, n, cells, None
        except Exception as e:  # whatever a broken file raises is reported
            yield path, None, None, None, None, f"{type(e).__name__}: {e}"[:300]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.string()]
        names = ["path", "sheet", "sheet_no", "row", "cells", "error"]
        for b in batches:
            for k in range(b.num_rows):
                found = rows(b.column(0)[k].as_py(), b.column(1)[k].as_py())
                while held := list(itertools.islice(found, 1024)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    return files.mapInArrow(run, _ROWS)


def _names(header: list[str | None]) -> list[str]:
    """Names of columns; a name that is missing is made of its place, one that repeats gets a number."""
    out: list[str] = []
    for k, c in enumerate(header):
        name, n = c if c else f"Unnamed: {k}", 1
        while (name if n == 1 else f"{name}.{n - 1}") in out:
            n += 1
        out.append(name if n == 1 else f"{name}.{n - 1}")
    return out


def read_workbooks(spark: SparkSession, paths: list[str], every_sheet: bool = False) -> tuple[list[tuple[str, DataFrame]], list[tuple[str, str]]]:
    """(name, frame) of the sheets of many workbooks, and (path, error) of each file that cannot be read.

    Sheets with one header share a frame, named after the first file, so the
    number of frames does not grow with the files; ``data_source`` and
    ``sheet`` tell where a row comes from. All columns are text, texts that
    mean a missing value are null. A file that breaks off gives no rows.

    One pass finds headers and errors, a row for each sheet; another reads.
    """
    there, bad = [], []
    for p in paths:
        try:
            spark.read.format("binaryFile").load(p)
            there.append(p)
        except Exception as e:
            bad.append((p, str(e).splitlines()[0][:300]))
    if not there:
        return [], bad
    rows = workbook_rows(spark, there, every_sheet)
    heads = rows.where("row = 0 or error is not null").drop("row").orderBy("path", "sheet_no").collect()
    broken = {r["path"]: r["error"] for r in heads if r["error"] is not None}
    bad += sorted(broken.items())
    groups: dict[tuple, list] = {}
    for r in heads:
        if r["path"] not in broken:
            groups.setdefault(tuple(_names(r["cells"])), []).append(r)
    good = []
    for header, sheets in groups.items():
        listed = spark.createDataFrame([(r["path"], r["sheet_no"]) for r in sheets], "path string, sheet_no int")
        own = rows.where("row > 0").join(F.broadcast(listed), ["path", "sheet_no"])
        cell = lambda k: F.get("cells", F.lit(k))
        d = null_tokens(own.select(*[cell(k).alias(c) for k, c in enumerate(header)], "path", F.col("sheet").alias("__sheet")))
        extra = {"data_source": F.element_at(F.split("path", "/"), -1), "sheet": F.col("__sheet")}
        d = d.withColumns({c: v for c, v in extra.items() if c not in header}).drop("__sheet", *[] if "path" in header else ["path"])
        good.append((sheets[0]["path"].rsplit("/", 1)[-1], d))
    return good, bad


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of an xlsx file, its first row as names, all columns as text; ValueError if it cannot be read."""
    good, bad = read_workbooks(spark, [path])
    if bad or not good:
        raise ValueError(f"{path}: {bad[0][1] if bad else 'no sheet'}")
    return good[0][1].drop("data_source", "sheet")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length, modificationTime`` of files, by Spark's file reader."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
