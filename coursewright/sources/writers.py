"""Results as files: Spark's writers for tables, workbooks as a stream or by a sink with commit."""

from __future__ import annotations

import dataclasses
import io
import itertools
import math
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from typing import IO
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Rows of a report sheet that the driver makes; a longer table raises and should be written by ``write_workbooks``.
MOST_ROWS = 100_000
#: Fixed value: rows that the format allows a sheet.
SHEET_ROWS = 1_048_576


def write_table(df: DataFrame, path: str, kind: str = "csv", mode: str = "overwrite") -> None:
    """Write as csv (with header), json or parquet; arrays and maps become JSON text in csv."""
    if kind == "csv":
        flat = [F.to_json(F.col(c)).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode(mode).csv(path, header=True)
    else:
        getattr(df.write.mode(mode), kind)(path)


def recommendations_table(recs: DataFrame) -> DataFrame:
    """Recommendations with their lists as lines of text."""
    return recs.select(*[F.array_join(F.col(c).cast("array<string>"), "\n").alias(c) if t.startswith("array") else F.col(c) for c, t in recs.dtypes])


def _column(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8"?>'


def _row_xml(n: int, row: Iterable) -> str:
    cells = []
    for k, v in enumerate(row):
        if v is None:
            continue
        if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v):
            cells.append(f'<c r="{_column(k)}{n}"><v>{v}</v></c>')
        else:
            text = "\n".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)
            cells.append(f'<c r="{_column(k)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(_UNFIT.sub("", text))}</t></is></c>')
    return f'<row r="{n}">{"".join(cells)}</row>'


#: Control characters that XML cannot hold.
_UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


class Workbook:
    """An xlsx file written as a stream: sheets row by row, the lists of sheets at the end."""

    def __init__(self, out: IO[bytes]) -> None:
        self.zip, self.sheets = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), []

    def add(self, name: str, columns: list[str], rows: Iterable) -> int:
        """Write a sheet, and more of that name with a number if the rows need them; how many rows there were."""
        rows, total = iter(rows), 0
        for part in itertools.count(1):
            self.sheets.append(name[:31] if part == 1 else f"{name[:25]} {part}")
            with self.zip.open(f"xl/worksheets/sheet{len(self.sheets)}.xml", "w", force_zip64=True) as f:
                f.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{_row_xml(1, columns)}'.encode())
                n = 1
                for n, row in enumerate(itertools.islice(rows, SHEET_ROWS - 1), 2):
                    f.write(_row_xml(n, row).encode())
                f.write(b"</sheetData></worksheet>")
            total += n - 1
            if n < SHEET_ROWS:
                return total
        return total

    def close(self) -> None:
        every = list(enumerate(self.sheets, 1))
        names = "".join(f'<sheet name="{escape(n, _QUOTE)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in every)
        links = "".join(f'<Relationship Id="rId{k}" Type="{_REL}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k, _ in every)
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        over = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k, _ in every)
        parts = {
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{names}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>',
            "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{over}</Types>',
        }
        for name, text in parts.items():
            self.zip.writestr(name, _HEAD + text)
        self.zip.close()


_QUOTE = {'"': "&quot;"}


def _few(df: DataFrame) -> list:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a sheet holds {MOST_ROWS} rows at most; use write_workbooks instead")
    return rows


def workbook(sheets: dict[str, DataFrame]) -> bytes:
    """An xlsx file with a sheet for each of a few small tables (a report, not an export)."""
    out = io.BytesIO()
    book = Workbook(out)
    for name, d in sheets.items():
        book.add(name, d.columns, _few(d))
    book.close()
    return out.getvalue()


@dataclasses.dataclass
class _Part(WriterCommitMessage):
    file: str
    rows: int


def _file_system(path: str):
    """Arrow's file system of a path or URI, and the path in it; every executor must reach it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class WorkbookWriter(DataSourceWriter):
    """One file for each task, written beside the target and moved into it when all tasks have ended well."""

    def __init__(self, path: str, sheet: str, columns: list[str], overwrite: bool) -> None:
        self.path, self.sheet, self.columns, self.overwrite = path.rstrip("/"), sheet, columns, overwrite
        self.waiting = f"{self.path}/_waiting-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> _Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, folder = _file_system(self.waiting)
        store.create_dir(folder, recursive=True)
        file = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.xlsx"
        with store.open_output_stream(f"{folder}/{file}") as out:
            book = Workbook(_Unseekable(out))
            n = book.add(self.sheet, self.columns, iterator)
            book.close()
        return _Part(file, n)

    def commit(self, messages: list[_Part | None]) -> None:
        from pyarrow import fs

        store, folder = _file_system(self.path)
        old = [f.path for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.base_name.endswith(".xlsx")]
        for m in messages:
            if m is not None:
                store.move(f"{_file_system(self.waiting)[1]}/{m.file}", f"{folder}/{m.file}")
        for f in old if self.overwrite else []:
            store.delete_file(f)
        self.abort(messages)

    def abort(self, messages: list[_Part | None]) -> None:
        from pyarrow import fs

        store, folder = _file_system(self.waiting)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class _Unseekable(io.RawIOBase):
    """A stream that a zip file is written to without going back."""

    def __init__(self, out) -> None:
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)


class WorkbookSink(DataSource):
    """``df.write.format("workbooks").option("path", ...).option("sheet", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options["path"], self.options.get("sheet", "Data"), schema.names, overwrite)


def write_workbooks(df: DataFrame, path: str, sheet: str = "Data", mode: str = "overwrite") -> None:
    """Write a table of any size as xlsx files in a folder, one for each task, rows streamed.

    Arrays and maps become JSON text, dates and decimals text. What tasks
    write is moved into ``path`` only when all have ended well, so neither a
    lost executor nor a failed job leaves part of a table; ``overwrite``
    removes the files that were there, after that. ``path`` is a folder or a
    URI that Arrow's file systems reach from every executor. A table beyond a
    sheet's limit goes on in the next sheet of the file.
    """
    df.sparkSession.dataSource.register(WorkbookSink)
    plain = [F.to_json(F.col(f"`{c}`")) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`") if t in ("string", "tinyint", "smallint", "int", "bigint", "float", "double") else F.col(f"`{c}`").cast("string") for c, t in df.dtypes]
    df.select(*[x.alias(c) for x, c in zip(plain, df.columns)]).write.format("workbooks").mode(mode).option("path", path).option("sheet", sheet).save()
