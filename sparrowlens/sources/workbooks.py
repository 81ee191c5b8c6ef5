"""Rows of spreadsheet workbooks (``.xlsx``), read with a zip and an XML reader alone.

Files come through Spark's binary source, so they may lie wherever Spark reads. A task unpacks a sheet as a stream and
cuts it, and the workbook's table of strings, into fragments of whole rows; fragments are dealt out, read by other
tasks into cells, and cells meet their strings by a join. No task holds an unpacked sheet, and none reads one alone.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of markup of a fragment, about.
FRAGMENT = 1 << 20
_NAME = r"(?:[A-Za-z_][\w.-]*:)?"


def _relation(archive: zipfile.ZipFile, sheet: str | None) -> tuple[str, str]:
    """Name and part of a sheet, the first one if none is named; KeyError if it isn't there."""
    local = lambda e: e.tag.rpartition("}")[2]
    book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    sheets = [(e.get("name"), next((v for k, v in e.attrib.items() if k.endswith("}id")), None)) for e in book.iter() if local(e) == "sheet"]
    name, relation = next((s for s in sheets if sheet is None or s[0] == sheet), (None, None))
    targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    if name is None or relation not in targets:
        raise KeyError(sheet)
    target = targets[relation]
    return name, target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def fragments(part: io.BufferedIOBase, element: str, size: int = FRAGMENT) -> Iterator[tuple[int, str]]:
    """(number of the first one, markup) of runs of whole elements named ``element``, in order, each run in a root of its own."""
    start = re.compile(rf"<{_NAME}{element}(?=[\s/>])".encode())
    whole = re.compile(rf"<{_NAME}{element}(?:\s[^<>]*)?/>|</{_NAME}{element}\s*>".encode())
    held, number, root = b"", 0, None
    while True:
        block = part.read(size)
        held += block
        if root is None and (first := start.search(held)):
            spaces = re.findall(rb"xmlns:[\w.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*')", held[: first.start()])
            root, held = b"<root " + b" ".join(dict.fromkeys(spaces)) + b">", held[first.start() :]
        ends = list(whole.finditer(held)) if root is not None else []
        if ends:
            yield number, (root + held[: ends[-1].end()] + b"</root>").decode("utf-8", "replace")
            number += len(ends)
            held = held[ends[-1].end() :]
        if not block:
            return


def elements(markup: str) -> ElementTree.Element:
    """A fragment's root; names come without their name spaces."""
    root = ElementTree.fromstring(markup)
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    return root


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _number(text: str) -> str:
    """A number as it is shown: whole ones without a point."""
    try:
        v = float(text)
    except ValueError:
        return text
    return str(int(v)) if v.is_integer() and abs(v) < 1e21 else repr(v)


def _text(element: ElementTree.Element) -> str:
    """Text of a string with all its runs, without phonetic hints."""
    return "".join(t.text or "" for run in element for t in ([run] if run.tag == "t" else run.iter("t") if run.tag == "r" else []))


def sheet_cells(files: DataFrame, sheet: str | None = None, size: int = FRAGMENT) -> DataFrame:
    """One row per cell that has a value: ``path``, ``sheet``, ``row`` and ``col`` (from 0), ``value`` as trimmed text.

    ``files``: path, content (whole workbooks, up to 2 GB each, as Spark's binary source gives them). ``sheet`` names the
    sheet, the first one by default. Files that are no workbooks or lack the sheet raise a ValueError
    with their path; null contents give no cells.
    """

    def cut(batches):
        schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("kind", pa.string()), ("first", pa.int64()), ("markup", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                if not content.is_valid:
                    continue
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content.as_buffer()))
                    name, part = _relation(archive, sheet)
                    parts = [("rows", part, "row")] + [("strings", "xl/sharedStrings.xml", "si")] * ("xl/sharedStrings.xml" in archive.namelist())
                    for kind, entry, element in parts:
                        with archive.open(entry) as stream:
                            for first, markup in fragments(stream, element, size):
                                yield pa.RecordBatch.from_pylist([{"path": path, "sheet": name, "kind": kind, "first": first, "markup": markup}], schema)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as error:
                    raise ValueError(f"{path} is no workbook with such a sheet: {error}") from None

    def read_rows(batches):
        schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("col", pa.int32()), ("value", pa.string()), ("string", pa.int64())])
        for batch in batches:
            for path, name, first, markup in zip(*(batch.column(c).to_pylist() for c in ("path", "sheet", "first", "markup"))):
                out = []
                for at, row in enumerate(elements(markup), first):
                    number, col = int(row.get("r", at + 1)) - 1, -1
                    for cell in row.iter("c"):
                        col = _column(cell.get("r")) if cell.get("r") else col + 1
                        kind, value = cell.get("t", "n"), cell.findtext("v")
                        found = {"path": path, "sheet": name, "row": number, "col": col, "value": None, "string": None}
                        if kind == "s" and value is not None:
                            found["string"] = int(value)
                        elif kind == "inlineStr":
                            found["value"] = _text(cell.find("is")) if cell.find("is") is not None else None
                        elif value is not None:
                            found["value"] = _number(value) if kind == "n" else {"1": "true", "0": "false"}.get(value, value) if kind == "b" else value
                        if found["value"] is not None or found["string"] is not None:
                            out.append(found)
                yield pa.RecordBatch.from_pylist(out, schema)

    def read_strings(batches):
        schema = pa.schema([("path", pa.string()), ("string", pa.int64()), ("text", pa.string())])
        for batch in batches:
            for path, first, markup in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "markup"))):
                yield pa.RecordBatch.from_pylist([{"path": path, "string": i, "text": _text(s)} for i, s in enumerate(elements(markup), first)], schema)

    pieces = files.select("path", "content").mapInArrow(cut, "path string, sheet string, kind string, first long, markup string")
    spread = lambda kind: pieces.where(F.col("kind") == kind).repartition("path", "first")
    rows = spread("rows").mapInArrow(read_rows, "path string, sheet string, row long, col int, value string, string long")
    strings = spread("strings").mapInArrow(read_strings, "path string, string long, text string").select(F.col("path").alias("_p"), F.col("string").alias("_s"), "text")
    both = rows.join(strings, (F.col("path") == F.col("_p")) & (F.col("string") == F.col("_s")), "left")
    return both.select("path", "sheet", "row", "col", F.regexp_replace(F.coalesce("value", "text", F.lit("")), r"(?U)^\s+|\s+$", "").alias("value"))


def sheet_rows(cells: DataFrame) -> DataFrame:
    """One row per sheet row below the first: ``path``, ``sheet``, ``row``, ``values`` (map from header to text).

    The first row (number 0) has the headers; columns without one are left out, of columns with one
    header the first counts. Rows without any cell aren't there.
    """
    headers = cells.where("row = 0 and value <> ''").groupBy("path", "sheet", F.col("value").alias("header")).agg(F.min("col").alias("col"))
    headers = headers.select(F.col("path").alias("_p"), F.col("sheet").alias("_t"), F.col("col").alias("_c"), "header")
    own = cells.where("row > 0").join(headers, (F.col("path") == F.col("_p")) & (F.col("sheet") == F.col("_t")) & (F.col("col") == F.col("_c")))
    return own.groupBy("path", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("header", "value"))).alias("values"))


def normalised_rows(rows: DataFrame, columns: dict[str, str], default_country: str, region: str = "") -> DataFrame:
    """Prospects of ``sheet_rows``: source_file, sheet_name, row_index, region, a column for each of ``columns`` and ``original_row``.

    ``columns`` maps a field to its header, ``company_name`` among them; what a sheet lacks is
    empty. Rows without a company go; where there is no country it is ``default_country``.
    """
    value = lambda field: F.coalesce(F.try_element_at("values", F.lit(columns[field])), F.lit(""))
    fields = {f: value(f) for f in columns}
    if "country" in fields:
        fields["country"] = F.when(fields["country"] == "", default_country).otherwise(fields["country"])
    else:
        fields["country"] = F.lit(default_country)
    out = rows.where(value("company_name") != "")
    return out.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), F.col("sheet").alias("sheet_name"), F.col("row").alias("row_index"), F.lit(region).alias("region"), *[c.alias(f) for f, c in fields.items()], F.col("values").alias("original_row"))


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """``sheet_rows`` of the workbooks of a folder or pattern."""
    return sheet_rows(sheet_cells(spark.read.format("binaryFile").load(path), sheet))
