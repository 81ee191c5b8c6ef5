"""Workbooks written by hand: strings of either kind, numbers, gaps, prefixes, many fragments, files that are none."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sparrowlens.sources import workbooks


def book(rows, strings=(), prefix="", target="worksheets/sheet1.xml", sheets=("Leads",)):
    held = io.BytesIO()
    p = f"{prefix}:" if prefix else ""
    space = f'xmlns:{prefix}="main"' if prefix else 'xmlns="main"'
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="main" xmlns:r="rel"><sheets>{"".join(f"<sheet name={n!r} sheetId={str(i)!r} r:id={f"id{i}"!r}/>" for i, n in enumerate(sheets))}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f"<Relationship Id={f'id{i}'!r} Target={target!r}/>" for i in range(len(sheets))) + "</Relationships>")
        z.writestr(f"xl/{target}".replace("xl//xl/", "xl/"), f'<?xml version="1.0" encoding="UTF-8"?><{p}worksheet {space} xmlns:x14ac="ac"><{p}cols/><{p}sheetData>{"".join(rows)}</{p}sheetData><{p}rowBreaks/></{p}worksheet>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<{p}sst {space}>" + "".join(f"<{p}si><{p}t xml:space='preserve'>{s}</{p}t></{p}si>" for s in strings) + f"</{p}sst>")
    return held.getvalue()


def cells(spark, *books, **options):
    files = spark.createDataFrame([(f"dir/b{i}.xlsx", b) for i, b in enumerate(books)], "path string, content binary")
    return {(r.path[-6], r.row, r.col): r.value for r in workbooks.sheet_cells(files, **options).collect()}


def test_cells(spark):
    rows = [
        '<row r="1" x14ac:dyDescent="0.2"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><r><t>in</t></r><r><t> line x:y=3</t></r><rPh><t>no</t></rPh></is></c></row>',
        "<row/>",
        '<row r="4"><c r="AB4"><v>1.50</v></c><c><v>3.0</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="str"><f>A1</f><v> &lt;f&gt; </v></c><c r="AH4" t="s"><v>1</v></c><c r="AI4"/><c r="AJ4"><v>1E3</v></c></row>',
        "<row><c><v>7</v></c></row>",
    ]
    got = cells(spark, book(rows, ["  Head ", "é\n&amp;"]))
    want = {(0, 0): "Head", (0, 2): "in line x:y=3", (3, 27): "1.5", (3, 28): "3", (3, 29): "true", (3, 30): "#N/A", (3, 31): "<f>", (3, 33): "é\n&", (3, 35): "1000", (3, 0): "7"}
    assert got == {("0", *k): v for k, v in want.items()}


def test_prefixes_sheets_and_small_fragments(spark):
    rows = ['<x:row r="1"><x:c r="A1" t="s"><x:v>0</x:v></x:c></x:row>', '<x:row r="2"><x:c r="A2"><x:v>5</x:v></x:c></x:row>']
    assert cells(spark, book(rows, ["One"], "x", "/xl/worksheets/s.xml", ("First", "Second")), sheet="Second", size=7) == {("0", 0, 0): "One", ("0", 1, 0): "5"}
    with pytest.raises(Exception, match="b0.xlsx is no workbook with such a sheet"):
        cells(spark, book(rows), sheet="Third")
    with pytest.raises(Exception, match="b1.xlsx is no workbook"):
        cells(spark, book(rows), b"PK no zip")
    assert cells(spark, None) == {} and cells(spark, book([])) == {}


def test_prospects(spark, tmp_path):
    head = ["Company Name", "Country", "Site", "Company Name", ""]
    top = '<row r="1">' + "".join(f'<c t="s"><v>{i}</v></c>' for i in range(5)) + "</row>"
    line = lambda r, *values: f'<row r="{r}">' + "".join(f'<c r="{"ABCDE"[i]}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(values) if v is not None) + "</row>"
    rows = [top, line(2, "Acme", "", "acme.example", "Other", "lost"), line(3, "  ", "DE", "blank"), line(4, "Bolt", "FR"), line(5, None, "IT", "x")]
    (tmp_path / "a.xlsx").write_bytes(book(rows, head))
    (tmp_path / "b.xlsx").write_bytes(book([top, line(2, "Cup")], head))
    got = workbooks.normalised_rows(workbooks.read_workbooks(spark, f"{tmp_path}/*.xlsx"), {"company_name": "Company Name", "country": "Country", "website_url": "Site", "notes": "Notes"}, "US", "R")
    want = [("a.xlsx", "Leads", 1, "R", "Acme", "US", "acme.example", "", {"Company Name": "Acme", "Country": "", "Site": "acme.example"}), ("a.xlsx", "Leads", 3, "R", "Bolt", "FR", "", "", {"Company Name": "Bolt", "Country": "FR"}), ("b.xlsx", "Leads", 1, "R", "Cup", "US", "", "", {"Company Name": "Cup"})]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:3]) == want


def test_a_large_sheet_is_read_by_several_tasks(spark):
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")  # else Spark joins tasks of so few bytes
    try:
        check_large_sheet(spark)
    finally:
        spark.conf.unset(setting)


def check_large_sheet(spark):
    n = 60_000
    rows = ['<row r="1"><c r="A1" t="s"><v>0</v></c></row>'] + [f'<row r="{i}"><c r="A{i}" t="s"><v>{i - 1}</v></c><c r="B{i}"><v>{i}</v></c></row>' for i in range(2, n + 1)]
    files = spark.createDataFrame([("x.xlsx", book(rows, ["Company Name"] + [f"Company {i}" for i in range(2, n + 1)]))], "path string, content binary")
    found = workbooks.sheet_cells(files, size=1 << 16)
    tasks = found.withColumn("task", F.spark_partition_id()).agg(F.count("*").alias("n"), F.countDistinct("task").alias("tasks")).first()
    assert tasks.n == 2 * n - 1 and tasks.tasks > 1
    rows = workbooks.normalised_rows(workbooks.sheet_rows(found), {"company_name": "Company Name"}, "US")
    assert rows.count() == n - 1 and rows.where(F.col("company_name") != F.concat(F.lit("Company "), (F.col("row_index") + 1).cast("string"))).count() == 0
