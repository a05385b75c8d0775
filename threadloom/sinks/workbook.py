"""A data dictionary as a workbook: catalogue, schema and sample, without any package beyond the standard library."""

from __future__ import annotations

import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.sinks.publish import atomic


def catalogue_accounts(catalogue: DataFrame, *columns: str) -> DataFrame:
    """(column, value, n): how many entries have each value."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return catalogue.select(rows.alias("r")).groupBy("r.column", "r.value").agg(F.count("*").alias("n"))


def repeated_names(catalogue: DataFrame, name: str) -> DataFrame:
    return catalogue.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def current_output(schema: DataFrame, catalogue: DataFrame, name: str) -> DataFrame:
    """The columns of the schema with their catalogue entries."""
    return schema.join(catalogue, name, "inner")


def drift(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows that only one of two tables of like columns has, each as often as it is missing."""
    names = one.columns
    return one.select(*names).exceptAll(other.select(*names)).withColumn("side", F.lit("first")).unionByName(other.select(*names).exceptAll(one.select(*names)).withColumn("side", F.lit("second")))


def _cell(column: int, row: int, value: object) -> str:
    letters, c = "", column
    while c >= 0:
        letters, c = chr(65 + c % 26) + letters, c // 26 - 1
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f'<c r="{letters}{row}"><v>{value}</v></c>'
    return f'<c r="{letters}{row}" t="inlineStr"><is><t xml:space="preserve">{escape("" if value is None else str(value))}</t></is></c>'


def write_workbook(path: str, sheets: dict[str, tuple[Sequence[str], Sequence[Sequence[object]]]]) -> None:
    """Sheets of a header and rows, in order. For tables that people read."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"

    def write(f) -> None:
        with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            n = len(sheets)
            z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>' + f'<Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in range(1, n + 1)) + "</Types>")
            z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(s[:31])}" sheetId="{i}" r:id="r{i}"/>' for i, s in enumerate(sheets, 1)) + "</sheets></workbook>")
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1)) + "</Relationships>")
            for i, (header, rows) in enumerate(sheets.values(), 1):
                body = "".join(f'<row r="{r}">' + "".join(_cell(c, r, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate([header, *rows], 1))
                z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")

    atomic(path, write, "wb")


def shown(value: object) -> str:
    return "" if value is None else str(value)


def read_workbook(path: str) -> dict[str, list[list[str]]]:
    """The values of every sheet of a workbook that write_workbook wrote, as text."""
    main, rel = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
    with zipfile.ZipFile(path) as z:
        names = [(s.get("name"), s.get(f"{rel}id")) for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet")]
        out = {}
        for name, key in names:
            sheet = ET.fromstring(z.read(f"xl/worksheets/sheet{key[1:]}.xml"))
            out[name] = [["".join(c.itertext()) for c in row] for row in sheet.iter(f"{main}row")]
    return out
