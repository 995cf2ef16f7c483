"""Excel workbooks: the XML inside the zip, read by a Python data source on an executor. Meant for small clinical sheets."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as E

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes, sheet: str | None) -> list[list[str | None]]:
    """Cell texts of a sheet (the first, if none is named)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = E.fromstring(z.read("xl/workbook.xml"))
        sheets = book.findall("m:sheets/m:sheet", _NS)
        chosen = next((s for s in sheets if sheet in (None, s.get("name"))), None)
        if chosen is None:
            raise ValueError(f"no sheet named {sheet}")
        links = {r.get("Id"): r.get("Target") for r in E.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[chosen.get(_REL)].lstrip("/")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in E.fromstring(z.read("xl/sharedStrings.xml"))]
        out = []
        for row in E.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).findall("m:sheetData/m:row", _NS):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.findall("m:c", _NS)):
                at, value = _column(c.get("r")) if c.get("r") else k, c.find("m:v", _NS)
                if c.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                elif value is not None:
                    cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
            out.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
        return out


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The rows of a sheet as strings, named by its first row. The file is read and parsed by Spark tasks."""
    import pandas as pd

    def parse(batches):
        for frame in batches:
            for data in frame["content"]:
                yield pd.DataFrame({"r": sheet_rows(bytes(data), sheet)})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "r array<string>")
    head = rows.limit(1).first()
    names = [n or f"column_{k}" for k, n in enumerate(head.r)] if head else []
    numbered = rows.withColumn("_n", F.monotonically_increasing_id())
    body = numbered.where(F.col("_n") > numbered.agg(F.min("_n")).first()[0]) if names else numbered
    return body.select(*[F.get("r", F.lit(k)).alias(n) for k, n in enumerate(names)])
