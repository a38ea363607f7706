"""Files out: result trees, CSV, workbooks.

Reports are as small as funds times years times metrics of the dictionary, so their writers run on the driver, behind a
check of the number of rows; larger tables go to :func:`csv_folder`.
"""

from __future__ import annotations

import csv
import json
import zipfile
from collections.abc import Iterable
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpimill import schema as S
from kpimill.functions.text import sheet_name

MOST_ROWS = 200_000


def _rows(df: DataFrame, most: int = MOST_ROWS) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them with csv_folder or parquet instead")
    return rows


def number(v: float | None) -> int | float | None:
    """Whole numbers without decimals."""
    return int(v) if isinstance(v, float) and v.is_integer() else v


def tree(facts: DataFrame) -> dict:
    """fund -> year -> metric -> finding."""
    out: dict = {}
    for r in _rows(facts.orderBy("fund", "year", "metric")):
        out.setdefault(r["fund"], {}).setdefault(r["year"], {})[r["metric"]] = {S.VALUE: number(r["value"]), S.SOURCE: r["source"], S.CERTAINTY: r["certainty"], S.COMMENT: r["comment"]}
    return out


def write_json(facts: DataFrame, path: str) -> str | None:
    """The result tree, indented, as UTF-8; no file and None without findings."""
    data = tree(facts)
    if not data:
        return None
    Path(path).write_text(json.dumps(data, indent=2, ensure_ascii=False), encoding="utf-8")
    return path


def csv_rows(facts: DataFrame, with_sources: bool = False) -> DataFrame:
    cols = [F.col("fund").alias("Fund"), F.col("year").alias("Year"), F.col("metric").alias("Key"), F.col("value").alias("Value")]
    return facts.select(*cols, *([F.col("source").alias("Source")] if with_sources else []))


def write_csv(facts: DataFrame, path: str, with_sources: bool = False) -> None:
    """One file with a byte-order mark, semicolons and a header."""
    df = csv_rows(facts, with_sources).orderBy("Fund", "Year", "Key")
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, delimiter=";", lineterminator="\n")
        out.writerow(df.columns)
        out.writerows([number(v) for v in r] for r in _rows(df))


def csv_folder(facts: DataFrame, path: str, with_sources: bool = False) -> None:
    """The same rows in as many files as there are partitions, without the mark."""
    csv_rows(facts, with_sources).write.option("sep", ";").option("header", True).mode("overwrite").csv(path)


def column_width(values: Iterable) -> int:
    return min(max(max((len(str(v)) for v in values if v is not None), default=0) + 2, 8), 40)


def _column(n: int) -> str:
    name = ""
    while n:
        n, r = divmod(n - 1, 26)
        name = chr(65 + r) + name
    return name


def write_workbook(path: str, sheets: dict[str, list[list]], bold: dict[str, set[int]] | None = None) -> None:
    """An XLSX file of plain cells; ``bold`` has the row numbers (from 0) set in bold of each sheet."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    names = list(sheets)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", head + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>' + kinds + "</Types>")
        z.writestr("_rels/.rels", head + f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", head + f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", head + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + f'<Relationship Id="s" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", head + f'<styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf fontId="0"/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        for k, n in enumerate(names, 1):
            rows, wide = sheets[n], max((len(r) for r in sheets[n]), default=0)
            cols = "".join(f'<col min="{c + 1}" max="{c + 1}" width="{column_width(r[c] for r in rows if c < len(r))}" customWidth="1"/>' for c in range(wide))
            body = []
            for y, r in enumerate(rows):
                style = ' s="1"' if y in (bold or {}).get(n, ()) else ""
                cells = []
                for x, v in enumerate(r):
                    at = f"{_column(x + 1)}{y + 1}"
                    if v is None or v == "":
                        continue
                    cells.append(f'<c r="{at}"{style}><v>{v}</v></c>' if isinstance(v, (int, float)) and not isinstance(v, bool) else f'<c r="{at}" t="inlineStr"{style}><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
                body.append(f'<row r="{y + 1}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/sheet{k}.xml", head + f'<worksheet xmlns="{main}">' + (f"<cols>{cols}</cols>" if cols else "") + f'<sheetData>{"".join(body)}</sheetData></worksheet>')


def write_report(report: DataFrame, path: str, with_sources: bool = False) -> None:
    """A workbook of a dense report: a sheet for each year, metrics by group below each other, a column for each fund.

    Funds are ordered by their official names and shown by their short ones; each group has a bold row of its own.
    """
    rows = _rows(report.orderBy("year", "grp_ord", "metric_ord", "fund"))
    years: dict = {}
    for r in rows:
        years.setdefault(r["year"], []).append(r)
    sheets, bold = {}, {}
    for year, part in years.items():
        fund_names = sorted({r["fund"]: r["short_name"] for r in part}.items())
        header = [S.METRIC]
        for _, short in fund_names:
            header += [short] + ([S.SOURCE_HEADER] if with_sources else [])
        out, marks, group = [header], {0}, object()
        cells = {(r["metric"], r["fund"]): r for r in part}
        for m, g in dict.fromkeys((r["metric"], r["grp"]) for r in part):
            if g != group:
                group = g
                marks.add(len(out))
                out.append([g])
            row = [m]
            for f, _ in fund_names:
                c = cells[m, f]
                row += [number(c["value"])] + ([c["source"]] if with_sources else [])
            out.append(row)
        sheets[str(year)], bold[str(year)] = out, marks
    write_workbook(path, sheets, bold)


def write_sheets(facts: DataFrame, path: str, by: str = "fund", with_sources: bool = False) -> None:
    """A workbook with the long rows, one sheet for each fund or year in order."""
    if by not in ("fund", "year"):
        raise ValueError('by must be "fund" or "year"')
    df = csv_rows(facts.withColumn("__sheet", sheet_name(F.col(by))), with_sources)
    names = df.columns
    key = {"fund": "Fund", "year": "Year"}[by]
    sheets: dict = {}
    for r in _rows(df.withColumn("__sheet", sheet_name(F.col(key))).orderBy(key, "Fund", "Year", "Key")):
        sheets.setdefault(r["__sheet"], [list(names)]).append([number(r[c]) for c in names])
    write_workbook(path, sheets)
