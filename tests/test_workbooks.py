"""Workbooks written here, cell by cell, and the records read from them."""

import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from draftlens.operators import reports
from draftlens.sources import workbooks

SPACE = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def letters(col):
    return chr(65 + col) if col < 26 else chr(64 + col // 26) + chr(65 + col % 26)


def write(path, sheets, styles=""):
    """Each sheet a list of rows; values are None, str, bool, number, or (number, style)."""
    with zipfile.ZipFile(path, "w") as book:
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook {SPACE} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i, _ in enumerate(sheets, 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        shared = ["shared text"]
        if styles:
            book.writestr("xl/styles.xml", styles)
        for i, rows in enumerate(sheets.values(), 1):
            body = ""
            for r, row in enumerate(rows):
                for c, v in enumerate(row):
                    at = f'r="{letters(c)}{r + 1}"'
                    if v is None:
                        continue
                    if isinstance(v, bool):
                        body += f'<c {at} t="b"><v>{int(v)}</v></c>'
                    elif isinstance(v, tuple):
                        body += f'<c {at} s="{v[1]}"><v>{v[0]}</v></c>'
                    elif isinstance(v, str):
                        if v not in shared:
                            shared.append(v)
                        body += f'<c {at} t="s"><v>{shared.index(v)}</v></c>'
                    else:
                        body += f"<c {at}><v>{v}</v></c>"
            book.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {SPACE}><sheetData><row>{body}</row></sheetData></worksheet>")
        book.writestr("xl/sharedStrings.xml", f"<sst {SPACE}>" + "".join(f"<si><t>{escape(t)}</t></si>" for t in shared) + "</sst>")


def test_cells(spark, tmp_path):
    styles = f'<styleSheet {SPACE}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    write(tmp_path / "a.xlsx", {"one": [[], [None, None, "x"], [True, 2.5, 3.0, (45292, 1)]], "empty": []}, styles)
    (tmp_path / "old.xls").write_bytes(b"\xd0\xcf")
    (tmp_path / "broken.xlsx").write_bytes(b"PK no")
    rows = workbooks.read_cells(spark, str(tmp_path)).collect()
    got = {(r["row"], r["col"]): (r["text"], r["number"], r["flag"]) for r in rows if r["sheet"] == "one"}
    assert got == {(1, 2): ("x", None, None), (2, 0): ("True", None, True), (2, 1): ("2.5", 2.5, None), (2, 2): ("3", 3.0, None), (2, 3): ("2024-01-01 00:00:00", None, None)}
    assert [(r["row"], r["error"]) for r in rows if r["sheet"] == "empty"] == [(None, None)]
    assert sorted(r["source_file"] for r in rows if r["error"]) == ["broken.xlsx", "old.xls"]


def test_limits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbooks, "MAX_COLUMNS", 2)
    write(tmp_path / "wide.xlsx", {"s": [[1, 2, 3]]})
    with pytest.raises(ValueError):
        workbooks.decode((tmp_path / "wide.xlsx").read_bytes())


def test_dimension_report(spark, tmp_path):
    head = ["NO.", "KEY", "检验项目 ITEM", "UTL", "LTL", 1, 2, "判定", "EQ"]
    rows = [[None, None, "title"], head, ["", "", "名义值", "上限", "下限"], [1, "Y", "⌀10±0.1", 10.1, 9.9, 10.0, 10.05, "", "CMM"], [None, None, "R5", 5.2, 4.8, 5.3], ["2 - 1", "n", "7X M3 +0.2", None, None, None, None, "NG"], ["3", None, "8", None, None, True, "8,000.5 mm"], [None] * 9, ["4", None, "12", 12.5, None, 12.1]]
    write(tmp_path / "r.xlsx", {"cover": [["x"]], "03": rows})
    table = workbooks.read_cells(spark, str(tmp_path))
    assert [r["source_type"] for r in reports.detect_types(table).collect()] == ["dimension_report"]
    got = [r.asDict(True) for r in reports.dimension_records(table).orderBy("source_row").collect()]
    pick = [(r["source_row"], r["no"], r["is_key"], r["nominal"], r["upper_tol"], r["lower_tol"], r["utl"], r["ltl"], [(a["sample"], a["value"]) for a in r["actuals"]], r["result"], r["raw_result"], r["equipment"]) for r in got]
    assert pick == [
        (4, "1", True, 10.0, 0.1, -0.1, 10.1, 9.9, [(1, 10.0), (2, 10.05)], "OK", "", "CMM"),
        (5, "1", False, 5.0, pytest.approx(0.2), pytest.approx(-0.2), 5.2, 4.8, [(1, 5.3)], "NOK", "", ""),
        (6, "2-1", False, 3.0, 0.2, 0.0, None, None, [], "NOK", "NOK", ""),
        (7, "3", False, 8.0, None, None, None, None, [(2, 8000.5)], "UNKNOWN", "", ""),
        (9, "4", False, 12.0, 0.5, None, 12.5, None, [(1, 12.1)], "UNKNOWN", "", ""),
    ]
    assert [r["continuation_of"] for r in got] == [None, got[0]["record_id"], None, None, None]
    assert got[0]["record_id"].endswith(":03:4:1")


def test_deviations_and_default_samples(spark, tmp_path):
    write(tmp_path / "d.xlsx", {"03": [["No", None, "Item", "上偏差", "下偏差"], [1, None, "20", 0.3, -0.1, 20.2, None, 20.5], [2, None, "30±0.5", None, None, 30.0]]})
    got = reports.dimension_records(workbooks.read_cells(spark, str(tmp_path))).orderBy("source_row").collect()
    assert [(r["utl"], r["ltl"], r["upper_tol"], r["result"], [a["sample"] for a in r["actuals"]]) for r in got] == [(20.3, 19.9, 0.3, "NOK", [1, 3]), (30.5, 29.5, 0.5, "OK", [1])]


def test_measuring_report(spark, tmp_path):
    heads = ["Characteristic", "Actual", "Nominal", "Upper Tol", "Lower Tolerance", "Deviation"]
    write(tmp_path / "c.xlsx", {"first": [["x"]], "Report": [["Measurement plan"], heads, ["12#⌀4", 4.05, 4, 0.1, -0.1, 0.05], ["R2 +0.1", 2.3, None, None, None], [None, 1], ["3 - 1# x", None, None]], "again": [heads, ["late", 1, 1, 1, 1]]})
    table = workbooks.read_cells(spark, str(tmp_path))
    assert [r["source_type"] for r in reports.detect_types(table).collect()] == ["calypso_report"]
    got = reports.measuring_records(table).orderBy("source_row").collect()
    assert [(r["no"], r["item_text"], r["nominal"], r["utl"], r["ltl"], r["result"], r["deviation"]) for r in got] == [("12", "⌀4", 4.0, 4.1, 3.9, "OK", 0.05), (None, "R2 +0.1", 2.0, 2.1, 2.0, "NOK", None), ("3 - 1", "x", None, None, None, "UNMEASURED", None)]


def test_no_workbooks_of_a_kind(spark, tmp_path):
    write(tmp_path / "n.xlsx", {"other": [["a"]]})
    table = workbooks.read_cells(spark, str(tmp_path))
    assert reports.dimension_records(table).count() == reports.measuring_records(table).count() == 0
    assert reports.detect_types(table).select(F.max("source_type")).first()[0] == "unknown"
