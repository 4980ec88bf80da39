"""Spreadsheets: every kind of cell, sheets cut into ranges, archives that
cannot be read, and the same rows as the CSV upload."""

import io
import os
import random
import zipfile

import pytest

from altfinder.operators import upload as up
from altfinder.sources import workbook as wb

MAIN = wb._MAIN
RELS = (f'<Relationships xmlns="{wb._PACKAGE}/relationships"><Relationship Id="a" Target="worksheets/one.xml"/>'
        '<Relationship Id="b" Target="/xl/worksheets/two.xml"/></Relationships>')
BOOK = (f'<workbook xmlns="{MAIN}" xmlns:r="{wb._DOC}"><sheets><sheet name="One" sheetId="1" r:id="a"/>'
        '<sheet name="Two" sheetId="2" r:id="b"/></sheets></workbook>')
STRINGS = (f'<sst xmlns="{MAIN}"><si><t>plain &amp; é</t></si><si><r><t>rich </t></r><r><t xml:space="preserve">text </t></r>'
           '<rPh sb="0" eb="1"><t>sound</t></rPh></si><si><t>two_x000A_lines &lt;row &gt;</t></si></sst>')
STYLES = (f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="164" formatCode="0.0&quot;d&quot;"/><numFmt numFmtId="165" '
          'formatCode="[Red]yyyy\\-mm"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/>'
          '<xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
ONE = (f'<x:worksheet xmlns:x="{MAIN}"><x:sheetData><x:row r="2"><x:c r="B2" t="s"><x:v>0</x:v></x:c><x:c r="D2" t="s"><x:v>1</x:v></x:c></x:row>'
       '<x:row r="3"/><x:row r="7" spans="1:9"><x:c r="A7"><x:v>12</x:v></x:c><x:c r="B7"><x:v>0.1</x:v></x:c><x:c r="C7" s="1"><x:v>45000</x:v></x:c>'
       '<x:c r="D7" s="3"><x:v>45000.5</x:v></x:c><x:c r="E7" s="2"><x:v>3</x:v></x:c><x:c r="F7" t="b"><x:v>1</x:v></x:c>'
       '<x:c r="G7" t="e"><x:v>#N/A</x:v></x:c><x:c r="H7" t="str"><x:f>A1</x:f><x:v>sum</x:v></x:c>'
       '<x:c r="I7" t="inlineStr"><x:is><x:t>in line</x:t></x:is></x:c><x:c r="AA7" t="s"><x:v>2</x:v></x:c></x:row></x:sheetData></x:worksheet>')
TWO = f'<worksheet xmlns="{MAIN}"><sheetData><row><c><v>1E3</v></c><c t="s"><v>0</v></c></row><row><c r="C2"><v>-2.50</v></c></row></sheetData></worksheet>'


def book(path, **parts):
    names = {"rels": "xl/_rels/workbook.xml.rels", "book": "xl/workbook.xml", "strings": "xl/sharedStrings.xml", "styles": "xl/styles.xml",
             "one": "xl/worksheets/one.xml", "two": "xl/worksheets/two.xml"}
    parts = {"rels": RELS, "book": BOOK, "strings": STRINGS, "styles": STYLES, "one": ONE, "two": TWO} | parts
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for k, text in parts.items():
            if text is not None:
                z.writestr(names[k], text)
    return path


def cells_of(df):
    return {(r.sheet, r.row): r.cells for r in df.collect() if r.error is None}


def test_every_kind_of_cell(spark, tmp_base):
    path = book(f"{tmp_base}/a.xlsx")
    seven = ["12", "0.1", "2023-03-15", "2023-03-15T12:00:00", "3", "true", None, "sum", "in line", *[None] * 17, "two\nlines <row >"]
    first = {("One", 2): [None, "plain & é", None, "rich text "], ("One", 3): [], ("One", 7): seven}
    assert cells_of(wb.read_cells(spark, path)) == first
    both = first | {("Two", 1): ["1000", "plain & é"], ("Two", 2): [None, None, "-2.5"]}
    assert cells_of(wb.read_cells(spark, path, sheets="all")) == both
    serial = cells_of(wb.read_cells(spark, path, dates="serial"))[("One", 7)]
    assert serial[2:4] == ["45000", "45000.5"]


def test_dates():
    assert [wb.date_text(x, False) for x in (1, 59, 61, 0.5, 45000.25)] == [
        "1900-01-01", "1900-02-28", "1900-03-01", "12:00:00", "2023-03-15T06:00:00"]
    assert [wb.date_text(x, True) for x in (0.25, 1, 43538)] == ["06:00:00", "1904-01-02", "2023-03-15"]
    assert [wb.letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(wb._column(wb.letters(i)) == i for i in range(2000))


def test_ranges_cover_every_row_once(spark, tmp_base):
    rng = random.Random(2)
    rows = [[rng.choice([None, f"v{rng.randrange(50)}", "<row r='1'>", "é" * rng.randrange(9)]) for _ in range(rng.randrange(1, 5))]
            for _ in range(300)]
    path = f"{tmp_base}/b.xlsx"
    wb.write_workbook(path, ["h"], rows)
    want = {("Sheet1", i + 1): r for i, r in enumerate([["h"], *rows])}
    stripped = lambda r: r[:max((i + 1 for i, v in enumerate(r) if v is not None), default=0)]
    for split in (37, 1000, 1 << 20):
        df = wb.read_cells(spark, path, split_bytes=str(split))
        got = df.collect()
        assert len(got) == len(want) and all(r.error is None for r in got)
        assert {(r.sheet, r.row): r.cells for r in got} == {k: stripped(v) for k, v in want.items()}
    xml = zipfile.ZipFile(path).read("xl/worksheets/sheet1.xml")
    for chunk in (1, 7, 100):
        whole = list(wb.row_elements(io.BytesIO(xml), 0, len(xml), chunk))
        cut = [x for lo in range(0, len(xml), 211) for x in wb.row_elements(io.BytesIO(xml), lo, lo + 211, chunk)]
        assert whole == cut and len(whole) == 301


GOOD = [["Brand Name", "wise item no ", "Catalog No", "Mainframe Description", "WIN ITEM NAME"]]


def test_bad_archives_are_rejects(spark, tmp_base):
    wb.write_workbook(f"{tmp_base}/1.xlsx", GOOD[0], [["b", "IT1", None, None, "n"], [None] * 5, ["c", None, None, None, None]])
    wb.write_workbook(f"{tmp_base}/2.xlsx", ["Brand Name"], [["b"]])
    wb.write_workbook(f"{tmp_base}/3.xlsx", GOOD[0], [])
    with open(f"{tmp_base}/4.xlsx", "wb") as f:
        f.write(b"not a zip")
    whole = open(f"{tmp_base}/1.xlsx", "rb").read()
    with open(f"{tmp_base}/5.xlsx", "wb") as f:
        f.write(whole[:len(whole) // 2])
    book(f"{tmp_base}/6.xlsx", one=ONE.replace("</x:v>", "</v>"))
    book(f"{tmp_base}/7.xlsx", strings=None)
    book(f"{tmp_base}/8.xlsx", strings='<!DOCTYPE x [<!ENTITY a "b">]>' + STRINGS)
    wb.write_workbook(f"{tmp_base}/9.xlsx", GOOD[0], [["d", "IT2", None, None, "m"]])
    rows, rejects = up.read_workbooks(spark, tmp_base)
    assert sorted((r.ordinal, r.item_number, r.brand, r.item_name) for r in rows.collect()) == [
        (1, "IT1", "b", "n"), (3, "", "c", ""), (4, "IT2", "d", "m")]
    assert sorted(os.path.basename(r.file) for r in rejects.collect()) == [f"{i}.xlsx" for i in range(2, 9)]
    with pytest.raises(up.UploadError):
        up.read_upload(spark, f"{tmp_base}/2.xlsx")
    assert up.read_upload(spark, f"{tmp_base}/9.xlsx").count() == 1
    with pytest.raises(up.UploadError):
        up.read_upload(spark, f"{tmp_base}/none.xlsx").count()


def test_workbook_equals_csv(spark, tmp_base):
    rows = [(i, "" if i % 5 == 0 else f"B{i}", f"IT{i}" if i % 7 else "", "", f"d {i}, x", "" if i % 35 == 0 else f"n{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"`{h}` string" for h in up.REQUIRED_HEADERS))
    df.coalesce(1).orderBy("k").drop("k").write.option("header", True).csv(f"{tmp_base}/csv")
    wb.write_workbooks(df, f"{tmp_base}/books", ["k"], 11).count()
    got, rejects = up.read_workbooks(spark, f"{tmp_base}/books/*.xlsx")
    assert rejects.count() == 0
    columns = ["ordinal", "item_number", "item_name", "brand", "catalog_number", "description"]
    want = up.read_upload(spark, f"{tmp_base}/csv").select(columns).collect()
    assert sorted(got.select(columns).collect()) == sorted(want) and len(want) > 30
