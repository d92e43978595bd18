"""Tables out of HTML and DOCX: spans, headers, formats, links."""

import io
import json
import zipfile

from clausegrid.sources import tables as T

PAGE = """<p>x</p><table><thead><tr><th rowspan=2>Item</th><th colspan="2">Price</th></tr><tr><th>Net<th>Gross</tr></thead>
<tr><td>Bolt</td><td>1</td><td>2 &amp; more</td></tr><tr><td rowspan="2">Nut</td><td colspan=2>free<br>now</td></tr><tr><td>3</td><td>4</td></tr></table>
<table><tr><td>A</td><td></td><td>A</td></tr><tr><td>1</td><td>2<table><tr><td>in</td></tr><tr><td>ner</td></tr></table></td><td>3</td></tr></table><table></table><table><tr><th>only</th></tr></table><table><tr><td>open<td>row"""


def word(rows, mark="w:tr"):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:tbl>{''.join(rows)}</w:tbl></w:body></w:document>")
    return data.getvalue()


def cell(text, extra=""):
    return f"<w:tc><w:tcPr>{extra}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"


def listed(spark, rows, read=T.html_grids, kind="string"):
    df = spark.createDataFrame(rows, f"page_id long, content {kind}")
    return {(r.page_id, r.table_no): r for r in T.tables(T.table_cells(df, ["page_id"], "content", read), ["page_id"]).collect()}


def test_html_tables(spark):
    got = listed(spark, [(1, PAGE), (2, None), (3, "no table"), (4, "<table><tr><td colspan='x' rowspan='0'>a</td></tr><tr><td>b</td></tr>")])
    assert set(got) == {(1, 0), (1, 1), (1, 2), (4, 0)}
    first = got[1, 0]
    assert first.headers == ["Item", "Price Net", "Price Gross"] and (first.row_count, first.column_count) == (3, 3)
    assert first.rows == [{"Item": "Bolt", "Price Net": "1", "Price Gross": "2 & more"}, {"Item": "Nut", "Price Net": "free now", "Price Gross": "free now"}, {"Item": "Nut", "Price Net": "3", "Price Gross": "4"}]
    assert first.formatted_text.split("\n")[0] == "Item: Bolt; Price Net: 1; Price Gross: 2 & more" and json.loads(first.json_data) == first.rows
    assert got[1, 1].headers == ["A", "Column2", "A_2"] and got[1, 1].rows == [{"A": "1", "Column2": "2", "A_2": "3"}]
    assert got[1, 2].headers == ["in"] and got[1, 2].rows == [{"in": "ner"}]
    assert got[4, 0].rows == [{"a": "b"}]


def test_docx_tables(spark):
    header = f"<w:tr><w:trPr><w:tblHeader/></w:trPr>{cell('Item')}{cell('Price', '<w:gridSpan w:val=\"2\"/>')}</w:tr>"
    rows = [header, f"<w:tr>{cell('Bolt', '<w:vMerge w:val=\"restart\"/>')}{cell('1')}{cell('2')}</w:tr>", f"<w:tr>{cell('', '<w:vMerge/>')}{cell('3')}{cell('4')}</w:tr>"]
    got = listed(spark, [(1, word(rows)), (2, b"broken")], T.docx_grids, "binary")
    assert set(got) == {(1, 0)} and got[1, 0].headers == ["Item", "Price", "Price_2"]
    assert got[1, 0].rows == [{"Item": "Bolt", "Price": "1", "Price_2": "2"}, {"Item": "Bolt", "Price": "3", "Price_2": "4"}]


def test_links(spark):
    df = spark.createDataFrame([(1, PAGE), (2, PAGE)], "page_id long, content string")
    found = T.tables(T.table_cells(df, ["page_id"], "content"), ["page_id"])
    clauses = [(1, 0, "See ITEM and price net below."), (1, 1, "An item."), (1, 2, None), (2, 0, "Item, Price Net, Price Gross"), (3, 0, "Item, Price Net, Price Gross")]
    got = T.linked(found, spark.createDataFrame(clauses, "page_id long, pos int, content string"), ["page_id"]).collect()
    assert sorted((r.page_id, r.table_no, r.pos, r.n_matched, round(r.share, 3)) for r in got) == [(1, 0, 0, 2, 0.667), (2, 0, 0, 3, 1.0)]


def test_none(spark):
    assert listed(spark, []) == {}
