"""Office files, mail and tables written by hand, the plug-ins around them, and the external index."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import external, files, parsers

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as made:
        for name, text in parts.items():
            made.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


def word():
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = (
        '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Master Agreement</w:t></w:r></w:p><w:p><w:r><w:t>First </w:t></w:r><w:r><w:t>part.</w:t><w:br/><w:t>Next line</w:t></w:r></w:p><w:p/>'
        f'<w:tbl><w:tr>{cell("Item")}{cell("Fee")}</w:tr><w:tr>{cell("Setup")}{cell("5")}</w:tr></w:tbl>'
        '<w:p><w:r><w:br w:type="page"/><w:t>On page two</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>listed</w:t></w:r></w:p>'
    )
    return archive(word__document=f"<w:document {W}><w:body>{body}</w:body></w:document>")


def slides():
    shape = lambda kind, t: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = lambda x: f"<p:sld {A}><p:cSld><p:spTree>{x}</p:spTree></p:cSld></p:sld>"
    return archive(ppt__slides__slide10=slide(shape("body", "last")), ppt__slides__slide2=slide(shape("title", "Second") + shape("body", "text")), ppt__slides__slide1=slide(shape("ctrTitle", "First")))


def sheets():
    strings = "<sst><si><t>Item</t></si><si><r><t>Fee</t></r></si></sst>"
    rows = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>Setup</t></is></c><c r="C2"><v>12.5</v></c></row><row/>'
    return archive(xl__sharedStrings=strings, xl__worksheets__sheet1=f"<worksheet><sheetData>{rows}</sheetData></worksheet>", xl__worksheets__sheet2="<worksheet/>")


MAIL = b"Subject: Invoice due\r\nFrom: a@b\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>Dear all</p><script>no</script><p>pay &amp; go</p>"


def test_formats():
    assert parsers.parse(word(), "a.DOCX") == [("Title", 1, "Master Agreement"), ("NarrativeText", 1, "First part.\nNext line"), ("Table", 1, "Item | Fee\nSetup | 5"), ("NarrativeText", 2, "On page two"), ("ListItem", 2, "listed")]
    assert parsers.parse(slides(), "a.pptx") == [("Title", 1, "First"), ("Title", 2, "Second"), ("NarrativeText", 2, "text"), ("NarrativeText", 3, "last")]
    assert parsers.parse(sheets(), "a.xlsx") == [("Table", 1, "Item |  | Fee\nSetup |  | 12.5")]
    assert parsers.parse("Item;Fee\n\"a;b\";5\n".encode(), "a.csv") == [("Table", 1, "Item | Fee\na;b | 5")]
    assert parsers.parse(MAIL, "a.eml") == [("Title", 1, "Invoice due"), ("NarrativeText", 1, "Dear all"), ("NarrativeText", 1, "pay & go")]
    assert parsers.parse(b"one\n\n two ", "a.txt") == [("NarrativeText", 1, "one"), ("NarrativeText", 1, "two")] and parsers.parse(b"", "a.csv") == []
    with pytest.raises(parsers.UnsupportedFormat):
        parsers.parse(b"%PDF", "a.pdf")


def test_a_folder_of_files(spark, tmp_path):
    for name, content in (("a.docx", word()), ("b.pptx", slides()), ("c.docx", b"no archive"), ("d.txt", b"plain"), ("e.pdf", b"%PDF"), ("f.png", b"x")):
        (tmp_path / name).write_bytes(content)
    found = files.scan(spark, f"file://{tmp_path}")
    elements = files.parsed(found)
    got = {r.filename: r for r in files.joined_texts(found, elements).collect()}
    assert set(got) == {"a.docx", "b.pptx", "c.docx", "d.txt", "e.pdf"}
    assert got["a.docx"].text.startswith("Master Agreement\n\nFirst part.") and got["a.docx"].error is None and got["d.txt"].text == "plain"
    assert got["c.docx"].text is None and "BadZipFile" in got["c.docx"].error and got["e.pdf"].error == "UnsupportedFormat: no parser for .pdf files"
    places = {(r.position, r.page_number) for r in files.page_boundaries(elements).join(found.where("filename = 'a.docx'"), "document_id").collect()}
    assert places == {(0, 1), (18, 1), (41, 1), (63, 2), (76, 2)}
    text = got["a.docx"].text
    assert text[63:].startswith("On page two") and text[76:] == "listed"


def test_page_images(spark):
    found = spark.createDataFrame([("d", "a.pdf", bytearray(b"x")), ("e", "bad.pdf", bytearray(b""))], "document_id string, filename string, content binary")

    def render(content, filename):
        return [(1, 2048, 1000, content * 2), (2, 10, 20 // len(content), b"")]

    got = {r.page_number: r for r in files.page_images(found, render).collect()}
    assert set(got) == {1, 2} and tuple(got[1].target) == (1024, 500) and tuple(got[2].target) == (10, 20) and bytes(got[1].image) == b"xx"


def test_external_index(spark):
    rows = spark.createDataFrame([(f"c{i}", f"text {i}", "d1") for i in range(7)], "id string, text string, document_id string").coalesce(1)

    def client():
        def send(actions):
            assert len(actions) <= 3
            return [json.loads(a.split("\n")[0])["index"]["_index"] == "idx" and json.loads(a.split("\n")[1])["text"] != "text 4" for a in actions]

        return send

    got = {r.id: r.indexed for r in external.bulk_index(rows, "idx", client, bulk=3).collect()}
    assert len(got) == 7 and [i for i, ok in got.items() if not ok] == ["c4"]
    body = json.loads(external.request("net 30", 5, {"organization_id": "a", "lang": ["en", "de"], "workspace_id": None}))
    assert body["size"] == 5 and body["query"]["bool"]["must"] == [{"match": {"text": "net 30"}}] and {"terms": {"lang": ["en", "de"]}} in body["query"]["bool"]["filter"] and {"term": {"organization_id": "a"}} in body["query"]["bool"]["filter"]
    ask = lambda: lambda request: [(json.loads(request)["query"]["bool"]["must"][0]["match"]["text"], 2.0), ("z", 1.0)]
    found = external.search(spark.createDataFrame([(1, "q1"), (2, "q2")], "query_id long, query string"), ask).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.score, r["rank"]) for r in found] == [(1, "q1", 2.0, 1), (1, "z", 1.0, 2), (2, "q2", 2.0, 1), (2, "z", 1.0, 2)]
    assert json.loads(external.deletion("d1"))["query"]["term"]["document_id"] == "d1"
    assert external.bulk_index(rows.where(F.lit(False)), "idx", client).count() == 0
