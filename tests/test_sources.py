import io
import zipfile

import pytest
from pyspark.sql import functions as F

from brindle.functions.files import client_address, extension, file_name, masked_key, safe_name, unique_names
from brindle.functions.text import clean_text, normal_key, strip, word_count
from brindle.sources.files import Parser, Registry, decode, default_registry, parse_files, read_files, text_paragraphs
from brindle.sources.html import page_rows, parse_html, plain_text

PAGE = """<html><head><title>Sample</title><meta name="description" content="About"><meta property="og:title" content="OG 1"><meta property="og:title" content="OG 2">
<meta name="twitter:card" content="summary"><script>var p = "</p>";</script></head><body><nav><a href="/n">Menu</a></nav><h2>Second</h2><h1>First</h1>
<p>One <b>bold</b> word.</p><p>  </p><p>See <a href="https://example.com">here</a> and <a>nowhere</a>.</p><footer>End</footer></body></html>"""


def test_page_rows():
    rows = page_rows(PAGE)
    assert rows[0] == ("title", None, None, "Sample") and rows[1:3] == [("heading", 1, None, "First"), ("heading", 2, None, "Second")]
    assert [r[3] for r in rows if r[0] == "paragraph"] == ["One bold word.", "See here and nowhere."]
    assert [(r[2], r[3]) for r in rows if r[0] == "link"] == [("/n", "Menu"), ("https://example.com", "here")]
    assert rows[-1][3] == "description: About\nog_title: OG 2\ntwitter_card: summary"
    assert not [r for r in page_rows(PAGE, links=False) if r[0] == "link"]


def test_malformed_pages():
    assert page_rows("<title>Un<p>closed <h1>x") and page_rows("") == [] and page_rows("</p></b>") == []
    assert [r[3] for r in page_rows("<p>a<b>b<br></article>")] == ["ab"]
    assert page_rows("<div>" * 5000 + "<p>deep</p>")[0][3] == "deep"


def test_plain_text():
    text = plain_text(PAGE, keep_links=True)
    assert "here (https://example.com)" in text and "Menu" not in text and "End" not in text and "var p" not in text


def test_parse_html_rows(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (1, PAGE)], "id int, html string")
    rows = parse_html(df, "id", "html").filter("id = 1").collect()
    assert len(rows) == 2 * len(page_rows(PAGE))
    one = sorted({(r.ordinal, r.span_start, r.span_end, r.text) for r in rows})
    assert all(b[1] == a[2] + 1 and b[2] - b[1] == len(b[3]) for a, b in zip(one, one[1:]))
    assert parse_html(df.limit(0), "id", "html").count() == 0


def docx():
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in c) + "</w:tr>"
    body = p("Introduction") + "<w:tbl>" + row("Name", "Age") + row("Alice", "30") + row("", "25") + "</w:tbl>" + p(" ") + p("Conclusion")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_files(spark, tmp_path):
    for name, content in (("a.TXT", "Hello 世界\r\nx".encode()), ("b.md", "Café".encode("latin-1")), ("c.html", b"<p>Caf\xe9</p>"), ("d.docx", docx()), ("e.docx", b"no zip"), ("f.bin", b"x")):
        (tmp_path / name).write_bytes(content)
    spans, errors = parse_files(read_files(spark, str(tmp_path)))
    got = {}
    for r in spans.orderBy("path", "ordinal").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.type, r.text, r.span_start, r.span_end))
    assert got["a.TXT"] == [("text", "Hello 世界\nx", 0, 10)] and got["b.md"] == [("text", "Café", 0, 4)]
    assert got["c.html"] == [("paragraph", "Café", 0, 4)]
    assert [x[1] for x in got["d.docx"]] == ["Introduction", "Conclusion", "Name | Age", "Alice | 30", "25"] and got["d.docx"][1][2] == 12
    assert sorted(r.path.rsplit("/", 1)[1] for r in errors.collect()) == ["e.docx", "f.bin"]
    empty = spark.createDataFrame([("g.txt", bytearray())], "path string, content binary")
    assert [(r.text, r.span_end) for r in parse_files(empty)[0].collect()] == [("", 0)]


def test_paragraphs(spark, tmp_path):
    (tmp_path / "x.txt").write_text("one\n\n  \n\ntwo\nlines \n\n")
    assert [(r.ordinal, r.text) for r in text_paragraphs(read_files(spark, str(tmp_path))).collect()] == [(0, "one"), (2, "two\nlines")]


def test_registry():
    r = default_registry()
    assert r.get("MD").name == "text" and r.get(".unknown") is None and ".docx" in r.extensions()
    for bad in (Parser("text", (".zzz",), decode), Parser("new", (".q", ".HTML"), decode), Parser("two", (".q", ".Q"), decode)):
        with pytest.raises(ValueError):
            r.register(bad)
    assert r.get(".q") is None
    r.unregister("html")
    assert r.get(".htm") is None
    with pytest.raises(KeyError):
        Registry().unregister("x")


def test_names(spark):
    df = spark.createDataFrame([("http://h/x/My%20File.PDF?q=1", "k", "a<b>:c.txt"), ("http://h/plain", "k", "..  "), (None, "k", None), ("http://h/", "k", "n" * 300 + ".csv")], "u string, k string, n string")
    out = df.select(file_name(F.col("u"), F.col("k")).alias("f"), extension(F.col("u")).alias("e"), safe_name(F.col("n")).alias("s")).collect()
    assert [r.f for r in out] == ["My File.PDF", "download_k", "download_k", "download_k"]
    assert [r.s for r in out][:3] == ["a_b__c.txt", "unnamed_file", "unnamed_file"] and len(out[3].s) == 200 and out[3].s.endswith(".csv")
    rows = spark.createDataFrame([("d", "a.txt", 1), ("d", "a.txt", 2), ("e", "a.txt", 3), ("d", "b", 4), ("d", "b", 5)], "dir string, name string, seq int")
    assert [r.unique_name for r in unique_names(rows, "dir", "name", "seq").orderBy("seq").collect()] == ["a.txt", "a_1.txt", "a.txt", "b", "b_1"]
    masked = spark.createDataFrame([("",), (None,), ("12345678",), ("sk-123456789",)], "k string").select(masked_key(F.col("k")).alias("m")).collect()
    assert [r.m for r in masked] == ["", "", "***", "sk-1***6789"]
    ip = spark.createDataFrame([(" 1.1.1.1 , 2.2.2.2", None, "p"), ("", "3.3.3.3", "p"), (None, " ", "p")], "x string, r string, p string")
    assert [r.a for r in ip.select(client_address(F.col("x"), F.col("r"), F.col("p")).alias("a")).collect()] == ["1.1.1.1", "3.3.3.3", "p"]


def test_text_functions(spark):
    cases = ["  This  has   spaces  \n\n\n\n  And   newlines  \n  ", " x\x1c", "a\n \n　\n\nb", "", None, "one two three"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(cases)], "n int, t string")
    out = df.select("n", clean_text("t").alias("c"), strip("t").alias("s"), word_count("t").alias("w"), normal_key("t").alias("k")).orderBy("n").collect()
    assert out[0].c == "This has spaces\n\nAnd newlines" and out[1].s == "x" and out[2].c == "a\n\nb"
    assert [r.s for r in out] == [None if t is None else t.strip() for t in cases] and [r.w for r in out] == [None if t is None else len(t.split()) for t in cases]
    assert out[3].k is None and out[1].k == "x"
