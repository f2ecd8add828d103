import io
import zipfile

import pytest
from pyspark.sql import functions as F

from chunkloom.operators import ingest
from chunkloom.operators.chunk import token_chunks
from chunkloom.sources import blobs, docx, pdf
from chunkloom.sources.extract import EXTRACTORS, extracted
from chunkloom.sources.storage import Storage, open_storage
from chunkloom.streaming.ingest import ingest_stream, pages_and_chunks

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def document(body, relations=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        archive.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{relations}</Relationships>')
    return out.getvalue()


def run(text):
    return f'<w:r><w:t xml:space="preserve">{text}</w:t></w:r>'


def test_docx_paragraphs_tables_links_images():
    field = '<w:r><w:instrText>HYPERLINK "https://a.com/b"</w:instrText></w:r>'
    cell = lambda inner, span="": f"<w:tc>{span}<w:p>{inner}</w:p></w:tc>"
    image = '<w:r><w:drawing><a:blip r:link="rId9"/></w:drawing></w:r>'
    table = f'<w:tbl><w:tr>{cell(run("h1"), "<w:tcPr><w:gridSpan w:val=\"2\"/></w:tcPr>")}{cell(run("h2"))}</w:tr><w:tr>{cell(run("x"))}{cell(image)}</w:tr></w:tbl>'
    body = f"<w:p>{run('Hi ')}{run('you')}</w:p><w:p/><w:p>{field}{run('link')}{run(' tail')}</w:p>{table}<w:p>{field}</w:p><w:p>{run('next')}</w:p>"
    raw = document(body, '<Relationship Id="rId9" Type="x/image" Target="http://i/p.png" TargetMode="External"/>')
    assert docx.to_markdown(raw).split("\n") == ["Hi you", "", "", "[link](https://a.com/b) tail", "| h1 |  | h2 |", "| --- | --- | --- |", "| x | ![image](http://i/p.png) |  |", "", "", "next"]
    assert "Hiyou" in docx.to_markdown(raw, compat=True) and docx.to_markdown(raw, compat=True).endswith("[next](https://a.com/b)")


def test_pdf_reader():
    texts = ["a (b) \\ c\nsecond", "", "ÄÖ", "\n\nblank lines\n\nstay\n", "\n"]
    assert [t for t, _ in pdf.pages(pdf.build(texts))] == texts
    with pytest.raises(ValueError, match="no PDF engine"):
        list(pdf.pages(b"%PDF", "other"))


def foreign_pdf(unmapped=False):
    """As other writers make them: objects in a compressed stream, a cross-reference stream, nested and inherited page
    nodes, arrays of contents, hex strings in a composite font with a ToUnicode map, kerned arrays, escapes, rotation."""
    import zlib

    cmap = b"/CIDInit /ProcSet findresource begin 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0048> <0002> <00E9> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange 1 beginbfrange <0020> <0021> [<D83DDE00> <00660069>] endbfrange endcmap"
    simple = b"BT /F2 9 Tf 1 0 0 1 50 700 Tm [(Ker) -20 (ned) -400 (w\\157rd)] TJ 0 -12 Td (l\\(ine\\)) ' ET"
    composite = b"q BT /F1 9 Tf 1 0 0 1 50 700 Tm <00010010> Tj <00110012 0002> Tj T* <00200021> Tj ET Q /Im1 Do /Im2 Do"
    broken = b"BT /F1 9 Tf <0777> Tj ET" if unmapped else b"BT /F2 9 Tf (third) Tj 40 0 Td (page) Tj 9 0 Td (, end) Tj ET"
    streams = {20: (b"", cmap), 21: (b"", simple), 22: (b"", composite[:20]), 23: (b"", composite[20:]), 24: (b"", broken), 25: (b"/Type /XObject /Subtype /Image /Width 1 /Height 1", b"pix"), 26: (b"/Type /XObject /Subtype /Image /Width 0 /Height 0", None)}
    inner = {
        1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R 4 0 R]/Count 3/Resources 10 0 R>>", 3: b"<</Type/Pages/Parent 2 0 R/Kids[5 0 R 6 0 R]/Count 2>>",
        4: b"<</Type/Page/Parent 2 0 R/Contents 24 0 R>>", 5: b"<</Type/Page/Rotate 90/Parent 3 0 R/Contents 21 0 R>>", 6: b"<</Type/Page/Parent 3 0 R/Contents[22 0 R 23 0 R]>>",
        10: b"<</Font<</F1 11 0 R/F2 12 0 R>>/XObject<</Im1 25 0 R/Im2 26 0 R>>>>", 11: b"<</Type/Font/Subtype/Type0/ToUnicode 20 0 R>>", 12: b"<</Type/Font/Subtype/TrueType/BaseFont/Arial>>",
    }
    index, body = b"", b""
    for number, value in inner.items():
        index += b"%d %d " % (number, len(body))
        body += value + b" "
    out = b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"
    for number, (head, data) in streams.items():
        packed = zlib.compress(data) if data is not None else b""
        out += b"%d 0 obj\r\n<<%s/Length %d/Filter/FlateDecode>>\r\nstream\r\n%s\r\nendstream\r\nendobj\r\n" % (number, head, len(packed), packed)
    packed = zlib.compress(index + body)
    out += b"30 0 obj <</Type/ObjStm/N %d/First %d/Length %d/Filter/FlateDecode>> stream\n%s\nendstream endobj\n" % (len(inner), len(index), len(packed), packed)
    return out + b"31 0 obj <</Type/XRef/W[1 2 1]/Root 1 0 R/Size 32/Length 0>> stream\n\nendstream endobj\nstartxref\n0\n%%EOF"


def test_pdf_of_another_writer():
    assert list(pdf.pages(foreign_pdf())) == [("Kerned word\nl(ine)", 0), ("Habcé\n😀fi", 1), ("third page, end", 0)]


def test_a_broken_page_leaves_the_others(spark):
    found = list(pdf.pages(foreign_pdf(unmapped=True)))
    assert found[1] == ("Habcé\n😀fi", 1) and "no text for code 0777" in str(found[2])
    files = blobs.from_data(spark, [("x/a.pdf", foreign_pdf(unmapped=True)), ("x/b.pdf", pdf.build(["whole"]))])
    rows = {(r.path, r.page): (r.page_content, r.error) for r in extracted(files).collect()}
    assert rows[("x/a.pdf", 1)] == ("Habcé\n😀fi\n[image]", None) and rows[("x/b.pdf", 0)] == ("whole", None)
    assert rows[("x/a.pdf", 2)] == (None, "ValueError: no text for code 0777")
    pages, _, rejected = pages_and_chunks(files)
    assert pages.count() == 3 and [(r.path, r.error) for r in rejected.collect()] == [("x/a.pdf", "ValueError: no text for code 0777")]


def test_extraction_isolates_broken_files(spark):
    files = blobs.from_data(spark, [("x/a.docx", docx.build(["one", "two"])), ("x/b.pdf", pdf.build(["p0", "p1"])), ("x/bad.pdf", b"junk"), ("x/bad.docx", b""), ("x/c.doc", b"old")])
    rows = {(r.path, r.page): (r.page_content, r.error) for r in extracted(files).collect()}
    assert rows[("x/a.docx", 0)] == ("one\ntwo", None) and rows[("x/b.pdf", 1)] == ("p1", None)
    assert all(rows[(p, None)][1] for p in ("x/bad.pdf", "x/bad.docx", "x/c.doc"))


def test_storage(spark, tmp_path):
    store = open_storage(spark, root=str(tmp_path))
    raw = bytes(range(256)) * 40
    store.save("a/b.bin", raw)
    store.save("a/c/d.txt", b"")
    assert store.load("a/b.bin") == raw and [len(p) for p in store.load("a/b.bin", stream=True)] == [4096, 4096, 2048] and store.load_once("a/c/d.txt") == b""
    assert store.scan("a") == ["a/b.bin", "a/c/d.txt"] and store.scan("", files=False, directories=True) == ["a/", "a/c/"]
    store.download("a/b.bin", str(tmp_path / "copy"))
    assert (tmp_path / "copy").read_bytes() == raw
    store.delete("a/b.bin")
    store.delete("a/b.bin")
    assert not store.exists("a/b.bin") and store.exists("a/c/d.txt")
    for use in (lambda: store.load_once("no"), lambda: store.load_stream("no"), lambda: store.download("no", str(tmp_path / "x")), lambda: store.scan("no")):
        with pytest.raises(FileNotFoundError):
            use()
    with pytest.raises(ValueError, match="neither"):
        store.scan("a", files=False)
    with pytest.raises(NotImplementedError):
        Storage(spark, str(tmp_path), lists=False).scan("a")
    with pytest.raises(ValueError, match="unsupported storage"):
        open_storage(spark, "azure")


def test_uploads_are_landed_by_their_content(spark, tmp_path):
    files = blobs.from_data(spark, [("in/a.pdf", pdf.build(["one"])), ("in/b.pdf", pdf.build(["two"])), ("other/a.pdf", pdf.build(["one"]))]).withColumn("length", F.octet_length("content").cast("long"))
    keyed = files.withColumn("key", ingest.upload_key(F.lit("t"), F.col("content"), F.col("path")))
    for _ in range(2):  # a second run writes the same objects
        rows = ingest.landed(keyed, str(tmp_path)).collect()
    records = {r.key for r in ingest.upload_records(files, F.lit("t"), F.lit("u"), F.lit("2024-01-01")).collect()}
    assert {r.key for r in rows} == records and len(records) == 2
    assert {tuple(t for t, _ in pdf.pages((tmp_path / key).read_bytes())) for key in records} == {("one",), ("two",)}
    assert sorted(r.page_content for r in extracted(blobs.files(spark, str(tmp_path))).collect()) == ["one", "two"]


def test_sources_by_path_and_address(tmp_path, monkeypatch):
    import http.server
    import threading

    (tmp_path / "f.txt").write_bytes(b"file")
    monkeypatch.setenv("HOME", str(tmp_path))
    assert blobs.resolved("~/f.txt") == (str(tmp_path / "f.txt"), None)
    with blobs.opened("~/f.txt") as stream:
        assert stream.read() == b"file"
    with blobs.opened(data=b"bytes") as stream:
        assert stream.read() == b"bytes"

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/ok" else 404)
            self.end_headers()
            self.wfile.write(b"web")

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert blobs.resolved(f"{base}/ok", allow_web=True) == (f"{base}/ok", b"web")
    with blobs.opened(f"{base}/ok", allow_web=True) as stream:
        assert stream.read() == b"web"
    for path, web, said in ((f"{base}/no", True, "status 404"), (f"{base}/ok", False, "web sources are off"), ("nothing here", True, "neither a file")):
        with pytest.raises(ValueError, match=said):
            blobs.resolved(path, web)
    server.shutdown()
    with pytest.raises(NotImplementedError), blobs.opened(data="text"):
        pass
    with pytest.raises(ValueError, match="data or a path"), blobs.opened():
        pass


def test_blobs_and_pushdown(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(pdf.build(["x"]))
    (tmp_path / "big.pdf").write_bytes(b"0" * 5000)
    found = blobs.files(spark, str(tmp_path), max_bytes=2000)
    assert [r.path.rsplit("/")[-1] for r in found.select("path").collect()] == ["a.PDF"]
    assert "LessThanOrEqual(length,2000)" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.mime_type for r in blobs.listing(spark, str(tmp_path)).collect()} == {"application/pdf"}
    data = blobs.from_data(spark, [("t.txt", "héllo"), (None, b"x")])
    assert [r[0] for r in data.select(blobs.as_text(F.col("content"))).collect()] == ["héllo", "x"]
    assert data.where(blobs.valid(F.col("path"), F.col("content"))).count() == 2
    assert [bytes(r[0]) for r in data.select(blobs.as_bytes(blobs.as_text(F.col("content")))).collect()] == ["héllo".encode(), b"x"]


def test_stream_equals_batch(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.docx").write_bytes(docx.build(["one two three"] * 5))
    (source / "b.pdf").write_bytes(pdf.build(["four five", "six"]))
    (source / "c.txt").write_bytes(b"no")
    chunker = lambda pages: token_chunks(pages, 4, 1)
    ingest_stream(spark, str(source), str(sink), str(tmp_path / "check"), chunker).awaitTermination(120)
    (source / "d.pdf").write_bytes(pdf.build(["seven"]))
    ingest_stream(spark, str(source), str(sink), str(tmp_path / "check"), chunker).awaitTermination(120)
    reads = spark.sparkContext.accumulator(0)

    def counted(content):
        reads.add(1)
        return pdf.pages(content)

    (source / "e.pdf").write_bytes(pdf.build(["eight"]))
    before = EXTRACTORS[".pdf"]
    EXTRACTORS[".pdf"] = counted
    try:
        ingest_stream(spark, str(source), str(sink), str(tmp_path / "check"), chunker).awaitTermination(120)
    finally:
        EXTRACTORS[".pdf"] = before
    assert reads.value == 1  # a file is extracted once, for all tables
    batch = pages_and_chunks(blobs.files(spark, str(source)), chunker)
    for name, expected in zip(("pages", "chunks", "rejected"), batch):
        got = spark.read.parquet(f"{sink}/{name}").drop("batch")
        key = lambda df: sorted(tuple(r) for r in df.select(*(F.col(c).cast("string") for c in sorted(df.columns))).collect())
        assert key(got) == key(expected.withColumn("path", F.col("path")))
