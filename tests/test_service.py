import json
import threading
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pytest

from chunkloom import service
from chunkloom.config import Settings
from chunkloom.sources import docx, pdf
from chunkloom.sources.storage import open_storage


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("uploads")
    running = service.server(open_storage(spark, root=str(root)), port=0, settings=Settings(max_upload_size=50_000))
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{running.server_port}", root
    running.shutdown()
    running.server_close()


def asked(url, name=None, content=b"", field="file", method=None):
    body = None
    if name is not None:
        body = b"--x1\r\nContent-Disposition: form-data; name=\"" + field.encode() + b"\"; filename=\"" + name.encode() + b"\"\r\nContent-Type: application/octet-stream\r\n\r\n" + content + b"\r\n--x1--\r\n"
    try:
        with urlopen(Request(url, body, {"Content-Type": "multipart/form-data; boundary=x1"} if body else {}, method=method), timeout=60) as answer:
            return answer.status, dict(answer.headers), json.loads(answer.read() or b"null")
    except HTTPError as problem:
        return problem.code, dict(problem.headers), json.loads(problem.read())


def test_listing_and_health(base):
    status, headers, body = asked(f"{base[0]}/")
    assert status == 200 and headers["Access-Control-Allow-Origin"] == "*" and body["version"] == "1.0.0"
    for path in body["endpoints"].values():
        assert asked(base[0] + path)[0] in (200, 404)  # upload only takes forms
    assert asked(f"{base[0]}/api/v1/health")[2] == {"status": "healthy"}
    assert asked(f"{base[0]}/", method="OPTIONS")[0] == 204 and asked(f"{base[0]}/no")[0] == 404 and asked(f"{base[0]}/no", "a.pdf")[0] == 404


def test_upload(base):
    url, root = f"{base[0]}/api/v1/upload", base[1]
    status, _, body = asked(url, "../../Two pages.PDF", pdf.build(["one\r\n--x1", "two"]))
    assert status == 200 and body == {"message": "Document uploaded and processed successfully", "filename": "../../Two pages.PDF", "file_size": len(pdf.build(["one\r\n--x1", "two"])), "document_type": ".pdf", "chunks_processed": 2}
    assert asked(url, "a.docx", docx.build(["x", "y"]))[2]["chunks_processed"] == 1
    kept = sorted(p.suffix for p in root.rglob("*") if p.is_file() and not p.name.startswith("."))
    assert kept == [".docx", ".pdf"]
    for name, content, code, said in (("", b"x", 400, "No file"), ("a.txt", b"x", 400, "Unsupported file type: .txt"), ("a.pdf", b"0" * 60_000, 400, "exceeds"), ("a.pdf", b"0" * 200_000, 400, "exceeds"), ("broken.pdf", b"junk", 500, "not a PDF"), ("old.doc", b"junk", 500, "no extractor")):
        status, _, body = asked(url, name, content)
        assert status == code and said in body["detail"]
    assert asked(url, "a.pdf", b"x", field="other")[0] == 400
    assert sorted(p.suffix for p in root.rglob("*") if p.is_file() and not p.name.startswith(".")) == kept  # what failed is gone
