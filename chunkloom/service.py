"""A small HTTP service over ingestion: upload one file, get its pages counted. Standard library only.

GET / lists the endpoints, GET /api/v1/health says whether Spark answers, POST /api/v1/upload takes a
multipart form with a field named file. Uploads are kept below the storage's root under a key of their
content, never under the name a client gives. All origins are allowed. Errors are {"detail": why}.
"""

from __future__ import annotations

import json
from email.parser import BytesParser
from email.policy import HTTP
from hashlib import sha256
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from chunkloom.config import Settings
from chunkloom.operators.ingest import ACCEPTED
from chunkloom.sources import blobs
from chunkloom.sources.extract import extracted
from chunkloom.sources.storage import Storage

VERSION = "1.0.0"
ENDPOINTS = {"upload": "/api/v1/upload", "health": "/api/v1/health"}


class Refused(Exception):
    def __init__(self, status: int, detail: str) -> None:
        super().__init__(detail)
        self.status = status


def form_file(content_type: str, body: bytes) -> tuple[str, bytes]:
    """(name, content) of the form field named file."""
    form = BytesParser(policy=HTTP).parsebytes(f"Content-Type: {content_type}\r\n\r\n".encode() + body)
    for part in form.iter_parts() if form.is_multipart() else ():
        if part.get_param("name", header="content-disposition") == "file":
            return part.get_filename() or "", part.get_payload(decode=True) or b""
    raise Refused(400, "No file provided")


def upload(storage: Storage, name: str, content: bytes, settings: Settings = Settings(), tenant_id: str = "1") -> dict:
    """Gates, lands and extracts one file. A file that cannot be extracted is deleted again."""
    suffix = PurePosixPath(name.replace("\\", "/")).suffix.lower()
    if not name:
        raise Refused(400, "No file provided")
    if suffix not in ACCEPTED:
        raise Refused(400, f"Unsupported file type: {suffix}")
    if len(content) > settings.max_upload_size:
        raise Refused(400, f"File size exceeds maximum allowed size of {settings.max_upload_size} bytes")
    key = f"upload_files/{tenant_id}/{sha256(content).hexdigest()}{suffix}"
    storage.save(key, content)
    pages = extracted(blobs.files(storage.spark, f"{storage.root.rstrip('/')}/{key}", max_bytes=None))
    count, failed = pages.agg(F.count("page"), F.first(F.when(F.col("page").isNull(), F.col("error")), ignorenulls=True)).first()
    if failed:
        storage.delete(key)
        raise Refused(500, f"Error processing document: {failed}")
    # Pages are what clients know as chunks here.
    return {"message": "Document uploaded and processed successfully", "filename": name, "file_size": len(content), "document_type": suffix, "chunks_processed": count}


def server(storage: Storage, host: str = "127.0.0.1", port: int = 8000, settings: Settings = Settings()) -> ThreadingHTTPServer:
    """A server that is ready to serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, body: dict | None = None) -> None:
            raw = json.dumps(body).encode() if body is not None else b""
            self.send_response(status)
            for name, value in (("Content-Type", "application/json"), ("Content-Length", str(len(raw))), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Methods", "*"), ("Access-Control-Allow-Headers", "*")):
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(raw)

        def do_OPTIONS(self) -> None:
            self._answer(204)

        def do_GET(self) -> None:
            if self.path == "/":
                self._answer(200, {"message": "Chunkloom ingestion", "version": VERSION, "endpoints": ENDPOINTS})
            elif self.path == ENDPOINTS["health"]:
                stopped = storage.spark.sparkContext._jsc.sc().isStopped()
                self._answer(503 if stopped else 200, {"status": "unhealthy" if stopped else "healthy"})
            else:
                self._answer(404, {"detail": "Not Found"})

        def do_POST(self) -> None:
            if self.path != ENDPOINTS["upload"]:
                self._answer(404, {"detail": "Not Found"})
                return
            try:
                size = int(self.headers.get("Content-Length") or 0)
                if size > settings.max_upload_size + (1 << 16):  # turned away unread
                    self.close_connection = True
                    raise Refused(400, f"File size exceeds maximum allowed size of {settings.max_upload_size} bytes")
                self._answer(200, upload(storage, *form_file(self.headers.get("Content-Type", ""), self.rfile.read(size)), settings))
            except Refused as problem:
                self._answer(problem.status, {"detail": str(problem)})
            except Exception as problem:
                self._answer(500, {"detail": f"{type(problem).__name__}: {problem}"})

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
