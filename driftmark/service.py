"""A small HTTP service over the same calls, with the standard library only.

GET  /api/meta                          versions, formats and limits
POST /api/profile                       {"name": .., "content": ..}
POST /api/diff                          {"old": side, "new": side, "version"?, "rules"?, "key"?}
GET  /api/history                       versioned datasets of the served directory
GET  /api/history/NAME/diff?old=&new=   two versions; by default the last two

A side is {"name": file name, "content": text} or {"name": .., "base64": ..}. Files live only
as long as a request. Requests beyond the limits are refused before anything is read.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import io
import json
import tempfile
import zlib
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

from driftmark import __version__, batch
from driftmark.errors import DatasetError
from driftmark.operators.profile import Profile
from driftmark.plans.analyze import analyze, payload
from driftmark.plans.rules import RuleSet
from driftmark.sources import load_profile, names
from driftmark.sources.stored import to_payload

HEADERS = {
    "Content-Type": "application/json; charset=utf-8",
    "Content-Security-Policy": "default-src 'none'",
    "X-Content-Type-Options": "nosniff",
    "Cache-Control": "no-store",
}


@dataclass(frozen=True)
class Settings:
    datasets: Path | None = None
    upload_bytes: int = 32 << 20
    #: Bytes that an uploaded file may take once it is decompressed.
    expanded_bytes: int = 512 << 20
    columns: int = 2000
    hosts: tuple[str, ...] = ("localhost", "127.0.0.1")


class Refused(Exception):
    def __init__(self, status: int, message: str) -> None:
        super().__init__(message)
        self.status = status


def fits(name: str, data: bytes, limit: int) -> bool:
    """Whether a file stays within a limit when it is decompressed. Gzip is unpacked as far as the
    limit only; Parquet tells in its footer; others are about as large as they come."""
    lower = name.lower()
    if lower.endswith(".gz"):
        size = 0
        try:
            with gzip.open(io.BytesIO(data)) as unpacked:
                while part := unpacked.read(min(1 << 20, limit + 1)):
                    size += len(part)
                    if size > limit:
                        return False
        except (OSError, EOFError, zlib.error) as error:
            raise Refused(422, f"{name!r} is not a gzip file") from error
        return True
    if names.suffix_of(name) in names.PARQUET_FORMATS:
        try:
            footer = pq.read_metadata(io.BytesIO(data))
        except pa.ArrowException as error:
            raise Refused(422, f"{name!r} is not a Parquet file") from error
        return sum(footer.row_group(i).total_byte_size for i in range(footer.num_row_groups)) <= limit
    return len(data) <= limit


class Service:
    """The calls behind the routes, apart from HTTP."""

    def __init__(self, spark: SparkSession, settings: Settings = Settings()) -> None:
        self.spark, self.settings = spark, settings

    def answer(self, method: str, target: str, body: Any = None) -> dict[str, Any]:
        parts = urlsplit(target)
        path = [unquote(p) for p in parts.path.strip("/").split("/")]
        asked = {k: v[-1] for k, v in parse_qs(parts.query).items()}
        try:
            if (method, path) == ("GET", ["api", "meta"]):
                return {"version": __version__, "formats": list(names.FORMATS), "upload_bytes": self.settings.upload_bytes, "columns": self.settings.columns}
            if (method, path) == ("POST", ["api", "profile"]):
                with tempfile.TemporaryDirectory(prefix="driftmark-") as folder:
                    return to_payload(self._profile(self._kept(body, Path(folder, "one"))))
            if (method, path) == ("POST", ["api", "diff"]):
                return self._diff(body)
            if (method, path) == ("GET", ["api", "history"]):
                return {name: [v.version for v in versions] for name, versions in batch.catalogue(self._datasets()).items()}
            if method == "GET" and len(path) == 4 and (path[:2], path[3]) == (["api", "history"], "diff"):
                return self._step(path[2], asked.get("old"), asked.get("new"))
        except (DatasetError, FileNotFoundError, ValueError) as error:
            raise Refused(422, str(error)) from error
        raise Refused(404, f"no such route: {method} {parts.path}")

    def _datasets(self) -> Path:
        if self.settings.datasets is None:
            raise Refused(404, "no directory of datasets is served")
        return self.settings.datasets

    def _kept(self, side: Any, folder: Path) -> str:
        """An uploaded side as a file; only the last part of its name is used."""
        if not isinstance(side, dict) or not isinstance(side.get("name"), str):
            raise Refused(400, "a side needs a name and its content")
        name = Path(side["name"]).name
        if names.is_database(side["name"]) or not (names.suffix_of(name) or names.is_profile(name)):
            raise Refused(415, f"{name!r} is in no supported format")
        try:
            data = base64.b64decode(side["base64"], validate=True) if "base64" in side else str(side.get("content", "")).encode()
        except (binascii.Error, TypeError) as error:
            raise Refused(400, "base64 content is broken") from error
        if not fits(name, data, self.settings.expanded_bytes):
            raise Refused(413, f"{name!r} expands to more than {self.settings.expanded_bytes} bytes")
        folder.mkdir()
        (folder / name).write_bytes(data)
        return str(folder / name)

    def _profile(self, path: str) -> Profile:
        found = load_profile(self.spark, path)
        if len(found.columns) > self.settings.columns:
            raise Refused(413, f"{len(found.columns)} columns exceed the limit of {self.settings.columns}")
        return Profile(Path(path).name, found.rows, found.columns, found.mode)

    def _diff(self, body: Any) -> dict[str, Any]:
        if not isinstance(body, dict):
            raise Refused(400, "expected an object")
        rules = RuleSet.of(body["rules"]) if body.get("rules") else None
        with tempfile.TemporaryDirectory(prefix="driftmark-") as folder:
            sides = [self._kept(body.get(n), Path(folder, n)) for n in ("old", "new")]
            for side in sides:
                self._profile(side)
            found = payload(analyze(self.spark, *sides, rules, body.get("version", "0.0.0"), key=body.get("key") or ()))
        return found | {n: found[n].rpartition("/")[2] for n in ("old_source", "new_source")}

    def _step(self, dataset: str, old: str | None, new: str | None) -> dict[str, Any]:
        folder = self._datasets()
        versions = batch.catalogue(folder).get(dataset, [])
        if old is None and new is None and len(versions) < 2:
            raise Refused(404, f"{dataset!r} has no two versions")
        sides = [batch.resolve(folder, dataset, old or versions[-2].version), batch.resolve(folder, dataset, new)]
        return payload(analyze(self.spark, *[str(s.path) for s in sides], version=batch.as_semver(sides[0].version)))


def serve(spark: SparkSession, port: int = 8000, settings: Settings = Settings(), host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is ready to run: call serve_forever() on it."""
    service = Service(spark, settings)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            try:
                if (self.headers.get("Host") or "").rpartition(":")[0] not in settings.hosts and self.headers.get("Host") not in settings.hosts:
                    raise Refused(400, "unknown host")
                size = int(self.headers.get("Content-Length") or 0)
                if size > settings.upload_bytes:
                    raise Refused(413, f"the request exceeds {settings.upload_bytes} bytes")
                try:
                    body = json.loads(self.rfile.read(size)) if size else None
                except (ValueError, RecursionError) as error:
                    raise Refused(400, "the body is not JSON") from error
                status, found = 200, service.answer(self.command, self.path, body)
            except Refused as error:
                status, found = error.status, {"error": str(error)}
            data = json.dumps(found, ensure_ascii=False).encode()
            self.send_response(status)
            for name, value in {**HEADERS, "Content-Length": str(len(data))}.items():
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
