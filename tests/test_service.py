import base64
import json
import threading
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pytest

from driftmark import batch, cli
from driftmark.service import Refused, Service, Settings, serve

OLD, NEW = {"name": "../a.csv", "content": "id,v\n1,a\n2,b\n"}, {"name": "b.csv", "base64": base64.b64encode(b"id,v,w\n1,a,x\n2,c,y\n").decode()}


def test_routes(spark, tmp_path):
    for version, text in (("1", "id\n1\n"), ("2.1", "id,x\n1,2\n")):
        (tmp_path / f"t_v{version}.csv").write_text(text)
    service = Service(spark, Settings(tmp_path))
    assert ".csv" in service.answer("GET", "/api/meta")["formats"]
    assert service.answer("POST", "/api/profile", OLD)["rows"] == 2
    found = service.answer("POST", "/api/diff", {"old": OLD, "new": NEW, "version": "1.0.0", "key": ["id"]})
    assert found["next_version"] == "1.1.0" and found["old_source"] == "a.csv"
    assert any(c["finding"]["kind"] == "rows_modified" for c in found["classified"])
    assert service.answer("GET", "/api/history") == {"t": ["1", "2.1"]}
    assert service.answer("GET", "/api/history/t/diff")["next_version"] == "1.1.0"


@pytest.mark.parametrize(
    ("method", "path", "body", "status"),
    [
        ("GET", "/nope", None, 404),
        ("GET", "/api/history", None, 404),
        ("POST", "/api/profile", {"name": "a.doc", "content": ""}, 415),
        ("POST", "/api/profile", {"name": "sqlite:///x#t"}, 415),
        ("POST", "/api/profile", {"name": "a.csv", "base64": "%"}, 400),
        ("POST", "/api/profile", [], 400),
        ("POST", "/api/profile", {"name": "a.csv", "content": "a,b,c\n1,2,3\n"}, 413),
        ("POST", "/api/diff", {"old": OLD}, 400),
        ("POST", "/api/diff", {"old": OLD, "new": OLD, "version": "x"}, 422),
    ],
)
def test_refusals(spark, method, path, body, status):
    with pytest.raises(Refused) as error:
        Service(spark, Settings(columns=2)).answer(method, path, body)
    assert error.value.status == status


def test_what_expands_beyond_the_limit_is_refused(spark):
    import gzip
    import io

    import pyarrow as pa
    import pyarrow.parquet

    packed = gzip.compress(b"id,v\n" + b"1,aaaa\n" * 5000)
    table = io.BytesIO()
    pa.parquet.write_table(pa.table({"id": list(range(5000))}), table, compression="zstd")
    uploads = [("a.csv.gz", packed), ("a.parquet", table.getvalue())]
    for name, data in uploads:
        body = {"name": name, "base64": base64.b64encode(data).decode()}
        with pytest.raises(Refused) as error:
            Service(spark, Settings(expanded_bytes=len(data) + 100)).answer("POST", "/api/profile", body)
        assert error.value.status == 413
        assert Service(spark, Settings(expanded_bytes=1 << 20)).answer("POST", "/api/profile", body)["rows"] == 5000
        with pytest.raises(Refused) as error:
            Service(spark).answer("POST", "/api/profile", {"name": name, "base64": base64.b64encode(data[:40]).decode()})
        assert error.value.status == 422


def test_over_http(spark):
    server = serve(spark, 0, Settings(upload_bytes=500))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/api"
    try:
        assert json.load(urlopen(f"{base}/meta"))["upload_bytes"] == 500
        for request, status in ((Request(f"{base}/meta", headers={"Host": "evil.example"}), 400), (Request(f"{base}/profile", b"x" * 600), 413), (Request(f"{base}/profile", b"{"), 400)):
            with pytest.raises(HTTPError) as error:
                urlopen(request)
            assert error.value.code == status
    finally:
        server.shutdown()


def test_ci_outputs_and_mode(tmp_path, monkeypatch):
    environment = {"GITHUB_OUTPUT": str(tmp_path / "o"), "GITHUB_STEP_SUMMARY": str(tmp_path / "s")}
    batch.ci_outputs(batch.RangeReport("a", "b", (batch.Outcome("x.csv", "added", reason="added"),)), environment)
    assert (tmp_path / "o").read_text() == "bump=none\ncompared=0\nskipped=1\n" and "x.csv: added" in (tmp_path / "s").read_text()
    monkeypatch.setenv(cli.MODE_VARIABLE, "quick")
    assert cli.main(["rules"]) == 2
