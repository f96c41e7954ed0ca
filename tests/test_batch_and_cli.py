import json
import subprocess

import pytest

from driftmark import batch, cli, profile
from driftmark.errors import DatasetError
from driftmark.sources.stored import write_profile
from driftmark.streaming.monitor import watch

OLD, NEW = "id,v\n1,a\n2,b\n3,a\n", "id,v,w\n1,a,x\n2,b,y\n3,a,x\n4,b,y\n"


@pytest.fixture
def session(spark, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda: spark)
    return spark


@pytest.fixture
def pair(tmp_path):
    (tmp_path / "old.csv").write_text(OLD)
    (tmp_path / "new.csv").write_text(NEW)
    return str(tmp_path / "old.csv"), str(tmp_path / "new.csv")


def test_diff_and_its_gate(session, pair, tmp_path, capsys):
    assert cli.main(["diff", *pair, "--current-version", "1.0.0", "--output", str(tmp_path / "C.md"), "--write-version"]) == 0
    assert "Suggested bump: MINOR" in capsys.readouterr().out
    assert (tmp_path / "new.csv.version").read_text() == "1.1.0\n" and "## [1.1.0]" in (tmp_path / "C.md").read_text()
    (tmp_path / "new.csv.version").unlink()
    assert cli.main(["diff", *pair, "--fail-on", "minor", "--json", "--write-version"]) == 1
    assert json.loads(capsys.readouterr().out)["bump"] == "minor" and not (tmp_path / "new.csv.version").exists()
    assert cli.main(["diff", *pair, "--key", "nope"]) == 2
    assert cli.main(["diff", pair[0], str(tmp_path / "gone.csv")]) == 2


def test_profile_rules_and_history(session, pair, tmp_path, capsys):
    assert cli.main(["profile", pair[0]]) == 0 and (tmp_path / "old.profile.json").exists()
    assert cli.main(["rules", "--json"]) == 0
    assert {"name": "psi_greater_than", "threshold": 0.25} in json.loads(capsys.readouterr().out.split("columns\n", 1)[1])["major"]
    folder = tmp_path / "past"
    folder.mkdir()
    for version, content in (("1", OLD), ("2", NEW), ("10", NEW)):
        (folder / f"things_v{version}.csv").write_text(content)
    assert [v.version for v in batch.catalogue(folder)["things"]] == ["1", "2", "10"]
    assert batch.resolve(folder, "things").version == "10" and batch.resolve(folder, "things", "v2").version == "2"
    with pytest.raises(DatasetError):
        batch.resolve(folder, "things", "3")
    assert [r.next_version for r in batch.history(session, folder, "things")] == ["1.1.0", "2.0.0"]
    assert cli.main(["history", str(folder)]) == 0 and "things: 1, 2, 10" in capsys.readouterr().out


def test_git_ranges(session, tmp_path):
    def git(*args):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *args], cwd=tmp_path, check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "data").mkdir()
    (tmp_path / "data/a.csv").write_text(OLD)
    (tmp_path / "gone.csv").write_text(OLD)
    (tmp_path / "data/a.csv.version").write_text("2.0.0\n")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "data/a.csv").write_text(NEW)
    (tmp_path / "gone.csv").unlink()
    (tmp_path / "fresh.csv").write_text("q\nz\n")
    git("add", ".")
    git("commit", "-qm", "two")
    found = batch.compare_range(session, tmp_path, "HEAD~1", "HEAD")
    by_path = {o.path: o for o in found.outcomes}
    assert by_path["data/a.csv"].report.next_version == "2.1.0" and by_path["gone.csv"].status == "deleted" and by_path["fresh.csv"].reason
    assert "| data/a.csv | minor | 2.0.0 -> 2.1.0 |" in batch.markdown(found)
    assert [o.path for o in batch.compare_range(session, tmp_path, "HEAD~1", "HEAD", ["data"]).outcomes] == ["data/a.csv"]
    with pytest.raises(DatasetError):
        batch.compare_range(session, tmp_path, "--help", "HEAD")


def test_stream_monitor(session, tmp_path):
    schema = "id bigint, v string"
    base = profile(session.createDataFrame([(i, "ab"[i % 2]) for i in range(100)], schema))
    session.createDataFrame([(i, None) for i in range(50)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    stream = session.readStream.schema(schema).parquet(f"{tmp_path}/in")
    watch(stream, base, lambda n, report: seen.append(report), f"{tmp_path}/state").awaitTermination(120)
    assert len(seen) == 1 and "nulls_introduced" in {c.finding.kind for c in seen[0].classified if c.severity}
    assert write_profile(base, tmp_path / "p.profile.json").exists()
