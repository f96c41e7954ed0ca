import gzip
import json
import sqlite3

import pyarrow as pa
import pyarrow.feather
import pyarrow.parquet
import pytest

from driftmark.errors import BadKey, DatasetError, FooterUnavailable, ProfileUnreadable, UnsupportedFormat
from driftmark.operators.profile import FOOTER
from driftmark.plans.analyze import analyze
from driftmark.sources import load_frame, load_prepared, load_profile, names, text
from driftmark.sources.stored import read_profile, write_profile

TABLE = {"id": [1, 2, 3, 4], "name": ["Ana", "Ben", None, "Dee"], "score": [1.5, 2.5, 3.25, None]}


@pytest.fixture
def files(tmp_path):
    arrow = pa.table(TABLE)
    pyarrow.parquet.write_table(arrow, tmp_path / "a.parquet")
    pyarrow.feather.write_feather(arrow, tmp_path / "a.feather", compression="uncompressed")
    lines = ["id;name;score", "1;Ana;1.5", "2;Ben;2.5", "3;;3.25", "4;Dee;NA"]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    with gzip.open(tmp_path / "a.tsv.gz", "wt") as out:
        out.write("\n".join(line.replace(";", "\t") for line in lines) + "\n")
    records = [dict(zip(TABLE, row, strict=True)) for row in zip(*TABLE.values(), strict=True)]
    (tmp_path / "a.json").write_text(json.dumps(records))
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, records)))
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("CREATE TABLE t (id INTEGER, name TEXT, score REAL)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [tuple(r.values()) for r in records])
    return tmp_path


def sources(files):
    return [*(f"{files}/a.{e}" for e in ("parquet", "feather", "csv", "tsv.gz", "json", "jsonl")), f"sqlite:///{files}/a.db#t"]


def test_every_format_gives_the_same_profile(spark, files):
    first = load_profile(spark, f"{files}/a.parquet")
    for source in sources(files):
        found = load_profile(spark, source)
        assert found.rows == 4 and dict(found.columns) == dict(first.columns), source


def test_delimiters():
    assert text.find_delimiter(["a,b;c", "1,2;3"]) == ","
    assert text.find_delimiter(["a;b", '"x,y,z";2']) == ";"
    assert text.find_delimiter(["one", "two"]) == ","
    assert text.find_delimiter(["a|b|c,d", "1|2|3,4"]) == "|"
    assert text.outside_quotes('a,"b,c",d', ",") == 2


def test_delimiter_from_the_environment(monkeypatch):
    monkeypatch.setenv(text.DELIMITER_VARIABLE, "\\t")
    assert text.named_delimiter() == "\t"
    monkeypatch.setenv(text.DELIMITER_VARIABLE, "ab")
    with pytest.raises(DatasetError):
        text.named_delimiter()


def test_headers(spark, tmp_path):
    (tmp_path / "h.csv").write_text('a,a,,"q,r"\n1,2,3,"x\ny"\n')
    assert load_frame(spark, f"{tmp_path}/h.csv").columns == ["a", "a.1", "Unnamed: 2", "q,r"]


def test_json_lines_are_all_read_and_structs_flattened(spark, tmp_path):
    (tmp_path / "n.jsonl").write_text('{"id": 1, "u": {"name": "x", "at": [1]}}\n{"id": 2, "u": {"name": "y"}, "more": true}\n')
    found = load_prepared(spark, f"{tmp_path}/n.jsonl")
    assert found.frame.count() == 2 and {f.name for f in found.fields} == {"id", "more", "u.name", "u.at"}
    (tmp_path / "one.json").write_text('{\n "id": 1,\n "b": "x"\n}')
    assert load_frame(spark, f"{tmp_path}/one.json").count() == 1
    (tmp_path / "none.json").write_text("[]")
    assert load_profile(spark, f"{tmp_path}/none.json").rows == 0


def test_tabs_and_records_of_other_lengths(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("n,a,m\tnote\n1,2,3\tx\n")
    found = load_frame(spark, f"{tmp_path}/t.tsv")
    assert found.columns == ["n,a,m", "note"] and tuple(found.first()) == ("1,2,3", "x")
    (tmp_path / "short.csv").write_text("a,b\n1\n2,x\n")
    assert sorted(map(tuple, load_frame(spark, f"{tmp_path}/short.csv").collect())) == [("1", None), ("2", "x")]
    (tmp_path / "long.csv").write_text("a,b\n" + "1,2\n" * 50 + "3,4,5\n")
    with pytest.raises(DatasetError, match="'3'"):
        load_frame(spark, f"{tmp_path}/long.csv")


@pytest.mark.parametrize("text", ['{"a": 1}\n' * 30 + "[2]\n", '{"a": 1}\n5\n', '[{"a": 1}, 3]', '[{"a": 1}, null]', '["x"]'])
def test_json_records_that_are_not_objects(spark, tmp_path, text):
    (tmp_path / "r.json").write_text(text)
    with pytest.raises(DatasetError, match="not objects"):
        load_frame(spark, f"{tmp_path}/r.json")


def test_footers_without_statistics(spark, tmp_path):
    pyarrow.parquet.write_table(pa.table(TABLE), tmp_path / "n.parquet", write_statistics=False)
    before = spark.conf.get("spark.sql.parquet.aggregatePushdown")
    with pytest.raises(FooterUnavailable):
        load_profile(spark, f"{tmp_path}/n.parquet", FOOTER)
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == before


def test_a_key_needs_rows(spark, files):
    with pytest.raises(BadKey, match="footer"):
        analyze(spark, f"{files}/a.parquet", f"{files}/a.parquet", key=["id"], mode=FOOTER)


def test_database_in_ranges(spark, tmp_path, monkeypatch):
    from driftmark.sources import tables

    monkeypatch.setattr(tables, "SQLITE_ROWS", 7)
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("CREATE TABLE t (id INTEGER, name TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"n{i}") for i in range(40)])
        db.execute("DELETE FROM t WHERE id BETWEEN 10 AND 20")
        db.execute("CREATE VIEW v AS SELECT name FROM t")
        db.execute("CREATE TABLE e (id INTEGER)")
    found = load_frame(spark, f"sqlite:///{tmp_path}/a.db#t")
    assert found.rdd.getNumPartitions() > 3 and sorted(int(r.id) for r in found.collect()) == [*range(10), *range(21, 40)]
    assert load_frame(spark, f"sqlite:///{tmp_path}/a.db#v").count() == 29
    assert load_frame(spark, f"sqlite:///{tmp_path}/a.db#e").count() == 0


def test_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text("[1, 2]\n[3]\n")
    (tmp_path / "x.feather").write_text("no arrow")
    (tmp_path / "e.csv").write_text("")
    for source, error in ((f"{tmp_path}/a.doc", UnsupportedFormat), (f"{tmp_path}/none.csv", FileNotFoundError), (f"{tmp_path}/x.feather", DatasetError), (f"{tmp_path}/e.csv", DatasetError), (f"sqlite:///{tmp_path}/no.db#t", FileNotFoundError)):
        with pytest.raises(error):
            load_profile(spark, source)


def test_footers(spark, files):
    found = load_profile(spark, f"{files}/a.parquet", FOOTER)
    c = found.columns
    assert found.mode == FOOTER and found.rows == 4 and c["name"].null_ratio == 0.25 and c["score"].maximum == 3.25 and c["id"].cardinality == 4 and c["id"].quantiles is None
    pyarrow.parquet.write_table(pa.table({"l": [[1]]}), files / "n.parquet")
    with pytest.raises(FooterUnavailable):
        load_profile(spark, f"{files}/n.parquet", FOOTER)


def test_stored_profiles(spark, files):
    found = load_profile(spark, f"{files}/a.csv")
    path = write_profile(found, files / "deep" / "a.profile.json")
    assert read_profile(path) == found
    assert analyze(spark, str(path), f"{files}/a.parquet").comparison.findings == ()
    with pytest.raises(BadKey):
        analyze(spark, str(path), f"{files}/a.csv", key=["id"])
    for broken in ("{", "[]", '{"profile_version": 99}', '{"rows": 1}', '{"source": "s", "rows": 1, "columns": {"a": {"odd": 1}}}'):
        path.write_text(broken)
        with pytest.raises(ProfileUnreadable):
            read_profile(path)


def test_names():
    assert names.suffix_of("x/y.CSV.GZ") == ".csv.gz" and names.suffix_of("a.doc") is None
    assert str(names.profile_path("d/sales.2024.csv")) == "d/sales.2024.profile.json"
    assert str(names.version_path("d/a.csv.gz")) == "d/a.csv.gz.version"
    assert str(names.profile_path("postgresql://u:p@h/db#s/t")) == "s-t.profile.json"
    assert str(names.profile_path("b.xlsx#Q 1")) == "b-Q-1.profile.json"
    assert names.split_sheet("b.xlsx#2") == ("b.xlsx", 2) and names.split_sheet("b.xlsx#'2'") == ("b.xlsx", "2") and names.split_sheet("b.xlsx") == ("b.xlsx", None)


@pytest.mark.parametrize("url", ["postgresql://u:pa@ss@h:5/db#t", "mysql://u:pass@[bad/db#t", "mariadb+x://u:pass@h/db#t"])
def test_passwords_are_not_shown(url):
    assert "pass" not in names.redacted(url).replace("pa@ss", "pass") and "u" in names.redacted(url)


def test_quoted_line_break_after_the_sampled_lines(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_text("a,b\n" + "".join(f"{i},x\n" for i in range(40)) + '40,"one\ntwo, ""three"""\n41,y\n')
    from driftmark.sources.text import read_text

    rows = [tuple(r) for r in read_text(spark, str(path)).collect()]
    assert len(rows) == 42 and (rows[40], rows[41]) == (("40", 'one\ntwo, "three"'), ("41", "y"))
