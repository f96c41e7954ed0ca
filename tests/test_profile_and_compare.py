import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark import Severity, analyze, bump, compare, profile, report_on
from driftmark.functions.stats import LEVELS, OTHER
from driftmark.operators import profile as P
from driftmark.operators import ranges
from driftmark.operators.prepare import prepare
from driftmark.operators.ranges import RANGE_VALUES, summaries
from driftmark.plans.analyze import entry, payload, refused, rendered, to_json, write_changelog


def numbers(spark, values, name="x"):
    return spark.createDataFrame([(float(v),) for v in values], f"{name} double")


def test_all_kinds_of_columns(spark):
    rows = [(1, 1.5, "a", True, dt.datetime(2024, 1, 1), [1, 2], {"k": 1}, None), (2, float("nan"), "b", None, None, None, None, None), (3, 2.5, "b", False, dt.datetime(2024, 1, 3), [1, 2], {"k": 2}, None)]
    df = spark.createDataFrame(rows, "i int, f double, s string, b boolean, t timestamp, l array<int>, m map<string,int>, v void")
    c = profile(df).columns
    assert {n: x.label for n, x in c.items()} == {"i": "int64", "f": "float64", "s": "string", "b": "bool", "t": "datetime64", "l": "string", "m": "string", "v": "string"}
    assert (c["f"].null_ratio, c["f"].cardinality, c["f"].mean) == (0.333333, 2, 2.0)
    assert (c["b"].mode, c["b"].cardinality) == ("False", 2)
    assert c["t"].maximum - c["t"].minimum == 2 * 86400
    assert c["l"].cardinality == 1 and c["l"].categories == ("[1,2]",)
    assert c["v"].null_ratio == 1 and c["v"].cardinality == 0
    assert c["s"].mode == "b" and c["s"].counts is None  # two of three values are distinct


def test_empty_frame(spark):
    found = profile(spark.createDataFrame([], "a int, b string"))
    assert found.rows == 0 and all(c.cardinality == 0 and c.null_ratio == 0 for c in found.columns.values())
    assert compare(found, found).findings == ()


def test_dotted_and_odd_names(spark):
    df = spark.range(3).select(F.col("id").alias("a.b"), F.struct(F.col("id").alias("c d"), F.struct(F.lit("x").alias("`q`")).alias("e")).alias("s"), F.lit(1).alias("z"))
    assert list(profile(df).columns) == ["a.b", "z", "s.c d", "s.e.`q`"]


def test_quantile_forms_agree(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.gauss(0, 5), 1.0, 2.0]) for _ in range(997)]
    frame = numbers(spark, values).repartition(5)
    exact = profile(frame).columns["x"].quantiles
    assert exact == pytest.approx(summaries(frame, 50 * RANGE_VALUES, LEVELS)["x"][0])
    ordered = sorted(values)
    assert exact[0] == ordered[0] and exact[-1] == ordered[-1] and exact[5] == pytest.approx(ordered[498])
    sketch = profile(frame, mode=P.SKETCH).columns["x"].quantiles
    assert max(abs(a - b) for a, b in zip(exact, sketch, strict=True)) <= 0.02 * (ordered[-1] - ordered[0])
    assert summaries(numbers(spark, [4.0]), 1, LEVELS) == {"x": ((4.0,) * len(LEVELS), 1)}


def test_ranges_of_one_hot_value_many_columns_and_none(spark, monkeypatch):
    monkeypatch.setattr(ranges, "CHUNK_ROWS", 64)
    rng = random.Random(4)
    hot = [7 if rng.random() < 0.6 else rng.randrange(-50, 3000) for _ in range(3000)]
    rows = [(v, float(v) / 3, None, -0.0 if i % 2 else 0.0, *[i] * 7) for i, v in enumerate(hot)]
    schema = "a bigint, b double, c double, z double, " + ", ".join(f"d{i} bigint" for i in range(7))
    frame = spark.createDataFrame(rows, schema).repartition(3)
    found = ranges.summaries(frame, 20 * RANGE_VALUES, LEVELS)
    few = ranges.summaries(frame, 3000, LEVELS)
    assert found == few and "c" not in found and found["z"] == ((0.0,) * len(LEVELS), 1)
    assert found["a"][1] == len(set(hot)) and found["d6"][1] == 3000
    want = np.quantile(hot, LEVELS)
    assert found["a"][0] == pytest.approx(want) and found["b"][0] == pytest.approx(want / 3)
    assert ranges.summaries(frame.limit(0), 0, LEVELS) == {}


def test_tail_of_categories(spark):
    df = spark.range(3000).select((F.col("id") % 300).cast("string").alias("v"))
    c = profile(df).columns["v"]
    assert len(c.counts) == 201 and c.counts[OTHER] == 1000 and c.categories is None and c.cardinality == 300


def test_self_comparison_and_row_order(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).cast("string").alias("c"), (F.rand(3) * 9).alias("x"))
    df = df.persist()
    one, other = profile(df), profile(df.orderBy(F.desc("id")).repartition(7))
    assert compare(one, other).findings == ()
    assert one.columns["c"] == other.columns["c"]


def kinds(old, new):
    return [(f.kind, f.column) for f in compare(old, new).findings]


def test_class_balance_collapses(spark):
    old, new = [spark.range(5000).select(F.when(F.rand(i) < p, "fraud").otherwise("ok").alias("label")) for i, p in ((1, 0.5), (2, 0.01))]
    report = report_on(profile(old), profile(new))
    assert [(c.finding.kind, c.severity) for c in report.classified] == [("category_balance_shift", Severity.MAJOR)]


def test_spread_and_modes_move_without_the_mean(spark):
    rng = random.Random(4)
    old = profile(numbers(spark, [rng.gauss(100, 1) for _ in range(4000)]))
    assert kinds(old, profile(numbers(spark, [rng.gauss(100, 40) for _ in range(4000)]))) == [("distribution_shift", "x")]
    assert kinds(old, profile(numbers(spark, [rng.gauss(rng.choice([98, 102]), 0.3) for _ in range(4000)]))) == [("distribution_shift", "x")]


def test_few_rows_stay_silent(spark):
    old, new = profile(numbers(spark, [1, 2, 3, 4, 5, 6])), profile(numbers(spark, [1, 2, 3, 4, 5, 600]))
    assert kinds(old, new) == [("minor_stat_change", "x")]


def test_moments_slide(spark):
    base = spark.range(2000).select((F.lit("2024-01-01").cast("timestamp") + F.expr("make_interval(0,0,0,0,cast(id as int))")).alias("at"))
    found = compare(profile(base), profile(base.select((F.col("at") + F.expr("INTERVAL 400 DAYS")).alias("at")))).findings
    assert [f.kind for f in found] == ["distribution_shift"] and "mean_shift_seconds" in found[0].metrics and "2024-01-01 to" in found[0].text


def test_keys_that_count_up_are_not_compared(spark):
    assert kinds(profile(spark.range(100)), profile(spark.range(1000, 1100))) == []


def test_types_nulls_and_cardinality(spark):
    old = profile(spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("w"), F.col("id").cast("string").alias("n")))
    new = profile(spark.range(100).select(F.col("id").cast("string").alias("k"), F.col("id").cast("double").alias("w"), F.when(F.col("id") % 2 == 0, F.lit("same")).alias("n")))
    found = kinds(old, new)
    assert ("type_changed_incompatible", "k") in found and ("type_changed_compatible", "w") in found
    assert ("nulls_introduced", "n") in found and ("cardinality_changed", "n") in found


def test_stored_profiles_without_grids_use_sigma(spark):
    from dataclasses import replace

    a, b = profile(numbers(spark, range(100))), profile(numbers(spark, range(60, 160)))
    bare = [P.Profile(p.source, p.rows, {n: replace(c, quantiles=None) for n, c in p.columns.items()}) for p in (a, b)]
    found = compare(*bare).of("distribution_shift")
    assert found and "sigma" in found[0].text and found[0].metrics["sigma_shift"] > 0.5


def test_reports(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c")], "id int, v string")
    report = analyze(spark, old, new, version="v1.4.2", key=["id"])
    assert report.next_version == "1.5.0" and refused(report, Severity.MINOR) and not refused(report, Severity.MAJOR) and not refused(report, None)
    assert "50.0% of the kept rows differ (1 of 2), in v (1)" in entry(report)
    assert payload(report)["bump"] == "minor" and "rows_modified" in to_json(report) and "Suggested bump: MINOR" in rendered(report)
    path = tmp_path / "CHANGELOG.md"
    write_changelog(report, path)
    write_changelog(report, path)
    assert path.read_text().count("## [1.5.0]") == 2 and path.read_text().startswith("# Changelog\n\n## [1.5.0]")
    same = analyze(spark, old, old, version="0.3.1")
    assert same.bump is None and same.next_version == "0.3.1" and "No classified changes" in entry(same)


def test_versions():
    assert [bump("1.2.3", s) for s in (None, *Severity)] == ["1.2.3", "1.2.4", "1.3.0", "2.0.0"]
    for bad in ("1.2", "1.2.3.4", "a.b.c", "01.2.3", ""):
        with pytest.raises(ValueError, match="invalid version"):
            bump(bad, None)


def test_text_columns_are_typed_by_their_values(spark):
    rows = [("1", " yes", "1.5", "2024-01-02", "3/4/2024", "1", None), ("2", "No", "1e3", "2024-01-03T10:11", "13/12/2024", "x", None), (None, "T", "inf", "2024/1/5 01:02:03", "1-2-2024", "2", None)]
    names = ["i", "b", "f", "d", "m", "s", "n"]
    found = prepare(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)), infer=True)
    assert [f.label for f in found.fields] == ["int64", "bool", "float64", "datetime64", "datetime64", "string", "string"]
    got = found.frame.orderBy("c0").collect()
    assert [str(r.c4.date()) for r in got] == ["2024-01-02", "2024-03-04", "2024-12-13"] and got[1].c1 is True


def test_zero_and_one_are_no_truth_values(spark):
    found = prepare(spark.createDataFrame([("0",), ("1",)], "v string"), infer=True)
    assert found.fields[0].label == "int64"
