import pytest

from driftmark.errors import BadKey, RuleProblem
from driftmark.operators.compare import Finding
from driftmark.operators.prepare import prepare
from driftmark.operators.rows import compare_rows
from driftmark.plans.rulejoin import classify
from driftmark.plans.rules import RuleSet, strongest
from driftmark.plans.versions import Severity


def rows(spark, data, schema="id int, v string"):
    return prepare(spark.createDataFrame(data, schema))


def diff(spark, old, new, key=("id",), schemas=("id int, v string",) * 2):
    return {f.kind: f for f in compare_rows(rows(spark, old, schemas[0]), rows(spark, new, schemas[1]), key)}


def test_missing_values_and_order_are_no_change(spark):
    assert diff(spark, [(1, None), (2, "b")], [(2, "b"), (1, None)]) == {}


def test_widened_numbers_are_no_change(spark):
    assert diff(spark, [(1, 5)], [(1, 5.0)], schemas=("id int, v int", "id int, v double")) == {}
    assert "rows_modified" in diff(spark, [(1, 5)], [(1, "5x")], schemas=("id int, v int", "id int, v string"))


def test_null_keys_match_each_other(spark):
    assert set(diff(spark, [(None, "a"), (1, "b")], [(None, "z"), (1, "b")])) == {"rows_modified"}


def test_membership(spark):
    found = diff(spark, [(1, "a"), (2, "b")], [(2, "b"), (3, "c"), (4, "d")])["rows_replaced"]
    assert found.metrics == {"rows_added": 2.0, "rows_removed": 1.0, "replaced_pct": 100.0}
    assert diff(spark, [(1, "a"), (2, "b")], [])["rows_replaced"].metrics["replaced_pct"] == 2.0


def test_composite_keys_and_ranked_columns(spark):
    schema = "a int, b string, x int, y int"
    old, new = [(1, "p", 1, 1), (1, "q", 2, 2)], [(1, "p", 9, 1), (1, "q", 9, 9)]
    found = compare_rows(rows(spark, old, schema), rows(spark, new, schema), ["a", "b"])
    assert found[0].details["columns"] == {"x": 2, "y": 1}


def test_refused_keys(spark):
    with pytest.raises(BadKey, match="2 more row"):
        diff(spark, [(1, "a"), (1, "b"), (None, "c"), (None, "d")], [(1, "a")])
    with pytest.raises(BadKey, match="'zz' does not exist"):
        diff(spark, [(1, "a")], [(1, "a")], key=("zz",))


def test_threshold_is_strict_and_scope_holds():
    rules = RuleSet.of({"major": [{"row_count_decrease_greater_than": 20}, {"nulls_introduced": {"columns": ["a"]}}], "MINOR": ["row_count_decreased"]})

    def severity(kind, column=None, **metrics):
        return rules.classify(Finding(kind, "", column, metrics)).severity

    assert severity("row_count_decreased", decrease_pct=20) is Severity.MINOR
    assert severity("row_count_decreased", decrease_pct=20.1) is Severity.MAJOR
    assert severity("nulls_introduced", "a") is Severity.MAJOR and severity("nulls_introduced", "b") is None


def test_ignored_findings_keep_their_rule():
    rules = RuleSet.of({"ignore": ["column_removed"], "major": ["column_removed"]})
    found = rules.evaluate([Finding("column_removed", "")])
    assert found[0].rule == "column_removed" and strongest(found) is None


@pytest.mark.parametrize(
    "bad",
    [
        [],
        {"huge": []},
        {"major": ["nonsense"]},
        {"major": [{"column_removed": 3}]},
        {"major": [{"psi_greater_than": True}]},
        {"major": [{"psi_greater_than": "x"}]},
        {"major": [{"column_removed": {"columns": "id"}}]},
        {"major": [{"column_removed": {"columns": []}}]},
        {"major": [{"column_removed": {"column": ["id"]}}]},
        {"major": [{"a": 1, "b": 2}]},
        {"major": [7]},
    ],
)
def test_rules_that_mean_nothing_are_refused(bad):
    with pytest.raises(RuleProblem):
        RuleSet.of(bad)


def test_rule_files(tmp_path):
    path = tmp_path / "rules.yaml"
    for text in ("major: &a [column_removed]\nminor: *a\n", "major: [", "[" * 100_000):
        path.write_text(text)
        with pytest.raises(RuleProblem):
            RuleSet.load(path)
    path.write_text("")
    assert RuleSet.load(path).ranked == ()
    with pytest.raises(FileNotFoundError):
        RuleSet.load(tmp_path / "none.yaml")


def test_join_classifies_as_the_rule_set_does(spark):
    rules = RuleSet.of({"ignore": [{"column_added": {"columns": ["x"]}}], "major": [{"psi_greater_than": 0.25}], "minor": ["category_balance_shift", "column_added"]})
    findings = [("column_added", "x", {}), ("column_added", "y", {"null_ratio": 1.0}), ("category_balance_shift", "z", {"psi": 0.3}), ("category_balance_shift", "z", {"psi": 0.2}), ("rows_modified", None, {})]
    got = classify(spark.createDataFrame(findings, "kind string, column_name string, metrics map<string,double>"), rules).collect()
    expected = [rules.classify(Finding(k, "", c, m)) for k, c, m in findings]
    assert sorted((r.kind, str(r.severity), str(r.rule)) for r in got) == sorted((e.finding.kind, e.severity.word if e.severity else "None", str(e.rule)) for e in expected)
