"""Two versions in, a report out."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from datetime import date
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from driftmark.errors import BadKey
from driftmark.operators.compare import Comparison, Finding, Sensitivity, compare
from driftmark.operators.prepare import prepare
from driftmark.operators.profile import EXACT, FOOTER, Profile, profile_prepared
from driftmark.operators.rows import compare_rows
from driftmark.plans.rules import Classified, RuleSet, strongest
from driftmark.plans.versions import STRONGEST_FIRST, Severity, bump
from driftmark.sources import load_prepared, load_profile
from driftmark.sources.names import described, is_profile

TITLE = "# Changelog"


@dataclass(frozen=True)
class Report:
    old_source: str
    new_source: str
    current_version: str
    next_version: str
    bump: Severity | None
    comparison: Comparison
    classified: tuple[Classified, ...]
    generated_at: date = field(default_factory=date.today)

    def of(self, severity: Severity | None) -> list[Classified]:
        return [c for c in self.classified if c.severity is severity]


def report_on(old: Profile, new: Profile, rules: RuleSet | None = None, version: str = "0.0.0", how: Sensitivity = Sensitivity(), extra: Sequence[Finding] = ()) -> Report:
    """The report on two profiles; extra findings come after those of the profiles."""
    found = compare(old, new, how)
    if extra:
        found = Comparison(old, new, (*found.findings, *extra), found.columns)
    classified = tuple((rules or RuleSet.load()).evaluate(found.findings))
    severity = strongest(classified)
    return Report(old.source, new.source, bump(version, None), bump(version, severity), severity, found, classified)


def analyze(
    spark: SparkSession,
    old: str | DataFrame,
    new: str | DataFrame,
    rules: RuleSet | str | Path | None = None,
    version: str = "0.0.0",
    how: Sensitivity = Sensitivity(),
    key: Sequence[str] = (),
    mode: str = EXACT,
) -> Report:
    """Profile and compare two versions: paths, database tables, stored profiles or DataFrames.

    With a key, rows are matched too, which needs rows on both sides; each source is then
    read into one prepared frame for both purposes.
    """
    rules = rules if isinstance(rules, RuleSet) else RuleSet.load(rules)
    if not key:
        profiles = [load_profile(spark, side, mode) for side in (old, new)]
        return report_on(*profiles, rules, version, how)
    if mode == FOOTER:
        raise BadKey("footer mode reads no rows, which matching on a key needs")
    for side in (old, new):
        if isinstance(side, str) and is_profile(side):
            raise BadKey(f"{side} is a stored profile; matching rows on a key needs rows on both sides")
    named = [(load_prepared(spark, s), described(s)) if isinstance(s, str) else (prepare(s), "dataframe") for s in (old, new)]
    profiles = [profile_prepared(found, name, mode) for found, name in named]
    extra = compare_rows(named[0][0], named[1][0], key, named[0][1], named[1][1])
    return report_on(*profiles, rules, version, how, extra)


def entry(report: Report) -> str:
    """The report as a changelog entry."""
    parts = [f"## [{report.next_version}] - {report.generated_at.isoformat()}"]
    for severity in STRONGEST_FIRST:
        if found := report.of(severity):
            parts.append("\n".join([f"### {severity.word.capitalize()}", *(f"- {c.finding.text}" for c in found)]))
    if len(parts) == 1:
        parts.append("No classified changes detected.")
    return "\n\n".join(parts) + "\n"


def write_changelog(report: Report, path: str | Path) -> Path:
    """A new changelog, or the entry on top of the one that there is."""
    path = Path(path)
    rest = path.read_text(encoding="utf-8").lstrip() if path.exists() else TITLE
    titled = rest.startswith(TITLE)
    rest = rest.removeprefix(TITLE).lstrip("\n")
    text = "\n".join(x for x in (f"{TITLE}\n" if titled else "", entry(report), rest) if x)
    path.write_text(text, encoding="utf-8")
    return path


def payload(report: Report) -> dict[str, Any]:
    """The whole report as plain data."""
    def side(p: Profile) -> dict[str, Any]:
        return {"source": p.source, "rows": p.rows, "mode": p.mode, "columns": {n: asdict(c) for n, c in p.columns.items()}}

    def one(c: Classified) -> dict[str, Any]:
        return {"finding": asdict(c.finding), "severity": c.severity.word if c.severity else None, "rule": c.rule}

    return {
        "generated_at": report.generated_at.isoformat(),
        "old_source": report.old_source,
        "new_source": report.new_source,
        "current_version": report.current_version,
        "next_version": report.next_version,
        "bump": report.bump.word if report.bump else None,
        "old": side(report.comparison.old),
        "new": side(report.comparison.new),
        "columns": [
            {"name": s.name, "status": s.status, "renamed_from": s.renamed_from}
            | {f"{n}_{v}": getattr(p, n) if p else None for v, p in (("old", s.old), ("new", s.new)) for n in ("label", "null_ratio", "cardinality")}
            for s in report.comparison.columns
        ],
        "classified": [one(c) for c in report.classified],
    }


def to_json(report: Report) -> str:
    return json.dumps(payload(report), indent=2, ensure_ascii=False)


def rendered(report: Report) -> str:
    """The report as plain text tables."""
    def grid(rows: list[tuple[str, ...]]) -> list[str]:
        widths = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
        return ["  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in rows]

    def moved(old: object, new: object) -> str:
        return f"{'-' if old is None else old} -> {'-' if new is None else new}"

    columns = [("column", "status", "type", "nulls", "cardinality")]
    for s in report.comparison.columns:
        nulls = [f"{p.null_ratio:.1%}" if p else None for p in (s.old, s.new)]
        columns.append((s.name, s.status, moved(*[p.label if p else None for p in (s.old, s.new)]), moved(*nulls), moved(*[p.cardinality if p else None for p in (s.old, s.new)])))
    changes = [("severity", "rule", "description")]
    changes += [(c.severity.name if c.severity else "-", c.rule or "-", c.finding.text) for s in (*STRONGEST_FIRST, None) for c in report.of(s)]
    head = [f"Suggested bump: {report.bump.name if report.bump else 'none'}", f"{report.current_version} -> {report.next_version}", f"old: {report.old_source} ({report.comparison.old.rows} rows)", f"new: {report.new_source} ({report.comparison.new.rows} rows)"]
    return "\n".join([*head, "", *grid(columns), "", *(grid(changes) if len(changes) > 1 else ["No changes."])])


def refused(report: Report, least: Severity | None) -> bool:
    """Whether a gate at this severity turns the change down."""
    return least is not None and report.bump is not None and report.bump >= least
