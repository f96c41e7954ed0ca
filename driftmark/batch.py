"""Many datasets at once: versioned directories, git and DVC revision ranges."""

from __future__ import annotations

import json
import re
import subprocess
import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from driftmark.errors import DatasetError
from driftmark.operators.profile import EXACT, Profile
from driftmark.plans.analyze import Report, report_on
from driftmark.plans.rules import RuleSet
from driftmark.plans.versions import Severity, bump
from driftmark.sources import load_profile, names
from driftmark.sources.stored import read_profile

_NAMED = re.compile(r"(?P<name>.+?)_v(?P<version>\d+(?:\.\d+)*)$")
#: Findings that a table of many datasets lists for each.
TOP = 5


@dataclass(frozen=True)
class Version:
    version: str
    path: Path

    @property
    def order(self) -> tuple[int, ...]:
        return tuple(map(int, self.version.split(".")))


def catalogue(directory: str | Path) -> dict[str, list[Version]]:
    """``name_vN.ext`` files of a directory: versions of each name, in numeric order."""
    found: dict[str, list[Version]] = {}
    for path in sorted(Path(directory).iterdir()):
        suffix = names.suffix_of(path.name)
        if path.is_file() and suffix and (m := _NAMED.match(path.name[: -len(suffix)])):
            found.setdefault(m["name"], []).append(Version(m["version"], path))
    return {name: sorted(v, key=lambda x: x.order) for name, v in sorted(found.items())}


def resolve(directory: str | Path, dataset: str, version: str | None = None) -> Version:
    """A version of a dataset; the latest one by default."""
    versions = catalogue(directory).get(dataset)
    if not versions:
        raise DatasetError(f"{directory} holds no dataset {dataset!r}")
    if version is None:
        return versions[-1]
    for v in versions:
        if v.version == version.removeprefix("v"):
            return v
    raise DatasetError(f"{dataset!r} has no version {version!r}, only {', '.join(v.version for v in versions)}")


def as_semver(version: str) -> str:
    """``v2.1`` as ``2.1.0``."""
    parts = version.removeprefix("v").split(".")
    return ".".join((parts + ["0", "0"])[:3])


def history(spark: SparkSession, directory: str | Path, dataset: str, rules: RuleSet | None = None, mode: str = EXACT) -> Iterator[Report]:
    """A report on each step between consecutive versions; each version is profiled once."""
    before: tuple[Version, Profile] | None = None
    for v in catalogue(directory).get(dataset, []):
        found = load_profile(spark, str(v.path), mode)
        if before:
            yield report_on(before[1], found, rules, as_semver(before[0].version))
        before = v, found


@dataclass(frozen=True)
class Outcome:
    """What became of one dataset of a revision range."""

    path: str
    status: str
    report: Report | None = None
    reason: str | None = None
    previous: str | None = None


@dataclass(frozen=True)
class RangeReport:
    old: str
    new: str
    outcomes: tuple[Outcome, ...] = field(default_factory=tuple)

    @property
    def bump(self) -> Severity | None:
        return max((o.report.bump for o in self.outcomes if o.report and o.report.bump), default=None)


def _run(command: Sequence[str], cwd: str | Path) -> bytes:
    try:
        return subprocess.run(command, cwd=cwd, check=True, capture_output=True).stdout
    except FileNotFoundError as error:
        raise DatasetError(f"{command[0]} is not installed") from error
    except subprocess.CalledProcessError as error:
        lines = error.stderr.decode(errors="replace").strip().splitlines() or ["no reason given"]
        raise DatasetError(f"{' '.join(command[:2])} failed: {lines[-1]}") from error


def is_dataset(path: str) -> bool:
    return names.suffix_of(path) is not None and not names.is_profile(path)


def within(path: str, roots: Sequence[str]) -> bool:
    return not roots or any(path == r.rstrip("/") or path.startswith(f"{r.rstrip('/')}/") for r in roots)


def git_changes(repo: str | Path, old: str, new: str) -> list[tuple[str, str, str | None]]:
    """(status, path, previous path) of the datasets that a range changes."""
    if old.startswith("-") or new.startswith("-"):
        raise DatasetError("a revision may not start with a dash")
    out = _run(["git", "diff", "--name-status", "-z", "-M", "--diff-filter=ACDMRT", old, new], repo).decode().split("\0")
    words, found = iter(out), []
    kinds = {"A": "added", "C": "added", "D": "deleted", "M": "modified", "T": "modified", "R": "renamed"}
    for code in words:
        if not code:
            break
        first = next(words)
        second = next(words) if code[0] in "RC" else None
        path = second or first
        if is_dataset(path):
            found.append((kinds[code[0]], path, first if code[0] == "R" else None))
    return sorted(found, key=lambda c: c[1])


def dvc_changes(repo: str | Path, old: str, new: str | None) -> list[tuple[str, str, str | None]]:
    """(status, path, previous path) as ``dvc diff`` tells them; directories are passed over."""
    payload = json.loads(_run(["dvc", "diff", "--json", old, *([new] if new else [])], repo) or b"{}")
    found = []
    for status in ("added", "deleted", "modified", "renamed"):
        for one in payload.get(status, ()):
            path = one["path"]
            was, now = (path["old"], path["new"]) if isinstance(path, dict) else (None, path)
            if not now.endswith("/") and is_dataset(now):
                found.append((status, now, was))
    return sorted(found, key=lambda c: c[1])


class GitBlobs:
    """Files of a revision, put where Spark can read them for as long as this lasts.

    That is the folder in spark.checkpoint.dir where there is one, which all executors
    share, and a temporary folder otherwise.
    """

    def __init__(self, spark: SparkSession, repo: str | Path) -> None:
        self.spark, self.repo = spark, repo
        self.local = tempfile.TemporaryDirectory(prefix="driftmark-")
        shared = spark.conf.get("spark.checkpoint.dir", None)
        self.shared = f"{shared.rstrip('/')}/driftmark-{uuid.uuid4().hex}" if shared else None

    def content(self, revision: str, path: str) -> bytes:
        return _run(["git", "show", f"{revision}:{path}"], self.repo)

    def _local(self, revision: str, path: str) -> Path:
        target = Path(self.local.name, re.sub(r"\W", "_", revision), path)
        target.parent.mkdir(parents=True, exist_ok=True)
        return target

    def fetch(self, revision: str, path: str) -> str:
        """A path for Spark's readers."""
        target = self._local(revision, path)
        target.write_bytes(self.content(revision, path))
        return self._placed(target)

    def _placed(self, target: Path) -> str:
        if self.shared is None:
            return str(target)
        jvm, context = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        goal = jvm.org.apache.hadoop.fs.Path(f"{self.shared}/{target.relative_to(self.local.name).as_posix()}")
        goal.getFileSystem(context.hadoopConfiguration()).copyFromLocalFile(jvm.org.apache.hadoop.fs.Path(f"file://{target}"), goal)
        return goal.toString()

    def stored(self, revision: str, path: str) -> Profile | None:
        """The profile that is kept beside a dataset, which saves fetching the dataset."""
        beside = names.profile_path(path).as_posix()
        try:
            target = self._local(revision, beside)
            target.write_bytes(GitBlobs.content(self, revision, beside))
            return read_profile(target)
        except DatasetError:
            return None

    def version(self, revision: str, path: str) -> str | None:
        try:
            return bump(GitBlobs.content(self, revision, names.version_path(path).as_posix()).decode(), None)
        except ValueError:
            return None


class DvcBlobs(GitBlobs):
    """Datasets come from DVC's storage, profiles and versions from git."""

    def content(self, revision: str, path: str) -> bytes:
        target = self._local(revision, path)
        _run(["dvc", "get", ".", path, "--rev", revision, "-o", str(target), "--force"], self.repo)
        return target.read_bytes()


def compare_range(
    spark: SparkSession,
    repo: str | Path,
    old: str,
    new: str,
    roots: Sequence[str] = (),
    rules: RuleSet | None = None,
    version: str = "0.0.0",
    dvc: bool = False,
    mode: str = EXACT,
) -> RangeReport:
    """Reports on all datasets that a revision range modifies or renames; others carry a reason."""
    blobs = DvcBlobs(spark, repo) if dvc else GitBlobs(spark, repo)
    changes = dvc_changes(repo, old, new) if dvc else git_changes(repo, old, new)
    outcomes = []
    for status, path, previous in changes:
        if not within(path, roots):
            continue
        if status not in ("modified", "renamed"):
            outcomes.append(Outcome(path, status, reason=f"{status}: nothing to compare with"))
            continue
        was = previous or path
        try:
            sides = [blobs.stored(rev, p) or load_profile(spark, blobs.fetch(rev, p), mode) for rev, p in ((old, was), (new, path))]
            outcomes.append(Outcome(path, status, report_on(*sides, rules, blobs.version(old, was) or version), previous=previous))
        except (DatasetError, FileNotFoundError) as error:
            outcomes.append(Outcome(path, status, reason=str(error), previous=previous))
    return RangeReport(old, new, tuple(outcomes))


def _cell(text: object) -> str:
    return re.sub(r"([\\|`*_<>\[\]])", r"\\\1", re.sub(r"\s+", " ", str(text)))


def markdown(found: RangeReport, limit: int = 60_000) -> str:
    """The range as Markdown: a table, the findings of each dataset, and what was skipped."""
    done = sorted((o for o in found.outcomes if o.report), key=lambda o: (-(o.report.bump or 0), o.path))
    lines = [f"## Dataset changes: {found.bump.word if found.bump else 'none'}", "", "| dataset | bump | version |", "|-|-|-|"]
    lines += [f"| {_cell(o.path)} | {o.report.bump.word if o.report.bump else 'none'} | {o.report.current_version} -> {o.report.next_version} |" for o in done]
    for o in done:
        if listed := [c for c in o.report.classified if c.severity]:
            lines += ["", f"### {_cell(o.path)}", ""]
            lines += [f"- {c.severity.word}: {_cell(c.finding.text)}" for c in sorted(listed, key=lambda c: -c.severity)[:TOP]]
            if len(listed) > TOP:
                lines.append(f"- and {len(listed) - TOP} more")
    skipped = [o for o in found.outcomes if not o.report]
    if skipped:
        lines += ["", "### Skipped", "", *[f"- {_cell(o.path)}: {_cell(o.reason)}" for o in skipped]]
    text = "\n".join(lines) + "\n"
    return text if len(text) <= limit else text[: limit - 20] + "\n\n(truncated)\n"


def ci_outputs(found: RangeReport, environment: Mapping[str, str]) -> None:
    """Results for a CI job: key=value lines and a summary, in the files that the environment names."""
    if target := environment.get("GITHUB_OUTPUT"):
        done = [o for o in found.outcomes if o.report]
        values = {"bump": found.bump.word if found.bump else "none", "compared": len(done), "skipped": len(found.outcomes) - len(done)}
        with open(target, "a", encoding="utf-8") as out:
            out.writelines(f"{k}={v}\n" for k, v in values.items())
    if target := environment.get("GITHUB_STEP_SUMMARY"):
        with open(target, "a", encoding="utf-8") as out:
            out.write(markdown(found))
