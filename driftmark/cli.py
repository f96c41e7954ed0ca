"""Command line: diff, profile, range, history, rules and serve.

Exit codes: 0 done, 1 the gate turned the change down, 2 it could not run.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence
from pathlib import Path

from driftmark import __version__, batch
from driftmark.operators.profile import EXACT, FOOTER, SKETCH
from driftmark.plans import analyze as A
from driftmark.plans.rules import RuleSet
from driftmark.plans.versions import Severity, read_version, write_version
from driftmark.session import build_session
from driftmark.sources import load_profile, names
from driftmark.sources.stored import to_payload, write_profile

MODES = (EXACT, SKETCH, FOOTER)
MODE_VARIABLE = "DRIFTMARK_MODE"


def default_mode() -> str:
    """The mode that the environment asks for; an argument takes precedence."""
    mode = os.environ.get(MODE_VARIABLE) or EXACT
    if mode not in MODES:
        raise ValueError(f"{MODE_VARIABLE} must be one of {', '.join(MODES)}, got {mode!r}")
    return mode


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="driftmark", description=__doc__.splitlines()[0])
    out.add_argument("--version", action="version", version=__version__)
    sub = out.add_subparsers(dest="command", required=True)

    def gate(p: argparse.ArgumentParser) -> None:
        p.add_argument("--rules", type=Path)
        p.add_argument("--json", action="store_true")
        p.add_argument("--output", type=Path)
        p.add_argument("--current-version")
        p.add_argument("--fail-on", choices=[s.word for s in Severity])
        p.add_argument("--write-version", action="store_true")

    diff = sub.add_parser("diff", help="compare two versions of a dataset")
    diff.add_argument("old")
    diff.add_argument("new")
    diff.add_argument("--key", action="append", default=[], help="column that identifies rows; repeat for a composite key")
    diff.add_argument("--mode", choices=MODES, default=default_mode())
    gate(diff)
    prof = sub.add_parser("profile", help="write the profile of a dataset")
    prof.add_argument("source")
    prof.add_argument("--output", type=Path)
    prof.add_argument("--mode", choices=MODES, default=default_mode())
    over = sub.add_parser("range", help="compare the datasets that a revision range changes")
    over.add_argument("paths", nargs="*")
    over.add_argument("--repo", type=Path, default=Path())
    over.add_argument("--rev", default="HEAD~1")
    over.add_argument("--to", default="HEAD")
    over.add_argument("--dvc", action="store_true")
    over.add_argument("--mode", choices=MODES, default=default_mode())
    gate(over)
    past = sub.add_parser("history", help="compare consecutive versions in a directory")
    past.add_argument("directory", type=Path)
    past.add_argument("dataset", nargs="?")
    past.add_argument("--rules", type=Path)
    web = sub.add_parser("serve", help="answer the same questions over HTTP")
    web.add_argument("--port", type=int, default=8000)
    web.add_argument("--datasets", type=Path)
    rules = sub.add_parser("rules", help="show the rules in force")
    rules.add_argument("file", nargs="?", type=Path)
    rules.add_argument("--json", action="store_true")
    return out


def _gate(args: argparse.Namespace) -> Severity | None:
    return Severity.parse(args.fail_on) if args.fail_on else None


def _diff(args: argparse.Namespace) -> int:
    version = args.current_version or (read_version(names.version_path(args.old)) or "0.0.0")
    report = A.analyze(build_session(), args.old, args.new, args.rules, version, key=args.key, mode=args.mode)
    refused = A.refused(report, _gate(args))
    print(A.to_json(report) if args.json else A.rendered(report))
    if args.output:
        A.write_changelog(report, args.output)
    elif not args.json:
        print("\n" + A.entry(report), end="")
    if args.write_version and not refused:
        write_version(names.version_path(args.new), report.next_version)
    return int(refused)


def _profile(args: argparse.Namespace) -> int:
    found = load_profile(build_session(), args.source, args.mode)
    path = write_profile(found, args.output or names.profile_path(args.source))
    print(f"{path}: {found.rows} rows, {len(to_payload(found)['columns'])} columns")
    return 0


def _range(args: argparse.Namespace) -> int:
    found = batch.compare_range(build_session(), args.repo, args.rev, args.to, args.paths, RuleSet.load(args.rules), args.current_version or "0.0.0", args.dvc, args.mode)
    refused = any(o.report and A.refused(o.report, _gate(args)) for o in found.outcomes)
    if args.json:
        done = [{"path": o.path, "status": o.status, "reason": o.reason, "report": A.payload(o.report) if o.report else None} for o in found.outcomes]
        text = json.dumps({"old": found.old, "new": found.new, "bump": found.bump.word if found.bump else None, "datasets": done}, indent=2, ensure_ascii=False)
    else:
        text = batch.markdown(found)
    if args.output:
        args.output.write_text(text, encoding="utf-8")
    else:
        print(text)
    batch.ci_outputs(found, os.environ)
    if args.write_version and not refused:
        for o in found.outcomes:
            if o.report:
                write_version(args.repo / names.version_path(o.path), o.report.next_version)
    return int(refused)


def _history(args: argparse.Namespace) -> int:
    if not args.dataset:
        for name, versions in batch.catalogue(args.directory).items():
            print(f"{name}: {', '.join(v.version for v in versions)}")
        return 0
    for report in batch.history(build_session(), args.directory, args.dataset, RuleSet.load(args.rules)):
        print(A.rendered(report) + "\n")
    return 0


def _serve(args: argparse.Namespace) -> int:
    from driftmark.service import Settings, serve

    server = serve(build_session(), args.port, Settings(args.datasets))
    print(f"listening on http://127.0.0.1:{server.server_port}")
    server.serve_forever()
    return 0


def _rules(args: argparse.Namespace) -> int:
    listed = RuleSet.load(args.file).described()
    if args.json:
        print(json.dumps(listed, indent=2))
        return 0
    for severity, rules in listed.items():
        print(severity + ":")
        for rule in rules:
            print("  " + ", ".join(str(v) if k == "name" else f"{k} {v}" for k, v in rule.items()))
    return 0


def main(arguments: Sequence[str] | None = None) -> int:
    runs = {"diff": _diff, "profile": _profile, "range": _range, "history": _history, "rules": _rules, "serve": _serve}
    try:
        args = parser().parse_args(arguments)
        return runs[args.command](args)
    except (ValueError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
