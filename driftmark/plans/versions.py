"""Severities and version arithmetic."""

from __future__ import annotations

import re
from enum import IntEnum
from pathlib import Path

from driftmark.errors import BadVersion


class Severity(IntEnum):
    PATCH = 1
    MINOR = 2
    MAJOR = 3

    @property
    def word(self) -> str:
        return self.name.lower()

    @classmethod
    def parse(cls, text: object) -> Severity:
        try:
            return cls[str(text).upper()]
        except KeyError:
            raise ValueError(f"unknown severity {text!r}, expected one of {[s.word for s in STRONGEST_FIRST]}") from None


STRONGEST_FIRST = (Severity.MAJOR, Severity.MINOR, Severity.PATCH)
_VERSION = re.compile(r"v?(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)")


def parse_version(text: str) -> tuple[int, int, int]:
    if not (m := _VERSION.fullmatch(text.strip())):
        raise BadVersion(f"invalid version {text!r}, expected MAJOR.MINOR.PATCH")
    return int(m[1]), int(m[2]), int(m[3])


def bump(version: str, severity: Severity | None) -> str:
    """The next version; without a severity, the same one in its normal form."""
    major, minor, patch = parse_version(version)
    if severity is Severity.MAJOR:
        major, minor, patch = major + 1, 0, 0
    elif severity is Severity.MINOR:
        minor, patch = minor + 1, 0
    elif severity is Severity.PATCH:
        patch += 1
    return f"{major}.{minor}.{patch}"


def read_version(path: str | Path) -> str | None:
    """The version in a sidecar file, if there is one."""
    path = Path(path)
    return bump(path.read_text(encoding="utf-8"), None) if path.is_file() else None


def write_version(path: str | Path, version: str) -> Path:
    path = Path(path)
    normal = bump(version, None)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(f"{normal}\n", encoding="utf-8")
    return path
