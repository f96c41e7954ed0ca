"""Dataset versioning analytics on Spark: profile, compare, classify, release."""

__version__ = "0.1.0"

from driftmark.errors import DatasetError
from driftmark.operators.compare import Comparison, Finding, Sensitivity, compare
from driftmark.operators.profile import ColumnProfile, Profile, profile
from driftmark.operators.rows import compare_rows
from driftmark.plans.analyze import Report, analyze, report_on
from driftmark.plans.rules import Classified, Rule, RuleSet
from driftmark.plans.versions import Severity, bump
from driftmark.sources import load_frame, load_profile
from driftmark.sources.stored import read_profile, write_profile

__all__ = [
    "Classified",
    "ColumnProfile",
    "Comparison",
    "DatasetError",
    "Finding",
    "Profile",
    "Report",
    "Rule",
    "RuleSet",
    "Sensitivity",
    "Severity",
    "analyze",
    "bump",
    "compare",
    "compare_rows",
    "load_frame",
    "load_profile",
    "profile",
    "read_profile",
    "report_on",
    "write_profile",
]
