"""Errors that a caller can act on; all are ValueErrors."""


class DatasetError(ValueError):
    """Something about a dataset, a profile or a rule set cannot be used as given."""


class UnsupportedFormat(DatasetError):
    """No reader for this kind of source."""


class UnreadableSource(DatasetError):
    """A source of a known kind that cannot be read."""


class FooterUnavailable(DatasetError):
    """A file's metadata cannot answer what was asked of it."""


class ProfileUnreadable(DatasetError):
    """A stored profile that is broken or from a newer version."""


class RuleProblem(DatasetError):
    """A rule file that does not say what it means."""


class BadKey(DatasetError):
    """A row key that is missing or not unique."""


class BadVersion(DatasetError):
    """A version that is not MAJOR.MINOR.PATCH."""
