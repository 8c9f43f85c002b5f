"""Errors of contract checks; all are ``ValueError`` but the use of an unfitted model."""


class SchemaError(ValueError):
    """Columns, types or values differ from the declared recording."""


class WindowError(ValueError):
    """Window parameters or labels can't be used."""


class SplitError(ValueError):
    """Subjects can't be split as asked."""


class NormalizationError(ValueError):
    """Statistics can't be fitted or applied."""


class DuplicateWindowError(ValueError):
    """Equal windows stand in different splits; ``report`` has the counts."""

    def __init__(self, report):
        super().__init__(f"equal windows across splits: {report}")
        self.report = report


class ArtifactError(ValueError):
    """A manifest or a file under it doesn't hold."""


class NotFittedError(RuntimeError):
    """Statistics are used before they are fitted."""


class SettingsError(ValueError):
    """Settings are unknown, of another kind, or out of their range."""
