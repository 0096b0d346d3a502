"""Exceptions raised by the library, one per kind of failure a caller may handle."""


class TallymarkError(Exception):
    """Base class."""


class SchemaContractError(TallymarkError):
    """A frame does not have the columns or types its contract asks for."""


class SourceArtifactError(TallymarkError):
    """A CSV artifact is missing, empty or malformed; the whole artifact is rejected."""


class SourceTableError(TallymarkError):
    """An input table is missing or has no rows."""


class IntegrityError(TallymarkError):
    """Stored rows disagree with what a write was asked to store."""


class AmbiguousReleaseError(TallymarkError):
    """Several artifacts share the greatest release year of one observation."""


class DuplicateKeyError(TallymarkError):
    """A release holds more than one row for one observation key."""


class NoMatchingDataError(TallymarkError):
    """A well-formed query matched nothing."""
