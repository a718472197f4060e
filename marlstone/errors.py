"""Errors by what a caller can do about them; each kind ends the command line with a code of its own."""

from __future__ import annotations


class MarlstoneError(Exception):
    exit_code = 7


class Invalid(MarlstoneError, ValueError):
    """What was asked for, or the configuration, makes no sense."""

    exit_code = 1


class NotFound(MarlstoneError, LookupError):
    exit_code = 2


class SchemaMismatch(MarlstoneError):
    """A store of another version."""

    exit_code = 3


class Busy(MarlstoneError):
    """Somebody else is writing."""

    exit_code = 4


class IntegrityError(MarlstoneError, ValueError):
    """Stored tables contradict each other."""

    exit_code = 5


class DataError(MarlstoneError, ValueError):
    """Input that contradicts itself or lacks something."""

    exit_code = 6
