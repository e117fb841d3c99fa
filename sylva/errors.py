"""What can go wrong; the cause of an error is its ``__cause__``."""

from __future__ import annotations


class SylvaError(Exception):
    pass


class WalkError(SylvaError):
    """A tree couldn't be read; tells of what and where."""


class Cancelled(WalkError):
    """The caller asked to stop."""


class PartFull(SylvaError):
    """A part has more text or nodes than its numbers can name."""


class JsonError(SylvaError):
    """A document that breaks its format."""


class WriteError(SylvaError):
    """A file couldn't be written."""


class ReadError(SylvaError):
    """A file that breaks its format."""
