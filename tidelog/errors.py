"""Exceptions of the library."""

from __future__ import annotations


class TidelogError(Exception):
    """Base of all of them."""


class LogError(TidelogError):
    """A log file or folder can't be handled; ``path`` says which."""

    def __init__(self, message: str, path: str | None = None):
        super().__init__(f"{message} ({path})" if path else message)
        self.path = path


class LogReadError(LogError):
    """Reading a file or folder failed."""


class LogWriteError(LogError):
    """Writing a file failed."""


class CorruptRecord(LogReadError):
    """A record's bytes contradict each other."""


class ChecksumMismatch(CorruptRecord):
    """A record's checksum doesn't match its bytes."""


class InvalidTag(CorruptRecord):
    """A record's tag is none of the known ones."""


class PayloadTooLarge(CorruptRecord):
    """A record's key or value section is longer than a reader accepts."""


class TruncatedRecord(LogReadError):
    """A file ends within a record."""


class TableDecodeError(TidelogError):
    """A varint, block handle or footer can't be decoded."""


class TableCorrupted(TidelogError):
    """A footer has the wrong size."""


class ConfigError(TidelogError):
    """Configuration is missing, unreadable or invalid."""
