"""Errors and the exit codes a command gives for them."""


class ReadEngineError(Exception):
    exit_code = 1


class UsageError(ReadEngineError):
    """Arguments that contradict each other or name nothing."""

    exit_code = 1


class SourceError(ReadEngineError):
    """A file can't be read or written."""

    exit_code = 2


class EncodeError(ReadEngineError):
    """A stream can't be encoded."""

    exit_code = 2


class ResourceError(ReadEngineError):
    """More memory than the limit allows."""

    exit_code = 1


class FormatError(ReadEngineError):
    exit_code = 3


class ParseError(FormatError):
    """A record breaks the text format."""


class DecodeError(FormatError):
    """A stream can't be decoded."""


class ChecksumError(ReadEngineError):
    exit_code = 4


class CorruptBlock(ChecksumError):
    """A block that fails its check."""


class UnsupportedFormat(FormatError):
    exit_code = 5


class UnsupportedVersion(UnsupportedFormat):
    """An archive of another major version."""
