"""Typed errors: a code and four independent axes, never a value, path or CRS text of the data."""

from __future__ import annotations

import hashlib
import re

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException


class EdgeError(Exception):
    """code names what went wrong; category, phase, effect and retry say what a caller may do about it."""

    def __init__(self, code: str, message: str, *, category: str = "data", phase: str = "read", effect: str = "none", retry: str = "never", diagnostics=None) -> None:
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.category, self.phase, self.effect, self.retry, self.diagnostics = code, message, category, phase, effect, retry, diagnostics

    def to_dict(self) -> dict:
        out = {"code": self.code, "message": self.message, "category": self.category, "phase": self.phase, "effect": self.effect, "retry": self.retry}
        return out | ({"diagnostics": self.diagnostics.to_dict()} if self.diagnostics is not None else {})

    def __reduce__(self):
        return _rebuild, (self.code, self.message, self.category, self.phase, self.effect, self.retry)


def _rebuild(code, message, category, phase, effect, retry):
    return EdgeError(code, message, category=category, phase=phase, effect=effect, retry=retry)


#: Process exit codes of the command line, by error code.
EXIT_CODES = {
    "USAGE": 2, "DATA_MAPPING": 2, "EXISTS": 3, "UNSUPPORTED": 4, "CRS_REQUIRED": 5, "CONTRACT": 6, "LIMIT": 7,
    "READER_BUSY": 8, "PROJECTION_UNSUPPORTED": 8, "CRS_UNRESOLVED": 8, "CANCELLED": 130,
}


def exit_code(error: EdgeError) -> int:
    return EXIT_CODES.get(error.code, 1)


def fingerprint(error: BaseException) -> str:
    """A short hash of a foreign error's text, so that it can be told apart without being shown."""
    return hashlib.sha256(str(error).encode()).hexdigest()[:16]


#: What Spark names errors of the data with; anything else that Spark raises (memory, lost executors, permissions) is none.
_DATA = re.compile(r"MALFORMED_|CANNOT_READ_FILE_FOOTER|is not a Parquet file|INVALID_UTF8|INVALID_GEOMETRY")
_TYPED = re.compile(r"EdgeError: ([A-Z_]+): ([^\n]*)")


def guarded_rows(phase: str, rows):
    """The items of ``rows``; what a third-party decoder raises on the way becomes a typed error with a fingerprint."""
    rows = iter(rows)
    while True:
        try:
            row = guarded(phase, next, rows)
        except StopIteration:
            return
        yield row


def guarded(phase: str, f, *args):
    """Run code of a third-party decoder; what it finds wrong with the data becomes a typed error with a fingerprint.

    Errors of the machine (memory, files, a lost executor, a failed task) are let through as they are. A typed error that
    was raised within a Spark task comes back with its code.
    """
    try:
        return f(*args)
    except (EdgeError, StopIteration, MemoryError):
        raise
    except (PySparkException, Py4JError) as error:
        said = str(error)
        if typed := _TYPED.search(said):
            raise EdgeError(typed[1], typed[2], phase=phase) from error
        if not _DATA.search(said):
            raise
        raise EdgeError("FORMAT", f"malformed data ({type(error).__name__}, {fingerprint(error)})", phase=phase) from None
    except Exception as error:  # noqa: BLE001
        if isinstance(error, OSError) and error.errno is not None:  # decoders raise OSErrors without a number
            raise
        raise EdgeError("FORMAT", f"decoder failed ({type(error).__name__}, {fingerprint(error)})", phase=phase) from None
