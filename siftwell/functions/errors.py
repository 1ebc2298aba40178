"""Messages for files that could not be worked on."""

from __future__ import annotations

import errno

# How the advice for each kind of failure begins.
_FIRST = {"permission": "Check file permissions", "missing": "File may have been deleted", "space": "Destination disk is full", "io": "Check disk health"}
_ADVICE = {
    "permission": f"{_FIRST['permission']}: the executors' user must be able to read the source and to write the target",
    "missing": f"{_FIRST['missing']} or moved since the scan, or its mount is gone on this executor",
    "space": f"{_FIRST['space']}: make room there, or copy to another folder",
    "io": f"{_FIRST['io']}, and the mount if it is a share",
}


def kind_of(error: str | Exception) -> str | None:
    said = str(error)
    if isinstance(error, PermissionError) or "Permission denied" in said:
        return "permission"
    if isinstance(error, FileNotFoundError) or "No such file" in said:
        return "missing"
    if isinstance(error, OSError):
        return "space" if error.errno == errno.ENOSPC or f"Errno {errno.ENOSPC}" in said else "io"
    return None


def error_message(path: str, error: str | Exception) -> str:
    name = type(error).__name__ if isinstance(error, Exception) else "Error"
    advice = _ADVICE.get(kind_of(error) or "")
    return f"Error processing {path!r}: [{name}] {error}" + (f"\n  Suggestions: {advice}" if advice else "")
