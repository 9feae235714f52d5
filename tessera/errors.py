"""What goes wrong, as one error with a code; two kinds that callers tell apart have a class."""

from __future__ import annotations

CODES = ("fetch", "timeout", "blocked", "quality", "content", "index", "session", "ingest", "format", "dependency", "config", "request")


class TesseraError(Exception):
    """code is one of CODES; details say more, by name."""

    code = "index"

    def __init__(self, message: str, code: str | None = None, **details):
        super().__init__(message)
        self.code, self.details = code or self.code, details

    def to_dict(self) -> dict:
        return {"error": str(self), "code": self.code, **self.details}


class SessionNotFound(TesseraError):
    code = "session"

    def __init__(self, session: str):
        super().__init__(f"there is no session {session!r}", session=session)


class BadRequest(TesseraError):
    code = "request"
