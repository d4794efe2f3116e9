"""Errors raised by the public API."""


class MapframeError(Exception):
    """Base class of every error of this package."""


class BadRequest(MapframeError, ValueError):
    """The caller passed something unusable."""


class NotFound(MapframeError, KeyError):
    """No dataset has the requested id."""

    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""
