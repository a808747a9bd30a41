"""Errors that keep the id of what went wrong first, however often they are raised again."""

from __future__ import annotations

import logging
import uuid

log = logging.getLogger("chunkvault")


class ChunkvaultError(RuntimeError):
    """An error of the engine: root is the id of the first one of its chain."""

    def __init__(self, message: str, cause: BaseException | None = None, level: int = logging.ERROR, **context: object):
        super().__init__(message)
        self.root = cause.root if isinstance(cause, ChunkvaultError) else uuid.uuid4()
        self.message, self.context, self.__cause__ = message, context, cause
        told = " ".join(f"{k}={v!r}" for k, v in context.items())
        # A traceback is worth its length for errors only.
        log.log(level, "%s root=%s %s", message, self.root, told, exc_info=cause if cause is not None and level >= logging.ERROR else None, stack_info=cause is None and level >= logging.ERROR)


class ReadOnlyError(ChunkvaultError):
    """Snapshots can't be written to."""


class NotFoundError(ChunkvaultError):
    """What was asked for is in none of its places."""


class InvalidManifestError(ChunkvaultError):
    """A manifest that doesn't decode to what it says."""


class LockedError(ChunkvaultError):
    """A lock that a replica doesn't give, or a refresh while one is held."""
