"""Sinks for rendered messages: whatever sends is given, nothing here knows a network."""

from __future__ import annotations

import logging
import logging.handlers
import sys
from collections.abc import Callable

log = logging.getLogger("pulsemill.notify")

Send = Callable[[str], bool]


def fitted(text: str, most: int) -> str:
    """The text, cut to ``most`` characters with dots for what is missing."""
    return text if len(text) <= most else text[: most - 3] + "..."


def safe(send: Send, most: int = 4000) -> Send:
    """``send`` that never raises and never sends more than ``most`` characters."""

    def run(text: str) -> bool:
        try:
            return bool(send(fitted(text, most)))
        except Exception:
            log.exception("a message was not sent")
            return False

    return run


def to_all(sends: list[Send]) -> Send:
    """Sends to each of them, whatever the others do; true if one took it."""
    parts = [safe(s, 10**9) for s in sends]
    return lambda text: any([s(text) for s in parts])


def log_to(path: str, days: int = 30, level: int = logging.INFO) -> list[logging.Handler]:
    """Log lines of the package to the console and to a file that is begun anew each midnight (UTC) and kept for ``days``; calling it again replaces the handlers."""
    root = logging.getLogger("pulsemill")
    for handler in list(root.handlers):
        root.removeHandler(handler)
        handler.close()
    handlers = [logging.StreamHandler(sys.stdout), logging.handlers.TimedRotatingFileHandler(path, when="midnight", backupCount=days, encoding="utf-8", utc=True)]
    for handler in handlers:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)-7s %(name)s: %(message)s"))
        root.addHandler(handler)
    root.setLevel(level)
    return handlers
