"""Log lines that are worth passing on."""

from __future__ import annotations

import logging
from collections.abc import Callable


class LineFilter(logging.Filter):
    """Passes the records whose message meets a condition, such as warnings on cut texts."""

    def __init__(self, wanted: Callable[[str], bool]):
        super().__init__()
        self.wanted = wanted

    def filter(self, record: logging.LogRecord) -> bool:
        return self.wanted(record.getMessage())
