"""Results that are kept for a while."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame


class ResultCache:
    """Persisted results by (query, first, last); each use puts off the end by `ttl` seconds."""

    def __init__(self, ttl: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock = ttl, clock
        self._kept: dict[tuple, tuple[float, DataFrame]] = {}

    def get(self, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        self.sweep()
        _, df = self._kept.get(key) or (0.0, make().persist())
        self._kept[key] = (self.clock(), df)
        return df

    def sweep(self) -> int:
        now = self.clock()
        old = [k for k, (t, _) in self._kept.items() if now - t > self.ttl]
        for k in old:
            self._kept.pop(k)[1].unpersist()
        return len(old)
