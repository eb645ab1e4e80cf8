"""A bounded cache of immutable objects (what an epoch holds), with counters. Manifests and the log are never cached."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Counters:
    hits: int = 0
    misses: int = 0
    evictions: int = 0

    @property
    def hit_rate(self) -> float:
        asked = self.hits + self.misses
        return self.hits / asked if asked else 0.0

    def since(self, before: Counters) -> Counters:
        return Counters(self.hits - before.hits, self.misses - before.misses, self.evictions - before.evictions)


class Cache:
    """The least recently used objects go when their bytes exceed ``capacity``; one larger than that is not kept."""

    def __init__(self, capacity: int = 64 << 20):
        self.capacity, self.size, self.counters = capacity, 0, Counters()
        self._kept: OrderedDict = OrderedDict()
        self._lock = threading.Lock()

    def get(self, key: object, load: Callable[[], bytes]) -> bytes:
        with self._lock:
            if key in self._kept:
                self._kept.move_to_end(key)
                self.counters = replace(self.counters, hits=self.counters.hits + 1)
                return self._kept[key]
            self.counters = replace(self.counters, misses=self.counters.misses + 1)
        body = load()
        with self._lock:
            if key not in self._kept and len(body) <= self.capacity:
                self._kept[key] = body
                self.size += len(body)
                while self.size > self.capacity:
                    _, old = self._kept.popitem(last=False)
                    self.size -= len(old)
                    self.counters = replace(self.counters, evictions=self.counters.evictions + 1)
        return body
