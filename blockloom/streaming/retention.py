"""Retention that follows another service: what it already serves needn't be kept here."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from blockloom.sources.store import Manifest, Store


@dataclass
class Follower:
    """``status`` says from when its heights hold, and the height per dataset; after ``delay`` seconds they are applied once."""

    stores: Mapping[str, Store]
    status: Callable[[], tuple[float, Mapping[str, int | None]]]
    now: Callable[[], float]
    delay: float = 0.0
    applied: float | None = None

    def step(self) -> dict[str, Manifest]:
        """The stores that changed; nothing before the delay is over, nothing twice."""
        effective, heights = self.status()
        if effective == self.applied or self.now() < effective + self.delay:
            return {}
        out = {name: store.retain(from_block=heights[name]) for name, store in self.stores.items() if heights.get(name) is not None}
        self.applied = effective
        return out
