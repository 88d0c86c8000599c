"""What a Python worker keeps from one task to the next: one thing at a time.

Workers are reused, also by other operators. Who begins with something else
drops what was kept before, so caches never add up in a worker.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_slot: list[tuple[str, Any]] = []


def keep(name: str, make: Callable[[], Any]) -> Any:
    """The kept thing of this name, made if another one is kept."""
    if not _slot or _slot[0][0] != name:
        _slot.clear()
        _slot.append((name, make()))
    return _slot[0][1]


def forget() -> None:
    _slot.clear()
