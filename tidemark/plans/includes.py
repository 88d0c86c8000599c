"""Includes as a set of hops: sorted, without repeats, shared prefixes joined once."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..query import Hop, Include


def canonical(includes: tuple[Include, ...]) -> tuple[Include, ...]:
    """Sorted distinct maximal paths: one that another extends adds nothing."""
    every = sorted(set(includes), key=lambda i: (i.guard, i.hops))
    return tuple(
        a for a in every if not any(b != a and b.guard == a.guard and b.hops[: len(a.hops)] == a.hops for b in every)
    )


@dataclass
class Node:
    """One hop with those below it."""

    hop: Hop
    guard: tuple[str, ...] = ()
    below: dict[tuple[Hop, tuple[str, ...]], Node] = field(default_factory=dict)


def tree(includes: tuple[Include, ...]) -> dict[tuple[Hop, tuple[str, ...]], Node]:
    """Hops by identity: relationship, narrowing and, at the root, guard."""
    top: dict[tuple[Hop, tuple[str, ...]], Node] = {}
    for path in canonical(includes):
        level, guard = top, path.guard
        for hop in path.hops:
            node = level.setdefault((hop, guard), Node(hop, guard))
            level, guard = node.below, ()
    return top


def hops(nodes: dict[tuple[Hop, tuple[str, ...]], Node]) -> int:
    return sum(1 + hops(n.below) for n in nodes.values())


def view_key(hop: Hop) -> str:
    """The name of a loaded view: the relationship, and the subtypes it is narrowed to."""
    return f"{hop[0]}[{','.join(n.rpartition('.')[2] for n in hop[1])}]" if hop[1] else hop[0]
