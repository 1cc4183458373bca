"""Which stored resolution each new one is summed from."""

from __future__ import annotations

from collections.abc import Iterable

from ..errors import ResolutionError


def zoom_order(existing: Iterable[int], wanted: Iterable[int]) -> list[tuple[int, int]]:
    """Ascending ``(resolution, index of the level it is built from)``.

    The index is -1 for stored levels and for levels no smaller one divides.
    An empty list means the request cannot be met: nothing to add, a
    resolution named twice, or a new level finer than everything stored.
    """
    have, new = list(existing), list(wanted)
    levels = sorted(have + new)
    if not have or not new or len(set(levels)) < len(levels) or levels[0] in new:
        return []
    plan = []
    for at, level in enumerate(levels):
        divisors = [i for i in range(at) if level % levels[i] == 0]
        plan.append((level, divisors[-1] if divisors and level in new else -1))
    return plan


def checked_zoom_plan(existing: Iterable[int], wanted: Iterable[int]) -> list[tuple[int, int]]:
    """``(source resolution, new resolution)`` steps, or an error naming what is wrong."""
    have, new = sorted(existing), sorted(wanted)
    if not new:
        return []
    plan = zoom_order(have, new)
    if not plan:
        raise ResolutionError(f"cannot derive {new} from stored resolutions {have}")
    levels = [r for r, _ in plan]
    steps = [(levels[src], r) for r, src in plan if r in new and src >= 0]
    missing = sorted(set(new) - {r for _, r in steps})
    if missing:
        raise ResolutionError(f"no stored or requested resolution divides {missing}")
    return steps
