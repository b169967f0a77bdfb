"""What a Python worker keeps from task to task: one thing at a time, let go of when another operator's task begins."""

from __future__ import annotations

from collections.abc import Callable, Iterable

HELD: dict[str, object] = {}


def release() -> None:
    """Let go of what an earlier query keeps here: a worker outlives queries, and so would that."""
    HELD.clear()


def keep(name: str, make: Callable[[], object]) -> object:
    """What is kept under ``name``, made by the worker's first task that asks for it."""
    if name not in HELD:
        release()
        HELD[name] = make()
    return HELD[name]


def alone(it: Iterable) -> Iterable:
    """A task's batches, for an operator that keeps nothing."""
    release()
    yield from it
