"""Progress of operators that run in rounds: a callback hears of each round of their loops.

A callback takes (stage, done, total), where total is None for a loop that ends when
nothing changes.  If it returns a true value, the operator ends with ``Cancelled``
before its next round.  It is called by the thread that runs the operator; a plan
that has no rounds reports nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from ..model import Cancelled

Callback = Callable[[str, int, int | None], object]
_listener: ContextVar[Callback | None] = ContextVar("voxstrata_progress", default=None)


@contextmanager
def listening(callback: Callback | None) -> Iterator[None]:
    """Rounds inside are reported to callback, and to no outer one."""
    token = _listener.set(callback)
    try:
        yield
    finally:
        _listener.reset(token)


def report(stage: str, done: int, total: int | None = None) -> None:
    callback = _listener.get()
    if callback is not None and callback(stage, done, total):
        raise Cancelled(stage)
