"""What workers keep between batches: tables that take long to build."""

from __future__ import annotations

import ctypes
import gc
from collections import OrderedDict
from collections.abc import Callable, Hashable

MOST = 1  # tables a worker holds; that of an earlier operator goes first
_held: OrderedDict[Hashable, object] = OrderedDict()


def give_back() -> None:
    """Return freed memory to the system, which the C library may keep otherwise."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def held(key: Hashable, make: Callable[[], object]):
    """The object of this key, made if this worker does not hold it."""
    if key not in _held:
        if len(_held) >= MOST:
            while len(_held) >= MOST:
                _held.popitem(last=False)
            give_back()
        _held[key] = make()
    _held.move_to_end(key)
    return _held[key]
