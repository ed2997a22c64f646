"""Objects that a Python worker keeps between tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

_HOME = "_meterlens_worker_objects"


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """The worker's object of this key, made on first use.

    The package travels to the executors by value, so its own modules start anew with each task; a module of the
    worker's process does not.
    """
    home = sys.modules.setdefault(_HOME, types.ModuleType(_HOME)).__dict__.setdefault("objects", {})
    if key not in home:
        home[key] = make()
    return home[key]
