"""A cap on requests in flight, shared by all processes of a host.

Python workers are processes of their own, so the cap is a set of lock files;
the kernel frees a lock when its holder dies.
"""

from __future__ import annotations

import fcntl
import os
import random
import tempfile
import time
from collections.abc import Iterator
from contextlib import contextmanager

SLOTS = 8


def _folder() -> str:
    path = os.path.join(tempfile.gettempdir(), f"assay-slots-{os.getuid()}")
    os.makedirs(path, mode=0o700, exist_ok=True)
    return path


@contextmanager
def slot(deadline: float) -> Iterator[None]:
    """Hold one of the slots; TimeoutError if none gets free before ``deadline`` (monotonic seconds)."""
    folder, order = _folder(), random.sample(range(SLOTS), SLOTS)
    held = None
    while held is None:
        for k in order:
            fd = os.open(os.path.join(folder, str(k)), os.O_CREAT | os.O_RDWR, 0o600)
            try:
                fcntl.flock(fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
                held = fd
                break
            except OSError:
                os.close(fd)
        else:
            if time.monotonic() >= deadline:
                raise TimeoutError
            time.sleep(0.002 + random.random() * 0.004)
    try:
        yield
    finally:
        os.close(held)
