"""One writer at a time: a lock file on the driver's disk beside the store's configuration."""

from __future__ import annotations

import contextlib
import fcntl
import os
import time
from collections.abc import Iterator

from .errors import Busy

#: Seconds to wait for a writer.
TIMEOUT = 1.0


@contextlib.contextmanager
def writer(path: str, timeout: float = TIMEOUT) -> Iterator[None]:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "a") as f:
        until = time.monotonic() + timeout
        while True:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                if time.monotonic() >= until:
                    raise Busy(f"{path} is locked by another run") from None
                time.sleep(0.05)
        yield  # closing the file lets go of the lock
