"""A stop that all tasks of a job see, and a rate that they share.

The stop is a file in a folder that all executors reach, looked for before every call: once one
task has met a quota, no task begins another call, whichever machine it runs on, and tasks that are
run again see it too. The rate is dealt out: of ``n`` tasks each gets an n-th.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyarrow import fs


@dataclass(frozen=True)
class SharedStop:
    """A stop at ``path``, a file of any file system that pyarrow reads."""

    path: str

    def _at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def reason(self) -> str | None:
        """Why work has stopped; None while it has not."""
        system, path = self._at()
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with system.open_input_stream(path) as f:
            return f.read().decode()

    def set(self, reason: str) -> None:
        """Stop all tasks. The file appears whole; of several reasons one stays."""
        system, path = self._at()
        part = f"{path}.{time.time_ns()}"
        with system.open_output_stream(part) as f:
            f.write(reason.encode())
        system.move(part, path)

    def clear(self) -> None:
        """Let the next run work."""
        system, path = self._at()
        if system.get_file_info(path).type != fs.FileType.NotFound:
            system.delete_file(path)


class Pace:
    """At most so many calls a second in a task, evenly spaced: a token bucket of one."""

    def __init__(self, per_second: float | None, tasks: int, clock: Callable[[], float] = time.monotonic, pause: Callable[[float], None] = time.sleep):
        self.every = tasks / per_second if per_second else 0.0
        self.clock, self.pause, self.next = clock, pause, None

    def wait(self) -> None:
        """Wait for this task's next turn."""
        now = self.clock()
        if self.next is not None and now < self.next:
            self.pause(self.next - now)
            now = self.next
        self.next = now + self.every
