"""Following files that grow: whole lines by byte offset, and the watcher's rules around it."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass
class ByteTail:
    """The new whole lines of a file since the last reading, by offset; state is small and can be kept between runs.

    A line that is not ended yet stays for the next reading, so one that is cut inside a character is never split. A file
    that was replaced (another inode), cut, or written anew at the same size (another beginning) is read from its start;
    ``resets`` counts that.
    """

    path: str
    offset: int = 0
    inode: int = -1
    head: bytes = b""
    resets: int = 0

    def read(self, most: int = 1 << 24) -> list[str]:
        """Whole lines, at most about ``most`` bytes of them at once; the rest comes with the next reading. A missing file has none."""
        try:
            f = open(self.path, "rb")
        except FileNotFoundError:
            return []
        with f:
            stat = os.fstat(f.fileno())
            start = f.read(min(256, max(self.offset, 1)))
            if self.inode >= 0 and (stat.st_ino != self.inode or stat.st_size < self.offset or start[: len(self.head)] != self.head[: len(start)] or len(start) < len(self.head)):
                self.offset, self.head, self.resets = 0, b"", self.resets + 1
            self.inode = stat.st_ino
            f.seek(self.offset)
            data = f.read(most)
            while data and b"\n" not in data and len(data) % most == 0 and (more := f.read(most)):
                data += more  # one line longer than a reading
            end = data.rfind(b"\n") + 1
            self.offset += end
            f.seek(0)
            self.head = f.read(min(256, self.offset))
        return [x.decode("utf-8", "replace") for x in data[:end].split(b"\n")[:-1]]


@dataclass
class Backoff:
    """How long to wait before the next try: doubling from ``first`` to ``most`` seconds; a time that the other side names is kept up to ``named`` seconds, and after ``tries`` of those it is given up."""

    first: float = 1.0
    most: float = 60.0
    named: float = 15.0
    tries: int = 2
    failed: int = 0
    limited: int = 0

    def after_failure(self) -> float:
        self.failed += 1
        return min(self.most, self.first * 2 ** (self.failed - 1))

    def after_limit(self, retry_after: float) -> float | None:
        """Seconds to wait, or None where it is to be given up."""
        self.limited += 1
        return None if self.limited > self.tries or retry_after > self.named else retry_after

    def success(self) -> None:
        self.failed = self.limited = 0


class SingleFlight:
    """At most one run at a time; what comes meanwhile is remembered as one more run."""

    def __init__(self, run) -> None:
        self.run, self.busy, self.dirty, self.runs = run, False, False, 0

    def poke(self) -> None:
        if self.busy:
            self.dirty = True
            return
        self.busy = True
        try:
            while True:
                self.dirty = False
                self.runs += 1
                self.run()
                if not self.dirty:
                    return
        finally:
            self.busy = False
