"""What a capture program needs to feed tail.py: device lists, file names, and a writer that rolls segments."""

from __future__ import annotations

import datetime
import os
import re
import time

FLUSH_S = 0.5


def devices(listing: str) -> list[str]:
    """Serial numbers of a debugging bridge's device list; only those whose state is ``device``."""
    rows = (line.split() for line in listing.splitlines())
    return [r[0] for r in rows if len(r) > 1 and r[1] == "device"]


def safe_name(serial: str) -> str:
    return re.sub(r"[^0-9A-Za-z._-]", "_", serial)


def stamp(seconds: float) -> str:
    """A UTC time with milliseconds for file names."""
    at = datetime.datetime.fromtimestamp(seconds, datetime.timezone.utc)
    return at.strftime("%Y%m%d_%H%M%S_") + f"{at.microsecond // 1000:03d}"


class SegmentWriter:
    """Lines into a folder of segments. A segment appears whole, by a rename, and ends at a line's end; what has none yet waits."""

    def __init__(self, folder: str, flush_s: float = FLUSH_S):
        os.makedirs(folder, exist_ok=True)
        self.folder, self.flush_s, self.held, self.number = folder, flush_s, b"", len([n for n in os.listdir(folder) if n.startswith("part-")])
        self.last = time.monotonic()

    def write(self, data: bytes) -> None:
        self.held += data
        if time.monotonic() - self.last >= self.flush_s:
            self.flush()

    def flush(self, rest: bool = False) -> None:
        """Rolls a segment; rest: with an unfinished last line too, as when the capture ends."""
        cut = len(self.held) if rest else self.held.rfind(b"\n") + 1
        self.last = time.monotonic()
        if not cut:
            return
        path = os.path.join(self.folder, f"part-{self.number:09d}.log")
        with open(f"{self.folder}/.{self.number}.tmp", "wb") as f:
            f.write(self.held[:cut])
            f.flush()
            os.fsync(f.fileno())
        os.rename(f"{self.folder}/.{self.number}.tmp", path)
        self.held, self.number = self.held[cut:], self.number + 1

    def close(self) -> None:
        self.flush(rest=True)
