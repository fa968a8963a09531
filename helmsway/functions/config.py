"""Parameters of a run, checked when they are set."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

POLICIES = ("drop-oldest", "drop-newest", "block")
MOST_CAPACITY = 65_535


def drive_date(drive: str) -> str:
    """The date folder of a drive, the first ten characters of its name; ValueError for other names."""
    if not re.match(r"^\d{4}_\d{2}_\d{2}_.", drive):
        raise ValueError(f"{drive!r} doesn't begin with a date like 2011_09_26_")
    return drive[:10]


def viewer_host(host: str) -> str:
    """A bare host name or address; ValueError for a URL, a port or nothing."""
    h = host.strip()
    if not h or "/" in h or (h.count(":") == 1 and not h.startswith("[")):
        raise ValueError(f"{host!r} isn't a bare host")
    return h


@dataclass(frozen=True)
class RunConfig:
    """What a run depends on. A rate of None or infinity is unpaced; waits of 0 never wait."""

    drive: str
    voxel_m: float = 0.2
    capacity: int = 4
    policy: str = "drop-oldest"
    rate: float | None = 1.0
    pair_wait_ns: int | None = None
    stale_ns: int = 0

    def __post_init__(self) -> None:
        drive_date(self.drive)
        if not (math.isfinite(self.voxel_m) and self.voxel_m > 0):
            raise ValueError("the voxel edge must be finite and above 0")
        if not 1 <= self.capacity <= MOST_CAPACITY:
            raise ValueError(f"the capacity must be from 1 to {MOST_CAPACITY}")
        if self.policy not in POLICIES:
            raise ValueError(f"the policy must be one of {', '.join(POLICIES)}")
        if self.rate is not None and not self.rate > 0:
            raise ValueError("the rate must be above 0")
        if self.stale_ns < 0 or (self.pair_wait_ns or 0) < 0:
            raise ValueError("waits can't be negative")

    @property
    def paced(self) -> bool:
        return self.rate is not None and math.isfinite(self.rate)
