"""Archival in the background: values older than an age move from one store to another, time and again."""

from __future__ import annotations

import re
import threading
import time as clock

from ..store import Store


def duration_ms(text: str) -> int:
    """Milliseconds of an ISO 8601 duration in days and smaller units (P7D, PT1H30M, P1DT0.5S) or in weeks (P2W)."""
    m = re.fullmatch(r"P(?=.)(?:(\d+)W|(?:(\d+)D)?(?:T(?=\d)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?)", text)
    if not m:
        raise ValueError(f"no duration: {text!r}")
    return round(sum(float(x or 0) * ms for x, ms in zip(m.groups(), (7 * 86_400_000, 86_400_000, 3_600_000, 60_000, 1000), strict=True)))


class Archival:
    """Moves values older than age, waits for delay after each move (ISO durations), until it is stopped.

    A move that fails is tried again after the delay, as moving again does no harm; error holds the last failure.
    """

    def __init__(self, hot: Store, cold: Store, age: str, delay: str):
        self.hot, self.cold, self.age, self.delay = hot, cold, duration_ms(age), duration_ms(delay) / 1000
        self.moved, self.rounds, self.error = 0, 0, None
        self._stop, self._thread = threading.Event(), threading.Thread(target=self._run, daemon=True)

    def once(self, now: int | None = None) -> int:
        """One move; how many values went."""
        return self.hot.archive_to(self.cold, (int(clock.time() * 1000) if now is None else now) - self.age)

    def _run(self) -> None:
        while not self._stop.is_set():
            try:
                self.moved += self.once()
                self.error = None
            except Exception as e:  # noqa: BLE001
                self.error = e
            self.rounds += 1
            self._stop.wait(self.delay)

    def start(self) -> Archival:
        self._thread.start()
        return self

    def stop(self) -> None:
        """Returns when a move at hand is done."""
        self._stop.set()
        self._thread.join()
