"""Overlapping windows of samples as chunks arrive: what is held of a recording is at most two windows and the chunks that came too early."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cadenza.operators.pcm import BYTES, RATE
from cadenza.streaming.joblog import with_state_store

WINDOWS = "rec long, k long, offset double, duration double, is_final boolean, body binary"


class Cutter(StatefulProcessor):
    """Chunks (rec, seq, body, last) to windows; the one after which nothing new came is known to be the final one when the last chunk has come.

    The newest full window is held back, as it may be the final one. State: the next chunk's number, the bytes from the held window's
    start on, how many windows there were, and whether one is held.
    """

    def __init__(self, size: int, step: int, rate: int):
        self.size, self.step, self.rate = size * BYTES, step * BYTES, rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "next long, held binary, count long, full boolean, closed boolean")
        self.early = handle.getMapState("early", "seq long", "body binary, last boolean")

    def _window(self, rec: int, k: int, body: bytes, final: bool) -> Row:
        return Row(rec=rec, k=k, offset=k * self.step / BYTES / self.rate, duration=len(body) / BYTES / self.rate, is_final=final, body=body)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        due, held, count, full, closed = self.now.get() if self.now.exists() else (0, b"", 0, False, False)
        for row in rows:
            if not closed and row.seq >= due:
                self.early.updateValue((row.seq,), (bytes(row.body or b""), bool(row.last)))
        held = bytearray(held)
        while not closed and self.early.containsKey((due,)):
            body, closed = self.early.getValue((due,))
            self.early.removeKey((due,))
            held += body
            due += 1
            at = 0  # of the held window, or of the next one to be filled
            while len(held) - at >= (self.step if full else 0) + self.size:
                if full:
                    yield self._window(key[0], count - 1, bytes(held[at : at + self.size]), False)
                    at += self.step
                full, count = True, count + 1
            del held[:at]
        if closed:
            if len(held) % BYTES:
                raise ValueError("the last sample is cut")
            if full:
                tail = bytes(held[self.step :])
                more = len(held) > self.size
                yield self._window(key[0], count - 1, bytes(held[: self.size]), not more)
                if more:
                    yield self._window(key[0], count, tail, True)
            elif held:
                yield self._window(key[0], 0, bytes(held), True)
            held = b""
            self.early.clear()
        self.now.update((due, bytes(held), count, full, closed))

    def close(self) -> None:
        pass


def windows(chunks: DataFrame, window: float, overlap: float, rate: int = RATE) -> DataFrame:
    """A stream of chunks (rec, seq from 0, body, last) to windows (rec, k, offset, duration, is_final, body); a chunk that comes again is dropped."""
    size = max(1, round(window * rate))
    step = size - round(overlap * rate)
    if not (window > 0 and 0 <= overlap < window and rate > 0 and step > 0):
        raise ValueError("the overlap must be shorter than the window")
    rows = with_state_store(chunks).select("rec", "seq", "body", "last")
    return rows.groupBy("rec").transformWithState(Cutter(size, step, rate), WINDOWS, "Append", "None")
