"""One-time codes of a stream: a code serves once and not after its expiry, and then leaves the state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTCOME = "owner string, code string, at timestamp, outcome string"
_ROW = Row("owner", "code", "at", "outcome")


class Codes(StatefulProcessor):
    """The valid codes of one owner. Timers stand at the expiries; a code that is issued again is as the newer one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.valid = handle.getMapState("valid", "code string", "expires bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # of equal times codes are issued before they are used
        for r in sorted(rows, key=lambda r: (r.millis, r.type != "issue", r.code or "")):
            known = self.valid.getValue((r.code,))[0] if r.code is not None and self.valid.containsKey((r.code,)) else None
            if r.type == "issue" and r.code is not None and r.expires is not None:
                self.valid.updateValue((r.code,), (r.expires,))
                self.handle.registerTimer(r.expires)
            elif r.type == "use":
                good = known is not None and known > r.millis
                if good:
                    self.valid.removeKey((r.code,))
                yield _ROW(key[0], r.code, r.at, "accepted" if good else "rejected")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        gone = [code for (code,), (expires,) in list(self.valid.iterator()) if expires <= now]
        for code in sorted(gone):
            self.valid.removeKey((code,))
            yield _ROW(key[0], code, None, "expired")

    def close(self) -> None:
        pass


def checked_codes(events: DataFrame) -> DataFrame:
    """(owner, code, at, outcome): each use as accepted or rejected, and each code that expires unused.

    events(owner, type, code, at, expires): type is issue or use; `at` is an event time with a watermark, expires a timestamp of
    issues. A use is accepted once, of a code issued to the owner whose expiry lies after the use. Codes leave the state when they
    are used or the watermark passes their expiry. The session must use completion.PROVIDER."""
    rows = events.select("owner", "type", "code", "at", F.unix_millis("at").alias("millis"), F.unix_millis("expires").alias("expires"))
    return rows.groupBy("owner").transformWithState(Codes(), OUTCOME, "Append", "EventTime")
