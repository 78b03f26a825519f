"""State of our own: late rows beside daily counts, and dry spells, with event-time timers that end their state.

Late rows must be seen, so the event time goes into these operators as a plain number of milliseconds, and each
compares it with the watermark itself. What a timer closes leaves the state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _closed(days: pd.Series, watermark: int) -> pd.Series:
    """Which days have ended by the watermark."""
    return (days + 1) * DAY_MS <= watermark


class DailyCounts(StatefulProcessor):
    """Counts of each key's open days; a day is told once the watermark passes its end, and rows that come later are told as late."""

    def __init__(self, keys: Sequence[str]):
        self.keys = list(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day long", "n long")

    def _frame(self, key: tuple, kind: str, ids, days, n) -> pd.DataFrame:
        out = pd.DataFrame({"kind": kind, "id": ids, "day": days, "n": n})
        for name, value in zip(self.keys, key):
            out[name] = value
        return out[[*self.keys, "kind", "id", "day", "n"]].astype({"id": "Int64", "day": "int64", "n": "int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, counts = timerValues.getCurrentWatermarkInMs(), pd.Series(dtype="int64")
        for pdf in rows:
            pdf = pdf[pdf["ms"].notna()]
            day = pdf["ms"].astype("int64") // DAY_MS
            late = _closed(day, mark)
            if late.any():
                yield self._frame(key, "late", pdf["id"][late].tolist(), day[late].tolist(), 1)
            counts = counts.add(day[~late].value_counts(), fill_value=0)
        for day, n in counts.astype("int64").items():
            before = self.days.getValue((day,)) if self.days.containsKey((day,)) else (0,)
            self.days.updateValue((day,), (before[0] + n,))
            self.handle.registerTimer((day + 1) * DAY_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 1
        if self.days.containsKey((day,)):
            (n,) = self.days.getValue((day,))
            self.days.removeKey((day,))
            yield self._frame(key, "day", [None], [day], n)

    def close(self) -> None:
        pass


def daily_counts_and_late(stream: DataFrame, keys: Sequence[str], id_col: str, time: str = "ts", salt: int = 8) -> DataFrame:
    """``(…keys, kind, id, day, n)``: a row of kind ``day`` with the count of each day that the watermark has closed, in parts, and one of kind ``late`` for each row that came after.

    ``stream`` carries a watermark on ``time``. A key's rows are dealt over ``salt`` parts, so that no key is one task; add the counts up.
    """
    # keys as one text without nulls, which pandas would turn into numbers
    told = F.to_json(F.struct(*keys)).alias("__keys")
    rows = stream.select(told, F.pmod(F.xxhash64(id_col), F.lit(salt)).alias("__salt"), F.col(id_col).cast("long").alias("id"), F.unix_millis(time).alias("ms"))
    found = rows.groupBy("__keys", "__salt").transformWithStateInPandas(DailyCounts(["__keys", "__salt"]), "__keys string, __salt long, kind string, id long, day long, n long", "Append", "EventTime")
    kinds = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in keys)
    return found.withColumn("__keys", F.from_json("__keys", kinds)).select("__keys.*", "kind", "id", "day", "n")


class DrySpells(StatefulProcessor):
    """The current run of dry days of a key. Days wait until the watermark has passed their end, so order within it doesn't matter.

    A key's open days and its run are one value, and it has one timer: at the end of its first open day, or of its run. What
    the watermark has closed by then is told at once, so calls to the store grow with keys and watermarks, not with days.
    """

    def __init__(self, key: str, below: float, keep_days: int):
        self.key, self.below, self.keep_days = key, below, keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "days array<long>, sums array<double>, last long, length int")

    def _rows(self, key: tuple, kind: str, days: list[int], lengths: list[int]) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(days), "kind": kind, "last_day": pd.array(days, "int32"), "length": pd.array(lengths, "int32")})

    def _get(self) -> tuple[dict[int, float], int | None, int]:
        days, sums, last, length = self.held.get() or ((), (), None, 0)
        return dict(zip(days, sums)), last, length

    def _ends(self, last: int) -> int:
        return (last + 1 + self.keep_days) * DAY_MS

    def _due(self, open_days: dict[int, float], last: int | None) -> int | None:
        """When the key's timer is due: never if it holds nothing."""
        return min([*([(min(open_days) + 1) * DAY_MS] if open_days else []), *([] if last is None else [self._ends(last)])], default=None)

    def _put(self, open_days: dict[int, float], last: int | None, length: int, before: int | None) -> None:
        due = self._due(open_days, last)
        if due is None:
            self.held.clear()
            return
        self.held.update((list(open_days), list(open_days.values()), last, length))
        if before is None or due < before:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, sums = timerValues.getCurrentWatermarkInMs(), {}
        for pdf in rows:
            for day, v in pdf.dropna().groupby("day")["v"].sum().items():
                sums[int(day)] = sums.get(int(day), 0.0) + float(v)
        late = [day for day in sums if (day + 1) * DAY_MS <= mark]
        if late:
            yield self._rows(key, "late", late, [0] * len(late))
        if len(late) < len(sums):
            open_days, last, length = self._get()
            before = self._due(open_days, last)
            for day in sums.keys() - set(late):
                open_days[day] = open_days.get(day, 0.0) + sums[day]
            self._put(open_days, last, length, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        open_days, last, length = self._get()
        before = self._due(open_days, last)
        if before is None or before > mark:  # a timer that an earlier one has overtaken
            return
        closed, lengths = sorted(day for day in open_days if (day + 1) * DAY_MS <= mark), []
        for day in closed:
            length = (length + 1 if last == day - 1 else 1) if open_days.pop(day) < self.below else 0
            last = day
            lengths.append(length)
        if mark >= self._ends(last):
            last, length = None, 0
        self._put(open_days, last, length, None)
        if closed:
            yield self._rows(key, "run", closed, lengths)

    def close(self) -> None:
        pass


def dry_spells(stream: DataFrame, key: str, value: str, below: float, time: str = "ts", keep_days: int = 1) -> DataFrame:
    """``(key, kind, last_day, length)``: a row of kind ``run`` for each day that the watermark closes, with the days under the limit in a row up to it, and one of kind ``late`` for a day that came after.

    A day's values are added up, in whatever order they come within the watermark. A day without
    values ends a run, so a key's state goes once ``keep_days`` days without values have passed.
    """
    rows = stream.select(F.col(key).cast("long").alias(key), F.floor(F.unix_millis(time) / DAY_MS).cast("long").alias("day"), F.col(value).cast("double").alias("v"))
    return rows.groupBy(key).transformWithStateInPandas(DrySpells(key, below, keep_days), f"{key} long, kind string, last_day int, length int", "Append", "EventTime")
