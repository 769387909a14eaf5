"""State that takes the rows of a key in event-time order, however they arrive within the lateness.

Rows wait in the key's state until the watermark has passed them, so a late row still takes its place, and the same rules
as in batch apply to the same order. A rule may ask for rows to wait longer, until what follows them is settled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType, TimestampType, _parse_datatype_string

from harborlight.streaming.stateful import FORGET_S

#: Columns that may be null keep their kind through pandas.
KINDS = {"bigint": "Int64", "int": "Int32", "double": "Float64", "boolean": "boolean", "string": "object"}


def plain_rows(frame: pd.DataFrame, names: list[str], types: list) -> list[tuple]:
    """Rows of a frame as tuples of plain values, None where missing."""
    columns = []
    for name, kind in zip(names, types):
        cast = int if isinstance(kind, (LongType, IntegerType)) else float if isinstance(kind, DoubleType) else None
        missing, values = frame[name].isna().tolist(), frame[name].tolist()
        columns.append([None if m else cast(v) if cast else v for m, v in zip(missing, values)])
    return list(zip(*columns))


def to_frame(rows: list[tuple], schema: StructType) -> pd.DataFrame:
    """Rows of plain values as a frame; times are epoch seconds."""
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    out = {}
    for field, values in zip(schema, columns):
        if isinstance(field.dataType, TimestampType):
            out[field.name] = pd.to_datetime(pd.Series(values, dtype="int64"), unit="s")
        else:
            out[field.name] = pd.Series(list(values), dtype=KINDS.get(field.dataType.simpleString(), "object"))
    return pd.DataFrame(out)


class Ordered(StatefulProcessor):
    """Calls step() for each row in the order (t_s, row_id), and rank where rows have one.

    `memory` is a struct of the key whose first field is the time of its newest row. A row comes out `settled_s` seconds of
    event time after its own time; `event_time` of what it gives is that moment, so that rows stay in order further on.
    A key without rows for `forget_s` is forgotten.
    """

    def __init__(self, columns: StructType, memory: str, output: StructType, settled_s: int = 0, forget_s: int = FORGET_S):
        self.columns, self.memory_schema, self.output = columns, _parse_datatype_string(memory), output
        self.settled_s, self.forget_s = settled_s, forget_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.columns)
        self.memory = handle.getValueState("memory", self.memory_schema)
        self.time = self.columns.names.index("t_s")
        self.order = [self.columns.names.index(c) for c in ("t_s", "row_id", "rank") if c in self.columns.names]

    def step(self, key: tuple, memory: tuple | None, row: tuple, following: tuple | None) -> tuple[tuple, list[tuple]]:
        """The memory after a row, and what the row gives; `following` is the key's next row if it is there already."""
        raise NotImplementedError

    def _due(self, row: tuple) -> int:
        # A second more: event times may have fractions that t_s has not.
        return row[self.time] + self.settled_s + 1

    def _wake(self, at_s: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at_s * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, types = self.columns.names, [f.dataType for f in self.columns]
        new = [r for frame in rows for r in plain_rows(frame, names, types)]
        self.waiting.appendList(new)
        self._wake(min([min(map(self._due, new)), *(t // 1000 for t in self.handle.listTimers())]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // 1000
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        rows.sort(key=lambda r: [r[i] for i in self.order])
        count = sum(self._due(r) <= now for r in rows)
        memory, out = tuple(self.memory.get()) if self.memory.exists() else None, []
        for i in range(count):
            if memory is not None and rows[i][self.time] - memory[0] >= self.forget_s:
                memory = None
            memory, given = self.step(key, memory, rows[i], rows[i + 1] if i + 1 < len(rows) else None)
            out.extend((*g, self._due(rows[i])) for g in given)
        if count:
            self.memory.update(memory)
            if count < len(rows):
                self.waiting.put(rows[count:])
            else:
                self.waiting.clear()
        if count < len(rows):
            self._wake(self._due(rows[count]))
        elif memory is not None and memory[0] + self.forget_s > now:
            self._wake(memory[0] + self.forget_s)
        else:
            self.memory.clear()
        if out:
            yield to_frame(out, self.output)

    def close(self) -> None:
        pass


def in_order(
    rows: DataFrame, processor: type[Ordered], memory: str, output: str | StructType, keys: tuple[str, ...] = ("mmsi",),
    settled_s: int = 0, forget_s: int = FORGET_S, **limits,
) -> DataFrame:
    """`processor` over rows with event_time and a watermark. `output` names its columns; event_time is added last."""
    given = rows.drop("event_time").schema
    output = output if isinstance(output, StructType) else _parse_datatype_string(output)
    output = StructType([*output.fields, *_parse_datatype_string("event_time timestamp").fields])
    # Keys go along in the rows; the grouping has copies of its own.
    grouped = rows.withColumns({f"_key_{k}": F.col(k) for k in keys}).groupBy(*[f"_key_{k}" for k in keys])
    return grouped.transformWithStateInPandas(
        statefulProcessor=processor(given, memory, output, settled_s, forget_s, **limits),
        outputStructType=output, outputMode="Append", timeMode="EventTime", eventTimeColumnName="event_time",
    )
