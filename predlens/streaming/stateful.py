"""Monitors that remember a key across micro-batches: severities that change, and content that was seen."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _by_state(stream: DataFrame, key: str, time: str, late: str, function, output: str, state: str) -> DataFrame:
    """The function gets times as microseconds in _us and gives them so, as pandas has no timestamps after 2262. The watermark and
    timeouts go by a clock a thousand times slower, _clock, on which any time fits; so they are whole seconds of the true times."""
    rows = stream.withColumn("_us", F.unix_micros(F.col(time).cast("timestamp"))).drop(time)
    rows = rows.withColumn("_clock", F.timestamp_micros(F.expr("(_us - pmod(_us, 1000)) div 1000")))
    rows = rows.withWatermark("_clock", f"{math.ceil(pd.Timedelta(late).total_seconds())} milliseconds")
    out = rows.groupBy(key).applyInPandasWithState(function, output, state, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("_us", F.timestamp_micros("_us")).withColumnRenamed("_us", time)


def _micros(length: str) -> int:
    return int(pd.Timedelta(length).total_seconds() * 1_000_000)


def _time_out(state: GroupState, us: int) -> None:
    """When the watermark has passed this time."""
    state.setTimeoutTimestamp(max(-(-us // 1_000_000), state.getCurrentWatermarkMs() + 1))


def severity_changes(reports: DataFrame, key: str, time: str = "ts", severity: str = "severity", late: str = "1 day", forget: str = "400 days", calm: str = "OK") -> DataFrame:
    """key, time, previous and severity of each report whose severity is not that of the report before it; before its first report a key is
    calm, so a calm first report is no change.

    The last report of a key is kept until the watermark has passed its time by forget; after that the key is calm again. Reports of a
    key come in the order of their times: what a micro-batch holds is sorted, and a report that is older than the last one
    is left out, as it is no news. Reports without a key or time go, and those that come after the watermark are dropped by the engine.
    """
    keep = _micros(forget)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, at = state.get if state.exists else (calm, -(2**62))
        out = []
        for us, now in sorted((r for b in batches for r in zip(b["_us"].tolist(), b[severity], strict=True) if pd.notna(r[1])), key=lambda r: (r[0], r[1])):
            if us < at:
                continue
            if now != last:
                out.append((k[0], us, last, now))
            last, at = now, us
        if at > -(2**62):
            state.update((last, at))
            _time_out(state, at + keep)
        if out:
            yield pd.DataFrame(out, columns=[key, "_us", "previous", severity])

    rows = reports.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time, severity)
    kind = rows.schema[key].dataType.simpleString()
    return _by_state(rows, key, time, late, step, f"`{key}` {kind}, _us long, previous string, `{severity}` string", "last string, at long")


def unseen_content(stream: DataFrame, digest: str = "md5", name: str = "path", time: str = "ts", live: str = "7 days", late: str = "1 day") -> DataFrame:
    """digest, name and time of each row whose content was not seen within the time to live before it.

    A content's last time is kept, and forgotten when the watermark has passed it by the time to live, so the state holds what was seen
    lately and no more. Of rows of one micro-batch with equal times the first by name counts. Rows without digest or time go, and those that come after
    the watermark are dropped by the engine.
    """
    keep = _micros(live)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, out = state.get[0] if state.exists else None, []
        for us, who in sorted((r for b in batches for r in zip(b["_us"].tolist(), b[name], strict=True)), key=lambda r: (r[0], str(r[1]))):
            if last is None or us - last >= keep:
                out.append((k[0], who, us))
            last = us if last is None else max(last, us)
        state.update((last,))
        _time_out(state, last + keep)
        if out:
            yield pd.DataFrame(out, columns=[digest, name, "_us"])

    rows = stream.where(F.col(digest).isNotNull() & F.col(time).isNotNull()).select(digest, name, time)
    kind = rows.schema[name].dataType.simpleString()
    return _by_state(rows, digest, time, late, step, f"`{digest}` string, `{name}` {kind}, _us long", "at long")
