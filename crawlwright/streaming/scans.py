"""S2 by scan: one alert per site and scan, as soon as the site turns calm, whatever batches the scan arrives in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from crawlwright import constants as K

REJECTS, HOMES = 3, 5
GAP_SECONDS = 1800
ALERT = "site string, scan_start timestamp, rejects long, home_redirects long, first_sign timestamp"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Scan = tuple[int, int, int, int, int, bool]  # start, end, rejects, homes, first sign (-1: none), told


def scans_of(at: np.ndarray, refused: np.ndarray, home: np.ndarray, gap: int) -> list[Scan]:
    """The scans in some rows of a site: rows that are at most ``gap`` apart belong together."""
    order = np.argsort(at, kind="stable")
    at, refused, home = at[order], refused[order], home[order]
    first = np.flatnonzero(np.diff(at, prepend=at[0] - gap - 1) > gap)
    sign = np.where(refused | home, at, np.iinfo(np.int64).max)
    ends = np.append(first[1:], len(at)) - 1
    signs = np.minimum.reduceat(sign, first)
    return [(int(at[a]), int(at[b]), int(r), int(h), -1 if s == np.iinfo(np.int64).max else int(s), False) for a, b, r, h, s in
            zip(first, ends, np.add.reduceat(refused.astype(np.int64), first), np.add.reduceat(home.astype(np.int64), first), signs)]


def joined(scans: list[Scan], gap: int) -> list[Scan]:
    """Scans that touch become one; it has told if one of them has."""
    out: list[Scan] = []
    for scan in sorted(scans):
        if out and scan[0] - out[-1][1] <= gap:
            a = out[-1]
            signs = [s for s in (a[4], scan[4]) if s >= 0]
            out[-1] = (a[0], max(a[1], scan[1]), a[2] + scan[2], a[3] + scan[3], min(signs, default=-1), a[5] or scan[5])
        else:
            out.append(scan)
    return out


class ScanAlerts(StatefulProcessor):
    """Keeps a site's open scans, a few numbers each.  A timer drops a scan once no row can reach it any more."""

    def __init__(self, gap_seconds: int):
        self.gap = gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scans = handle.getListState("scans", "start long, last long, rejects long, homes long, first long, told boolean")

    def _put(self, scans: list[Scan]) -> None:
        if scans:
            self.scans.put(scans)
        else:
            self.scans.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        scans = [tuple(s) for s in self.scans.get()]
        for pdf in rows:
            scans = joined(scans + scans_of(pdf["at"].to_numpy(), pdf["refused"].to_numpy(bool), pdf["home"].to_numpy(bool), self.gap), self.gap)
        due = [s for s in scans if not s[5] and (s[2] >= REJECTS or s[3] >= HOMES)]
        self._put([(*s[:5], s[5] or s in due) for s in scans])
        for s in scans:
            self.handle.registerTimer((s[1] + self.gap) // 1000 + 1)
        if due:
            time = lambda i: pd.to_datetime([s[i] for s in due], unit="us")
            yield pd.DataFrame({"site": [key[0]] * len(due), "scan_start": time(0), "rejects": [s[2] for s in due], "home_redirects": [s[3] for s in due],
                                "first_sign": time(4)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        self._put([s for s in (tuple(s) for s in self.scans.get()) if s[1] + self.gap >= now])
        return iter(())

    def close(self) -> None:
        pass


def scan_alerts(fetches: DataFrame, gap_seconds: int = GAP_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """``(site, scan_start, rejects, home_redirects, first_sign)``, once per scan, in the batch in which three refusals or five
    redirects to the home page are reached; counts are those so far.

    ``fetches``: a stream of site, ts, fetch_code and, if there, challenge.  A scan ends with ``gap_seconds`` without a fetch.  Rows
    may be out of order by ``delay``; scans that late rows join into one keep the alerts that were sent.  Rows without a time
    are left out.  A site's rows of a batch are reduced to scans chunk by chunk, so a task holds one chunk and a few numbers.
    Times are UTC, so set the session's time zone to it.  The state store must be RocksDB (``STORE``).
    """
    code = F.col("fetch_code")
    refused = code == "http_429"  # a plain 403 is a page's own answer, not a refusal of the scan
    if "challenge" in fetches.columns:
        refused = refused | F.coalesce("challenge", F.lit(False))
    rows = fetches.where("ts IS NOT NULL").withWatermark("ts", delay).select(
        "site", "ts", F.unix_micros("ts").alias("at"), F.coalesce(refused, F.lit(False)).alias("refused"), F.coalesce(code == K.FETCH_DELETED_HOME, F.lit(False)).alias("home"))
    return rows.groupBy("site").transformWithStateInPandas(ScanAlerts(gap_seconds), ALERT, "Append", "EventTime")
