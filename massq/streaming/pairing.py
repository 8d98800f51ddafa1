"""Pairing of arriving MS2 scans with the MS1 of their run, by keyed state.

The rule is that of ``operators.spectra.correlate``: the named source scan, else the last MS1 before by scan, else
the MS1 earliest in time. Scans of a run arrive in order, cut into batches anywhere. What is known
is given out at once; an MS2 that comes before any MS1 waits in the state for the run's end, a row of level 0.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "run string, scan int, ms1_scan int, method string"
#: MS1 scans so far, by number; the earliest in time; MS2 scans that wait.
STATE = "ms1 array<int>, first_rt double, first_scan int, waiting array<int>"


def _pair(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ms1, first_rt, first_scan, waiting = state.get if state.exists else ([], None, None, [])
    ms1, waiting, found = list(ms1), list(waiting), []
    rows = pd.concat(list(parts))
    ended = bool((rows.ms_level == 0).any())
    for r in rows[rows.ms_level > 0].sort_values("scan").itertuples():
        if r.ms_level == 1:
            insort(ms1, int(r.scan))
            if first_scan is None or (r.rt_min, r.scan) < (first_rt, first_scan):
                first_rt, first_scan = float(r.rt_min), int(r.scan)
        elif r.ms_level == 2:
            at = bisect_left(ms1, int(r.scan))
            source = None if pd.isna(r.source) else int(r.source)
            k = bisect_left(ms1, source) if source is not None else len(ms1)
            if k < len(ms1) and ms1[k] == source:
                found.append((key[0], int(r.scan), source, "source_scan"))
            elif at:
                found.append((key[0], int(r.scan), ms1[at - 1], "scan_order"))
            else:
                waiting.append(int(r.scan))
    if ended:
        found += [(key[0], scan, first_scan, None if first_scan is None else "nearest_rt") for scan in waiting]
        state.remove()
    else:
        state.update((ms1, first_rt, first_scan, waiting))
    out = pd.DataFrame(found, columns=["run", "scan", "ms1_scan", "method"])
    yield out.astype({"ms1_scan": "Int32", "scan": "int32"})


def paired(scans: DataFrame) -> DataFrame:
    """A stream of (run, scan, ms1_scan, method) for a stream of (run, scan, ms_level, rt_min, source).

    A run's state holds its MS1 scan numbers and the few MS2 scans before the first of them, and goes with the run's end.
    """
    return scans.select("run", "scan", "ms_level", "rt_min", "source").groupBy("run").applyInPandasWithState(_pair, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
