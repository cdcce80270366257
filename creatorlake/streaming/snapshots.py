"""View snapshots as a stream: what is kept of each video, and first sightings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEPT = 64


def last_snapshots(stream: DataFrame, kept: int = KEPT) -> DataFrame:
    """(video_id, at, views) for each new snapshot that enters a video's list.

    A video's state is its last `kept` snapshots in time order, so it stays small. A snapshot that repeats the one
    before it, or is older than all of a full list, is left out; a late one takes its place in time.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        entered = []
        for batch in batches:
            for at, views in sorted(zip(batch["at"].astype("int64"), batch["views"], strict=True)):
                before = [h for h in held if h[0] <= at]
                if before and (before[-1][1] == views or before[-1][0] == at) or len(held) == kept and not before:
                    continue
                held = sorted([*held, (int(at), int(views))])[-kept:]
                entered.append((int(at), int(views)))
        if held:
            state.update(([h[0] for h in held], [h[1] for h in held]))
        yield pd.DataFrame({"video_id": [key[0]] * len(entered), "at": [e[0] for e in entered], "views": [e[1] for e in entered]})

    rows = stream.selectExpr("video_id", "unix_micros(at) AS at", "views").filter("video_id IS NOT NULL AND at IS NOT NULL AND views IS NOT NULL")
    return rows.groupBy("video_id").applyInPandasWithState(update, "video_id string, at long, views long", "at array<long>, views array<long>", "append", GroupStateTimeout.NoTimeout)


def first_sightings(stream: DataFrame, ident: str, at: str, late: str = "36 hours") -> DataFrame:
    """Each ident once, as long as it comes again within `late`; older state is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([ident])
