"""A daily budget of requests, kept as the state of a stream: each request is admitted or refused.

The state of a day and a bucket of keys is the number of requests that were admitted of each key; a call for each key would take longer
than its requests. A micro-batch admits the earliest of a key's requests as long as some are left, holding of a bucket's requests little
more than these, and passes all others on as refused. The state goes when the watermark has passed the day's end, and is restored from
the checkpoint when the stream starts again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "key string, day string, request long, admitted boolean, used long"
_DAY_MS = 86_400_000
#: Buckets of a day's keys; a checkpoint keeps to the number it was made with.
BUCKETS = 64
#: Requests that are looked at together, at least.
AT_ONCE = 10_000


class Budget(StatefulProcessor):
    def __init__(self, daily: int):
        self.daily = daily

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "keys array<string>, n array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        day = key[0]
        state = self.used.get() if self.used.exists() else ((), ())
        used = dict(zip(*state))
        held, waiting, n = None, [], 0
        for part in rows:
            waiting.append(part[["key", "at", "request"]])
            n += len(part)
            if n >= max(AT_ONCE, 0 if held is None else len(held)):  # so that what is held is sorted as often as it doubles
                held, over = self._first(held, waiting, used)
                yield over.assign(day=day)
                waiting, n = [], 0
        if held is None and not waiting:
            return
        held, over = self._first(held, waiting, used)
        yield over.assign(day=day)
        counts = held.groupby("key", dropna=False, sort=False)["used"].max()
        used |= {None if pd.isna(k) else k: int(c) for k, c in counts.items()}
        self.used.update((list(used), list(used.values())))
        if isinstance(day, str):
            end = (int(pd.Timestamp(day).timestamp()) * 1000) + _DAY_MS
            if end > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(end)
        yield held.drop(columns="at").assign(day=day)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.used.clear()
        return iter(())

    def close(self) -> None:
        pass

    def _first(self, held: pd.DataFrame | None, more: list[pd.DataFrame], used: dict) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Of what is held and more: what is within the keys' budgets, with the place in them, and what is not."""
        rows = pd.concat([*([] if held is None else [held[["key", "at", "request"]]]), *more], ignore_index=True)
        codes, keys = pd.factorize(rows["key"], use_na_sentinel=False)
        order = np.lexsort((rows["request"].to_numpy(), rows["at"].to_numpy(), codes))
        rows, codes = rows.iloc[order], codes[order]
        before = np.array([used.get(None if pd.isna(k) else k, 0) for k in keys], np.int64)[codes]
        place = before + np.arange(len(codes)) - np.searchsorted(codes, codes) + 1
        rows = rows.assign(admitted=place <= self.daily, used=np.minimum(place, self.daily), request=rows["request"].astype("int64"))
        return rows[rows["admitted"]], rows[~rows["admitted"]].drop(columns="at")


def with_state(spark: SparkSession) -> SparkSession:
    """The state store that keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def admitted(requests: DataFrame, daily: int, *, late: str = "1 day") -> DataFrame:
    """SCHEMA of a stream of requests (key, request, ts): whether each is within its key's budget of its day, and which it is."""
    with_state(requests.sparkSession)
    at = requests.select("key", F.col("request").cast("long").alias("request"), F.col("ts").cast("timestamp").alias("at")).withWatermark("at", late)
    keyed = at.withColumn("day", F.date_format("at", "yyyy-MM-dd")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
    return keyed.groupBy("day", "bucket").transformWithStateInPandas(statefulProcessor=Budget(daily), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")
