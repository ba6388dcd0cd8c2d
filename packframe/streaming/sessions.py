"""Session dedup on a stream: state is one map per session, from name to stable id."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "session string, call long, qualifiedName string, id long, known boolean"


class _Seen(StatefulProcessor):
    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getMapState("ids", "name string", "id long", self.ttl_ms)
        self.size = handle.getValueState("size", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        got = pd.concat(list(rows)).sort_values(["call", "place"], kind="stable")
        n = self.size.get()[0] if self.size.exists() else 0
        out, fresh = [], {}
        for call, name in zip(got["call"], got["qualifiedName"], strict=True):
            if name in fresh:
                number, since = fresh[name]
                known = since < call
            elif self.ids.containsKey((name,)):
                number, known = self.ids.getValue((name,))[0], True
            else:
                number, known = n, False
                fresh[name] = (n, call)
                self.ids.updateValue((name,), (n,))
                n += 1
            out.append((key[0], int(call), name, int(number), known))
        self.size.update((n,))
        yield pd.DataFrame(out, columns=["session", "call", "qualifiedName", "id", "known"])

    def close(self) -> None:
        pass


def dedup_stream(calls: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """From a stream of (session, call, _pos, qualifiedName): SCHEMA rows.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).  With ttl_ms a name that was recorded
    longer ago is forgotten and gets a new id; without, state grows with the names of a session."""
    rows = calls.select("session", "call", F.col("_pos").alias("place"), "qualifiedName")
    return rows.groupBy("session").transformWithStateInPandas(statefulProcessor=_Seen(ttl_ms), outputStructType=SCHEMA, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")
