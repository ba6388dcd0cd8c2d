"""A producer that sends a table again and again, as a delta or, now and then, in full.

The held snapshot and the counters are in one folder, a subfolder for each turn, so that a stream's batch that is
replayed gives the same wire and a lost driver goes on where it was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packframe.operators import delta as D
from packframe.operators.roots import table_root
from packframe.streaming.storage import stored

DEFAULT_EVERY = 15


@dataclass(frozen=True)
class Policy:
    """every: a full snapshot each so many turns; None: when the deltas since the last one would outweigh it."""

    every: int | None = DEFAULT_EVERY

    @staticmethod
    def fixed(n: int) -> Policy:
        return Policy(n if n > 0 else DEFAULT_EVERY)

    @staticmethod
    def size_guard() -> Policy:
        return Policy(None)


def wire_bytes(lines: DataFrame) -> int:
    return lines.agg(F.sum(F.octet_length("line") + 1)).first()[0] or 0


class ReanchorSession:
    def __init__(self, spark: SparkSession, path: str, key: str, name: str = "rows", tool: str = "", policy: Policy = Policy()):  # noqa: B008
        self.spark, self.path, self.key, self.name, self.tool, self.policy = spark, path.rstrip("/"), key, name, tool, policy

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _turn_path(self, turn: int) -> str:
        return f"{self.path}/turn-{turn:08d}"

    def state(self, turn: int) -> dict | None:
        """The counters after a turn; None if it isn't committed."""
        path = self._turn_path(turn) + "/state"
        return self.spark.read.parquet(path).first().asDict() if self._exists(path + "/_SUCCESS") else None

    def base(self, turn: int) -> DataFrame:
        return self.spark.read.parquet(self._turn_path(turn) + "/base")

    def _hold(self, turn: int, after: DataFrame) -> DataFrame:
        """The snapshot of a turn, written once: that of a committed turn is never touched again."""
        if self.state(turn) is None:
            after.write.mode("overwrite").parquet(self._turn_path(turn) + "/base")
        return self.base(turn)

    def _commit(self, turn: int, is_full: bool, total: int, root: str) -> None:
        state = self.spark.range(1).select(F.lit(turn).alias("turn"), F.lit(is_full).alias("is_full"), F.lit(total).cast("long").alias("bytes"), F.lit(root).alias("root"))
        state.coalesce(1).write.mode("overwrite").parquet(self._turn_path(turn) + "/state")

    def full(self, df: DataFrame, root: str | None = None) -> DataFrame:
        return D.full_lines(df, self.key, self.name, self.tool, root)

    def start(self, base: DataFrame) -> DataFrame:
        """Turn 0: the first full snapshot."""
        held, before = self._hold(0, base), self.state(0)
        root = before["root"] if before else table_root(held)
        if before is None:
            self._commit(0, True, 0, root)
        return self.full(held, root)

    def next(self, after: DataFrame, turn: int) -> tuple[DataFrame, bool]:
        """Lines of this turn (1, 2, ...), and whether they are a full snapshot.  A turn can be repeated: if it is committed,
        its lines are made again from what is held; `after` isn't looked at."""
        before = self.state(turn - 1)
        if before is None:
            raise ValueError(f"turn {turn - 1} isn't committed")
        after, done = self._hold(turn, after), self.state(turn)
        base = self.base(turn - 1)
        root = done["root"] if done else table_root(after)
        if base.columns != after.columns:
            lines, is_full, total = self.full(after, root), True, 0
        else:
            changes = stored(D.diff(base, after, self.key), "changes")
            lines = D.delta_lines(changes, self.key, before["root"], root)
            if done:
                is_full = done["is_full"]
            else:
                total = before["bytes"] + wire_bytes(lines)
                is_full = turn % self.policy.every == 0 if self.policy.every else total >= wire_bytes(self.full(after, root))
            if is_full:
                lines, total = self.full(after, root), 0
        if not done:
            self._commit(turn, is_full, total, root)
        return lines, is_full

    def write_batch(self, out: str):
        """For foreachBatch of a stream of whole snapshots: batch n is turn n (0 starts); wires go to `out`/turn-n."""

        def one(batch: DataFrame, batch_id: int) -> None:
            lines = self.start(batch) if batch_id == 0 else self.next(batch, batch_id)[0]
            # range-partitioned: the files' names are in the order of the wire, and no task gets all of a snapshot
            lines.sort("section", "place").select("line").write.mode("overwrite").text(f"{out}/turn-{batch_id:08d}")

        return one
