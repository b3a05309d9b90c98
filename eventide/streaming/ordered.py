"""Streams whose rows must be applied in event-time order.

Files of one trigger, and partitions of one file, arrive in any order. A job
here therefore never trusts arrival: every micro-batch joins the rows that
still wait, the watermark is the latest event time seen (with several sources:
that of the slowest) less a delay, and only rows before it are released - as one batch, to be ordered by (time, id). Rows
that arrive after their time was released go to the ``late`` output with a
reason. Input = output + late + waiting, whatever the layout of the files.

Everything lives below one folder of the shared file system: per released
step ``<seq>-<epoch>`` the tables ``out``, ``late``, ``wait`` and ``state``, and
last a row in ``commits`` that makes the step count. A repeated micro-batch finds
its commit and does nothing; a restarted job goes on from the last commit.

A step costs the same however many came before: commits are listed once, only
the newest can be unfinished, a step gets the output of the one before and no
older one, and waiting rows and state are removed once the next step stands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.session import children, remove

# ready rows, state of the last step (None at first), output of the last step
# (None at first) -> output, new state (None: no state)
Step = Callable[[DataFrame, DataFrame | None, DataFrame | None],
                tuple[DataFrame, DataFrame | None]]


class OrderedJob:
    """``sources``: with several, the values of column ``source`` that must all
    have been seen before time can pass."""

    def __init__(self, spark: SparkSession, root: str, time: str, delay_seconds: int, step: Step,
                 source: str | None = None, sources: tuple = ()):
        self.spark, self.root, self.time = spark, root.rstrip("/"), time
        self.delay, self.step = int(delay_seconds * 1_000_000), step
        self.source, self.sources = source, [str(x) for x in sources] or ["all"]

    def commits(self) -> list[str]:
        names = children(self.spark, f"{self.root}/commits")
        # A release removes an unfinished commit before it makes another: only the last may be one.
        if names and "_SUCCESS" not in children(self.spark, f"{self.root}/commits/{names[-1]}"):
            names.pop()
        return names

    def table(self, kind: str) -> DataFrame | None:
        """``out`` or ``late`` rows of all committed steps."""
        paths = [f"{self.root}/{n}/{kind}" for n in self.commits()]
        return self.spark.read.parquet(*paths) if paths else None

    def release(self, df: DataFrame | None, epoch: str) -> None:
        """One step: the rows of a micro-batch, or None to release all that waits."""
        done = self.commits()
        for n in children(self.spark, f"{self.root}/commits")[len(done):]:
            remove(self.spark, f"{self.root}/commits/{n}")
        if epoch in {n.split("-", 1)[1] for n in done}:
            return
        seen: dict[str, int] = {}
        upto = None
        state = waiting = before = None
        if done:
            last = f"{self.root}/{done[-1]}"
            seen, upto = self.spark.read.parquet(f"{self.root}/commits/{done[-1]}").first()
            seen = dict(seen)
            waiting = self.spark.read.parquet(f"{last}/wait")
            before = self.spark.read.parquet(f"{last}/out")
            if "state" in children(self.spark, last):
                state = self.spark.read.parquet(f"{last}/state")
        micros = F.unix_micros(F.col(self.time))
        here = f"{self.root}/{len(done):08d}-{epoch}"
        if df is not None:
            df = df.persist()
            which = F.col(self.source).cast("string") if self.source else F.lit("all")
            for r in df.groupBy(which.alias("s")).agg(F.max(micros).alias("t")).collect():
                if r.t is not None:  # one row per source
                    seen[r.s] = max(seen.get(r.s, r.t), r.t)
            late = F.lit(False) if upto is None else F.coalesce(micros < upto, F.lit(False))
            late = late | micros.isNull()
            reason = F.when(micros.isNull(), "no-time").otherwise("late")
            df.filter(late).withColumn("reason", reason).write.mode("overwrite").parquet(f"{here}/late")
            rows = df.filter(~late)
            rows = rows if waiting is None else rows.unionByName(waiting)
        else:
            if waiting is None:
                return
            rows = waiting
            rows.limit(0).withColumn("reason", F.lit("")).write.mode("overwrite").parquet(f"{here}/late")
        if df is None and seen or all(s in seen for s in self.sources):
            limit = max(seen.values()) + 1 if df is None else min(seen[s] for s in self.sources) - self.delay
            upto = limit if upto is None else max(upto, limit)
        ready = rows.filter(micros < upto) if upto is not None else rows.limit(0)
        wait = rows.filter(micros >= upto) if upto is not None else rows
        wait.write.mode("overwrite").parquet(f"{here}/wait")
        out, state = self.step(ready, state, before)
        out.write.mode("overwrite").parquet(f"{here}/out")
        if state is not None:
            state.write.mode("overwrite").parquet(f"{here}/state")
        self.spark.createDataFrame([(seen, upto)], "seen map<string,bigint>, upto long").write.mode(
            "overwrite").parquet(f"{self.root}/commits/{len(done):08d}-{epoch}")
        if done:  # what only this step could still need
            remove(self.spark, f"{last}/wait")
            remove(self.spark, f"{last}/state")
        if df is not None:
            df.unpersist()

    def run(self, stream: DataFrame, drain: bool = True) -> OrderedJob:
        """All available micro-batches; ``drain`` then releases what waits (for
        bounded input: a later row before that time would be late)."""
        from eventide.streaming.jobs import run_foreach_batch
        run_foreach_batch(stream, lambda df, epoch: self.release(df, str(epoch)),
                          checkpoint=f"{self.root}/checkpoint")
        if drain:
            self.release(None, f"drain{len(self.commits())}")
        return self
