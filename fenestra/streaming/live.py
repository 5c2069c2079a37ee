"""Live fingerprints: windows of a stream are closed by watermark and become documents, in order, once.

A window closes when the largest event time seen, less the allowed delay, has passed its end. Step N reads the state that
step N - 1 left and writes its own: the events still open (those of closed windows are gone, so state is bounded by what the
delay keeps open), the counts of the last closed window, the new templates, the closed documents, and last a mark with the
largest event time and the last window closed. State is read by the mark before N alone, so a step that is run again,
whatever of it was written before, finds what it found the first time and overwrites its own output. :func:`flush` is a step
too; batches after it count on from there.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import KEYS, Config
from ..operators import stats
from ..operators.order import with_ordinal
from ..plans.documents import BLOCKS, fingerprint, previous_ends, to_json
from ..sources.events import canonical, registry

MARK = "step long, batch long, mark long, upto long, closed long"


def tumbling(ts: Column, seconds: int) -> Column:
    """Window number of an event time."""
    return F.floor(F.unix_seconds(ts) / seconds).cast("long")


def windowed_counts(events: DataFrame, window: str, delay: str, slide: str | None = None) -> DataFrame:
    """Template counts per event-time window (tumbling, or sliding with ``slide``), emitted once closed; late events are
    dropped by the watermark."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    counts = events.withWatermark("ts", delay).groupBy(span.alias("w"), "source", "template_id").agg(F.count("*").alias("count"))
    return counts.select("source", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "template_id", "count")


def sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Events per trace session: a pause longer than ``gap`` ends one."""
    span = F.session_window("ts", gap)
    return events.withWatermark("ts", delay).groupBy(span.alias("w"), "source", "trace_id").agg(F.count("*").alias("count")).select("source", "trace_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count")


class LiveFingerprints:
    """The state tables of one stream, under ``path`` (a folder all executors share)."""

    def __init__(self, spark: SparkSession, path: str, seconds: int, delay_seconds: int, config: Config = Config(), blocks: frozenset[str] | set[str] = BLOCKS):
        self.spark, self.path, self.seconds, self.delay, self.config, self.blocks = spark, path.rstrip("/"), seconds, delay_seconds, config, blocks

    def start(self, stream: DataFrame, **options: str) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.path}/checkpoint")
        return writer.trigger(**(options or {"availableNow": True})).start()  # type: ignore[arg-type]

    def _read(self, name: str) -> DataFrame | None:
        """A table of all steps, by its column ``at``; none if no step wrote to it."""
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def _of(self, name: str, step: int | None) -> DataFrame | None:
        """What a step wrote."""
        table = None if step is None else self._read(name)
        return None if table is None else table.where(F.col("at") == step).drop("at")

    def _write(self, frame: DataFrame, name: str, step: int) -> DataFrame:
        path = f"{self.path}/{name}/at={step}"
        frame.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def _marks(self) -> list:
        """The finished steps, in order: one small row a step."""
        rows = self._read("marks")
        return [] if rows is None else sorted(rows.collect(), key=lambda r: r["step"])

    def batch(self, rows: DataFrame, number: int) -> None:
        """One micro-batch; one that is finished already is not run again."""
        if not any(m["batch"] == number for m in self._marks()):
            self._step(canonical(rows.withColumn("window_id", tumbling(F.col("ts"), self.seconds))), number)

    def flush(self) -> None:
        """Closes what is still open, at the end of the stream or of a part of it."""
        self._step(None, None)

    def _step(self, events: DataFrame | None, number: int | None) -> None:
        marks = self._marks()
        step, last = len(marks), marks[-1] if marks else None
        after, mark, closed = (last["upto"], last["mark"], last["closed"]) if last else (None, None, None)
        every = self._of("open", last["step"] if last else None)
        if events is not None:
            # late: the window has become a document already
            fresh = self._write(events if after is None else events.where(F.col("window_id") > after), "input", step)
            seen = fresh.agg(F.max(F.unix_seconds("ts"))).first()[0]
            mark = max((x for x in (seen, mark) if x is not None), default=None)
            every = fresh if every is None else every.unionByName(fresh)
            upto = None if mark is None else (mark - self.delay) // self.seconds - 1
        else:
            upto = None if every is None else every.agg(F.max("window_id")).first()[0]
        upto = max((x for x in (upto, after) if x is not None), default=None)
        if every is not None:
            if upto is not None and self._close(every.where(F.col("window_id") <= upto), step, closed):
                closed = step
            self._write(every if upto is None else every.where(F.col("window_id") > upto), "open", step)
        self._write(self.spark.createDataFrame([(step, number, mark, upto, closed)], MARK).coalesce(1), "marks", step)
        # nothing reads these again
        for name, old in (("input", step), ("open", step - 1)):
            table = self._of(name, old)
            if table is not None:
                self._write(self.spark.createDataFrame([], table.schema), name, old)

    def _close(self, table: DataFrame, step: int, before: int | None) -> bool:
        """Writes the documents of ``table``; ``before`` is the step that closed windows last."""
        if not table.limit(1).count():
            return False
        docs = fingerprint(table, self.config, blocks=self.blocks)
        counts = self._write(stats.template_stats(with_ordinal(table)).select(*KEYS, "template_id", "count"), "counts", step)
        if docs.stability is not None:
            # the first window closed now is compared with the last one closed before
            ends = self._write(docs.header.select(*KEYS, "end"), "ends", step)
            old_counts, old_ends = self._of("counts", before), self._of("ends", before)
            known = counts if old_counts is None else counts.unionByName(old_counts)
            seen = stats.stability(known).join(counts.select(*KEYS).distinct(), KEYS, "left_semi")
            docs = replace(docs, stability=previous_ends(seen, ends if old_ends is None else ends.unionByName(old_ends)))
        self._write(to_json(docs), "documents", step)
        new, known = registry(table), self.registry(step)
        self._write(new if known is None else new.join(known.select("template_id"), "template_id", "left_anti"), "registry", step)
        return True

    def _finished(self, name: str, below: int) -> DataFrame | None:
        table = self._read(name)
        return None if table is None else table.where(F.col("at") < below).drop("at")

    def registry(self, below: int | None = None) -> DataFrame | None:
        """(template_id, template_str): the first spelling of each id, of the steps below a number or all finished ones."""
        return self._finished("registry", len(self._marks()) if below is None else below)

    def documents(self) -> DataFrame:
        """Documents of the finished steps."""
        return self._finished("documents", len(self._marks()))

    def stability(self) -> DataFrame:
        """Every closed window against the one before it, also across micro-batches."""
        return stats.stability(self._finished("counts", len(self._marks())))
