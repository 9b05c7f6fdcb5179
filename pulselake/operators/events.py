"""Event sets as lazy DataFrames, and conjunctive cuts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class EventSet:
    """Traces keyed by (channel, event_idx) with a time base. Every method gives a new set; nothing runs before collect."""

    def __init__(self, df: DataFrame, dt_us: float, length: int, trace: str = "x"):
        missing = {"channel", "event_idx", trace} - set(df.columns)
        if missing:
            raise ValueError(f"no columns {sorted(missing)}")
        self.df, self.dt_us, self.length, self.trace = df, dt_us, length, trace

    def _with(self, df: DataFrame, length: int | None = None) -> EventSet:
        return EventSet(df, self.dt_us, length or self.length, self.trace)

    def channels(self, *names) -> EventSet:
        return self._with(self.df.where(F.col("channel").isin(*names)))

    def events(self, idx: Iterable[int] | DataFrame) -> EventSet:
        """By event numbers: a short list, or a DataFrame with event_idx for many."""
        if isinstance(idx, DataFrame):
            return self._with(self.df.join(idx.select("event_idx").distinct(), "event_idx", "left_semi"))
        return self._with(self.df.where(F.col("event_idx").isin(*idx)))

    def count(self) -> int:
        """Events, by their largest number: numbers run from 0."""
        return (self.df.agg(F.max("event_idx")).first()[0] or -1) + 1 if self.df.head(1) else 0

    def __getitem__(self, key) -> EventSet:
        """events[channel, idx] or events[channel]: one channel, a list or slice of names; idx a number, a slice, a list of numbers or of
        booleans, negative numbers from the end. A column is a mask over the rows."""
        names, idx = key if isinstance(key, tuple) else (key, slice(None))
        out = self if names == slice(None) or names is None else self.channels(*([names] if isinstance(names, (int, str)) else names))
        if isinstance(idx, Column):
            return out.where(idx)
        if isinstance(idx, slice):
            if idx == slice(None):
                return out
            step = idx.step or 1
            low, high, _ = slice(idx.start, idx.stop, abs(step)).indices(self.count()) if step > 0 else (0, 0, 0)
            if step < 0:
                places = range(*idx.indices(self.count()))
                low, high, step = (min(places, default=0), max(places, default=-1) + 1, -step)
            return out.where((F.col("event_idx") >= low) & (F.col("event_idx") < high) & ((F.col("event_idx") - low) % step == 0))
        idx = [idx] if isinstance(idx, int) and not isinstance(idx, bool) else list(idx)
        if idx and all(isinstance(i, bool) for i in idx):
            if len(idx) != self.count():
                raise IndexError(f"{len(idx)} flags for {self.count()} events")
            idx = [i for i, flag in enumerate(idx) if flag]
        n = self.count() if any(i < 0 for i in idx) else None
        places = [i + n if i < 0 else i for i in idx]
        if any(i < 0 for i in places):
            raise IndexError(f"no event {min(idx)} of {n}")
        return out.events(places)

    def __radd__(self, other) -> EventSet:
        """So that sum() of several sets works."""
        return self if other == 0 else NotImplemented

    def where(self, flag: Column) -> EventSet:
        return self._with(self.df.where(flag))

    def __add__(self, other: EventSet) -> EventSet:
        """Both sets' events, those of other with numbers after the last of self. Time base and length must agree."""
        if (self.dt_us, self.length) != (other.dt_us, other.length):
            raise ValueError("time base or record length differ")
        after = self.df.agg((F.coalesce(F.max("event_idx"), F.lit(-1)) + 1).alias("after_"))
        moved = other.df.withColumn("one_", F.lit(1)).join(after.withColumn("one_", F.lit(1)), "one_").withColumn("event_idx", F.col("event_idx") + F.col("after_")).drop("one_", "after_")
        return self._with(self.df.unionByName(moved.withColumnRenamed(other.trace, self.trace)))

    def with_processing(self, *steps: Callable[[Column], Column], length: int | None = None) -> EventSet:
        """Functions of the trace's column, one after the other."""
        x = F.col(self.trace)
        for step in steps:
            x = step(x)
        return self._with(self.df.withColumn(self.trace, x), length)

    def apply(self, **features: Callable[[Column], Column]) -> DataFrame:
        """channel, event_idx and a column for each feature of the trace."""
        return self.df.select("channel", "event_idx", *[f(F.col(self.trace)).alias(k) for k, f in features.items()])

    def times_ms(self) -> list[float]:
        """Time of each sample, zero at a quarter of the record."""
        return [(i - self.length // 4) * self.dt_us / 1000 for i in range(self.length)]

    def grab(self, event_idx: int) -> dict:
        return {r["channel"]: r[self.trace] for r in self.df.where(F.col("event_idx") == event_idx).collect()}


class LogicalCut:
    """Conditions that all must hold; single events can be forced either way."""

    def __init__(self, first: Column | None = None):
        self.flag = F.lit(True) if first is None else first
        self.kept: list[DataFrame] = []
        self.lost: list[DataFrame] = []

    def add_condition(self, condition: Column) -> LogicalCut:
        self.flag = self.flag & condition
        return self

    def force_true(self, ids: DataFrame) -> LogicalCut:
        self.kept.append(ids)
        return self

    def force_false(self, ids: DataFrame) -> LogicalCut:
        self.lost.append(ids)
        return self

    def flagged(self, df: DataFrame, key: str = "event_idx") -> DataFrame:
        """df with a column flag."""
        out = df.withColumn("flag", F.coalesce(self.flag, F.lit(False)))
        for ids, value in [(i, True) for i in self.kept] + [(i, False) for i in self.lost]:
            marks = ids.select(F.col(key).alias("mark_")).distinct()
            out = out.join(marks, F.col(key) == F.col("mark_"), "left").withColumn("flag", F.when(F.col("mark_").isNotNull(), F.lit(value)).otherwise(F.col("flag"))).drop("mark_")
        return out

    def kept_rows(self, df: DataFrame, key: str = "event_idx") -> DataFrame:
        return self.flagged(df, key).where("flag").drop("flag")

    def cut_rows(self, df: DataFrame, key: str = "event_idx") -> DataFrame:
        """What kept_rows leaves out."""
        return self.flagged(df, key).where("not flag").drop("flag")

    def numbers(self, df: DataFrame, kept: bool = True, key: str = "event_idx") -> DataFrame:
        """The event numbers that pass the cut, or those that do not."""
        return (self.kept_rows(df, key) if kept else self.cut_rows(df, key)).select(key).distinct()

    def counts(self, df: DataFrame, key: str = "event_idx") -> DataFrame:
        return self.flagged(df, key).agg(F.count(F.lit(1)).alias("total"), F.count_if("flag").alias("n_kept"))
