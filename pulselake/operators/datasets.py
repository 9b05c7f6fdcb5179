"""Features of events as tables for training and evaluation: one row an event, a column for each channel and feature."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.operators import evaluate


def stacked_features(df: DataFrame, columns: list[str]) -> Column:
    """One array of doubles from columns of numbers and of arrays, in order."""
    arrays = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}
    return F.concat(*[(F.col(c) if c in arrays else F.array(c)).cast("array<double>") for c in columns])


def samples(df: DataFrame, keys: dict[str, int | None], channels: list[int], one_hot: dict[str, list[int]] | None = None) -> DataFrame:
    """event_idx and columns {key}_ch{c} (numbers, or whole arrays) and {key}_ch{c}_fe{f} (the first `keys[key]` members of arrays), and
    {key}_ch{c}_is_{code} for keys of `one_hot`. df: channel, event_idx and the keys. Events that lack a channel have nulls there; of
    several rows of one event and channel each column takes its largest value."""
    found = []
    for c in channels:
        at = lambda value, c=c: F.max(F.when(F.col("channel") == c, value))
        for key, n in keys.items():
            if one_hot and key in one_hot:
                found += [at((F.col(key) == code).cast("int")).alias(f"{key}_ch{c}_is_{code}") for code in one_hot[key]]
            elif n is None:
                found.append(at(F.col(key)).alias(f"{key}_ch{c}"))
            else:
                found += [at(F.get(key, F.lit(f))).alias(f"{key}_ch{c}_fe{f}") for f in range(n)]
    return df.where(F.col("channel").isin(channels)).groupBy("event_idx").agg(*found)


class Splits:
    """A table in parts by a hash of the event number, and its rows as numpy batches."""

    def __init__(self, df: DataFrame, shares: dict[str, float], ident: str = "event_idx", seed: int = 1):
        self.df, self.shares, self.ident, self.seed = df, shares, ident, seed

    def part(self, name: str) -> DataFrame:
        if name not in self.shares:
            raise KeyError(name)
        return self.df.where(evaluate.split(F.col(self.ident), self.shares, self.seed) == name)

    def batches(self, name: str, size: int) -> Iterator[dict[str, np.ndarray]]:
        """Dictionaries of arrays of `size` rows for a training loop outside Spark; one partition at a time is on the driver."""
        rows: list = []
        for row in self.part(name).toLocalIterator(prefetchPartitions=True):
            rows.append(row)
            if len(rows) == size:
                yield {c: np.array([r[c] for r in rows]) for c in self.df.columns}
                rows = []
        if rows:
            yield {c: np.array([r[c] for r in rows]) for c in self.df.columns}


class Models:
    """Models and scalers by channel, kept as one file in a folder that all machines see. A model is any function of a matrix of features."""

    def __init__(self, info: str = ""):
        self.info, self.models, self.scalers = info, {}, {}

    def add(self, channel: int, model: Callable[[np.ndarray], np.ndarray], scaler: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.models[channel], self.scalers[channel] = model, scaler

    def rename(self, old: int, new: int) -> None:
        """The model of a channel for another one."""
        self.models[new], self.scalers[new] = self.models.pop(old), self.scalers.pop(old)

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([(bytearray(pickle.dumps(self)),)], "model binary").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> Models:
        """Only from folders you trust: a pickle runs code."""
        return pickle.loads(bytes(spark.read.parquet(path).first()["model"]))

    def predict(self, df: DataFrame, value: str, ident: str = "event_idx") -> DataFrame:
        """channel, ident, prediction of the channels that have a model."""
        out = None
        for channel, model in sorted(self.models.items()):
            mean, sd = self.scalers[channel] or (0.0, 1.0)
            load = lambda model=model, mean=mean, sd=sd: lambda rows: model((rows - mean) / sd)
            part = evaluate.predicted(df.where(F.col("channel") == channel), ident, value, load).withColumn("channel", F.lit(channel))
            out = part if out is None else out.unionByName(part)
        return out.select("channel", ident, "prediction")


class Evaluation:
    """Features, labels and predictions of events of several files, keyed by file_nbr and event_idx."""

    def __init__(self, df: DataFrame | None = None, methods: tuple[str, ...] = ()):
        self.df, self.methods = df, methods

    def add_events(self, df: DataFrame, channel: int, only: list[int] | None = None, only_labelled: bool = False, label: str = "label") -> Evaluation:
        """The set with the events of one more file (channel, event_idx, features, label)."""
        part = df.where(F.col("channel") == channel)
        part = part.where(F.col("event_idx").isin(only)) if only is not None else part
        part = part.where(F.coalesce(F.col(label), F.lit(0)) != 0) if only_labelled else part
        number = 0 if self.df is None else (self.df.agg(F.max("file_nbr")).first()[0] or 0) + 1
        part = part.select(F.lit(number).alias("file_nbr"), "event_idx", "features", F.col(label).alias("label"))
        return Evaluation(part if self.df is None else self.df.select(*part.columns).unionByName(part))

    def with_features(self, features: DataFrame) -> Evaluation:
        """The set with other features (file_nbr, event_idx, features); each event must have some."""
        met = self.df.drop("features").join(features.select("file_nbr", "event_idx", "features"), ["file_nbr", "event_idx"], "left")
        missing = met.where("features is null").count()
        if missing:
            raise ValueError(f"{missing} events have no features")
        return Evaluation(met, self.methods)

    def with_prediction(self, method: str, predictions: DataFrame) -> Evaluation:
        """The set with the predictions of a method (file_nbr, event_idx, prediction)."""
        if method in self.methods:
            raise ValueError(f"there are predictions of {method} already")
        side = predictions.select("file_nbr", "event_idx", F.col("prediction").alias(f"pred_{method}"))
        return Evaluation(self.df.join(side, ["file_nbr", "event_idx"], "left"), (*self.methods, method))

    def predictions(self, method: str, part: str = "all", train: float = 0.8, seed: int = 1) -> DataFrame:
        """file_nbr, event_idx, label, prediction of all, train or test events."""
        if method not in self.methods:
            raise KeyError(method)
        out = self.df.select("file_nbr", "event_idx", "label", F.col(f"pred_{method}").alias("prediction"))
        if part == "all":
            return out
        key = F.concat_ws(":", "file_nbr", "event_idx")
        return out.where(evaluate.split(key, {"train": train, "test": 1 - train}, seed) == part)

    def confusion(self, method: str) -> DataFrame:
        """label, prediction, n, share of the label."""
        counted = self.predictions(method).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
        totals = counted.groupBy(F.col("label").alias("l_")).agg(F.sum("n").alias("all_"))
        return counted.join(totals, F.col("label").eqNullSafe(F.col("l_"))).select("label", "prediction", "n", (F.col("n") / F.col("all_")).alias("share"))
