"""Splits, scalers, projections and scores of classifications."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.operators.ordered import ranked

#: Names of the label codes.
LABELS = {0: "unlabeled", 1: "Event_Pulse", 2: "Test/Control_Pulse", 3: "Noise", 4: "Squid_Jump", 5: "Spike", 6: "Early_or_late_Trigger", 7: "Pile_Up", 8: "Carrier_Event", 9: "Strongly_Saturated_Event_Pulse", 10: "Strongly_Saturated_Test/Control_Pulse", 11: "Decaying_Baseline", 12: "Temperature_Rise", 13: "Stick_Event", 14: "Square_Waves", 15: "Human_Disturbance", 16: "Large_Sawtooth", 17: "Cosinus_Tail", 18: "Light_only_Event", 19: "Ring_Light_Event", 20: "Sharp_Light_Event", 99: "unknown/other"}


def label_name(code: Column) -> Column:
    pairs = [x for k, v in LABELS.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), code.cast("int"))


def split(ident: Column, shares: dict[str, float], seed: int = 1) -> Column:
    """The part an id falls to, by a hash of seed and id: the same on every run and machine."""
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), ident.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    at, out = 0.0, None
    names = list(shares)
    for name in names[:-1]:
        at += shares[name]
        out = F.when(place < at, name) if out is None else out.when(place < at, name)
    return out.otherwise(names[-1]) if out is not None else F.lit(names[0])


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with each column as deviations from its mean in population standard deviations."""
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]).withColumn("one_", F.lit(1))
    joined = df.withColumn("one_", F.lit(1)).join(stats, "one_").drop("one_")
    return joined.select(*[c for c in df.columns if c not in columns], *[((F.col(c) - F.col(f"mean_{c}")) / F.col(f"sd_{c}")).alias(c) for c in columns])


def principal_components(df: DataFrame, ident: str, value: str, k: int) -> DataFrame:
    """ident, pc (k projections of an array column without its mean), error (root mean squared residual)."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    read = df.select(ident, array_to_vector(value).alias("v_"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="v_", outputCol="c_").fit(read).transform(read)
    out = PCA(k=k, inputCol="c_", outputCol="p_").fit(centred).transform(centred)
    power = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, x: a + x * x)
    n = F.size(vector_to_array("c_"))
    return out.select(ident, vector_to_array("p_").alias("pc"), F.sqrt(F.greatest(power("c_") - power("p_"), F.lit(0.0)) / n).alias("error"))


def accuracy_by_label(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def raster(df: DataFrame, x: Column, y: Column, limits: tuple[float, float, float, float], width: int, height: int, alpha: float = 0.3) -> DataFrame:
    """px, py (down from the top), shade: the density of points on a grid of pixels; the pixels of the left and upper edge are dropped."""
    x_low, x_high, y_low, y_high = limits
    px, py = F.bround((x - x_low) / (x_high - x_low) * width).cast("long"), F.bround((1 - (y - y_low) / (y_high - y_low)) * height).cast("long")
    inside = F.col("px").between(1, width) & F.col("py").between(1, height)
    counted = df.select(px.alias("px"), py.alias("py")).where(inside).groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("px", "py", F.least(F.lit(1.0), alpha * F.col("n")).alias("shade"))


def predicted(df: DataFrame, ident: str, value: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]], kind: str = "double") -> DataFrame:
    """ident, prediction: a model of any library over whole Arrow batches of feature arrays; each task loads it once."""
    schema = f"{ident} {df.schema[ident].dataType.simpleString()}, prediction {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            if batch.num_rows:
                model = model or load()
                rows = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.asarray(model(rows)).tolist())], names=[ident, "prediction"])

    return df.select(ident, value).where(F.col(value).isNotNull()).mapInArrow(run, schema)


def equal_count_accuracy(df: DataFrame, height: str, ident: str, hit: Column, size: int) -> DataFrame:
    """bin, n, mean_height, accuracy in bins of `size` rows by height."""
    binned = ranked(df.withColumn("hit_", hit), height, ident, "place_").withColumn("bin", F.floor(F.col("place_") / size))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(height).alias("mean_height"), F.avg(F.col("hit_").cast("double")).alias("accuracy"))
