"""A catalog of groups: one Parquet table for each group under a folder, keyed by explicit event numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Groups:
    """Tables of a measurement by group name. Each write makes a new version; a pointer file names the current one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path

    def keys(self) -> list[str]:
        root = self._hadoop(self.path)
        return sorted({s.getPath().getName() for s in self._fs.listStatus(root)}) if self._fs.exists(root) else []

    def _versions(self, group: str) -> list[int]:
        root = self._hadoop(f"{self.path}/{group}")
        found = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(int(v[1:]) for v in found if v[1:].isdigit() and self._fs.exists(self._hadoop(f"{self.path}/{group}/{v}/_SUCCESS")))

    def get(self, group: str, *columns: str) -> DataFrame:
        versions = self._versions(group)
        if not versions:
            raise KeyError(group)
        df = self.spark.read.parquet(f"{self.path}/{group}/v{versions[-1]}")
        return df.select(*columns) if columns else df

    def create(self) -> None:
        """Makes the folder, without groups."""
        self._fs.mkdirs(self._hadoop(self.path))

    def exists(self) -> bool:
        return self._fs.exists(self._hadoop(self.path))

    def location(self, group: str) -> str:
        """Where the current version of a group lies; KeyError if there is none."""
        versions = self._versions(group)
        if not versions:
            raise KeyError(group)
        return f"{self.path}/{group}/v{versions[-1]}"

    def content(self, *groups: str) -> DataFrame:
        """group, column, type, n (rows), length (of arrays in the first row) of all or some groups; counted by Spark, one row a column."""
        rows = []
        for group in groups or self.keys():
            df = self.get(group)
            n, first = df.count(), df.first()
            rows += [(group, name, kind, n, len(first[name]) if first and isinstance(first[name], list) else None) for name, kind in df.dtypes]
        return self.spark.createDataFrame(rows, "group string, column string, type string, n long, length int")

    def derived(self, group: str, name: str, of: str = "mainpar", key: str = "event_idx") -> DataFrame:
        """key, channel and a derived column: a field of a stored struct, or a difference of its times (length_rise, length_peak,
        length_decay, length_firsthalfdecay, length_secondhalfdecay)."""
        times = {"length_rise": ("t_rise", "t_zero"), "length_peak": ("t_decaystart", "t_rise"), "length_decay": ("t_end", "t_decaystart"), "length_firsthalfdecay": ("t_half", "t_decaystart"), "length_secondhalfdecay": ("t_end", "t_half")}
        df = self.get(group)
        if name in df.columns:
            value = F.col(name)
        elif name in times:
            value = F.col(f"{of}.{times[name][0]}") - F.col(f"{of}.{times[name][1]}")
        else:
            value = F.col(f"{of}.{name}")
        return df.select(*[c for c in (key, "channel") if c in df.columns], value.alias(name))

    def repack(self, group: str, files: int) -> None:
        """The same rows in `files` files."""
        self.put(group, self.get(group).repartition(files))

    def put(self, group: str, df: DataFrame) -> None:
        """Writes a group anew; the version before stays until the new one is whole."""
        versions = self._versions(group)
        df.write.parquet(f"{self.path}/{group}/v{(versions or [0])[-1] + 1}")
        for v in versions:
            self._fs.delete(self._hadoop(f"{self.path}/{group}/v{v}"), True)

    def set(self, group: str, df: DataFrame, key: str = "event_idx", overwrite: bool = False) -> None:
        """Adds the columns of df to a group by key; existing ones only with overwrite."""
        old = self.get(group)
        clash = [c for c in df.columns if c in old.columns and c != key]
        if clash and not overwrite:
            raise ValueError(f"{group} has {clash}; pass overwrite=True")
        self.put(group, old.drop(*clash).join(df, key, "left"))

    def drop(self, group: str, *columns: str) -> None:
        if columns:
            self.put(group, self.get(group).drop(*columns))
        else:
            self._fs.delete(self._hadoop(f"{self.path}/{group}"), True)

    def rename(self, group: str, **names: str) -> None:
        self.put(group, self.get(group).withColumnsRenamed(names))

    def merge(self, group: str, parts: list[tuple[str, DataFrame]], key: str = "event_idx") -> None:
        """Writes the union of parts with their names as origin and event numbers that go on from part to part."""
        schemas = {tuple(df.dtypes) for _, df in parts}
        if len(schemas) > 1:
            raise ValueError(f"parts differ: {schemas}")
        shifted, at = [], 0
        for name, df in parts:
            top = df.agg(F.max(key)).first()[0]
            shifted.append(df.withColumn(key, F.col(key) + at).withColumn("origin", F.lit(name)))
            at += (top + 1) if top is not None else 0
        self.put(group, reduce(DataFrame.unionByName, shifted))


def properties(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """origin, column, type, n of each part, as a table."""
    spark = parts[0][1].sparkSession
    return spark.createDataFrame([(name, c, kind, df.count()) for name, df in parts for c, kind in df.dtypes], "origin string, column string, type string, n long")


def inconsistencies(parts: list[tuple[str, DataFrame]]) -> list[str]:
    """What keeps parts from being merged: columns that some lack, and columns of several types."""
    kinds: dict[str, dict[str, list[str]]] = {}
    for name, df in parts:
        for c, kind in df.dtypes:
            kinds.setdefault(c, {}).setdefault(kind, []).append(name)
    found = []
    for c, by in sorted(kinds.items()):
        have = {n for names in by.values() for n in names}
        lacking = [name for name, _ in parts if name not in have]
        found += [f"{c} is missing in {', '.join(lacking)}"] if lacking else []
        found += [f"{c} has types {', '.join(sorted(by))}"] if len(by) > 1 else []
    return found


def available(df: DataFrame) -> bool:
    """Whether all files that a DataFrame reads are still there."""
    spark = df.sparkSession
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return False
    return True
