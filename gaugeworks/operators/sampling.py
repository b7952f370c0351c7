"""Hash-ordered samples, splits and orders: the same rows on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import bucket, salted_hash, split_of
from gaugeworks.spec import Split


def cohort(ids: DataFrame, key: str, salt: str, n: int) -> DataFrame:
    """The ``n`` distinct keys that come first by the MD5 of key and salt (1 to 10,000)."""
    if not 1 <= n <= 10_000:
        raise ValueError("a cohort has 1 to 10,000 members")
    return ids.select(key).distinct().orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(salt))), key).limit(n)


def _enough(df: DataFrame, counts: DataFrame, short: Column, said: str) -> DataFrame:
    """``df`` with a check in its plan: reading it fails if any row of ``counts`` is short."""
    worst = counts.agg(F.coalesce(F.bool_or(short), F.lit(False)).alias("_short"))
    known = F.when(F.col("_short"), F.raise_error(F.lit(said)).cast("boolean")).otherwise(F.lit(True))
    return df.crossJoin(F.broadcast(worst.select(known.alias("_enough")))).where("_enough").drop("_enough")  # one row


def top_by_hash(df: DataFrame, within: list[str], key: str, salt: str, n: int, *, required: bool = False) -> DataFrame:
    """The ``n`` rows of each group that come first by salted hash; too few are fatal if ``required``."""
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(salted_hash(salt, key), key))
    out = df.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")
    return _enough(out, df.groupBy(*within).count(), F.col("count") < n, "a group has too few members") if required else out


def one_per_group(df: DataFrame, group: str, key: str, group_salt: str, key_salt: str, n: int, *, required: bool = False) -> DataFrame:
    """For the first ``n`` groups by hash, the row whose own hash is least; fewer groups are fatal if ``required``."""
    best = df.groupBy(group).agg(F.min_by(F.struct(*df.columns), F.struct(salted_hash(key_salt, key), F.col(key))).alias("r"))
    out = best.orderBy(salted_hash(group_salt, group), group).limit(n).select("r.*")
    return _enough(out, df.agg(F.count_distinct(group).alias("count")), F.col("count") < n, "too few groups") if required else out


def with_split(df: DataFrame, key: str, salt: str, rules: tuple[Split, ...]) -> DataFrame:
    """Adds ``split``; null where the rules don't name exactly one."""
    return df.withColumn("split", split_of(bucket(salt, key), rules))


def explicit_split(df: DataFrame, group: str, splits: dict[str, str]) -> DataFrame:
    """Adds ``split`` from a declared map of groups; a missing group is fatal when rows are read."""
    pairs = df.sparkSession.createDataFrame(list(splits.items()), f"{group} string, split string")
    out = df.join(pairs, group, "left")
    return out.withColumn("split", F.coalesce("split", F.raise_error(F.concat(F.lit("no declared split for "), F.col(group))).cast("string")))


def overlaps(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that occur in more than one split; empty if splits are disjoint."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def shuffled(df: DataFrame, key: str, seed: int, after: str | None = None) -> DataFrame:
    """Rows in the order of a seeded hash; ``after`` is the cursor: rows behind that hash only, so a resumed read is the suffix."""
    place = salted_hash(f"{seed}:", key)
    out = df.withColumn("place", place)
    return (out.where(F.col("place") > after) if after is not None else out).orderBy("place", key)


class Ranked:
    """A table in an order over all its rows, stored as ranges, so that a place costs one of them.

    Rows are dealt to ranges of the order, sorted in each and written once; a range's rows are
    numbered within it, and the ranges' counts, added up, give the place of its first
    row. ``page`` reads the range that holds a place; ``rows`` numbers the whole table.
    """

    def __init__(self, df: DataFrame, order: list[Column | str], folder: str, ranges: int | None = None):
        spark = df.sparkSession
        ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        keys = [F.col(o) if isinstance(o, str) else o for o in order]
        sorted_ = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
        within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # of a partition's rows as they come
        sorted_.withColumns({"_range": F.spark_partition_id(), "_at": within}).write.partitionBy("_range").option("compression", "zstd").parquet(folder)
        self.columns = df.columns
        self.stored = spark.read.schema(sorted_.withColumns({"_at": within, "_range": F.spark_partition_id()}).schema).parquet(folder)
        counts = {r["_range"]: r["count"] for r in self.stored.groupBy("_range").count().collect()}  # a row for each range
        self.first, self.count = {}, 0
        for i in sorted(counts):
            self.first[i] = self.count
            self.count += counts[i]

    def page(self, index: int, rows: int = 1) -> DataFrame:
        """The ``rows`` rows from place ``index`` (from 0) on; a place outside the table is an error."""
        if not 0 <= index < self.count:
            raise IndexError(index)
        later = sorted(self.first.items())
        hit = [(i, a) for (i, a), b in zip(later, [a for _, a in later[1:]] + [self.count], strict=True) if a < index + rows and b > index]
        place = self._place(hit)
        return self.stored.where(F.col("_range").isin([i for i, _ in hit])).where((place >= index) & (place < index + rows)).orderBy(place).select(*self.columns)

    def rows(self, name: str = "place") -> DataFrame:
        """All rows with their ``name``, from 1."""
        return self.stored.withColumn(name, self._place(list(self.first.items())) + 1).select(*self.columns, name)

    def _place(self, ranges: list[tuple[int, int]]) -> Column:
        firsts = F.create_map(*(F.lit(x) for pair in ranges for x in pair)) if ranges else None
        return F.col("_at") + (F.element_at(firsts, F.col("_range")) if ranges else F.lit(0))
