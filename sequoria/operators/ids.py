"""Dense ids and running totals without a sort of everything in one task, splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sequoria.sources.tables import written

#: Rows of a range have places of this many bits behind the number of the range.
_PLACE_BITS = 33


def ranged(df: DataFrame, *order: Column | str, ranges: int | None = None) -> DataFrame:
    """``df`` written in ``ranges`` parts of about equal size along ``order``, with ``_range`` and ``_in_range`` in it.

    The bounds are quantiles of a sample of all of ``order``, so many rows of one value are
    spread by what breaks their ties. As many ranges as shuffle partitions unless given.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(dealt.select("*", F.shiftright(number, _PLACE_BITS).cast("int").alias("_range"), number.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("_in_range")))


def _before(sums: DataFrame) -> DataFrame:
    """(_range, _before): totals of the ranges before each; a row for each range. ``sums``: _range, _sum."""
    return sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))


def with_running_total(df: DataFrame, value: Column, order: Column, *ties: str, name: str = "total") -> DataFrame:
    """Adds the sum of ``value`` up to and with each row, by ``order`` and ``ties``."""
    parts = ranged(df.withColumns({"_value": value, "_order": order}), "_order", *ties)
    before = _before(parts.groupBy("_range").agg(F.sum("_value").alias("_sum")))
    w = Window.partitionBy("_range").orderBy("_in_range").rowsBetween(Window.unboundedPreceding, 0)
    return parts.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.sum("_value").over(w)).drop("_range", "_in_range", "_before", "_value", "_order")


def with_dense_id(df: DataFrame, order: Column, *ties: str, name: str = "id", start: int = 0) -> DataFrame:
    """Adds 0, 1, 2 ... by ``order`` and ``ties``; one shuffle, and no window over rows."""
    parts = ranged(df.withColumn("_order", order), "_order", *ties)
    before = _before(parts.groupBy("_range").agg(F.count("*").alias("_sum")))
    return parts.join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_in_range") + start).cast("long")).drop("_range", "_in_range", "_before", "_order")


def first_appearance_ids(rows: DataFrame, key: str, place: str) -> DataFrame:
    """(key, id): ids by where a key first appears; ``place`` numbers the rows."""
    return with_dense_id(rows.groupBy(key).agg(F.min(place).alias("_first")), F.col("_first"), key).select(key, "id")


def appended_ids(known: DataFrame, keys: DataFrame, key: str, order: str) -> DataFrame:
    """``known`` (key, id) and new keys behind the largest id; old ids never change."""
    new = keys.join(known, key, "left_anti")
    top = known.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("_top"))
    added = with_dense_id(new, F.col(order), key).crossJoin(F.broadcast(top)).select(key, (F.col("id") + F.col("_top") + 1).alias("id"))
    return known.select(key, "id").unionByName(added)


def hash_order(key: Column, seed: int) -> Column:
    """A fixed pseudo-random number for each key."""
    return F.xxhash64(F.lit(seed), key)


def with_split(keys: DataFrame, key: str, shares: tuple[tuple[str, float], ...], seed: int = 0) -> DataFrame:
    """Adds ``split``: keys in hash order, cut at rounded counts of ``shares``; the last takes the rest."""
    n = keys.agg(F.count("*").alias("_n"))
    placed = with_dense_id(keys.withColumn("_h", hash_order(F.col(key), seed)), F.col("_h"), key, name="_place").crossJoin(F.broadcast(n))
    split, total = F.lit(shares[-1][0]), 0.0
    ends = []
    for name, share in shares[:-1]:
        total += share
        ends.append((name, F.round(F.col("_n") * total)))
    for name, end in reversed(ends):
        split = F.when(F.col("_place") < end, name).otherwise(split)
    return placed.withColumn("split", split).drop("_h", "_place", "_n")


def fixed_sample(rows: DataFrame, key: str, n: int, seed: int = 0, skip: int = 0) -> DataFrame:
    """``n`` rows in hash order behind the first ``skip``: samples of one seed with other skips are disjoint."""
    placed = with_dense_id(rows.withColumn("_h", hash_order(F.col(key), seed)), F.col("_h"), key, name="_place")
    return placed.filter((F.col("_place") >= skip) & (F.col("_place") < skip + n)).drop("_h", "_place")


def sample_to_target(users: DataFrame, weight: str, target: int, seed: int = 0) -> DataFrame:
    """Users in hash order until their summed ``weight`` reaches ``target``."""
    summed = with_running_total(users.withColumn("_h", hash_order(F.col("user"), seed)), F.col(weight), F.col("_h"), "user", name="_total")
    return summed.filter(F.col("_total") - F.col(weight) < target).drop("_h", "_total")


def weighted_draws(weights: DataFrame, draws: DataFrame, seed: int = 0) -> DataFrame:
    """``draws`` (draw) with an ``item`` each, with replacement, in proportion to ``weights`` (item, p).

    A draw's number finds its range of the running sum by an equi-join on a coarse cell,
    so no draw meets all items.
    """
    cells = 1 << 12
    total = weights.agg(F.sum("p").alias("_all"))
    upto = with_running_total(weights, F.col("p"), F.col("item"), name="_hi").crossJoin(F.broadcast(total)).select("item", ((F.col("_hi") - F.col("p")) / F.col("_all")).alias("_lo"), (F.col("_hi") / F.col("_all")).alias("_hi"))
    spread = upto.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") * cells), F.floor(F.least(F.col("_hi"), F.lit(1 - 1e-12)) * cells))))
    numbered = draws.withColumn("_u", (F.pmod(F.xxhash64(F.lit(seed), "draw"), F.lit(1 << 30)) + 0.5) / (1 << 30)).withColumn("_cell", F.floor(F.col("_u") * cells))
    return numbered.join(spread, "_cell").filter("_lo <= _u AND _u < _hi").drop("_cell", "_lo", "_hi", "_u")


def candidate_counts(targets: DataFrame, draws: DataFrame) -> DataFrame:
    """(candidate, place, item, real): a batch's candidate set, all target slots (place, item) and then all draws (place, item).

    A slot without a target (null) stands for item 0 and is not ``real``. Places go on behind the targets'.
    """
    slots = targets.agg(F.coalesce(F.max("place") + 1, F.lit(0)).alias("_slots"))
    own = targets.select(F.lit("target").alias("candidate"), F.col("place").cast("long").alias("place"), F.coalesce("item", F.lit(0)).alias("item"), F.col("item").isNotNull().alias("real"))
    drawn = draws.crossJoin(F.broadcast(slots)).select(F.lit("draw").alias("candidate"), (F.col("place") + F.col("_slots")).cast("long").alias("place"), "item", F.lit(True).alias("real"))
    return own.unionByName(drawn)


def log_q(shares: DataFrame, n_targets: int, n_draws: int) -> DataFrame:
    """(item, log_q): the logarithm of how often an item is expected in a candidate set, as a target and as a draw.

    ``shares``: item, target_share (of targets), draw_share (probability of a draw).
    """
    expected = n_targets * F.col("target_share") + n_draws * F.col("draw_share")
    return shares.select("item", F.log(F.greatest(expected, F.lit(1e-12))).alias("log_q"))


def draw_shares(counts: DataFrame, power: float) -> DataFrame:
    """(item, target_share, draw_share): shares of counts ``n``, and of their ``power``; power 0 gives all items the same."""
    totals = counts.agg(F.sum("n").alias("_all"), F.sum(F.pow(F.col("n").cast("double"), F.lit(float(power)))).alias("_powers"))
    return counts.crossJoin(F.broadcast(totals)).select("item", (F.col("n") / F.col("_all")).alias("target_share"), (F.pow(F.col("n").cast("double"), F.lit(float(power))) / F.col("_powers")).alias("draw_share"))
