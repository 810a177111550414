"""Windows over ordered sequences (seq, pos, item). An item outside the vocabulary has a null ``item`` but keeps its place.

Frames are bounded, so a row holds a window and no sequence meets in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from sequoria.functions import arrays as a


def in_order() -> WindowSpec:
    return Window.partitionBy("seq").orderBy("pos")


def in_run() -> WindowSpec:
    return Window.partitionBy("seq", "run").orderBy("pos")


def in_vocabulary(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Items as ids of ``vocabulary`` (item, id); null outside."""
    return rows.join(vocabulary.select("item", "id"), "item", "left").drop("item").withColumnRenamed("id", "item")


def frequent_items(rows: DataFrame, min_count: int) -> DataFrame:
    """(item, n) of items that occur ``min_count`` times, repeats inside a sequence included."""
    return rows.filter("item IS NOT NULL").groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def long_sequences(rows: DataFrame, min_length: int) -> DataFrame:
    lengths = rows.groupBy("seq").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_length).select("seq")
    return rows.join(lengths, "seq", "left_semi")


def with_runs(rows: DataFrame) -> DataFrame:
    """Known items only, with ``run``: unknown items break a sequence into runs, and ``k``, the place in the run."""
    broken = rows.withColumn("run", F.sum(F.col("item").isNull().cast("int")).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    return broken.filter("item IS NOT NULL").withColumn("k", F.row_number().over(in_run()) - 1)


def fixed_windows(rows: DataFrame, length: int) -> DataFrame:
    """(seq, pos, inputs, target): ``length`` items and the next one, none of them unknown."""
    # unknown items are null and are not gathered, so a full list has none
    framed = rows.withColumn("inputs", F.collect_list("item").over(in_order().rowsBetween(-length, -1)))
    return framed.filter(F.col("item").isNotNull() & (F.size("inputs") == length)).select("seq", "pos", "inputs", F.col("item").alias("target"))


def chunks(rows: DataFrame, length: int) -> DataFrame:
    """(seq, run, chunk, inputs, targets): runs cut into pieces of ``length`` + 1 items that share one; padded with 0 and -100."""
    paired = with_runs(rows).withColumn("_next", F.lead("item").over(in_run())).filter("_next IS NOT NULL")
    grouped = paired.groupBy("seq", "run", F.floor(F.col("k") / length).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("k", "item", "_next"))).alias("_rows"))
    kind = rows.schema["item"].dataType
    side = lambda name, fill: a.padded_right(F.transform("_rows", lambda r: r[name]), length, F.lit(fill).cast(kind))
    return grouped.select("seq", "run", "chunk", side("item", 0).alias("inputs"), side("_next", -100).alias("targets"))


def any_length_cases(rows: DataFrame, length: int) -> DataFrame:
    """(seq, pos, inputs, target): every known item with a known one before it; up to ``length`` items back, not across unknown ones."""
    framed = with_runs(rows).withColumn("inputs", F.collect_list("item").over(in_run().rowsBetween(-length, -1)))
    return framed.filter(F.size("inputs") > 0).select("seq", "pos", "inputs", F.col("item").alias("target"))


def padded_inputs(cases: DataFrame, length: int) -> DataFrame:
    """Adds ``n_inputs``; ``inputs`` are padded with 0 behind."""
    kind = cases.schema["inputs"].dataType.elementType
    return cases.withColumn("n_inputs", F.size("inputs")).withColumn("inputs", a.padded_right(F.col("inputs"), length, F.lit(0).cast(kind)))


def prefix_windows(rows: DataFrame, length: int) -> DataFrame:
    """(seq, pos, inputs): the up to ``length`` items that end at each place."""
    return rows.select("seq", "pos", F.collect_list("item").over(in_order().rowsBetween(1 - length, 0)).alias("inputs"))


def histories(rows: DataFrame, length: int = 100) -> DataFrame:
    """(seq, pos, history): the ``length`` places that end here, unknown ones as -1, padded with -1 in front."""
    kind = rows.schema["item"].dataType
    gathered = F.collect_list(F.coalesce("item", F.lit(-1).cast(kind))).over(in_order().rowsBetween(1 - length, 0))
    return rows.select("seq", "pos", a.padded_left(gathered, length, F.lit(-1).cast(kind)).alias("history"))


def next_targets(rows: DataFrame, n: int) -> DataFrame:
    """(seq, pos, targets): this item and the ``n`` - 1 after it; null past the end, outside the vocabulary or for a repeat."""
    ahead = F.array(*(F.lead("item", d).over(in_order()) if d else F.col("item") for d in range(n)))
    return rows.select("seq", "pos", a.without_repeats(ahead).alias("targets"))


def case_targets(cases: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """``cases`` with ``targets``: ``next_targets`` of their places, without later ones that are inputs."""
    return cases.join(next_targets(rows, n), ["seq", "pos"]).withColumn("targets", a.without_inputs(F.col("targets"), F.col("inputs")))


def last_positions(rows: DataFrame) -> DataFrame:
    """(seq, item, last): where an item last appears in a sequence."""
    return rows.filter("item IS NOT NULL").groupBy("seq", "item").agg(F.max("pos").alias("last"))


def sequence_starts(cases: DataFrame, length: int) -> DataFrame:
    """Cases whose inputs begin a sequence."""
    return cases.filter(F.col("pos") == length)


def augmented(cases: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """``cases`` with some inputs changed, told by a hash of their place: a run of 3 to 5 reordered, a crop, or masked items (0)."""
    draw = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "seq", "pos"), F.lit(1 << 20)) / (1 << 20)).cast("double")
    n = F.size("inputs")
    size = F.least(n, (3 + F.floor(draw(1) * 3)).cast("int"))
    at = F.floor(draw(2) * (n - size + 1)).cast("int")
    run = F.slice("inputs", at + 1, size)
    shuffled = F.transform(F.array_sort(F.transform(run, lambda x, i: F.struct(F.xxhash64(F.lit(seed), F.lit(3), "seq", "pos", i).alias("h"), x.alias("x")))), lambda s: s["x"])
    reordered = F.concat(F.slice("inputs", 1, at), shuffled, F.slice("inputs", at + size + 1, n))
    cropped = F.slice("inputs", at + 1, n - at)
    kind = cases.schema["inputs"].dataType.elementType
    masked = F.transform("inputs", lambda x, i: F.when(F.pmod(F.xxhash64(F.lit(seed), F.lit(4), "seq", "pos", i), F.lit(100)) < 15, F.lit(0).cast(kind)).otherwise(x))
    which = F.floor(draw(5) * 3)
    return cases.withColumn("inputs", F.when(draw(0) >= share, F.col("inputs")).when(which == 0, reordered).when(which == 1, cropped).otherwise(masked))


def as_sequences(rows: DataFrame) -> DataFrame:
    """(seq, items): whole sequences as arrays, for sequences that fit a row (playlists, sessions)."""
    return rows.groupBy("seq").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "item"))), lambda r: r["item"]).alias("items"))


def later_in_sequence(top: DataFrame, last: DataFrame) -> DataFrame:
    """(case, later): share of a case's ranked items that its sequence goes on to hold. ``top``: case, seq, pos, item."""
    joined = top.join(last, ["seq", "item"], "left")
    hit: Column = F.when(F.col("last") >= F.col("pos"), 1.0).otherwise(0.0)
    return joined.groupBy("case").agg(F.avg(hit).alias("later"))
