"""Queries over updates: versions that are switched, undone and pruned, updates replayed by day, listeners of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sequoria.functions import arrays as a
from sequoria.operators import pairs, replay
from sequoria.plans import inputs as i
from sequoria.plans.table_plans import written_files
from sequoria.sources.tables import written
from sequoria.sources.versions import Versions
from sequoria.streaming import live

#: Days of the month whose listens are the base, and the days that are replayed after it.
BASE_DAYS, DAYS = 20, 30


def _switched(spark: SparkSession, sf_dir: str) -> Versions:
    """Suppliers in a base and three updates: the first goes live, the second is undone, the third is never live."""
    rows = i.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    part = lambda k: {"suppliers": rows.filter(F.col("s_suppkey") % 4 == k)}
    versions = Versions(spark, written_files(spark))
    versions.publish("base", part(0))
    versions.prepare("base")
    versions.flip()
    versions.finish()
    for k in (1, 2):
        versions.publish(f"update-{k}", part(k), versions.state().live)
        versions.prepare(f"update-{k}")
        versions.flip()
        versions.finish()
    versions.undo()
    versions.finish()
    versions.publish("update-3", part(3), "update-2")
    versions.prune(keep=0)
    return versions


def rows_of_versions(spark, sf_dir):
    """Suppliers by nation in each version that is left after pruning, and whether it is live."""
    versions = _switched(spark, sf_dir)
    live_one, nations = versions.state().live, i.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    parts = [versions.table("suppliers", f).select(F.lit(f).alias("version"), F.lit(f == live_one).alias("live"), "s_suppkey") for f in versions.published()]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.join(nations, "s_suppkey").groupBy("version", "live", "s_nationkey").agg(F.count("*").alias("suppliers"))


def rows_after_undo(spark, sf_dir):
    """The live rows after the undo: the base's and the first update's."""
    return _switched(spark, sf_dir).table("suppliers")


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = i.listens(spark, sf_dir).select("user", "sec", "event_id", "item", a.relative_day(F.col("sec"), i.START).cast("int").alias("day"))
    return rows.withColumn("last", F.lag("item").over(Window.partitionBy("user").orderBy("sec", "event_id")))


def replayed_updates(spark, sf_dir):
    """Next items of each day after the base, ranked with the pairs of the days before it, by variant of the update."""
    rows = written(_days(spark, sf_dir).filter("last IS NOT NULL"))
    base = rows.filter(F.col("day") < BASE_DAYS).groupBy(F.col("last").alias("a"), F.col("item").alias("b")).agg(F.count("*").alias("n"))
    daily = rows.filter(F.col("day").between(BASE_DAYS, DAYS)).groupBy("day", F.col("last").alias("a"), F.col("item").alias("b")).agg(F.count("*").alias("n"))
    # an item that only the later days have stands for the new ones: the base does not know items that 10 divides
    base = base.filter("a % 10 > 0 AND b % 10 > 0")
    cases = rows.filter(F.col("day").between(BASE_DAYS, DAYS)).select("day", F.col("event_id").alias("case"), "last", F.col("item").alias("target"))
    out = replay.replay_report(replay.replayed_ranks(replay.variant_pairs(base, daily), cases))
    return out.select("variant", "day", "n", *(F.round(c, 9).alias(c) for c in ("ndcg_10", "difference", "se")))


def replayed_pairs_sum(spark, sf_dir):
    """Counts of an update's pairs by variant."""
    rows = _days(spark, sf_dir).filter("last IS NOT NULL")
    counted = rows.groupBy("day", F.col("last").alias("a"), F.col("item").alias("b")).agg(F.count("*").alias("n"))
    base = counted.filter(F.col("day") < BASE_DAYS).groupBy("a", "b").agg(F.sum("n").alias("n")).filter("a % 10 > 0 AND b % 10 > 0")
    return replay.variant_pairs(base, counted.filter(F.col("day") >= BASE_DAYS)).groupBy("variant", "day").agg(F.count("*").alias("pairs"), F.sum("n").alias("n"))


def replayed_listeners(spark, sf_dir):
    """Events as a stream of five files, each of six days: different users within a week up to each day, by key."""
    folder = written_files(spark)
    rows = i.listens(spark, sf_dir).select(F.col("item").alias("key"), "user", F.timestamp_seconds("sec").alias("ts"), F.floor(a.relative_day(F.col("sec"), i.START) / 6).alias("file"))
    rows.repartition("file").write.partitionBy("file").parquet(f"{folder}/in")
    stream = live.stream_of(spark, f"{folder}/in/*", "key long, user long, ts timestamp")
    live.run_available(live.live_listeners(stream, 7, "7 days"), live.listeners_step(f"{folder}/out"), f"{folder}/ledger")
    out = live.listeners_of(spark, f"{folder}/out")
    return out.select((F.col("day") - F.lit(i.START // 86_400)).alias("day"), "key", "listeners")


QUERIES = {f.__name__: f for f in (rows_of_versions, rows_after_undo, replayed_updates, replayed_pairs_sum, replayed_listeners)}

_DAYS = f"{i.LISTENS}, dd AS (SELECT *, (sec - {i.START}) // 86400 AS day, lag(item) OVER (PARTITION BY \"user\" ORDER BY sec, event_id) AS last FROM l), x AS (SELECT * FROM dd WHERE last IS NOT NULL)"
_VARIANTS = f"""bs AS (SELECT last AS a, item AS b, count(*) AS n FROM x WHERE day < {BASE_DAYS} AND last % 10 > 0 AND item % 10 > 0 GROUP BY ALL), kn AS (SELECT a AS item FROM bs UNION SELECT b FROM bs),
    da AS (SELECT day, last AS a, item AS b, count(*) AS n FROM x WHERE day >= {BASE_DAYS} {{upto}} GROUP BY ALL),
    va AS (SELECT variant, -1 AS day, a, b, n FROM bs, (SELECT unnest(['today', 'all', 'new']) AS variant) UNION ALL SELECT 'all', day, a, b, n FROM da UNION ALL SELECT 'new', day, a, b, n FROM da WHERE a NOT IN (SELECT item FROM kn) OR b NOT IN (SELECT item FROM kn))"""

SQL = {
    "rows_of_versions": "SELECT version, version = 'update-1' AS live, s_nationkey, count(*) AS suppliers FROM supplier, (SELECT unnest([0, 1]) AS k, unnest(['base', 'update-1']) AS version) WHERE s_suppkey % 4 <= k GROUP BY ALL",
    "rows_after_undo": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 4 < 2",
    "replayed_updates": f"""WITH {_DAYS}, {_VARIANTS.format(upto=f'AND day <= {DAYS}')}, ca AS (SELECT day, event_id AS "case", last, item AS target FROM x WHERE day BETWEEN {BASE_DAYS} AND {DAYS}),
        ct AS (SELECT variant, q.day AS onday, q.last, b, sum(n) AS n FROM (SELECT DISTINCT day, last FROM ca) q JOIN va ON va.a = q.last AND va.day < q.day GROUP BY ALL), rk AS (SELECT variant, onday, last, b, row_number() OVER (PARTITION BY variant, onday, last ORDER BY n DESC, b) AS rank FROM ct),
        g AS (SELECT v.variant, ca.day, "case", CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END AS gain FROM ca CROSS JOIN (SELECT DISTINCT variant FROM va) v LEFT JOIN rk ON rk.variant = v.variant AND rk.onday = ca.day AND rk.last = ca.last AND rk.b = ca.target),
        o AS (SELECT day, "case", gain AS other FROM g WHERE variant = 'today')
        SELECT variant, day::INTEGER AS day, count(*) AS n, round(avg(gain), 9) AS ndcg_10, round(avg(gain - other), 9) AS difference, round(stddev_samp(gain - other) / sqrt(count(*)), 9) AS se FROM g JOIN o USING (day, "case") GROUP BY variant, day""",
    "replayed_pairs_sum": f"WITH {_DAYS}, {_VARIANTS.format(upto='')} SELECT variant, day::INTEGER AS day, count(*) AS pairs, sum(n)::BIGINT AS n FROM va GROUP BY variant, day",
    "replayed_listeners": f'WITH {i.LISTENS}, x AS (SELECT DISTINCT (sec - {i.START}) // 86400 AS day, item AS key, "user" FROM l) SELECT p.day, p.key, count(DISTINCT x."user") AS listeners FROM (SELECT DISTINCT day, key FROM x) p JOIN x ON x.key = p.key AND x.day <= p.day AND x.day > p.day - 7 GROUP BY ALL',
}
