"""Queries over archives: listens and orders are written as ``.tar.zst`` dumps and scanned again."""

from __future__ import annotations

from pyspark.sql import functions as F

from sequoria.plans import inputs as i
from sequoria.plans.table_plans import written_files
from sequoria.sources import dumps

STARTED, ENDED = "2024-02-01 00:00:03.250000+00:00", "2024-02-02 00:00:01+00:00"


def archived_listens(spark, sf_dir):
    """Events as JSON listens in archives, read back and parsed; every row has its archive's window."""
    info = F.struct(F.col("event_id").cast("string").alias("recording_mbid"), (F.col("item") * 1000).alias("duration_ms"))
    track = F.struct(F.initcap("event_type").alias("artist_name"), F.when(F.col("event_id") % 11 > 0, F.concat(F.lit("Item "), "item")).otherwise(" ").alias("track_name"), info.alias("additional_info"))
    line = F.when(F.col("event_id") % 13 == 0, "{cut off").otherwise(F.to_json(F.struct(F.col("user").alias("user_id"), F.col("sec").alias("timestamp"), track.alias("track_metadata"))))
    path = written_files(spark)
    dumps.write_archives(i.listens(spark, sf_dir).select(F.year("ts").alias("year"), F.month("ts").alias("month"), line.alias("line")).repartition(4, "line"), path, STARTED, ENDED)
    lines = dumps.archive_lines(spark, path, i.START, i.START + 31 * 86_400)
    windows = lines.groupBy("year", "month").agg(F.date_format(F.min("started"), "yyyy-MM-dd HH:mm:ss.SSS").alias("started"), F.date_format(F.max("ended"), "yyyy-MM-dd HH:mm:ss.SSS").alias("ended"))
    rows = dumps.parsed(lines, i.START + 86_400, i.START + 20 * 86_400)
    return rows.groupBy("reason", "artist").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum("duration_ms").cast("long").alias("ms")).crossJoin(F.broadcast(windows))  # one window


def archived_months(spark, sf_dir):
    """Orders in archives by month; filters on year and month reach the scan, which passes over other members."""
    rows = i.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.concat_ws(",", "o_orderkey", "o_orderstatus").alias("line"))
    path = written_files(spark)
    dumps.write_archives(rows.repartition(3, "line"), path)
    return dumps.archive_lines(spark, path).filter("year = 1995 AND month <= 6").select("year", "month", "line")


def archive_windows(spark, sf_dir):
    """An archive for each region, by the window that its first members tell."""
    path = written_files(spark)
    regions = i.table(spark, sf_dir, "region").select("r_regionkey").collect()  # a folder for each of five regions
    customers = i.table(spark, sf_dir, "customer").select(F.lit(2024).alias("year"), F.lit(1).alias("month"), F.col("c_name").alias("line"), "c_nationkey")
    for (k,) in regions:
        dumps.write_archives(customers.filter(F.col("c_nationkey") % 5 == k).coalesce(1), f"{path}/{k}", f"2024-01-{k + 1:02d} 00:00:00+00:00", f"2024-01-{k + 2:02d} 12:30:00+00:00")
    return dumps.dump_windows(spark, path).select(F.unix_seconds("started").alias("started"), F.unix_seconds("ended").alias("ended"))


QUERIES = {f.__name__: f for f in (archived_listens, archived_months, archive_windows)}

SQL = {
    "archived_listens": f"""WITH {i.LISTENS}, x AS (SELECT CASE WHEN event_id % 13 = 0 THEN 'unreadable' WHEN sec < {i.START + 86_400} OR sec >= {i.START + 20 * 86_400} THEN 'outside the window' WHEN event_id % 11 = 0 THEN 'no artist or title' ELSE 'kept' END AS reason,
        CASE WHEN event_id % 13 > 0 THEN upper(event_type[1]) || event_type[2:] ELSE '' END AS artist, CASE WHEN event_id % 13 > 0 THEN sec END AS ts, CASE WHEN event_id % 13 > 0 THEN item * 1000 ELSE 0 END AS ms FROM l)
        SELECT reason, artist, count(*) AS n, min(ts) AS first, max(ts) AS last, sum(ms)::BIGINT AS ms, 2024 AS year, 1 AS month, '2024-02-01 00:00:03.250' AS started, '2024-02-02 00:00:01.000' AS ended FROM x GROUP BY reason, artist""",
    "archived_months": "SELECT y AS year, m AS month, line FROM (SELECT EXTRACT(year FROM o_orderdate)::INT AS y, EXTRACT(month FROM o_orderdate)::INT AS m, o_orderkey || ',' || o_orderstatus AS line FROM orders) WHERE y = 1995 AND m <= 6",
    "archive_windows": "SELECT epoch(TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * r_regionkey)::BIGINT AS started, epoch(TIMESTAMP '2024-01-02 12:30:00' + INTERVAL 1 DAY * r_regionkey)::BIGINT AS ended FROM region",
}
