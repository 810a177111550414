"""Queries over listens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sequoria.functions import arrays as a
from sequoria.functions import text as t
from sequoria.operators import catalog as c
from sequoria.operators import ids, incremental, pairs, personal, ranking, reports
from sequoria.operators import sessions as s
from sequoria.plans import inputs as i
from sequoria.sources import dumps
from sequoria.sources.tables import shared_folder
from sequoria.streaming import live

_SESSIONS = f"""{i.LISTENS}, st AS (SELECT *, coalesce(sec - lag(sec) OVER w > {i.GAP}, true) AS starts, lag(item) OVER w AS before FROM l WINDOW w AS (PARTITION BY "user" ORDER BY sec, event_id)),
se AS (SELECT *, coalesce(before = item, false) AND NOT starts AS repeat, sum(starts::INT) OVER (PARTITION BY "user" ORDER BY sec, event_id) AS session FROM st),
ke AS (SELECT * FROM (SELECT *, sum((NOT repeat)::INT) OVER (PARTITION BY "user", session) AS n FROM se) WHERE NOT repeat AND n >= {i.MIN_LENGTH})"""
UNTIL = i.START + 24 * 86_400


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.with_sessions(i.listens(spark, sf_dir), i.GAP, i.TIES)


def session_starts(spark, sf_dir):
    return _sessions(spark, sf_dir).select("event_id", "user", "starts", "repeat", "session")


def session_keep(spark, sf_dir):
    return s.kept_listens(_sessions(spark, sf_dir), i.MIN_LENGTH).select("event_id", "user", "session", "item")


def session_windows(spark, sf_dir):
    return s.session_windows(i.listens(spark, sf_dir), i.GAP)


def noise_filter(spark, sf_dir):
    return s.without_noise(i.listens(spark, sf_dir), i.START, i.MAX_DAY, i.SKIP, i.TIES).select("event_id", "user", "day")


def rank_from_end(spark, sf_dir):
    return s.with_rank_from_end(i.listens(spark, sf_dir), i.TIES).select("event_id", "user", "from_end")


def most_recent_k(spark, sf_dir):
    return s.most_recent(i.listens(spark, sf_dir), 5, i.TIES).select("event_id", "user", "item")


def users_per_item(spark, sf_dir):
    return s.users_per_item(i.listens(spark, sf_dir))


def _training(spark, sf_dir):
    return i.listens(spark, sf_dir).withColumn("training", F.col("user") % 10 < 7)


def capped_catalog(spark, sf_dir):
    """The catalog and session rules again, under a cap of 40 listens a user."""
    return c.capped_catalog(_training(spark, sf_dir), 40, 3, i.GAP, 2, i.TIES).select("event_id", "user", "session", "item")


def coverage_by_minimum(spark, sf_dir):
    rows = _training(spark, sf_dir)
    out = c.coverage_by_minimum(rows.filter("training"), rows.filter("NOT training"))
    return out.withColumns({"listen_share": F.round("listen_share", 9), "coverage": F.round("coverage", 9)})


def top_session_pairs(spark, sf_dir):
    """Flagship: sessions, their item lists, ordered pairs within 5 places, the most frequent 100."""
    kept = s.kept_listens(_sessions(spark, sf_dir), i.MIN_LENGTH)
    return pairs.pair_counts(s.session_items(kept, i.TIES)).orderBy(F.desc("n"), "a", "b").limit(100)


def user_activity(spark, sf_dir):
    rows = i.listens(spark, sf_dir).withColumn("day", a.relative_day(F.col("sec"), i.START))
    return reports.bot_flags(reports.user_activity(rows, 3600, i.TIES))


def _activity(spark, sf_dir):
    rows = i.listens(spark, sf_dir).withColumn("day", a.relative_day(F.col("sec"), i.START))
    return reports.user_activity(rows, 30, i.TIES)


def top_user_share(spark, sf_dir):
    return reports.top_user_share(_activity(spark, sf_dir), 10).select(F.round("top_share", 9).alias("top_share"))


def cap_table(spark, sf_dir):
    return reports.cap_table(_activity(spark, sf_dir), (1, 10, 50, 100))


def activity_percentiles(spark, sf_dir):
    return reports.percentiles(_activity(spark, sf_dir), "listens", (0.1, 0.5, 0.9, 0.99))


def dump_report(spark, sf_dir):
    return reports.dump_report(_sessions(spark, sf_dir)).withColumn("top_item_share", F.round("top_item_share", 9))


def sane_rates(spark, sf_dir):
    daily = i.listens(spark, sf_dir).groupBy(a.relative_day(F.col("sec"), i.START).alias("day")).agg(F.count("*").cast("double").alias("rate"))
    return reports.sane_rates(daily)


def latency_summary(spark, sf_dir):
    calls = i.listens(spark, sf_dir).select(F.col("event_type").alias("group"), F.col("value").alias("ms"))
    return reports.latency_summary(calls).withColumns({"p50": F.round("p50", 6), "p99": F.round("p99", 6)})


def artist_affinity(spark, sf_dir):
    return personal.artist_affinity(_plays(spark, sf_dir), UNTIL).withColumn("affinity", F.round("affinity", 9))


def _plays(spark, sf_dir):
    return i.listens(spark, sf_dir).withColumns({"artist": F.col("event_type"), "listened": F.col("value") >= 20, "skipped": F.col("item") % 7 == 0})


def skip_rates(spark, sf_dir):
    return personal.skip_rates(_plays(spark, sf_dir).withColumn("item", F.floor(F.col("item") / 100)), UNTIL).withColumn("skip_rate", F.round("skip_rate", 9))


def adjusted_lists(spark, sf_dir):
    """Each user's items by count, moved by affinity for their kind and by skips."""
    plays = _plays(spark, sf_dir)
    counts = plays.groupBy("user", "item", "artist").agg(F.count("*").cast("double").alias("score"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("score"), "item")))
    out = personal.adjusted(ranked, personal.artist_affinity(plays, UNTIL), personal.skip_rates(plays, UNTIL), 0.5, 0.25)
    return out.select("user", "item", F.round("score", 9).alias("score"))


def time_split(spark, sf_dir):
    return personal.time_split(_sessions(spark, sf_dir)).groupBy("user", "part").agg(F.count("*").alias("n"))


def listeners_within(spark, sf_dir):
    rows = i.listens(spark, sf_dir)
    seen = rows.select(((F.floor(F.col("sec") / 86_400) + 1) * 86_400).alias("end"), F.col("item").alias("key"), "user")
    return incremental.listeners_within(seen, i.START + 30 * 86_400, 7)


def rolling_listeners(spark, sf_dir):
    rows = i.listens(spark, sf_dir).select(a.relative_day(F.col("sec"), i.START).alias("day"), F.col("item").alias("key"), "user")
    return incremental.rolling_listeners(rows, 7)


def chained_dumps(spark, sf_dir):
    """Blocks of 500 events as dumps, and their halves as dumps that repeat a part."""
    rows = i.listens(spark, sf_dir)
    whole = rows.groupBy(F.floor(F.col("event_id") / 500).alias("k")).agg(F.min("sec").alias("start"), F.max("sec").alias("end")).select(F.concat(F.lit("whole "), F.lpad(F.col("k").cast("string"), 6, "0")).alias("name"), "start", "end")
    half = rows.filter("event_id % 500 >= 250").groupBy(F.floor(F.col("event_id") / 500).alias("k")).agg(F.min("sec").alias("start"), F.max("sec").alias("end")).select(F.concat(F.lit("half "), F.lpad(F.col("k").cast("string"), 6, "0")).alias("name"), "start", "end")
    return incremental.chained(whole.unionByName(half))


def parsed_listens(spark, sf_dir):
    """Events as JSON lines of listens, read again."""
    info = F.struct(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("https://open.spotify.com/track/"), F.lpad(F.col("item").cast("string"), 22, "a"))).alias("origin_url"), F.when(F.col("event_id") % 2 == 0, F.floor("value").cast("long")).alias("duration_ms"), F.floor("value").cast("long").cast("string").alias("duration"))
    meta = F.struct(F.when(F.col("event_id") % 11 > 0, F.col("event_type")).alias("artist_name"), F.concat(F.lit("Item "), F.col("item").cast("string")).alias("track_name"), info.alias("additional_info"))
    lines = i.listens(spark, sf_dir).select(F.to_json(F.struct(F.col("user").alias("user_id"), F.col("sec").alias("timestamp"), meta.alias("track_metadata"))).alias("line"))
    return dumps.parsed(lines, i.START + 86_400, UNTIL).select("user_id", "ts", "artist", "title", "spotify_id", "duration_ms", "reason")


def stream_pairs(spark, sf_dir):
    """Three dumps of ten days as micro-batches: sessions and pairs of each, added up."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = i.listens(spark, sf_dir).select("user", "sec", "item", "event_id", F.floor(a.relative_day(F.col("sec"), i.START) / 10).alias("dump"))
    rows.repartition("dump").write.partitionBy("dump").parquet(f"{folder}/in")
    source = live.stream_of(spark, f"{folder}/in/*", "user long, sec long, item long, event_id long")
    live.run_available(source, live.dump_step(f"{folder}/out", i.GAP, i.MIN_LENGTH), f"{folder}/ledger")
    return live.pairs_so_far(spark, f"{folder}/out")


def user_split(spark, sf_dir):
    users = i.listens(spark, sf_dir).select("user").distinct()
    return ids.with_split(users, "user", (("train", 0.64), ("validation", 0.16), ("ranker", 0.1), ("test", 0.1))).groupBy("split").agg(F.count("*").alias("n"))


def sampled_users(spark, sf_dir):
    """Users in hash order up to 2,000 listens (a sampling operator)."""
    return ids.sample_to_target(_activity(spark, sf_dir).select("user", "listens"), "listens", 2000)


def cleaned_text(spark, sf_dir):
    return i.table(spark, sf_dir, "documents").select("doc_id", t.clean_text(F.col("text")).alias("text"))


def bootstrap_value(spark, sf_dir):
    """Mean value with an interval, users resampled."""
    return ranking.bootstrap_interval(i.listens(spark, sf_dir), "value", "user", 200)


QUERIES = {f.__name__: f for f in (session_starts, session_keep, session_windows, noise_filter, rank_from_end, most_recent_k, users_per_item, capped_catalog, coverage_by_minimum, top_session_pairs, user_activity, top_user_share, cap_table, activity_percentiles, dump_report, sane_rates, latency_summary, artist_affinity, skip_rates, adjusted_lists, time_split, listeners_within, rolling_listeners, chained_dumps, parsed_listens, stream_pairs, user_split, sampled_users, cleaned_text, bootstrap_value)}

_W = 'WINDOW w AS (PARTITION BY "user" ORDER BY sec, event_id)'
_ACTIVITY = f"""{i.LISTENS}, g AS (SELECT "user", ((sec - {i.START}) // 86400)::INT AS day, sec - lag(sec) OVER w AS gap FROM l {_W}),
ac AS (SELECT "user", sum(n)::BIGINT AS listens, sum(g)::BIGINT AS gaps, sum(s)::BIGINT AS short_gaps, sum(z)::BIGINT AS zero_gaps, max(n) AS busiest_day FROM (SELECT "user", day, count(*) AS n, count(gap) AS g, count(*) FILTER (gap < 3600) AS s, count(*) FILTER (gap = 0) AS z FROM g GROUP BY ALL) GROUP BY "user")"""
_WEIGHT = f"pow(0.5, ({UNTIL} - sec) / (30.0 * 86400))"
_AFFINITY = f"""w AS (SELECT "user", event_type AS artist, ln(1 + sum({_WEIGHT})) AS w FROM l WHERE sec < {UNTIL} AND value >= 20 GROUP BY ALL), af AS (SELECT "user", artist, w / greatest(max(w) OVER (PARTITION BY "user"), 1e-9) AS affinity FROM w)"""


def _skips(item: str) -> str:
    return f"""sk AS (SELECT "user", {item} AS item, count(*) AS plays, CASE WHEN count(*) >= 3 THEN count(*) FILTER (l.item % 7 = 0 OR value < 20) / count(*) ELSE 0.0 END AS skip_rate FROM l WHERE sec < {UNTIL} GROUP BY "user", {item})"""


SQL = {
    "session_starts": f"WITH {_SESSIONS} SELECT event_id, \"user\", starts, repeat, session::BIGINT AS session FROM se",
    "session_keep": f"WITH {_SESSIONS} SELECT event_id, \"user\", session::BIGINT AS session, item FROM ke",
    "session_windows": f"WITH {_SESSIONS} SELECT \"user\", min(sec) AS begin, max(sec) AS \"end\", count(*) AS n FROM (SELECT *, sum(st2::INT) OVER (PARTITION BY \"user\" ORDER BY ts) AS s2 FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY \"user\" ORDER BY ts) > INTERVAL {i.GAP} SECOND, true) AS st2 FROM l)) GROUP BY \"user\", s2",
    "noise_filter": f"WITH {i.LISTENS}, d AS (SELECT *, ((sec - {i.START}) // 86400)::INT AS day FROM l), x AS (SELECT *, count(*) OVER (PARTITION BY \"user\", day) AS n, lag(sec) OVER w AS b, lead(sec) OVER w AS f FROM d {_W}) SELECT event_id, \"user\", day FROM x WHERE n <= {i.MAX_DAY} AND coalesce(sec <> b, true) AND NOT coalesce(f - sec > 0 AND f - sec < {i.SKIP}, false)",
    "rank_from_end": f"WITH {i.LISTENS} SELECT event_id, \"user\", row_number() OVER (PARTITION BY \"user\" ORDER BY sec DESC, event_id DESC) - 1 AS from_end FROM l",
    "most_recent_k": f"WITH {i.LISTENS} SELECT event_id, \"user\", item FROM l QUALIFY row_number() OVER (PARTITION BY \"user\" ORDER BY sec DESC, event_id DESC) <= 5",
    "users_per_item": f"WITH {i.LISTENS} SELECT item, count(DISTINCT \"user\") AS users FROM l GROUP BY item",
    "capped_catalog": f"""WITH {i.LISTENS}, r AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY sec DESC, event_id DESC) <= 40),
        ca AS (SELECT item FROM r WHERE "user" % 10 < 7 GROUP BY item HAVING count(DISTINCT "user") >= 3), x AS (SELECT * FROM r WHERE item IN (SELECT item FROM ca)),
        st AS (SELECT *, coalesce(sec - lag(sec) OVER w > {i.GAP}, true) AS starts, lag(item) OVER w AS before FROM x {_W}),
        se AS (SELECT *, coalesce(before = item, false) AND NOT starts AS repeat, sum(starts::INT) OVER w AS session FROM st {_W})
        SELECT event_id, "user", session::BIGINT AS session, item FROM (SELECT *, sum((NOT repeat)::INT) OVER (PARTITION BY "user", session) AS n FROM se) WHERE NOT repeat AND n >= 2""",
    "coverage_by_minimum": f"""WITH {i.LISTENS}, tr AS (SELECT item, count(DISTINCT "user") AS users, count(*) AS n FROM l WHERE "user" % 10 < 7 GROUP BY item), he AS (SELECT item, count(*) AS h FROM l WHERE "user" % 10 >= 7 GROUP BY item),
        b AS (SELECT coalesce(users, 0) AS users, coalesce(n, 0) AS n, coalesce(h, 0) AS h FROM tr FULL JOIN he USING (item)), m AS (SELECT unnest([1, 2, 3, 5, 10, 20]) AS min_users)
        SELECT min_users, count(*) FILTER (users >= min_users) AS items, round(coalesce(sum(n) FILTER (users >= min_users), 0) / sum(n), 9) AS listen_share, round(coalesce(sum(h) FILTER (users >= min_users), 0) / sum(h), 9) AS coverage FROM b, m GROUP BY min_users""",
    "top_session_pairs": f"WITH {_SESSIONS}, p AS (SELECT \"user\", session, item, row_number() OVER (PARTITION BY \"user\", session ORDER BY sec, event_id) AS pos FROM ke) SELECT x.item AS a, y.item AS b, count(*) AS n FROM p x JOIN p y ON x.\"user\" = y.\"user\" AND x.session = y.session AND y.pos BETWEEN x.pos + 1 AND x.pos + 5 GROUP BY ALL ORDER BY n DESC, a, b LIMIT 100",
    "user_activity": f"WITH {_ACTIVITY} SELECT *, busiest_day > 1000 AS busy, listens >= 1000 AND short_gaps > 0.5 * gaps AS rapid, listens >= 100 AND zero_gaps > 0.5 * gaps AS same_second FROM ac",
    "top_user_share": f"WITH {_ACTIVITY} SELECT round(sum(listens) FILTER (k <= greatest(1, n // 10)) / sum(listens), 9) AS top_share FROM (SELECT listens, row_number() OVER (ORDER BY listens DESC, \"user\") AS k, count(*) OVER () AS n FROM ac)",
    "cap_table": f"WITH {_ACTIVITY} SELECT cap, sum(least(listens, cap))::BIGINT AS listens FROM ac, (SELECT unnest([1, 10, 50, 100]) AS cap) GROUP BY cap",
    "activity_percentiles": f"WITH {_ACTIVITY} SELECT point, trunc(value)::BIGINT AS value FROM (SELECT unnest([0.1, 0.5, 0.9, 0.99]::DOUBLE[]) AS point, unnest(quantile_cont(listens, [0.1, 0.5, 0.9, 0.99])) AS value FROM ac)",
    "dump_report": f"WITH {_SESSIONS} SELECT (SELECT count(*) FROM l) AS listens, (SELECT count(DISTINCT \"user\") FROM l) AS users, (SELECT count(*) FROM se WHERE starts) AS sessions, (SELECT count(DISTINCT item) FROM l) AS items, round((SELECT max(n) FROM (SELECT count(*) AS n FROM l GROUP BY item)) / (SELECT count(*) FROM l), 9) AS top_item_share",
    "sane_rates": f"WITH {i.LISTENS}, d AS (SELECT ((sec - {i.START}) // 86400)::INT AS day, count(*)::DOUBLE AS rate FROM l GROUP BY ALL), m AS (SELECT *, median(rate) OVER (ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS mid FROM d) SELECT day, rate, coalesce(rate BETWEEN 0.3 * mid AND 3 * mid, true) AS sane FROM m",
    "latency_summary": "WITH e AS (SELECT event_type AS \"group\", value AS ms, (SELECT quantile_cont(value, 0.99) FROM events) AS lim FROM events) SELECT \"group\", count(*) AS n, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.99), 6) AS p99, count(*) FILTER (ms > lim) AS slow_n FROM e GROUP BY ALL",
    "artist_affinity": f"WITH {i.LISTENS}, {_AFFINITY} SELECT \"user\", artist, round(affinity, 9) AS affinity FROM af",
    "skip_rates": f"WITH {i.LISTENS}, {_skips('l.item // 100')} SELECT \"user\", item, plays, round(skip_rate, 9) AS skip_rate FROM sk",
    "adjusted_lists": f"WITH {i.LISTENS}, {_AFFINITY}, {_skips('l.item')} SELECT x.\"user\", x.item, round(x.n + 0.5 * coalesce(affinity, 0) - 0.25 * coalesce(skip_rate, 0), 9) AS score FROM (SELECT \"user\", item, event_type AS artist, count(*)::DOUBLE AS n FROM l GROUP BY ALL) x LEFT JOIN af ON af.\"user\" = x.\"user\" AND af.artist = x.artist LEFT JOIN sk ON sk.\"user\" = x.\"user\" AND sk.item = x.item",
    "time_split": f"WITH {_SESSIONS}, b AS (SELECT \"user\", min(sec) OVER (PARTITION BY \"user\", session) AS b, min(sec) OVER (PARTITION BY \"user\") AS lo, max(sec) OVER (PARTITION BY \"user\") AS hi FROM se), t AS (SELECT \"user\", (b - lo) / greatest(hi - lo, 1)::DOUBLE AS place FROM b) SELECT \"user\", CASE WHEN place >= 1 - 0.1::DOUBLE THEN 'test' WHEN place >= 1 - 0.1::DOUBLE - 0.1::DOUBLE THEN 'tune' ELSE 'before' END AS part, count(*) AS n FROM t GROUP BY ALL",
    "listeners_within": f"WITH {i.LISTENS} SELECT item AS key, count(DISTINCT \"user\") AS listeners FROM l WHERE (sec // 86400 + 1) * 86400 > {i.START + 23 * 86_400} GROUP BY item",
    "rolling_listeners": f"WITH {i.LISTENS}, d AS (SELECT DISTINCT ((sec - {i.START}) // 86400)::INT AS day, item AS key, \"user\" FROM l) SELECT x.day, x.key, count(DISTINCT y.\"user\") AS listeners FROM (SELECT DISTINCT day, key FROM d) x JOIN d y ON y.key = x.key AND y.day <= x.day AND y.day > x.day - 7 GROUP BY ALL",
    "parsed_listens": f"""WITH {i.LISTENS}, x AS (SELECT "user" AS user_id, sec AS ts, CASE WHEN event_id % 11 > 0 THEN event_type ELSE '' END AS artist, 'Item ' || item AS title,
        CASE WHEN event_id % 3 = 0 THEN lpad(item::VARCHAR, 22, 'a') ELSE '' END AS spotify_id, CASE WHEN event_id % 2 = 0 AND floor(value) > 0 THEN floor(value)::BIGINT ELSE floor(value)::BIGINT * 1000 END AS duration_ms FROM l)
        SELECT *, CASE WHEN ts < {i.START + 86_400} OR ts >= {UNTIL} THEN 'outside the window' WHEN artist = '' THEN 'no artist or title' ELSE 'kept' END AS reason FROM x""",
    "stream_pairs": f"""WITH {i.LISTENS}, d AS (SELECT *, ((sec - {i.START}) // 86400) // 10 AS dump FROM l),
        st AS (SELECT *, coalesce(sec - lag(sec) OVER w > {i.GAP}, true) AS starts, lag(item) OVER w AS before FROM d WINDOW w AS (PARTITION BY dump, "user" ORDER BY sec, item)),
        se AS (SELECT *, coalesce(before = item, false) AND NOT starts AS repeat, sum(starts::INT) OVER (PARTITION BY dump, "user" ORDER BY sec, item ROWS UNBOUNDED PRECEDING) AS session FROM st),
        ke AS (SELECT * FROM (SELECT *, sum((NOT repeat)::INT) OVER (PARTITION BY dump, "user", session) AS n FROM se) WHERE NOT repeat AND n >= {i.MIN_LENGTH}),
        p AS (SELECT dump, "user", session, item, row_number() OVER (PARTITION BY dump, "user", session ORDER BY sec, item) AS pos FROM ke)
        SELECT x.item AS a, y.item AS b, count(*) AS n FROM p x JOIN p y ON x.dump = y.dump AND x."user" = y."user" AND x.session = y.session AND y.pos BETWEEN x.pos + 1 AND x.pos + 5 GROUP BY ALL""",
    "user_split": "WITH n AS (SELECT count(DISTINCT user_id) AS n FROM events), e AS (SELECT n, round(n * 0.64) AS a, round(n * 0.8) AS b, round(n * 0.9) AS c FROM n) SELECT unnest(['train', 'validation', 'ranker', 'test']) AS split, unnest([a, b - a, c - b, n - c])::BIGINT AS n FROM e",
    "chained_dumps": f"""WITH RECURSIVE {i.LISTENS}, w AS (SELECT 'whole ' || lpad((event_id // 500)::VARCHAR, 6, '0') AS name, min(sec)::DOUBLE AS start, max(sec)::DOUBLE AS "end" FROM l GROUP BY event_id // 500 UNION ALL SELECT 'half ' || lpad((event_id // 500)::VARCHAR, 6, '0'), min(sec)::DOUBLE, max(sec)::DOUBLE FROM l WHERE event_id % 500 >= 250 GROUP BY event_id // 500),
        o AS (SELECT *, row_number() OVER (ORDER BY start, "end", name) AS rn FROM w),
        c AS (SELECT 0::BIGINT AS rn, NULL::VARCHAR AS name, NULL::DOUBLE AS start, NULL::DOUBLE AS "end", NULL::VARCHAR AS status, NULL::DOUBLE AS gap_from, NULL::DOUBLE AS upto
          UNION ALL SELECT o.rn, o.name, o.start, o."end", CASE WHEN o.start < upto - 1 THEN 'skipped' ELSE 'used' END, CASE WHEN o.start > upto + 1 THEN upto END, CASE WHEN o.start < upto - 1 THEN upto ELSE o."end" END FROM c JOIN o ON o.rn = c.rn + 1)
        SELECT name, start, "end", status, gap_from FROM c WHERE rn > 0""",
}
