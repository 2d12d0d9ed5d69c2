"""Registered queries: each applies an operator to whole driver tables, beside SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import scalars as S
from tidegrid.operators import clean, climatology, evaluate, grids, harmonics, spectrum, stats, timeline
from tidegrid.plans import compose
from tidegrid.session import bounded_batches, shared_folder
from tidegrid.streaming import frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR, CADENCE = 3600, 7200
DAY, WEEK = 86400, 604800


def query(name: str, sql: str | None):
    """Register a query with its oracle; None where SQL can't express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, t, event_type, value): events as an irregular series of epoch seconds."""
    return read(spark, sf_dir, "events").select("event_id", S.epoch_seconds(F.col("ts")).alias("t"), "event_type", F.col("value").cast("double").alias("value"))


EV = "ev AS (SELECT event_id, epoch_us(ts) // 1000000 AS t, event_type, value FROM events)"


def hourly(spark: SparkSession, sf_dir: str, step: int = HOUR) -> DataFrame:
    """(t, value): events in steps of an hour, by their mean."""
    ev = event_rows(spark, sf_dir)
    return ev.groupBy((F.floor(F.col("t") / step) * step).alias("t")).agg(F.avg("value").alias("value"))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, value): one row for each day with orders, t its first second."""
    o = read(spark, sf_dir, "orders").select(S.epoch_seconds(F.col("o_orderdate")).alias("s"), "o_totalprice")
    return o.groupBy((F.floor(F.col("s") / DAY) * DAY).alias("t")).agg(F.avg("o_totalprice").alias("value"), F.count("*").alias("n"))


def weekly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, value): one row for each week with orders, weeks counted from the epoch."""
    o = read(spark, sf_dir, "orders").select(S.epoch_seconds(F.col("o_orderdate")).alias("s"), "o_totalprice")
    return o.groupBy((F.floor(F.col("s") / WEEK) * WEEK).alias("t")).agg(F.avg("o_totalprice").alias("value"), F.count("*").alias("n"))


DAILY = (
    "d AS (SELECT (epoch_us(o_orderdate) // 1000000) // 86400 * 86400 AS t, avg(o_totalprice) AS value, count(*) AS n "
    "FROM orders GROUP BY 1)"
)
WEEKLY = DAILY.replace("86400", "604800")
SPLIT_1, SPLIT_2 = 883612800, 915148800  # 1998-01-01, 1999-01-01


# --- cleaning, manifests ---------------------------------------------------------------------------------------------


@query(
    "q_sentinel_mask",
    """SELECT event_id, CASE WHEN value < 400 THEN value END AS below_fill, CASE WHEN value - 50 >= 0 THEN value - 50 END AS not_negative,
       CASE WHEN value <= 300 THEN value END AS no_spike FROM events""",
)
def q_sentinel_mask(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    v = F.col("value")
    return e.select(
        "event_id",
        clean.mask_from(v, 400).alias("below_fill"),
        clean.mask_negative(v - 50).alias("not_negative"),
        clean.mask_above(v, 300).alias("no_spike"),
    )


@query(
    "q_sentinel_scaled",
    """SELECT o_orderkey, list_transform([o_custkey, 9999, o_orderkey], lambda x: CASE WHEN x <> 9999 THEN x * 0.1::DOUBLE END) AS scaled FROM orders""",
)
def q_sentinel_scaled(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", clean.mask_equal_scaled(F.array("o_custkey", F.lit(9999).cast("long"), "o_orderkey"), 9999, -1).alias("scaled"))


@query(
    "q_last_row_wins",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
       ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS k FROM lineitem) WHERE k = 1""",
)
def q_last_row_wins(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return clean.last_row_wins(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a download log: priority as source, day as key, status from the order's."""
    o = read(spark, sf_dir, "orders")
    failed = F.col("o_orderstatus") == "F"
    return o.select(
        F.col("o_orderpriority").alias("source"),
        S.day_key(F.to_date("o_orderdate")).alias("key"),
        F.when(failed, "failed").otherwise("downloaded").alias("status"),
        F.when(failed & (F.col("o_orderkey") % 3 == 0), "404").when(failed, "timeout").alias("reason"),
        F.col("o_orderkey").alias("seq"),
    )


MANIFEST = """m AS (SELECT o_orderpriority AS source, strftime(o_orderdate, '%Y-%j') AS key,
    CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'downloaded' END AS status,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN '404' WHEN o_orderstatus = 'F' THEN 'timeout' END AS reason, o_orderkey AS seq FROM orders)"""


@query(
    "q_coverage_report",
    f"""WITH {MANIFEST} SELECT source, count(*) AS total, count(*) FILTER (status IN ('present', 'downloaded')) AS present,
        count(*) FILTER (status = 'failed' AND reason = '404') AS gaps_404,
        count(*) FILTER (status = 'failed' AND reason IS DISTINCT FROM '404') AS other_failures FROM m GROUP BY source""",
)
def q_coverage_report(spark, sf_dir):
    m = manifest(spark, sf_dir)
    return clean.coverage(m, m.select("source", "key"))


@query(
    "q_topk_failures",
    f"""WITH {MANIFEST} SELECT source, seq, reason FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS k FROM m WHERE status = 'failed')
        WHERE k <= 5""",
)
def q_topk_failures(spark, sf_dir):
    m = manifest(spark, sf_dir).where(F.col("status") == "failed")
    return evaluate.first_n(m, ["source"], [F.col("seq")], 5).select("source", "seq", "reason")


@query(
    "q_resume_antijoin",
    f"""WITH {MANIFEST}, c AS (SELECT strftime(d, '%Y-%j') AS key FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2002-12-31', INTERVAL 1 DAY) AS g(d))
        SELECT key FROM c WHERE key NOT IN (SELECT key FROM m WHERE status IN ('present', 'downloaded') OR (status = 'failed' AND reason = '404'))""",
)
def q_resume_antijoin(spark, sf_dir):
    wanted = clean.calendar(spark, "1995-01-01", "2002-12-31").select(S.day_key(F.col("day")).alias("key"))
    return clean.unresolved(wanted, manifest(spark, sf_dir))


@query(
    "q_http_classify",
    """SELECT code, outcome, count(*) AS n FROM (SELECT code, CASE WHEN code = 404 THEN '404' WHEN code IN (401, 403) THEN 'auth'
       WHEN code <> 200 THEN 'http_' || code WHEN size < 2048 THEN 'bad_content:too_small' WHEN html THEN 'bad_content:html_page' ELSE 'ok' END AS outcome
       FROM (SELECT [200, 404, 401, 503, 200][event_id % 5 + 1] AS code, (value * 20)::BIGINT AS size, event_id % 7 = 0 AS html FROM events)) GROUP BY ALL""",
)
def q_http_classify(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    code = F.element_at(F.array(*[F.lit(c) for c in (200, 404, 401, 503, 200)]), (F.col("event_id") % 5 + 1).cast("int"))
    body = F.when(F.col("event_id") % 7 == 0, "<html>").otherwise("data")
    e = e.select(code.alias("code"), S.download_outcome(code, F.rint(F.col("value") * 20).cast("long"), body).alias("outcome"))
    return e.groupBy("code", "outcome").agg(F.count("*").alias("n"))


@query(
    "q_html_sniff",
    """SELECT page_id, starts_with(h, '<!doctype') OR starts_with(h, '<!DOCTYPE') OR starts_with(h, '<html') OR starts_with(h, '<HTML') AS is_html
       FROM (SELECT page_id, regexp_replace(substr(html, 1, 256), '^[ \\t\\r\\n]+', '') AS h FROM pages)""",
)
def q_html_sniff(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", S.is_html(F.col("html")).alias("is_html"))


@query(
    "q_url_templates",
    """SELECT day, strftime(day, '%Y-%j') AS key, CASE WHEN day < DATE '2023-08-07' THEN 'abcg' || strftime(day, '%j') || '0.' || strftime(day, '%y') || 'i.Z'
       ELSE 'ABC0OPSFIN_' || strftime(day, '%Y%j') || '0000_01D_02H_GIM.INX.gz' END AS first_name
       FROM (SELECT DISTINCT (o_orderdate + INTERVAL 9132 DAY)::DATE AS day FROM orders)""",
)
def q_url_templates(spark, sf_dir):
    # 25 years later, so that the days lie on both sides of the change of names.
    days = read(spark, sf_dir, "orders").select(F.date_add(F.to_date("o_orderdate"), 9132).alias("day")).distinct()
    return days.select("day", S.day_key(F.col("day")).alias("key"), S.map_file_names(F.col("day"), "ABC")[0].alias("first_name"))


@query(
    "q_url_order",
    """SELECT day, CASE WHEN day < DATE '2023-08-07' THEN [s, l] ELSE [l, s] END AS names FROM (SELECT d AS day,
       'abcg' || strftime(d, '%j') || '0.' || strftime(d, '%y') || 'i.Z' AS s, 'ABC0OPSFIN_' || strftime(d, '%Y%j') || '0000_01D_02H_GIM.INX.gz' AS l
       FROM (SELECT DISTINCT (l_shipdate + INTERVAL 9132 DAY)::DATE AS d FROM lineitem))""",
)
def q_url_order(spark, sf_dir):
    days = read(spark, sf_dir, "lineitem").select(F.date_add(F.to_date("l_shipdate"), 9132).alias("day")).distinct()
    return days.select("day", S.map_file_names(F.col("day"), "ABC").alias("names"))


@query(
    "q_epoch_calendar",
    """SELECT event_id, t, strftime(ts, '%Y-%m-%d') AS day, ((t % 86400) / 3600.0)::DOUBLE AS ut, epoch(date_trunc('year', ts))::BIGINT AS year_epoch,
       strftime(ts, '%Y-%j') AS key FROM (SELECT event_id, ts, epoch_us(ts) // 1000000 AS t FROM events)""",
)
def q_epoch_calendar(spark, sf_dir):
    e = event_rows(spark, sf_dir)
    day = S.epoch_date(F.col("t"))
    return e.select(
        "event_id",
        "t",
        F.date_format(day, "yyyy-MM-dd").alias("day"),
        S.ut_hours(F.col("t")).alias("ut"),
        S.year_start(F.year(day)).alias("year_epoch"),
        S.day_key(day).alias("key"),
    )


@query(
    "q_stamp_parts",
    """SELECT event_id, epoch_us(date_trunc('minute', ts)) // 1000000 AS stamp, strftime(ts, '%Y-%m-%d') AS key_day FROM events""",
)
def q_stamp_parts(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    s = S.stamp(F.year("ts"), F.dayofyear("ts"), F.hour("ts"), F.minute("ts"))
    return e.select("event_id", s.alias("stamp"), F.date_format(S.key_day(S.day_key(F.to_date("ts"))), "yyyy-MM-dd").alias("key_day"))


@query(
    "q_index_3hourly",
    """SELECT epoch_us(time_bucket(INTERVAL 3 HOUR, ts)) // 1000000 AS t, round_even(max(value) / 50 * 10, 0) / 10 AS kp FROM events
       GROUP BY 1""",
)
def q_index_3hourly(spark, sf_dir):
    e = event_rows(spark, sf_dir)
    per = e.groupBy((F.floor(F.col("t") / 10800) * 10800).alias("t")).agg(F.max("value").alias("v"))
    return per.select("t", S.one_decimal(F.col("v") / 50).alias("kp"))


@query("q_duplicate_mean", f"WITH {EV} SELECT t // 3600 * 3600 AS t, event_type, round(avg(value), 6) AS value FROM ev GROUP BY 1, 2")
def q_duplicate_mean(spark, sf_dir):
    e = event_rows(spark, sf_dir).withColumn("t", F.floor(F.col("t") / HOUR) * HOUR)
    return clean.mean_of_repeats(e, ["t", "event_type"], ["value"]).withColumn("value", r6("value"))


@query(
    "q_epoch_dedupe",
    f"""WITH {EV} SELECT t, event_id, value FROM (SELECT t // 1800 * 1800 AS t, event_id, value, row_number() OVER (PARTITION BY t // 1800 ORDER BY event_id) AS k
        FROM ev) WHERE k = 1""",
)
def q_epoch_dedupe(spark, sf_dir):
    e = event_rows(spark, sf_dir).select((F.floor(F.col("t") / 1800) * 1800).alias("t"), "event_id", "value")
    return timeline.dedupe_epochs(e, "t", "event_id")


@query(
    "q_dup_disagreement",
    f"""WITH {EV}, p AS (SELECT value, lag(value) OVER w AS prev, row_number() OVER w AS k FROM ev WINDOW w AS (PARTITION BY t // 1800 ORDER BY event_id))
        SELECT count(*) AS repeats, round(max(abs(value - prev)), 6) AS max_diff, round(avg(abs(value - prev)), 6) AS mean_diff,
        round(avg(abs(value - prev)) / avg(abs(prev)), 6) AS relative_diff FROM p WHERE k > 1""",
)
def q_dup_disagreement(spark, sf_dir):
    e = event_rows(spark, sf_dir).select(F.floor(F.col("t") / 1800).alias("t"), "event_id", "value")
    d = timeline.repeat_disagreement(e, "t", "event_id", "value")
    return d.select("repeats", *[r6(c).alias(c) for c in ("max_diff", "mean_diff", "relative_diff")])


@query(
    "q_daily_spike_interp",
    """WITH d AS (SELECT epoch_us(date_trunc('day', ts)) // 1000000 AS t, max(value) AS m FROM events GROUP BY 1),
       x AS (SELECT t, CASE WHEN m <= 300 THEN m END AS v, CASE WHEN m <= 300 THEN t END AS k FROM d),
       n AS (SELECT t, last_value(v IGNORE NULLS) OVER b AS pv, last_value(k IGNORE NULLS) OVER b AS pt, first_value(v IGNORE NULLS) OVER a AS nv,
             first_value(k IGNORE NULLS) OVER a AS nt FROM x WINDOW b AS (ORDER BY t ROWS UNBOUNDED PRECEDING),
             a AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
       SELECT t, round(CASE WHEN pt IS NULL THEN NULL WHEN nt IS NULL OR nt = pt THEN pv ELSE pv + (nv - pv) * (t - pt) / (nt - pt) END, 6) AS value FROM n""",
)
def q_daily_spike_interp(spark, sf_dir):
    e = event_rows(spark, sf_dir)
    d = e.groupBy((F.floor(F.col("t") / DAY) * DAY).alias("t")).agg(clean.mask_above(F.max("value"), 300).alias("value"))
    return timeline.fill_forward_linear(d, "t", "value").select("t", r6("value").alias("value"))


@query(
    "q_seasonal_signature",
    """SELECT round(j, 6) AS january, round(y, 6) AS july, coalesce(j > 1.015 AND y < 0.985, false) AS observed FROM (
       SELECT avg(o_totalprice / (o_totalprice + 1000)) FILTER (month(o_orderdate) = 1) AS j,
       avg(o_totalprice / (o_totalprice + 1000)) FILTER (month(o_orderdate) = 7) AS y FROM orders)""",
)
def q_seasonal_signature(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("adj", F.col("o_totalprice") + 1000)
    s = stats.seasonal_ratio(o, "o_orderdate", "o_totalprice", "adj")
    return s.select(r6("january").alias("january"), r6("july").alias("july"), "observed")


# --- alignment -------------------------------------------------------------------------------------------------------

#: The kinds of events in the given table.
CHANNEL_NAMES = ("click", "error", "purchase", "signup", "view")

CHANNELS = """ch AS (SELECT event_type, t, avg(value) AS v FROM ev GROUP BY 1, 2),
    fr AS (SELECT DISTINCT t // 3600 * 3600 AS t FROM ev), ft AS (SELECT event_type, fr.t FROM fr, (SELECT DISTINCT event_type FROM ev)),
    u AS (SELECT event_type, t, max(v) AS v, max(f) AS f FROM (SELECT event_type, t, v, 0 AS f FROM ch UNION ALL SELECT event_type, t, NULL, 1 FROM ft) GROUP BY 1, 2),
    n AS (SELECT event_type, t, f, last_value(v IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS pt,
          first_value(v IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER a AS nt FROM u
          WINDOW b AS (PARTITION BY event_type ORDER BY t ROWS UNBOUNDED PRECEDING),
          a AS (PARTITION BY event_type ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def channel_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = event_rows(spark, sf_dir)
    frames = ev.select((F.floor(F.col("t") / HOUR) * HOUR).alias("t")).distinct()
    types = ev.select("event_type").distinct()
    by_type = types.withColumn("_one", F.lit(1)).join(frames.withColumn("_one", F.lit(1)), "_one").drop("_one")  # a handful of channels
    return ev, by_type


@query(
    "q_align_interp",
    f"""WITH {EV}, {CHANNELS} SELECT event_type, t, round(CASE WHEN least(t - pt, nt - t) <= 1800 THEN CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL THEN pv
        WHEN pt = nt THEN pv ELSE pv + (nv - pv) * (t - pt) / (nt - pt) END END, 6) AS value, coalesce(least(t - pt, nt - t) > 0, true) AS imputed,
        least(t - pt, nt - t) AS gap_s FROM n WHERE f = 1""",
)
def q_align_interp(spark, sf_dir):
    obs, frames = channel_rows(spark, sf_dir)
    out = timeline.align_interpolated(obs, frames, "t", "value", 1800, ["event_type"])
    return out.withColumn("value", r6("value"))


@query(
    "q_align_ffill",
    f"""WITH {EV}, k AS (SELECT t // 10800 * 10800 AS t, max(value) AS v FROM ev GROUP BY 1), fr AS (SELECT DISTINCT t // 3600 * 3600 AS t FROM ev)
        SELECT fr.t, CASE WHEN fr.t - k.t <= 10800 THEN k.v END AS value, coalesce(fr.t - k.t > 0, true) AS imputed FROM fr ASOF LEFT JOIN k ON fr.t >= k.t""",
)
def q_align_ffill(spark, sf_dir):
    ev = event_rows(spark, sf_dir)
    kp = ev.groupBy((F.floor(F.col("t") / 10800) * 10800).alias("t")).agg(F.max("value").alias("value"))
    frames = ev.select((F.floor(F.col("t") / HOUR) * HOUR).alias("t")).distinct()
    return timeline.align_carried(kp, frames, "t", "value", 10800)


@query(
    "q_driver_quality",
    f"""WITH {EV}, {CHANNELS} SELECT event_type, round(avg((coalesce(g > 0, true))::INT), 6) AS imputed_share,
        round(avg((NOT coalesce(g <= 1800, false))::INT), 6) AS outage_share, count(*) AS frames FROM (SELECT event_type, least(t - pt, nt - t) AS g FROM n WHERE f = 1) GROUP BY 1""",
)
def q_driver_quality(spark, sf_dir):
    obs, frames = channel_rows(spark, sf_dir)
    q = stats.driver_quality(timeline.align_interpolated(obs, frames, "t", "value", 1800, ["event_type"]), "event_type", "value")
    return q.select("event_type", r6("imputed_share").alias("imputed_share"), r6("outage_share").alias("outage_share"), "frames")


@query(
    "q_fallback_days",
    """WITH d AS (SELECT ts::DATE AS day, avg(value) AS v FROM events GROUP BY 1), w AS (SELECT day FROM d UNION SELECT day + 1 FROM d)
        SELECT strftime(w.day, '%Y-%m-%d') AS day, round(coalesce(a.v, b.v), 6) AS value, a.v IS NULL AS from_previous
        FROM w LEFT JOIN d a ON a.day = w.day LEFT JOIN d b ON b.day = w.day - 1""",
)
def q_fallback_days(spark, sf_dir):
    daily = read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    wanted = daily.select("day").union(daily.select(F.date_add("day", 1).alias("day"))).distinct()
    out = clean.with_fallback(wanted, daily, "day", "v")
    return out.select(S.date_key(F.col("day")).alias("day"), r6("v").alias("value"), "from_previous")


@query(
    "q_model_comparison",
    """SELECT event_type AS model, """
    + ", ".join(f"round(sqrt(avg(value * value) FILTER (ts::DATE = DATE '2024-01-{d:02d}')), 6) AS rmse_{d}" for d in (2, 9, 16, 23))
    + " FROM events GROUP BY 1",
)
def q_model_comparison(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("day", F.dayofmonth("ts"))
    table = e.groupBy("event_type", "day").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rmse"))
    wide = evaluate.comparison(table, "event_type", "day", "rmse", [2, 9, 16, 23])
    return wide.select(F.col("event_type").alias("model"), *[r6(f"rmse_{d}").alias(f"rmse_{d}") for d in (2, 9, 16, 23)])


@query(
    "q_quality_by_day",
    f"""WITH {EV}, {CHANNELS}, w AS (SELECT t // 86400 AS day, t, event_type, coalesce(g > 0, true) AS imputed, NOT coalesce(g <= 1800, false) AS lost
            FROM (SELECT event_type, t, least(t - pt, nt - t) AS g FROM n WHERE f = 1)),
        l AS (SELECT day, count(*) FILTER (lost) AS frames_lost, count(*) AS frames FROM (SELECT day, t, bool_or(lost) AS lost FROM w GROUP BY 1, 2) GROUP BY 1)
        SELECT day, event_type AS channel, round(avg(imputed::INT), 6) AS imputed_share, round(avg(lost::INT), 6) AS outage_share, any_value(frames) AS frames,
        any_value(frames_lost) AS frames_lost FROM w JOIN l USING (day) GROUP BY 1, 2""",
)
def q_quality_by_day(spark, sf_dir):
    ev = event_rows(spark, sf_dir)
    names = sorted(r[0] for r in ev.select("event_type").distinct().limit(1000).collect())  # channels are columns, a handful
    frames_ = ev.select((F.floor(F.col("t") / HOUR) * HOUR).alias("t")).distinct()
    wanted = frames_.select("t", F.explode(F.array(*[F.lit(n) for n in names])).alias("event_type"))
    aligned = timeline.align_interpolated(ev, wanted, "t", "value", 1800, ["event_type"])
    value = [F.max(F.when(F.col("event_type") == n, F.col("value"))).alias(n) for n in names]
    flag = F.array(*[F.max(F.when(F.col("event_type") == n, F.col("imputed"))) for n in names]).alias("flags")
    wide = aligned.groupBy("t").agg(*value, flag)
    out = stats.quality_by_year(wide, F.floor(F.col("t") / DAY), names, "flags")
    return out.select(F.col("year").alias("day"), "channel", r6("imputed_share").alias("imputed_share"), r6("outage_share").alias("outage_share"), "frames", "frames_lost")


@query(
    "q_driver_matrix",
    f"""WITH {EV}, h AS (SELECT t // 3600 * 3600 AS t, event_type, avg(value) AS v FROM ev GROUP BY 1, 2)
        SELECT t, """
    + ", ".join(f"round(max(v) FILTER (event_type = '{n}'), 6) AS {n}" for n in CHANNEL_NAMES)
    + " FROM h GROUP BY t",
)
def q_driver_matrix(spark, sf_dir):
    e = event_rows(spark, sf_dir).withColumn("t", F.floor(F.col("t") / HOUR) * HOUR)
    wide = e.groupBy("t").pivot("event_type", list(CHANNEL_NAMES)).agg(F.avg("value"))
    return wide.select("t", *[r6(c).alias(c) for c in CHANNEL_NAMES])


@query(
    "q_daily_fallback",
    """WITH d AS (SELECT ts::DATE AS day, CASE WHEN max(value) < 480 THEN max(value) END AS v FROM events GROUP BY 1),
       c AS (SELECT d::DATE AS day FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) AS g(d))
       SELECT strftime(c.day, '%Y-%m-%d') AS day, coalesce(a.v, b.v) AS value, a.v IS NULL AS from_previous FROM c LEFT JOIN d a ON a.day = c.day
       LEFT JOIN d b ON b.day = c.day - 1""",
)
def q_daily_fallback(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.when(F.max("value") < 480, F.max("value")).alias("v"))
    days = clean.calendar(spark, "2024-01-01", "2024-01-31")
    before = e.select(F.date_add("day", 1).alias("day"), F.col("v").alias("w"))
    out = days.join(e, "day", "left").join(before, "day", "left")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("v", "w").alias("value"), F.col("v").isNull().alias("from_previous"))


# --- cadence, windows, splits ----------------------------------------------------------------------------------------


@query(
    "q_decimate_greedy",
    f"""WITH RECURSIVE {EV}, e AS (SELECT DISTINCT t FROM ev), k AS (SELECT min(t) AS t FROM e UNION ALL
        SELECT (SELECT min(e.t) FROM e WHERE e.t >= k.t + 7200) FROM k WHERE EXISTS (SELECT 1 FROM e WHERE e.t >= k.t + 7200)) SELECT t FROM k""",
)
def q_decimate_greedy(spark, sf_dir):
    return timeline.decimate(event_rows(spark, sf_dir).select("t").distinct(), "t", CADENCE)


WINDOWS = """w AS (SELECT t, min(g) OVER s AS a, max(g) OVER s AS b, sum(ok) OVER l AS f, count(*) OVER l AS c FROM
    (SELECT t, ok, lead(t) OVER (ORDER BY t) - t AS g FROM f) WINDOW s AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING),
    l AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING)),
    v AS (SELECT t, a = {c} AND b = {c} AS paced, f = 9 AS whole FROM w WHERE c = 9)"""


@query(
    "q_valid_windows",
    f"""WITH {WEEKLY}, f AS (SELECT t, (n % 5 > 0)::INT AS ok FROM d), {WINDOWS.format(c=604800)}
        SELECT t, paced AND whole AS valid FROM v""",
)
def q_valid_windows(spark, sf_dir):
    f = weekly_orders(spark, sf_dir).withColumn("ok", F.col("n") % 5 > 0)
    return timeline.window_starts(f, "t", "ok", WEEK).select("t", "valid")


@query(
    "q_window_attribution",
    f"""WITH {DAILY}, f AS (SELECT t, (n > 1)::INT AS ok FROM d), {WINDOWS.format(c=86400)} SELECT count(*) AS candidates,
        count(*) FILTER (paced AND whole) AS valid, count(*) FILTER (NOT paced) AS off_cadence, count(*) FILTER (paced AND NOT whole) AS missing FROM v""",
)
def q_window_attribution(spark, sf_dir):
    f = daily_orders(spark, sf_dir).withColumn("ok", F.col("n") > 1)
    w = timeline.window_starts(f, "t", "ok", DAY)
    return w.agg(
        F.count("*").alias("candidates"), *[F.count_if(c).alias(c) for c in ("valid", "off_cadence", "missing")]
    )


def split_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = weekly_orders(spark, sf_dir).withColumn("ok", F.lit(True))
    w = timeline.window_starts(f, "t", "ok", WEEK).where("valid")
    return w.select("t", timeline.split_name(F.col("t"), F.col("last_t"), SPLIT_1, SPLIT_2, 9 * WEEK).alias("split"))


SPLITS = f"""{WEEKLY}, f AS (SELECT t, 1 AS ok FROM d), {WINDOWS.format(c=604800)},
    s AS (SELECT t, CASE WHEN t + 4838400 < {SPLIT_1} THEN 'train' WHEN t >= {SPLIT_1} + 5443200 AND t + 4838400 < {SPLIT_2} THEN 'val'
    WHEN t >= {SPLIT_2} + 5443200 THEN 'test' END AS split FROM v WHERE paced AND whole)"""


@query("q_split_purge_embargo", f"WITH {SPLITS} SELECT t, split FROM s")
def q_split_purge_embargo(spark, sf_dir):
    return split_windows(spark, sf_dir)


@query("q_split_counts", f"WITH {SPLITS} SELECT coalesce(split, 'none') AS split, count(*) AS windows FROM s GROUP BY 1")
def q_split_counts(spark, sf_dir):
    return split_windows(spark, sf_dir).groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(F.count("*").alias("windows"))


@query(
    "q_split_disjoint",
    f"""WITH {SPLITS}, x AS (SELECT DISTINCT split, t + k * 604800 AS t FROM s, range(9) AS r(k) WHERE split IS NOT NULL)
        SELECT count(*) AS shared_frames FROM (SELECT t FROM x GROUP BY t HAVING count(*) > 1)""",
)
def q_split_disjoint(spark, sf_dir):
    s = split_windows(spark, sf_dir).where("split is not null")
    frames = s.select("split", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"), "t").select("split", (F.col("t") + F.col("k") * WEEK).alias("t")).distinct()
    return frames.groupBy("t").count().where("count > 1").agg(F.count("*").alias("shared_frames"))


MOMENTS = f"""{SPLITS}, u AS (SELECT DISTINCT t + k * 604800 AS t FROM s, range(6) AS r(k) WHERE split = 'train'),
    mo AS (SELECT count(*) AS n, sum(value) / count(*) AS mean, sqrt(greatest(sum(value * value) / count(*) - (sum(value) / count(*)) ** 2, 1e-12)) AS std
    FROM u JOIN d USING (t))"""


@query("q_train_moments", f"WITH {MOMENTS} SELECT n, round(mean, 3) AS mean, round(std, 3) AS std FROM mo")
def q_train_moments(spark, sf_dir):
    m = train_moments(spark, sf_dir)
    return m.select("n", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"))


def train_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = split_windows(spark, sf_dir).where("split = 'train'").select("t")
    frames = stats.input_frames(starts, "t", 6, WEEK).join(weekly_orders(spark, sf_dir), "t")
    return stats.train_moments(frames, F.col("value"))


@query(
    "q_window_tensors",
    f"""WITH {MOMENTS} SELECT s.split, s.t AS start, k AS step, CASE WHEN k < 6 THEN 'input' ELSE 'target' END AS role,
        round((d.value - mo.mean) / mo.std, 6) AS value FROM s CROSS JOIN range(9) AS r(k) JOIN d ON d.t = s.t + k * 604800 CROSS JOIN mo WHERE split IS NOT NULL""",
)
def q_window_tensors(spark, sf_dir):
    starts = split_windows(spark, sf_dir).where("split is not null")
    long = evaluate.windows_long(weekly_orders(spark, sf_dir), starts, "t", "value", WEEK, 6, 3, train_moments(spark, sf_dir))
    return long.join(starts.withColumnRenamed("t", "start"), "start").select(
        "split", "start", F.col("step").cast("long").alias("step"), "role", r6("value").alias("value")
    )


#: Weekly orders as maps of three cells, with two drivers.
ORDER_MAPS = """d AS (SELECT epoch_us(o_orderdate) // 1000000 // 604800 * 604800 AS t, avg(o_totalprice) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi,
    count(*)::DOUBLE AS n, sum(o_custkey)::DOUBLE AS c FROM orders GROUP BY 1)"""


def order_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select((F.floor(S.epoch_seconds(F.col("o_orderdate")) / WEEK) * WEEK).alias("t"), "o_totalprice", "o_custkey")
    price = F.col("o_totalprice")
    return o.groupBy("t").agg(F.array(F.avg(price), F.min(price), F.max(price)).alias("dtec"), F.count("*").cast("double").alias("n"), F.sum("o_custkey").cast("double").alias("c"))


@query(
    "q_window_arrays",
    f"""WITH {SPLITS.replace(WEEKLY, ORDER_MAPS)}, u AS (SELECT DISTINCT t + k * 604800 AS t FROM s, range(6) AS r(k) WHERE split = 'train'),
        x AS (SELECT unnest([a, lo, hi]) AS v FROM u JOIN d USING (t)),
        mo AS (SELECT sum(v) / count(*) AS m, sqrt(greatest(sum(v * v) / count(*) - (sum(v) / count(*)) ** 2, 1e-12)) AS s FROM x),
        dm AS (SELECT sum(n) / count(*) AS nm, sqrt(greatest(sum(n * n) / count(*) - (sum(n) / count(*)) ** 2, 1e-12)) AS ns,
            sum(c) / count(*) AS cm, sqrt(greatest(sum(c * c) / count(*) - (sum(c) / count(*)) ** 2, 1e-12)) AS cs FROM u JOIN d USING (t)),
        wa AS (SELECT s.split, s.t AS start, k AS step, [(a - m) / s, (lo - m) / s, (hi - m) / s] AS map, [(n - nm) / ns, (c - cm) / cs] AS driver
            FROM s CROSS JOIN range(9) AS r(k) JOIN d ON d.t = s.t + k * 604800 CROSS JOIN mo CROSS JOIN dm WHERE split IS NOT NULL)
        SELECT split, start, step, 'map' AS what, generate_subscripts(map, 1) - 1 AS place, round(unnest(map), 4) AS value FROM wa
        UNION ALL SELECT split, start, step, 'driver', generate_subscripts(driver, 1) - 1, round(unnest(driver), 4) FROM wa WHERE step < 6""",
)
def q_window_arrays(spark, sf_dir):
    settings = compose.Settings(cadence_seconds=WEEK)
    out, _ = compose.windows(order_maps(spark, sf_dir), settings, ["n", "c"], SPLIT_1, SPLIT_2)

    def rows(what: str, frames_: Column) -> DataFrame:
        steps = out.select("split", F.col("t").alias("start"), F.posexplode(frames_).alias("step", "_v"))
        flat = steps.select("split", "start", F.col("step").cast("long").alias("step"), F.lit(what).alias("what"), F.posexplode("_v").alias("place", "x"))
        return flat.select("split", "start", "step", "what", F.col("place").cast("long").alias("place"), F.round(F.col("x").cast("double"), 4).alias("value"))

    return rows("map", F.concat("inputs", "targets")).union(rows("driver", F.col("drivers")))


@query(
    "q_horizon_labels",
    """SELECT DISTINCT l_linenumber AS step, (l_linenumber * 2)::VARCHAR || 'h' AS label, array_to_string(list_transform(range(1, l_linenumber + 1), lambda k: '+' || (k * 2)), '/') || 'h' AS leads,
       't+' || (l_linenumber * 2) || 'h' AS name FROM lineitem""",
)
def q_horizon_labels(spark, sf_dir):
    steps, step = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("step")).distinct(), F.col("step")
    return steps.select("step", S.horizon_label(step, CADENCE).alias("label"), S.lead_labels(step, CADENCE).alias("leads"), S.step_label(step, CADENCE).alias("name"))


TWO_HOURLY = "h AS (SELECT t // 7200 * 7200 AS t, avg(value) AS value FROM ev GROUP BY 1)"


@query(
    "q_window_ok",
    f"""WITH {EV}, h AS (SELECT t // 7200 * 7200 AS t, max(value) > 300 AS ok FROM ev GROUP BY 1) SELECT a.t, (SELECT count(*) FROM h b WHERE b.ok AND b.t < a.t
        AND b.t >= a.t - 43200) = 6 AS usable FROM h a""",
)
def q_window_ok(spark, sf_dir):
    ev = event_rows(spark, sf_dir)
    f = ev.groupBy((F.floor(F.col("t") / CADENCE) * CADENCE).alias("t")).agg((F.max("value") > 300).alias("ok"))
    return timeline.history_ok(f, "t", "ok", 6, CADENCE)


@query(
    "q_hourly_fill",
    f"""WITH {EV}, d AS (SELECT t // 86400 AS day, (t % 86400) // 7200 * 2 AS hour, avg(value) AS value FROM ev GROUP BY 1, 2),
        g AS (SELECT day, hour FROM (SELECT DISTINCT day FROM d), range(24) AS r(hour)), x AS (SELECT g.day, g.hour, d.value FROM g LEFT JOIN d USING (day, hour)),
        w AS (SELECT day, hour, value, lag(value) OVER p AS a, lead(value) OVER p AS b FROM x WINDOW p AS (PARTITION BY day ORDER BY hour))
        SELECT day, hour, round(CASE WHEN hour = 23 THEN a WHEN hour % 2 = 1 THEN (a + b) / 2 ELSE value END, 6) AS value FROM w""",
)
def q_hourly_fill(spark, sf_dir):
    e = event_rows(spark, sf_dir)
    two = e.groupBy(F.floor(F.col("t") / DAY).alias("day"), (F.floor(F.pmod("t", F.lit(DAY)) / CADENCE) * 2).cast("int").alias("hour")).agg(F.avg("value").alias("value"))
    return timeline.fill_hours(two, "day", "hour", "value").select("day", F.col("hour").cast("long").alias("hour"), r6("value").alias("value"))


@query(
    "q_day_complete",
    f"""WITH {EV}, h AS (SELECT t // 3600 * 3600 AS t, max(value) > 300 AS ok FROM ev GROUP BY 1)
        SELECT t // 86400 AS day, count(*) FILTER (ok) AS hours, count(*) FILTER (ok) = 24 AS complete FROM h GROUP BY 1""",
)
def q_day_complete(spark, sf_dir):
    h = event_rows(spark, sf_dir).groupBy((F.floor(F.col("t") / HOUR) * HOUR).alias("t")).agg((F.max("value") > 300).alias("ok"))
    good = F.count_if("ok")
    return h.groupBy(F.floor(F.col("t") / DAY).alias("day")).agg(good.alias("hours"), (good == 24).alias("complete"))


@query(
    "q_lead_tags",
    f"WITH {EV} SELECT DISTINCT t // 3600 * 3600 AS t, CASE WHEN (t // 3600) % 2 = 0 THEN 7200.0::DOUBLE ELSE 'inf'::DOUBLE END AS lead_s FROM ev",
)
def q_lead_tags(spark, sf_dir):
    h = event_rows(spark, sf_dir).select((F.floor(F.col("t") / HOUR) * HOUR).alias("t")).distinct()
    return h.select("t", F.when(F.floor(F.col("t") / HOUR) % 2 == 0, F.lit(7200.0)).otherwise(F.lit(float("inf"))).alias("lead_s"))


# --- evaluation ------------------------------------------------------------------------------------------------------

CELLS = f"""{EV}, {TWO_HOURLY}, c AS (SELECT 'persistence' AS model, a.t, k AS horizon, a.value AS pred, b.value AS target FROM h a CROSS JOIN range(1, 4) AS r(k)
    JOIN h b ON b.t = a.t + k * 7200 UNION ALL SELECT 'zero', a.t, k, 0.0, b.value FROM h a CROSS JOIN range(1, 4) AS r(k) JOIN h b ON b.t = a.t + k * 7200),
    x AS (SELECT *, 1 + (t // 7200) % 3 AS w, target > 110 AS storm, target < 90 AS quiet FROM c)"""
METRICS = """m AS (SELECT model, horizon, sqrt(sum(w * (pred - target) ** 2) / sum(w)) AS rmse,
    1 - sum(w * (pred - target) ** 2) / (sum(w * target * target) - sum(w * target) ** 2 / sum(w)) AS r2,
    sqrt(coalesce(sum(w * (pred - target) ** 2) FILTER (storm), 0) / greatest(coalesce(sum(w) FILTER (storm), 0), 1e-8)) AS storm_rmse,
    sqrt(coalesce(sum(w * (pred - target) ** 2) FILTER (quiet), 0) / greatest(coalesce(sum(w) FILTER (quiet), 0), 1e-8)) AS quiet_rmse FROM x GROUP BY 1, 2)"""


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = event_rows(spark, sf_dir).withColumn("t", F.floor(F.col("t") / CADENCE) * CADENCE)
    h = clean.mean_of_repeats(ev, ["t"], ["value"])
    p = evaluate.persistence(h, "t", "value", 3, CADENCE)
    both = p.withColumn("model", F.lit("persistence")).unionByName(p.withColumn("pred", F.lit(0.0)).withColumn("model", F.lit("zero")))
    cells = both.withColumn("w", (1 + F.floor(F.col("t") / CADENCE) % 3).cast("double"))
    return evaluate.metrics(cells, ["model", "horizon"], "pred", "target", "w", F.col("target") > 110, F.col("target") < 90)


@query(
    "q_persistence_eval",
    f"WITH {CELLS}, {METRICS} SELECT model, horizon, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM m",
)
def q_persistence_eval(spark, sf_dir):
    return model_metrics(spark, sf_dir).select("model", F.col("horizon").cast("long").alias("horizon"), r6("rmse").alias("rmse"), r6("r2").alias("r2"))


@query(
    "q_correlation",
    f"WITH {CELLS} SELECT horizon, round(corr(pred, target), 6) AS corr FROM x WHERE model = 'persistence' GROUP BY 1",
)
def q_correlation(spark, sf_dir):
    m = model_metrics(spark, sf_dir).where("model = 'persistence'")
    return m.select(F.col("horizon").cast("long").alias("horizon"), r6("corr").alias("corr"))


@query(
    "q_skill_table",
    f"""WITH {CELLS}, {METRICS} SELECT m.model, m.horizon, round(100 * (1 - m.rmse / p.rmse), 6) AS skill FROM m
        JOIN m p ON p.horizon = m.horizon AND p.model = 'persistence'""",
)
def q_skill_table(spark, sf_dir):
    s = evaluate.skill(model_metrics(spark, sf_dir), "model", "horizon", "rmse", "persistence")
    return s.select("model", F.col("horizon").cast("long").alias("horizon"), r6("skill").alias("skill"))


@query(
    "q_storm_quiet",
    f"""WITH {CELLS}, {METRICS} SELECT model, round(max(storm_rmse) FILTER (horizon = 1), 6) AS storm_1, round(max(quiet_rmse) FILTER (horizon = 1), 6) AS quiet_1,
        round(max(storm_rmse) FILTER (horizon = 3), 6) AS storm_3, round(max(quiet_rmse) FILTER (horizon = 3), 6) AS quiet_3 FROM m GROUP BY 1""",
)
def q_storm_quiet(spark, sf_dir):
    m = model_metrics(spark, sf_dir)
    return m.groupBy("model").agg(
        *[r6(F.max(F.when(F.col("horizon") == h, F.col(f"{k}_rmse")))).alias(f"{k}_{h}") for h in (1, 3) for k in ("storm", "quiet")]
    )


@query(
    "q_hist_weights",
    """WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS total FROM events), c AS (SELECT least(floor((value - lo) / ((hi - lo) / 18)), 17)::INT AS bin, count(*) AS n
       FROM events, s GROUP BY 1), f AS (SELECT b::INT AS bin, coalesce(n, 0) AS n, lo, (hi - lo) / 18 AS w, total FROM range(18) AS r(b) LEFT JOIN c ON c.bin = b, s),
       x AS (SELECT bin, lo + bin * w AS lo, lo + (bin + 1) * w AS hi, n::BIGINT AS n, 1.0 / greatest(n / total / w, 1e-8) AS iw FROM f)
       SELECT bin, round(lo, 6) AS lo, round(hi, 6) AS hi, n, round(iw / (SELECT avg(iw) FROM x), 9) AS weight FROM x""",
)
def q_hist_weights(spark, sf_dir):
    h = stats.histogram_weights(read(spark, sf_dir, "events"), "value", 18)
    return h.select("bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "n", F.round("weight", 9).alias("weight"))


@query("q_bucketize", "SELECT event_id, ((value > 50)::INT + (value > 100)::INT + (value > 200)::INT + (value > 400)::INT) AS bucket FROM events")
def q_bucketize(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", stats.bucket_of(F.col("value"), [50, 100, 200, 400]).alias("bucket"))


@query(
    "q_weighted_loss",
    """SELECT round(sum(w * mse) / sum(w), 6) AS loss FROM (SELECT user_id, avg((value - 100) ** 2) AS mse, (1 + user_id % 4)::DOUBLE AS w FROM events GROUP BY user_id)""",
)
def q_weighted_loss(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("w", (1 + F.col("user_id") % 4).cast("double"))
    return evaluate.storm_weighted_loss(e, "user_id", F.col("value") - 100, "w").select(r6("loss").alias("loss"))


@query(
    "q_climatology_addback",
    f"""WITH {EV}, {TWO_HOURLY}, b AS (SELECT t // 7200 * 7200 AS t, max(value) AS base FROM ev GROUP BY 1)
        SELECT h.t, round(h.value + b.base, 6) AS absolute FROM h JOIN b USING (t)""",
)
def q_climatology_addback(spark, sf_dir):
    ev = event_rows(spark, sf_dir).withColumn("t", F.floor(F.col("t") / CADENCE) * CADENCE)
    f = ev.groupBy("t").agg(F.avg("value").alias("value"))
    base = ev.groupBy("t").agg(F.max("value").alias("base"))
    return evaluate.add_baseline(f, base, "t", "value", "base").select("t", r6("absolute").alias("absolute"))


@query(
    "q_equality_gate",
    """WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 10 <> 0),
       b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 11 <> 0)
       SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS both, count(*) FILTER (b.k IS NULL) AS only_old, count(*) FILTER (a.k IS NULL) AS only_new,
       count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL AND a.v IS NOT DISTINCT FROM b.v) AS exact, count(*) FILTER (abs(a.v - b.v) <= 1e-9) AS within
       FROM a FULL JOIN b ON a.k = b.k""",
)
def q_equality_gate(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    new = o.where("k % 11 <> 0").withColumn("v", F.when(F.col("k") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return evaluate.equality_gate(o.where("k % 10 <> 0"), new, "k", "v")


FINGERPRINTS = """p AS (SELECT year(o_orderdate)::INT AS part, count(*) || ':' || sum(('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 15))::BIGINT) AS x FROM orders {where} GROUP BY 1),
    {name} AS (SELECT part, substr(sha256(x), 1, 16) AS fingerprint FROM p)"""


@query("q_partition_fingerprint", f"WITH {FINGERPRINTS.format(where='', name='f')} SELECT part, fingerprint FROM f")
def q_partition_fingerprint(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return evaluate.partition_fingerprints(o, F.year("o_orderdate"), F.col("o_orderkey"))


@query(
    "q_stale_partitions",
    "WITH "
    + FINGERPRINTS.format(where="", name="f")
    + ", "
    + FINGERPRINTS.format(where="WHERE NOT (year(o_orderdate) = 1997 AND o_orderkey % 2 = 0) AND year(o_orderdate) < 2000", name="g").replace("p AS", "q AS").replace("FROM p)", "FROM q)")
    + """ SELECT f.part, f.fingerprint, CASE WHEN g.fingerprint IS NULL THEN 'build' WHEN g.fingerprint <> f.fingerprint THEN 'rebuild' ELSE 'skip' END AS action
       FROM f LEFT JOIN g ON g.part = f.part""",
)
def q_stale_partitions(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    year = F.year("o_orderdate")
    old = o.where(~((year == 1997) & (F.col("o_orderkey") % 2 == 0)) & (year < 2000))
    prints = [evaluate.partition_fingerprints(x, year, F.col("o_orderkey")) for x in (o, old)]
    return evaluate.stale_partitions(*prints)


@query(
    "q_json_constants",
    """SELECT k, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT (props->>'$.k')::BIGINT AS k, value FROM events) GROUP BY k""",
)
def q_json_constants(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k"), "value")
    return e.groupBy("k").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query(
    "q_best_checkpoint",
    f"WITH {EV}, l AS (SELECT t // 86400 AS epoch, avg(value) AS loss FROM ev GROUP BY 1) SELECT arg_min(epoch, loss) AS best_epoch, round(min(loss), 6) AS best_loss FROM l",
)
def q_best_checkpoint(spark, sf_dir):
    log = event_rows(spark, sf_dir).groupBy(F.floor(F.col("t") / DAY).alias("epoch")).agg(F.avg("value").alias("loss"))
    return evaluate.best_epoch(log, "epoch", "loss").select("best_epoch", r6("best_loss").alias("best_loss"))


# --- grids and spectra -----------------------------------------------------------------------------------------------

LATS = [70.0, 50.0, 30.0, 10.0, -10.0, -30.0, -50.0, -70.0]
LONS = [-180.0, -135.0, -90.0, -45.0, 0.0, 45.0, 90.0, 135.0]
TO_LATS, TO_LONS = [-60.0, -20.0, 0.0, 40.0], [0.0, 60.0, 120.0, 180.0, 240.0, 300.0]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, cell, v): embeddings as maps of 8 by 8 cells."""
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode("embedding").alias("cell", "x")).select("vec_id", "cell", F.col("x").cast("double").alias("v"))


CELL_SQL = "c AS (SELECT vec_id, (i - 1)::INT AS cell, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) AS r(i))"


def _weights() -> list[tuple[int, int, float]]:
    import numpy as np

    return grids.bilinear_weights(np.array(LATS), np.array(LONS), np.array(TO_LATS), np.array(TO_LONS))


@query(
    "q_regrid_bilinear",
    f"""WITH {CELL_SQL}, w AS (SELECT * FROM (VALUES {", ".join(f"({a}, {b}, {w!r}::DOUBLE)" for a, b, w in _weights())}) AS t(target, cell, w))
        SELECT vec_id, target, round(CASE WHEN count(v) = count(*) THEN sum(v * w) END, 6) AS v FROM c JOIN w USING (cell) GROUP BY 1, 2""",
)
def q_regrid_bilinear(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    row = grids.regrid_row(F.col("embedding"), _weights(), len(TO_LATS) * len(TO_LONS))
    return e.select("vec_id", F.posexplode(row).alias("target", "v")).select("vec_id", "target", r6("v").alias("v"))


@query(
    "q_repeat_differences",
    """WITH r AS (SELECT label, vec_id, embedding AS b, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS a FROM embeddings),
        p AS (SELECT list_transform(range(1, len(b) + 1), lambda k: abs(b[k]::DOUBLE - a[k]::DOUBLE)) AS d, list_transform(a, lambda x: abs(x::DOUBLE)) AS s FROM r WHERE a IS NOT NULL)
        SELECT count(*) AS dropped, round(max(list_max(d)), 6) AS max, round(sum(list_sum(d)) / sum(len(d)), 6) AS mean,
        round(sum(list_sum(d)) / sum(len(d)) / (sum(list_sum(s)) / sum(len(s))), 6) AS relative FROM p""",
)
def q_repeat_differences(spark, sf_dir):
    out = grids.repeat_differences(read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return out.select("dropped", *[r6(c).alias(c) for c in ("max", "mean", "relative")])


@query("q_lon_wrap", "SELECT c_custkey, round(((c_acctbal % 360) + 360) % 360, 6) AS lon FROM customer")
def q_lon_wrap(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", r6(S.wrap_longitude(F.col("c_acctbal"))).alias("lon"))


@query(
    "q_ring_mean",
    f"""WITH {CELL_SQL} SELECT vec_id, cell, round(CASE WHEN cell // 8 IN (0, 7) THEN avg(v) OVER (PARTITION BY vec_id, cell // 8) ELSE v END, 6) AS v FROM c""",
)
def q_ring_mean(spark, sf_dir):
    c = cells(spark, sf_dir).withColumn("row", F.floor(F.col("cell") / 8).cast("int"))
    return stats.ring_mean(c, ["vec_id"], "row", "v", [0, 7]).select("vec_id", "cell", r6("v").alias("v"))


@query(
    "q_residual_join",
    """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS cell FROM embeddings),
        m AS (SELECT label, cell, avg(v) AS b FROM e GROUP BY 1, 2)
        SELECT vec_id, cell::INT AS cell, round(v - b, 6) AS residual FROM e JOIN m USING (label, cell)""",
)
def q_residual_join(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    flat = e.select("label", F.posexplode("v").alias("cell", "x")).groupBy("label", "cell").agg(F.avg("x").alias("b"))
    # A label's mean map has a fixed number of cells.
    base = flat.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "b"))), lambda s: s["b"]).alias("b"))
    joined = grids.residuals(e.select("vec_id", "v"), e.select("vec_id", "label").join(base, "label").select("vec_id", "b"), ["vec_id"], "v", "b")
    return joined.select("vec_id", F.posexplode("residual").alias("cell", "x")).select("vec_id", "cell", r6("x").alias("residual"))


@query(
    "q_area_anomaly",
    f"""WITH {CELL_SQL}, w AS (SELECT *, cos(radians([{", ".join(map(str, LATS))}][cell // 8 + 1])) AS w FROM c)
        SELECT vec_id, cell, round(v - sum(v * w) OVER p / sum(w) OVER p, 6) AS anomaly FROM w WINDOW p AS (PARTITION BY vec_id)""",
)
def q_area_anomaly(spark, sf_dir):
    lat = F.element_at(F.array(*[F.lit(x) for x in LATS]), F.floor(F.col("cell") / 8).cast("int") + 1)
    c = cells(spark, sf_dir).withColumn("w", F.cos(F.radians(lat)))
    return stats.weighted_anomaly(c, ["vec_id"], "v", "w").select("vec_id", "cell", r6("anomaly").alias("anomaly"))


POWER = f"{CELL_SQL}, p AS (SELECT vec_id, floor(sqrt(cell))::INT AS l, sum(v * v) AS s_l FROM c GROUP BY 1, 2)"


def powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.degree_power(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("q_power_spectrum", f"WITH {POWER} SELECT vec_id, l, round(s_l, 9) AS s_l FROM p")
def q_power_spectrum(spark, sf_dir):
    return powers(spark, sf_dir).select("vec_id", "l", F.round("s_l", 9).alias("s_l"))


SPECTRA = f"{POWER}, m AS (SELECT l, avg(s_l) AS s_all, avg(s_l) FILTER (label >= 5) AS s_storm, avg(s_l) FILTER (label < 2) AS s_quiet FROM p JOIN embeddings USING (vec_id) GROUP BY 1)"


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = powers(spark, sf_dir).join(read(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return spectrum.mean_spectra(p, F.col("label") >= 5, F.col("label") < 2)


@query(
    "q_mean_spectra",
    f"WITH {SPECTRA} SELECT l, round(s_all, 9) AS s_all, round(s_storm, 9) AS s_storm, round(s_quiet, 9) AS s_quiet, round(s_storm / (s_quiet + 1e-12), 6) AS ratio FROM m",
)
def q_mean_spectra(spark, sf_dir):
    s = spectra(spark, sf_dir)
    return s.select("l", *[F.round(c, 9).alias(c) for c in ("s_all", "s_storm", "s_quiet")], r6("ratio").alias("ratio"))


@query("q_lmax_energy", f"WITH {SPECTRA} SELECT l, round(sum(s_all) OVER (ORDER BY l) / sum(s_all) OVER (), 6) AS fraction FROM m")
def q_lmax_energy(spark, sf_dir):
    return spectrum.energy_fraction(spectra(spark, sf_dir), "s_all").select("l", r6("fraction").alias("fraction"))


EPSILONS = [0.5, 0.4, 0.3, 0.2, 0.1, 0.05, 0.01, 0.001]


@query(
    "q_epsilon_sweep",
    f"""WITH {SPECTRA}, f AS (SELECT l, sum(s_all) OVER (ORDER BY l) / sum(s_all) OVER () AS fraction FROM m), e AS (SELECT unnest({EPSILONS})::DOUBLE AS epsilon)
        SELECT epsilon, coalesce((SELECT min(l) FROM f WHERE fraction >= 1 - e.epsilon), 0)::INT AS l FROM e""",
)
def q_epsilon_sweep(spark, sf_dir):
    return spectrum.degree_for_energy(spectrum.energy_fraction(spectra(spark, sf_dir), "s_all"), EPSILONS)


@query(
    "q_cliff",
    f"""WITH {SPECTRA}, d AS (SELECT l, lead(log10(s_all + 1e-12)) OVER (ORDER BY l) - log10(s_all + 1e-12) AS x FROM m)
        SELECT coalesce((SELECT min(l) FROM d WHERE x < 0.05), 36)::INT AS cliff""",
)
def q_cliff(spark, sf_dir):
    return spectrum.first_cliff(spectra(spark, sf_dir), "s_all", 0.05)


@query("q_noise_floor", f"WITH {SPECTRA} SELECT round(avg(s_all) FILTER (l >= 3 AND l % 2 = 1), 9) AS noise_floor FROM m")
def q_noise_floor(spark, sf_dir):
    return spectrum.noise_floor(spectra(spark, sf_dir), "s_all", 3).select(F.round("noise_floor", 9).alias("noise_floor"))


@query(
    "q_pred_minus_actual",
    """SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))), 6) AS total
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def q_pred_minus_actual(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("p"))
    # The next map stands for what was measured at the time that the map before it forecasts.
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("a")), "vec_id")
    d = grids.minus(F.col("p"), F.col("a"))
    return both.select("vec_id", r6(F.aggregate(d, F.lit(0.0), lambda s, x: s + F.abs(x))).alias("total"))


@query(
    "q_diff_gate",
    "SELECT vec_id, len(list_filter(list_transform(embedding, lambda x: CASE WHEN x < 0.3 THEN x END), lambda x: x IS NULL)) > 0 AS missing FROM embeddings",
)
def q_diff_gate(spark, sf_dir):
    masked = F.transform("embedding", lambda x: F.when(x < 0.3, x))
    return read(spark, sf_dir, "embeddings").select("vec_id", grids.any_missing(masked).alias("missing"))


@query("q_orientation_flip", "SELECT vec_id, CASE WHEN label % 2 = 0 THEN list_reverse(embedding) ELSE embedding END AS rows FROM embeddings")
def q_orientation_flip(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", grids.oriented(F.col("embedding"), F.col("label") % 2 == 0).alias("rows"))


#: A number as the nearest half float, ties to even; subnormal ones in steps of 2 ** -24.
HALF = """CASE WHEN x = 0 THEN 0.0 WHEN abs(x) < 2.0 ** -14 THEN round_even(x * 2.0 ** 24, 0) / 2.0 ** 24
    ELSE round_even(x * 2.0 ** (10 - floor(log2(abs(x)))), 0) / 2.0 ** (10 - floor(log2(abs(x)))) END"""


@query("q_float16_round_trip", f"SELECT vec_id, list_transform(list_transform(embedding, lambda v: v::DOUBLE), lambda x: ({HALF})::FLOAT) AS values FROM embeddings")
def q_float16_round_trip(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return grids.from_float16(grids.to_float16(e, "embedding"), "pack").select("vec_id", "values")


@query(
    "q_color_scale",
    """SELECT event_id, round(t * t * (3 - 2 * t), 6) AS shade, ((event_id % 40) + 1) || CASE WHEN (event_id % 40) + 1 BETWEEN 11 AND 13 THEN 'th'
       WHEN ((event_id % 40) + 1) % 10 = 1 THEN 'st' WHEN ((event_id % 40) + 1) % 10 = 2 THEN 'nd' WHEN ((event_id % 40) + 1) % 10 = 3 THEN 'rd' ELSE 'th' END AS nth
       FROM (SELECT event_id, least(greatest((value - 30) / 270, 0), 1) AS t FROM events)""",
)
def q_color_scale(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", r6(S.smoothstep(30.0, 300.0, F.col("value"))).alias("shade"), S.ordinal(F.col("event_id") % 40 + 1).alias("nth"))


# --- streams: the batch SQL says what the stream must come to --------------------------------------------------------


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


@query("q_stream_tumbling", f"WITH {EV} SELECT t // 7200 * 7200 AS t, count(*) AS n, round(avg(value), 6) AS mean FROM ev GROUP BY 1")
def q_stream_tumbling(spark, sf_dir):
    s = frames.tumbling_means(event_stream(spark, sf_dir), "ts", "value")
    return frames.run_to_table(s).select("t", "n", r6("mean").alias("mean"))


@query(
    "q_stream_sessions",
    """WITH e AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
       s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts) AS k FROM e)
       SELECT event_type, epoch_us(min(ts)) // 1000000 AS start, count(*) AS n FROM s GROUP BY event_type, k""",
)
def q_stream_sessions(spark, sf_dir):
    return frames.run_to_table(frames.gap_runs(event_stream(spark, sf_dir), "ts", "30 minutes", by=["event_type"]))


@query("q_stream_dedupe", "SELECT DISTINCT event_id FROM events")
def q_stream_dedupe(spark, sf_dir):
    s = frames.first_of_epoch(event_stream(spark, sf_dir), "ts", ["event_id"]).select("event_id")
    return frames.run_to_table(s, "append")


# --- Python-backed operators without SQL twins -----------------------------------------------------------------------


@query(
    "q_climatology_model",
    f"""WITH {EV}, fr AS (SELECT DISTINCT t // 3600 * 3600 AS t FROM ev), fl AS (SELECT t // 86400 AS d, max(value) AS f FROM ev GROUP BY 1),
        x AS (SELECT fr.t, f, radians(-23.44) * cos(2 * pi() * (dayofyear(to_timestamp(fr.t)) + 10) / 365.25) AS decl, (fr.t % 86400) / 3600.0 AS ut FROM fr JOIN fl ON fl.d = fr.t // 86400),
        y AS (SELECT t, f, decl, ut, i * 8 + j AS cell, radians([{", ".join(map(str, LATS))}][i + 1]) AS lat, radians([{", ".join(map(str, LONS))}][j + 1]) AS lon FROM x, range(8) AS a(i), range(8) AS b(j)),
        z AS (SELECT t, f, cell, sin(lat) * sin(decl) + cos(lat) * cos(decl) * cos(radians(15.0 * (ut - 14.0)) + lon) AS c FROM y)
        SELECT t, cell, round((4.0 + 0.25 * greatest(f, 0) * greatest(c, 0))::FLOAT::DOUBLE, 3) AS value FROM z""",
)
def q_climatology_model(spark, sf_dir):
    frames_ = event_rows(spark, sf_dir).select((F.floor(F.col("t") / HOUR) * HOUR).alias("t"), "value")
    f107 = frames_.groupBy(S.epoch_date(F.col("t")).alias("day")).agg(F.max("value").alias("f107"))
    maps = climatology.baseline(frames_.select("t").distinct(), f107, "t", LATS, LONS)
    return maps.select("t", F.posexplode("iri").alias("cell", "x")).select("t", F.col("cell").cast("long").alias("cell"), F.round(F.col("x").cast("double"), 3).alias("value"))


N_LAT, N_LON, L_MOST = 23, 45, 22


def _to_gauss() -> list[tuple[int, int, float]]:
    """From the 8 by 8 maps to the Gauss-Legendre grid; rows beyond the source get its edge row's mean."""
    import numpy as np

    lats, _ = grids.gauss_latitudes(N_LAT)
    w = grids.bilinear_weights(np.array(LATS), np.array(LONS), lats, np.arange(N_LON) * 360.0 / N_LON)
    return grids.pole_weights(w, (8, 8), (N_LAT, N_LON), south_first=False)


def _quadrature() -> list[tuple[int, int, int, float]]:
    """(l, m, row, weight): Legendre function times quadrature weight, which with the rows' Fourier sums makes coefficients."""
    import numpy as np

    x, w = np.polynomial.legendre.leggauss(N_LAT)
    p = harmonics.legendre(L_MOST, x)
    return [(n, m, i, float(p[n, m, i] * w[i])) for n in range(L_MOST + 1) for m in range(n + 1) for i in range(N_LAT)]


@query(
    "q_harmonic_power",
    f"""WITH {CELL_SQL}, rw AS (SELECT * FROM (VALUES {", ".join(f"({a}, {b}, {w!r}::DOUBLE)" for a, b, w in _to_gauss())}) AS t(target, cell, w)),
        q AS (SELECT * FROM (VALUES {", ".join(f"({n}, {m}, {i}, {w!r}::DOUBLE)" for n, m, i, w in _quadrature())}) AS t(l, m, i, p)),
        g AS (SELECT vec_id, target // {N_LON} AS i, target % {N_LON} AS j, sum(v * w) AS v FROM c JOIN rw USING (cell) GROUP BY 1, 2, 3),
        f AS (SELECT vec_id, i, m, sum(v * cos(2 * pi() * m * j / {N_LON})) * 2 * pi() / {N_LON} AS re, sum(v * sin(2 * pi() * m * j / {N_LON})) * 2 * pi() / {N_LON} AS im
            FROM g, range({L_MOST + 1}) AS r(m) GROUP BY 1, 2, 3),
        a AS (SELECT vec_id, l, m, sum(p * re) AS re, sum(p * im) AS im FROM f JOIN q USING (m, i) GROUP BY 1, 2, 3)
        SELECT vec_id, l, round(sum(CASE WHEN m = 0 THEN 1 ELSE 2 END * (re * re + im * im)), 6) AS s_l FROM a GROUP BY 1, 2""",
)
def q_harmonic_power(spark, sf_dir):
    bounded_batches(spark)
    e = read(spark, sf_dir, "embeddings").select("vec_id", grids.regrid_row(F.col("embedding"), _to_gauss(), N_LAT * N_LON).alias("map"))
    return harmonics.grid_power(e, "vec_id", "map", N_LAT, N_LON, L_MOST).select("vec_id", "l", r6("s_l").alias("s_l"))


@query("q_upsert_latest", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def q_upsert_latest(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    path = f"{shared_folder(spark)}/latest_{uuid.uuid4().hex}"
    for number, kind in enumerate(CHANNEL_NAMES):  # a batch each
        frames.upsert(e.where(F.col("event_type") == kind), path, "user_id", "event_id", number, buckets=16)
    return frames.current(spark, path)


# --- smaller pieces --------------------------------------------------------------------------------------------------


@query(
    "q_map_rmse",
    f"WITH {CELL_SQL} SELECT label, round(sqrt(avg(mse)), 9) AS rmse FROM (SELECT label, vec_id, avg((v - 0.1) ** 2) AS mse FROM c JOIN embeddings USING (vec_id) GROUP BY 1, 2) GROUP BY 1",
)
def q_map_rmse(spark, sf_dir):
    c = cells(spark, sf_dir).join(read(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return evaluate.map_rmse(c, ["label"], "vec_id", F.col("v") - 0.1).select("label", F.round("rmse", 9).alias("rmse"))


@query("q_hour_slice", "SELECT vec_id, embedding[17:24] AS cells FROM embeddings")
def q_hour_slice(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", S.hour_slice(F.col("embedding"), F.lit(2), 8).alias("cells"))


@query(
    "q_sun",
    """SELECT event_id, round((((dayofyear(ts) - 79 + epoch_us(ts) % 86400000000 / 86400000000.0) * (360.0 / 365.24)) % 360 + 360) % 360, 6) AS ecliptic, round(((hour(ts) - 13 + value) % 24 + 24) % 24, 6) AS sub_hour FROM events""",
)
def q_sun(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", r6(S.ecliptic_longitude(F.dayofyear("ts") + F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(DAY * 1_000_000)) / (DAY * 1e6))).alias("ecliptic"), r6(S.subsolar_hour(F.hour("ts") - 13 + F.col("value"))).alias("sub_hour"))


@query("q_year_list", "SELECT DISTINCT o_custkey, year(o_orderdate)::INTEGER AS year FROM orders")
def q_year_list(spark, sf_dir):
    years = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set(F.year("o_orderdate").cast("string"))), ", ").alias("years"))
    return years.select("o_custkey", F.explode(S.year_list(F.col("years"))).alias("year"))


@query(
    "q_lineage",
    "WITH "
    + FINGERPRINTS.format(where="", name="f")
    + ", "
    + FINGERPRINTS.format(where="WHERE year(o_orderdate) < 2000", name="g").replace("p AS", "q AS").replace("FROM p)", "FROM q)")
    + " SELECT f.part, f.fingerprint AS fp_0, coalesce(g.fingerprint, 'unknown') AS fp_1 FROM f LEFT JOIN g ON g.part = f.part",
)
def q_lineage(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    year = F.year("o_orderdate")
    every, some = (evaluate.partition_fingerprints(x, year, F.col("o_orderkey")) for x in (o, o.where(year < 2000)))
    return evaluate.lineage(every, every, some)


@query(
    "q_subsample",
    """SELECT * EXCLUDE (r, n) FROM (SELECT *, row_number() OVER (ORDER BY md5('7:' || event_id), event_id) AS r, count(*) OVER () AS n FROM events)
       WHERE r <= greatest(1, n // 4)""",
)
def q_subsample(spark, sf_dir):
    return evaluate.subsample(read(spark, sf_dir, "events"), "event_id", 4, 7)


@query(
    "q_day_packs",
    f"""WITH {EV}, m AS (SELECT t // 86400 AS day, t % 86400 // 21600 AS hour, [avg(value), min(value), max(value)] AS v FROM ev GROUP BY 1, 2),
        d AS (SELECT day, flatten(list(v ORDER BY hour)) AS v FROM m GROUP BY day HAVING count(*) = 4)
        SELECT day, list_transform(list_transform(v, lambda y: y::FLOAT::DOUBLE), lambda x: ({HALF})::FLOAT) AS values FROM d""",
)
def q_day_packs(spark, sf_dir):
    ev = event_rows(spark, sf_dir)
    maps = ev.groupBy(F.floor(F.col("t") / DAY).alias("day"), F.floor(F.pmod("t", F.lit(DAY)) / (6 * HOUR)).alias("hour")).agg(
        F.array(*[f("value").cast("float") for f in (F.avg, F.min, F.max)]).alias("v")
    )
    return grids.from_float16(grids.day_packs(maps, "day", "hour", "v", hours=4), "pack").select("day", "values")


# --- ranges, gates, weights ------------------------------------------------------------------------------------------


@query("q_date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1996-02-29' AND DATE '1997-03-01'")
def q_date_range(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return compose.in_range(o, "day", "1996-02-29", "1997-03-01").select("o_orderkey")


@query(
    "q_horizon_rmse",
    f"""WITH {WEEKLY}, p AS (SELECT k AS horizon, d.value AS pred, e.value AS target FROM d CROSS JOIN range(1, 4) AS r(k) JOIN d e ON e.t = d.t + k * 604800)
        SELECT horizon::INT AS horizon, round(sqrt(avg((pred - target) ** 2 / horizon)), 3) AS rmse FROM p GROUP BY 1""",
)
def q_horizon_rmse(spark, sf_dir):
    p = evaluate.persistence(weekly_orders(spark, sf_dir), "t", "value", 3, WEEK)
    return evaluate.horizon_rmse(p, "horizon", F.col("pred") - F.col("target"), 1 / F.col("horizon")).select("horizon", F.round("rmse", 3).alias("rmse"))


@query(
    "q_degree_weights",
    f"WITH {POWER} SELECT vec_id, round(sum((1 + l * (l + 1)) * s_l), 6) AS gradient, round(sum((1 - l / 8.0) * s_l), 6) AS faded FROM p GROUP BY 1",
)
def q_degree_weights(spark, sf_dir):
    p, l = powers(spark, sf_dir), F.col("l")
    sums = p.groupBy("vec_id").agg(F.sum(spectrum.sobolev_weight(l) * F.col("s_l")).alias("g"), F.sum(spectrum.gibbs_window(l, 8) * F.col("s_l")).alias("f"))
    return sums.select("vec_id", r6("g").alias("gradient"), r6("f").alias("faded"))


@query(
    "q_mismatches",
    """SELECT coalesce(c_custkey, s_suppkey) AS k, CASE WHEN s_suppkey IS NULL THEN 'only_old' WHEN c_custkey IS NULL THEN 'only_new' ELSE 'differs' END AS side,
       c_acctbal AS old, s_acctbal AS new FROM customer FULL JOIN supplier ON c_custkey = s_suppkey
       WHERE c_custkey IS NULL OR s_suppkey IS NULL OR abs(c_acctbal - s_acctbal) > 1e-9""",
)
def q_mismatches(spark, sf_dir):
    old = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return evaluate.mismatches(old, new, "k", "v")


@query("q_forcing_schedule", "SELECT o_orderkey, round(greatest(0.0, 1 - (year(o_orderdate) - 1995) / 5.0), 6)::DOUBLE AS share FROM orders")
def q_forcing_schedule(spark, sf_dir):
    epoch = F.year("o_orderdate") - 1995
    return read(spark, sf_dir, "orders").select("o_orderkey", r6(evaluate.teacher_forcing(epoch, 5)).alias("share"))


#: A target grid with rows beyond the source's latitudes on both sides.
POLE_LATS, POLE_LONS = [-80.0, -20.0, 20.0, 80.0], [0.0, 120.0, 240.0]


def _pole_weights() -> list[tuple[int, int, float]]:
    import numpy as np

    return grids.bilinear_weights(np.array(LATS), np.array(LONS), np.array(POLE_LATS), np.array(POLE_LONS))


@query(
    "q_regrid_poles",
    f"""WITH {CELL_SQL}, w AS (SELECT * FROM (VALUES {", ".join(f"({a}, {b}, {w!r}::DOUBLE)" for a, b, w in _pole_weights())}) AS t(target, cell, w))
        SELECT vec_id, target, round(sum(v * w), 6) AS v FROM c JOIN w USING (cell) GROUP BY 1, 2
        UNION ALL SELECT vec_id, (CASE WHEN cell // 8 = 7 THEN 0 ELSE 9 END + k)::INT, round(avg(v), 6) FROM c CROSS JOIN range(3) AS r(k)
        WHERE cell // 8 IN (0, 7) GROUP BY vec_id, cell // 8, k""",
)
def q_regrid_poles(spark, sf_dir):
    out = grids.with_poles(cells(spark, sf_dir), _pole_weights(), ["vec_id"], "cell", "v", (8, 8), (4, 3), south_first=False)
    return out.select("vec_id", "target", r6("v").alias("v"))
