"""Batch form of the stream jobs, over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.plans.catalog import Tables, query, rounded
from plumbline.streaming import ledger as lg
from plumbline.streaming import limits as lm
from plumbline.streaming import quality as wq


@query("rate_window", """
WITH e AS (SELECT user_id, time_bucket(INTERVAL '6 hours', ts) AS b, ts FROM events),
s AS (SELECT user_id, epoch(ts) AS t, unnest(range(0, 4)) AS k FROM e),
w AS (SELECT user_id, (floor(t / 21600) - k) * 21600 AS start, t FROM s)
SELECT user_id, make_timestamp((start * 1000000)::BIGINT) AS start, count(*) AS n, (count(*) > 3)::BIGINT AS over FROM w
WHERE t >= start AND t < start + 86400 GROUP BY user_id, start""")
def rate_window(t: Tables):
    out = lm.sliding_rate(t("events"), ["user_id"], "ts", "24 hours", "6 hours", limit=3)
    return rounded(out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "over"))


@query("trailing_rate", """
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events),
w AS (SELECT event_id, us, count(*) OVER s AS n, min(us) OVER s AS oldest FROM e
      WINDOW s AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 43199999999 PRECEDING AND CURRENT ROW))
SELECT event_id, n AS n_in_window, (n > 2)::BIGINT AS over,
       CASE WHEN n > 2 THEN greatest(1, floor(43200 - (us - oldest) / 1000000.0) + 1)::BIGINT END AS retry_after FROM w""")
def trailing_rate(t: Tables):
    out = lm.trailing_count(t("events").select("event_id", "user_id", "ts"), ["user_id"], "ts", 43200, 2)
    return rounded(out.select("event_id", "n_in_window", "over", "retry_after"))


@query("limiter_decisions", """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT event_id, user_id, rn, us, [us] AS admitted, true AS allowed, 0::BIGINT AS retry_after FROM e WHERE rn = 1
  UNION ALL
  SELECT event_id, user_id, rn, us, CASE WHEN len(h) < 2 THEN list_append(h, us) ELSE h END, len(h) < 2,
         CASE WHEN len(h) < 2 THEN 0 ELSE greatest(1, (43200000000 - (us - h[1])) // 1000000 + 1) END
  FROM (SELECT e.*, list_filter(r.admitted, lambda t: t > e.us - 43200000000) AS h FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT event_id, allowed::BIGINT AS allowed, retry_after FROM r""")
def limiter_decisions(t: Tables):
    """Two admitted events in twelve hours; refused ones use no slot."""
    out = lm.limiter_decisions(t("events").select("event_id", "user_id", "ts"), ["user_id"], "ts", 43200, 2, ["event_id"])
    return rounded(out.select("event_id", "allowed", "retry_after"))


@query("lockouts", """
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, (event_type = 'error')::INT AS f, (event_type = 'purchase')::INT AS o FROM events),
r AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY us RANGE UNBOUNDED PRECEDING) AS run FROM e),
w AS (SELECT event_id, sum(f) OVER (PARTITION BY user_id, run ORDER BY us RANGE BETWEEN 432000000000 PRECEDING AND CURRENT ROW)::BIGINT AS n_fails FROM r)
SELECT event_id, n_fails, (n_fails >= 3)::BIGINT AS locked FROM w""")
def lockouts(t: Tables):
    """Five-day window: errors are failures, purchases are successes."""
    events = t("events").select("event_id", "user_id", "ts", "event_type")
    out = lm.lockouts(events, ["user_id"], "ts", F.col("event_type") == "error",
                      F.col("event_type") == "purchase", max_fails=3, seconds=432000)
    return rounded(out.select("event_id", "n_fails", "locked"))


@query("session_idle", """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '4 hours' THEN 0 ELSE 1 END AS brk FROM events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, brk DESC ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '4 hours' AS stop, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_idle(t: Tables):
    out = lm.idle_sessions(t("events"), ["user_id"], "ts", "4 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"),
                      F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


def ledger_events(t: Tables):
    """Errors are false-positive marks, signups are useful marks, everything else is a sighting."""
    action = F.when(F.col("event_type") == "error", "false_positive").when(
        F.col("event_type") == "signup", "useful").otherwise("seen")
    key = F.concat(F.lit("k"), (F.col("user_id") * 37 + F.col("event_id") % 41).cast("string"))
    return t("events").select(key.alias("key"), "ts", action.alias("action"),
                              F.col("event_type").alias("source"), F.col("props").alias("sample"), "value")


_LEDGER = """
e AS (SELECT 'k' || (user_id * 37 + event_id % 41) AS key, ts,
        CASE event_type WHEN 'error' THEN 'false_positive' WHEN 'signup' THEN 'useful' ELSE 'seen' END AS action FROM events),
r AS (SELECT key, ts, row_number() OVER (PARTITION BY key ORDER BY ts) AS k FROM e WHERE action = 'seen'),
a AS (SELECT key, count(*) FILTER (action = 'seen') AS seen, count(*) FILTER (action = 'false_positive') AS false_pos,
        count(*) FILTER (action = 'useful') AS useful, min(ts) FILTER (action = 'false_positive') AS ff,
        max(ts) FILTER (action = 'useful') AS lu FROM e GROUP BY key),
t AS (SELECT a.*, (SELECT ts FROM r WHERE r.key = a.key AND k = 2) AS t2, (SELECT ts FROM r WHERE r.key = a.key AND k = 3) AS t3 FROM a),
st AS (SELECT key, seen, false_pos, useful, CASE WHEN false_pos >= 2 THEN 'rejected'
        WHEN (t3 IS NOT NULL AND (ff IS NULL OR t3 < ff)) OR (t2 IS NOT NULL AND lu > t2) THEN 'confirmed' ELSE 'candidate' END AS status FROM t)"""


@query("ledger_status", f"WITH {_LEDGER} SELECT * FROM st")
def ledger_status(t: Tables):
    out = lg.with_status(lg.aggregate_events(ledger_events(t)))
    return out.select("key", "seen", "false_pos", "useful", "status")


@query("ledger_merge", f"WITH {_LEDGER} SELECT * FROM st")
def ledger_merge(t: Tables):
    """Aggregating by halves and merging gives the same ledger as all at once."""
    events = ledger_events(t)
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    merged = lg.merge(lg.aggregate_events(events.where(early)), lg.aggregate_events(events.where(~early)))
    return lg.with_status(merged).select("key", "seen", "false_pos", "useful", "status")


@query("ledger_statistics", f"""
WITH {_LEDGER} SELECT count(*) AS entries, count(*) FILTER (status = 'confirmed') AS confirmed,
       count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'candidate') AS candidate FROM st""")
def ledger_statistics(t: Tables):
    return lg.statistics(lg.aggregate_events(ledger_events(t)))


@query("ledger_context", """
WITH e AS (SELECT 'k' || (user_id * 37 + event_id % 41) AS key, ts, value, event_type FROM events WHERE event_type NOT IN ('error', 'signup')),
l AS (SELECT key, count(*) AS seen, list_sort(list_distinct(list(event_type))) AS sources, max(ts) AS last FROM e GROUP BY key)
SELECT key, seen, array_to_string(sources, ',') AS sources,
       (SELECT max(value) FROM e WHERE e.key = l.key AND e.ts = l.last) AS low FROM l""")
def ledger_context(t: Tables):
    """All sources of an issue and the value range of its latest sighting, merged from two halves."""
    events = ledger_events(t).withColumns({"low": F.col("value"), "high": F.col("value")})
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    merged = lg.merge(lg.aggregate_events(events.where(early)), lg.aggregate_events(events.where(~early)))
    return merged.where("seen > 0").select(
        "key", "seen", F.concat_ws(",", "sources").alias("sources"), F.col("context.low").alias("low"))


@query("ledger_top", f"WITH {_LEDGER} SELECT key, seen FROM st ORDER BY seen DESC, key LIMIT 5")
def ledger_top(t: Tables):
    return lg.top(lg.aggregate_events(ledger_events(t)))


@query("ledger_annotate", """
WITH e AS (SELECT event_type AS category, user_id, (user_id % 7 = 0) AS fp FROM events),
k AS (SELECT category, count(*) FILTER (fp) AS n_fp, count(*) FILTER (NOT fp) AS seen FROM e WHERE category <> 'signup' GROUP BY category),
i AS (SELECT DISTINCT category, 'Score_' || user_id AS columns FROM e)
SELECT columns, i.category, coalesce(n_fp >= 2, false)::BIGINT AS muted, coalesce(seen, 0)::BIGINT AS times_seen FROM i LEFT JOIN k USING (category)""")
def ledger_annotate(t: Tables):
    """One finding per event type and user; the numbering of its column is no part of its key.  Signups are new to the ledger."""
    events = t("events").where("event_type <> 'signup'").select(
        F.concat(F.col("event_type"), F.lit("|score")).alias("key"), "ts",
        F.when(F.col("user_id") % 7 == 0, "false_positive").otherwise("seen").alias("action"))
    issues = t("events").select(
        F.col("event_type").alias("category"),
        F.array(F.concat(F.lit("Score_"), F.col("user_id").cast("string"))).alias("columns")).distinct()
    out = lg.annotate(issues, lg.aggregate_events(events))
    return rounded(out.select(F.concat_ws(",", "columns").alias("columns"), "category", "muted", "times_seen"))


_DIGITS = ", ".join(f"count(*) FILTER (round(abs(value) * 100)::BIGINT % 10 = {d}) AS t{d}" for d in range(10))


_FIRST = ", ".join(
    f"count(*) FILTER (try_cast(substr(ltrim(abs(value)::VARCHAR, '0.'), 1, 1) AS INT) = {d}) AS b{d}" for d in range(1, 10))
_CHI = " + ".join(f"(t{d} - n / 10.0) ** 2 / (n / 10.0)" for d in range(10))
_MAD = "(" + " + ".join(f"abs(b{d} / n::DOUBLE - log10(1.0 + 1.0 / {d}))" for d in range(1, 10)) + ") / 9"
_TOP = "greatest(" + ", ".join(f"t{d}" for d in range(10)) + ")"


@query("windowed_quality", f"""
SELECT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, count(*) - count(value) AS n_missing,
       count(*) FILTER (value NOT BETWEEN 0.05 AND 200) AS n_outside, min(value) AS min, max(value) AS max, {_DIGITS}, {_FIRST}
FROM events GROUP BY 1""")
def windowed_quality(t: Tables):
    out = wq.windowed_quality(t("events"), "ts", "value", 0.05, 200.0, "7 days")
    return rounded(out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "n_missing", "n_outside",
                              "min", "max", *[f"t{d}" for d in range(10)], *[f"b{d}" for d in range(1, 10)]))


@query("window_issues", f"""
WITH w AS (SELECT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n_all, count(value) AS n,
             count(*) FILTER (value NOT BETWEEN 0.05 AND 200) AS o, min(value) AS mn, max(value) AS mx, {_DIGITS}, {_FIRST} FROM events GROUP BY 1)
SELECT start, "check", CASE flag WHEN true THEN 'flagged' WHEN false THEN 'clear' ELSE 'abstained' END AS state FROM (
  SELECT start, 'missing' AS "check", CASE WHEN n_all >= 5 THEN n_all - n >= 0.3 * n_all END AS flag FROM w
  UNION ALL SELECT start, 'outside_range', CASE WHEN n >= 5 THEN o > 0 AND 2 * o <= n END FROM w
  UNION ALL SELECT start, 'constant', CASE WHEN n >= 5 THEN mn = mx END FROM w
  UNION ALL SELECT start, 'last_digit', CASE WHEN n >= 50 THEN {_CHI} > 27.877164871256568 AND {_TOP} / n::DOUBLE >= 0.25 END FROM w
  UNION ALL SELECT start, 'first_digit', CASE WHEN n >= 100 AND mn > 0 AND mx / mn >= 100 THEN {_MAD} > 0.015 END FROM w)""")
def window_issues(t: Tables):
    out = wq.window_issues(wq.windowed_quality(t("events"), "ts", "value", 0.05, 200.0, "7 days"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "check", "state")
