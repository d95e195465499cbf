"""Canonical frames of the driver's tables: observations, payloads, logits, evaluation rows, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import table


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a timestamp without zone, whatever the session's zone."""
    day = F.unix_date(ts.cast("date")).cast("bigint") * 86_400_000
    return day + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_observations(table(spark, sf_dir, "events"))


def as_observations(events: DataFrame) -> DataFrame:
    """stream_id, seq, t_ms, gap, cls, w: events read as classifier observations."""
    k = F.get_json_object("props", "$.k").cast("int")
    cls = F.when(F.col("event_type") == "signup", None).when(k >= 95, 258).when(k >= 84, 257).when(k >= 70, 256).otherwise(k)
    return events.select(
        F.col("user_id").alias("stream_id"),
        F.col("event_id").alias("seq"),
        epoch_ms(F.col("ts")).cast("bigint").alias("t_ms"),
        (F.col("event_type") == "error").alias("gap"),
        cls.cast("int").alias("cls"),
        F.round(F.col("value") * 100).cast("bigint").alias("w"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, id, turn, text: texts of 1 to 188 bytes."""
    turns = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("src"), F.col("conv_id").alias("id"), "turn", "text")
    urls = table(spark, sf_dir, "pages").select(F.lit("url").alias("src"), F.col("page_id").alias("id"), F.lit(0).cast("bigint").alias("turn"), F.col("url").alias("text"))
    return turns.unionByName(urls).where(F.octet_length("text").between(1, 188))


#: The same frames for the SQL oracles, by name; each may use those before it.
SQL_VIEWS = {
    "v_obs": """
        SELECT user_id AS stream_id, event_id AS seq, epoch_us(ts) // 1000 AS t_ms, event_type = 'error' AS gap,
               CAST(CASE WHEN event_type = 'signup' THEN NULL WHEN k >= 95 THEN 258 WHEN k >= 84 THEN 257 WHEN k >= 70 THEN 256 ELSE k END AS INT) AS cls,
               CAST(round(value * 100) AS BIGINT) AS w
        FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k FROM events)""",
    "v_islands": """
        SELECT * EXCLUDE (gap) FROM (
            SELECT *, CAST(sum(gap::INT) OVER (PARTITION BY stream_id ORDER BY t_ms, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS slot_no FROM v_obs)
        WHERE NOT gap""",
    "v_votes": """
        SELECT stream_id, slot_no, cls, CAST(sum(w) AS BIGINT) AS weight, count(*) AS n, min(seq) AS first_seq
        FROM v_islands WHERE cls IS NOT NULL AND cls <> 258 GROUP BY ALL""",
    "v_ballots": """
        SELECT stream_id, slot_no, CAST(sum(weight) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS accepted,
               arg_max(cls, weight * 1000000000 - first_seq) FILTER (weight > 0) AS winner,
               max(weight) FILTER (weight > 0) AS best, arg_max(n, weight * 1000000000 - first_seq) FILTER (weight > 0) AS winner_frames
        FROM v_votes GROUP BY ALL""",
    "v_slots": """
        SELECT * FROM (
            SELECT f.stream_id, f.slot_no, f.frames, f.t_start, f.t_end, coalesce(b.accepted, 0) AS accepted,
                   CASE WHEN guarded THEN NULL ELSE winner END AS cls,
                   CASE WHEN guarded OR winner IS NULL THEN 0 ELSE best / total END AS share,
                   CASE WHEN guarded OR winner IS NULL THEN 0 ELSE best / total * (1 - pow(0.5, winner_frames)) END AS reliability
            FROM (SELECT stream_id, slot_no, count(*) AS frames, min(t_ms) AS t_start, max(t_ms) AS t_end FROM v_islands GROUP BY ALL) f
            LEFT JOIN (SELECT *, winner IN (256, 257) AND winner_frames < 2 AS guarded FROM v_ballots) b USING (stream_id, slot_no))
        WHERE cls IS NOT NULL OR frames >= 2""",
    "v_marked": """
        SELECT *, coalesce(cls IN (256, 257), false) AS control,
               CAST(sum(coalesce(cls IN (256, 257), false)::INT) OVER (PARTITION BY stream_id ORDER BY slot_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS pass_no
        FROM v_slots""",
    "v_controls": """
        SELECT stream_id, pass_no, cls AS opened, lead(cls) OVER (PARTITION BY stream_id ORDER BY pass_no) AS closed FROM v_marked WHERE control""",
    "v_symbols": """
        SELECT m.stream_id, m.pass_no, row_number() OVER (PARTITION BY m.stream_id, m.pass_no ORDER BY slot_no) - 1 AS i,
               m.cls AS sym, CASE WHEN m.cls IS NULL THEN 0.0 ELSE greatest(0.05, m.reliability) END AS rel
        FROM v_marked m WHERE NOT control""",
    "v_passes": """
        SELECT s.stream_id, s.pass_no, count(*) AS length, coalesce(c.opened = 256, false) AS has_start,
               coalesce(c.opened = 257, false) AS after_end, coalesce(n.cls = 257, false) AS has_end, n.cls IS NULL AS is_current
        FROM v_symbols s LEFT JOIN v_controls c USING (stream_id, pass_no)
        LEFT JOIN (SELECT stream_id, pass_no - 1 AS pass_no, cls FROM v_marked WHERE control) n ON n.stream_id = s.stream_id AND n.pass_no = s.pass_no
        GROUP BY ALL""",
    "v_used": """
        SELECT * EXCLUDE (age) FROM (
            SELECT *, row_number() OVER (PARTITION BY stream_id, is_current ORDER BY pass_no DESC) AS age FROM v_passes
            WHERE (NOT is_current AND (has_start OR has_end)) OR (is_current AND has_start)) WHERE age <= 12""",
    "v_lengths": "SELECT len, CAST(len + 3 + greatest(4, ceil((len + 3) / 3.0)) AS BIGINT) AS n FROM (SELECT CAST(unnest(range(189)) AS BIGINT) AS len)",
    "v_support": """
        SELECT stream_id, n, round(sum(weight), 6) AS support, CAST(min(seen) AS BIGINT) AS seen FROM (
            SELECT stream_id, length + d AS n, CASE WHEN d = 0 THEN 2.0 ELSE 0.5 / abs(d) END AS weight, pass_no * 10 + CASE d WHEN 0 THEN 0 WHEN -2 THEN 1 WHEN -1 THEN 2 WHEN 1 THEN 3 ELSE 4 END AS seen
            FROM v_used, (SELECT unnest([-2, -1, 0, 1, 2]) AS d) WHERE has_start AND has_end
            UNION ALL SELECT u.stream_id, u.length - 1, CASE WHEN s.sym IS NULL THEN 1.5 ELSE 1.0 END, u.pass_no * 10 FROM v_used u JOIN v_symbols s USING (stream_id, pass_no) WHERE after_end AND has_end AND s.i = 0
            UNION ALL SELECT stream_id, length, 1.0, pass_no * 10 + 1 FROM v_used WHERE after_end AND has_end
            UNION ALL SELECT u.stream_id, l.n, 1 + s.rel, u.pass_no * 10 + 5 FROM v_used u JOIN v_symbols s USING (stream_id, pass_no) JOIN v_lengths l ON l.len = s.sym WHERE has_start AND s.i = 0)
        WHERE n IN (SELECT n FROM v_lengths) GROUP BY stream_id, n""",
    "v_expected": "SELECT stream_id, n FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY support DESC, seen) AS r FROM v_support) WHERE r = 1",
    "v_cast": """
        SELECT stream_id, n, pos, sym, round(sum(rel), 6) AS weight, min(pass_no) AS first_pass FROM (
            SELECT s.stream_id, s.pass_no, e.n, s.sym, s.rel, CASE WHEN u.has_start THEN s.i ELSE e.n - u.length + s.i END AS pos
            FROM v_used u JOIN v_expected e USING (stream_id) JOIN v_symbols s USING (stream_id, pass_no)
            WHERE s.sym IS NOT NULL AND CASE WHEN u.has_start AND u.has_end THEN u.length = e.n ELSE u.length <= e.n + 2 END)
        WHERE pos >= 0 AND pos < n GROUP BY stream_id, n, pos, sym""",
    "v_payload": """
        SELECT 'turn' AS src, conv_id AS id, turn, text FROM conversations WHERE strlen(text) BETWEEN 1 AND 188
        UNION ALL SELECT 'url', page_id, 0::BIGINT, url FROM pages WHERE strlen(url) BETWEEN 1 AND 188""",
}


def sql(body: str, *views: str, recursive: bool = False) -> str:
    """``body`` with the views it names and those before them."""
    last = max(list(SQL_VIEWS).index(v) for v in views) if views else -1
    start = list(SQL_VIEWS).index("v_payload") if views == ("v_payload",) else 0
    parts = ", ".join(f"{k} AS ({q})" for k, q in list(SQL_VIEWS.items())[start : last + 1])
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts} {body}" if parts else body
