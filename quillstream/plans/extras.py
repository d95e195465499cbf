"""Bench figures, status lines, error breakdowns, zips and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import CAL_CLASSES, HISTORY_CAP
from ..operators import slots as S
from ..registry import query, table
from ..sources.views import epoch_ms, observations, payloads, sql
from .dimensions import history
from .quality import CLASSIFIER_SQL, TOP_SQL, predicted


@query(sql("SELECT stream_id, count(*) AS frames, count(*) FILTER (NOT gap AND cls IS NOT NULL) AS accepted, count(*) FILTER (NOT gap) AS symbol_frames, CAST(sum(w) FILTER (NOT gap) AS BIGINT) / count(*) FILTER (NOT gap) AS mean_w FROM v_obs GROUP BY stream_id", "v_obs"))
def bench_metrics(spark: SparkSession, d: str) -> DataFrame:
    shown = ~F.col("gap")
    return observations(spark, d).groupBy("stream_id").agg(
        F.count("*").alias("frames"),
        F.count_if(shown & F.col("cls").isNotNull()).alias("accepted"),
        F.count_if(shown).alias("symbol_frames"),
        F.try_divide(F.sum(F.when(shown, F.col("w"))), F.count_if(shown)).alias("mean_w"),
    )


@query(sql("SELECT stream_id, slots || ' slot' || CASE WHEN slots = 1 THEN '' ELSE 's' END || ', ' || erased || ' erased (' || CAST(round(100.0 * erased / slots) AS BIGINT) || '%)' AS status FROM (SELECT stream_id, count(*) AS slots, count(*) FILTER (cls IS NULL) AS erased FROM v_slots GROUP BY stream_id)", "v_slots"))
def status_lines(spark: SparkSession, d: str) -> DataFrame:
    t = S.slots(S.islands(observations(spark, d))).groupBy("stream_id").agg(F.count("*").alias("slots"), F.count_if(F.col("cls").isNull()).alias("erased"))
    text = lambda c: F.col(c).cast("string")
    share = F.round(100.0 * F.col("erased") / F.col("slots")).cast("bigint").cast("string")
    return t.select("stream_id", F.concat(text("slots"), F.when(F.col("slots") == 1, " slot").otherwise(" slots"), F.lit(", "), text("erased"), F.lit(" erased ("), share, F.lit("%)")).alias("status"))


@query(
    f"WITH {TOP_SQL}, {CLASSIFIER_SQL} SELECT count(*) AS n, count(*) FILTER (label <> 9) AS symbols, count(*) FILTER (ok AND pred <> 9 AND pred = label) AS accepted_correct, count(*) FILTER (ok AND pred <> 9 AND label <> 9 AND pred <> label) AS symbol_to_other, "
    "count(*) FILTER (ok AND pred <> 9 AND label = 9) AS none_to_symbol, avg((pred = label)::INT) FILTER (label = 0) AS start_acc, avg((pred = label)::INT) FILTER (label = 1) AS end_acc FROM v_pred"
)
def error_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Where accepted errors come from; classes 0, 1 and 9 stand for the controls and for nothing."""
    c = F.col
    used = c("ok") & (c("pred") != 9)
    hit = (c("pred") == c("label")).cast("int")
    return predicted(spark, d).agg(
        F.count("*").alias("n"),
        F.count_if(c("label") != 9).alias("symbols"),
        F.count_if(used & (c("pred") == c("label"))).alias("accepted_correct"),
        F.count_if(used & (c("label") != 9) & (c("pred") != c("label"))).alias("symbol_to_other"),
        F.count_if(used & (c("label") == 9)).alias("none_to_symbol"),
        F.avg(F.when(c("label") == 0, hit)).alias("start_acc"),
        F.avg(F.when(c("label") == 1, hit)).alias("end_acc"),
    )


@query(f"WITH {TOP_SQL}, {CLASSIFIER_SQL} SELECT label, count(*) AS wrong FROM v_pred WHERE label <> 9 AND pred <> label GROUP BY label ORDER BY wrong DESC, label LIMIT 10")
def worst_classes(spark: SparkSession, d: str) -> DataFrame:
    return predicted(spark, d).where("label <> 9 AND pred <> label").groupBy("label").agg(F.count("*").alias("wrong")).orderBy(F.col("wrong").desc(), "label").limit(10)


@query("SELECT a.user_id, a.i, a.event_id AS view_event, b.event_id AS click_event FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_type = 'view') a JOIN (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_type = 'click') b USING (user_id, i)")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """The k-th view of each stream beside its k-th click."""
    e = table(spark, d, "events")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint")
    side = lambda kind, name: e.where(F.col("event_type") == kind).select("user_id", i.alias("i"), F.col("event_id").alias(name))
    return side("view", "view_event").join(side("click", "click_event"), ["user_id", "i"])


@query("SELECT r, g, b, printf('#%02X%02X%02X', r, g, b) AS colour FROM (SELECT CAST(i * 37 % 256 AS INT) AS r, CAST(i * 59 % 256 AS INT) AS g, CAST(i * 83 % 256 AS INT) AS b FROM (SELECT unnest(range(256)) AS i))")
def hex_colours(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    rows = spark.range(256).select((i * 37 % 256).cast("int").alias("r"), (i * 59 % 256).cast("int").alias("g"), (i * 83 % 256).cast("int").alias("b"))
    return rows.select("r", "g", "b", F.concat(F.lit("#"), *[F.lpad(F.hex(c), 2, "0") for c in ("r", "g", "b")]).alias("colour"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, round(embedding[1]::DOUBLE / (sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) + 1e-6), 6) AS first_unit FROM embeddings")
def l2_unit(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return table(spark, d, "embeddings").select("vec_id", F.round(norm, 6).alias("norm"), F.round(v[0] / (norm + 1e-6), 6).alias("first_unit"))


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("lang", "source").dropDuplicates()


@query("SELECT id, text FROM (SELECT turn AS id, text FROM conversations UNION ALL SELECT page_id, url FROM pages)")
def concat_sources(spark: SparkSession, d: str) -> DataFrame:
    """Stored and repeated rows as one."""
    return table(spark, d, "conversations").select(F.col("turn").alias("id"), "text").unionByName(table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("text")))


@query(sql("SELECT src, id, turn, reverse(text) AS backwards, text[2:5] AS slice, len(text) AS n FROM v_payload", "v_payload"))
def text_slices(spark: SparkSession, d: str) -> DataFrame:
    return payloads(spark, d).select("src", "id", "turn", F.reverse("text").alias("backwards"), F.substring("text", 2, 4).alias("slice"), F.length("text").cast("bigint").alias("n"))


@query("SELECT user_id, event_type, count(*) AS n, any_value(total) AS total FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS total FROM events) GROUP BY user_id, event_type QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) <= 2")
def votes_top2(spark: SparkSession, d: str) -> DataFrame:
    """The two commonest states of each stream, with its size: counts are pre-aggregated, and only they are ranked."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    user = Window.partitionBy("user_id")
    ranked = n.withColumn("total", F.sum("n").over(user)).withColumn("r", F.row_number().over(user.orderBy(F.col("n").desc(), "event_type")))
    return ranked.where("r <= 2").drop("r")


# --- text and arrays


_LINK = "https?://[^\\s<>\"']+"


@query(
    "WITH cut AS (SELECT page_id, regexp_split_to_array(html, 'https?://[^\\s<>\"'']+') AS plain, regexp_extract_all(html, 'https?://[^\\s<>\"'']+') AS links FROM pages) "
    "SELECT page_id, CAST(2 * k AS INT) AS i, 'text' AS kind, plain[k + 1] AS part FROM (SELECT *, unnest(range(len(plain))) AS k FROM cut) WHERE plain[k + 1] <> '' "
    "UNION ALL SELECT page_id, CAST(2 * k + 1 AS INT), 'link', links[k + 1] FROM (SELECT *, unnest(range(len(links))) AS k FROM cut)"
)
def link_segments(spark: SparkSession, d: str) -> DataFrame:
    """Pages as alternating stretches of plain text (even places, if there is any) and links (odd ones)."""
    plain, links = F.split("html", _LINK, -1), F.regexp_extract_all("html", F.lit(f"({_LINK})"), F.lit(1))
    pages = table(spark, d, "pages")
    parts = lambda words, kind, odd: pages.select("page_id", F.posexplode(words).alias("k", "part")).select("page_id", (2 * F.col("k") + odd).alias("i"), F.lit(kind).alias("kind"), "part")
    return parts(plain, "text", 0).where("part <> ''").unionByName(parts(links, "link", 1))


@query("SELECT event_id, lower(to_base(epoch_us(ts) // 1000, 36)) || '-' || sha1(event_id::VARCHAR)[:5] AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS at FROM events")
def timed_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of a time in base 36 and five digits of a hash, which stands for chance; and the time in ISO 8601."""
    ms = epoch_ms(F.col("ts")).cast("bigint")
    day = F.concat(F.lower(F.conv(ms.cast("string"), 10, 36)), F.lit("-"), F.substring(F.sha1(F.encode(F.col("event_id").cast("string"), "UTF-8")), 1, 5))
    return table(spark, d, "events").select("event_id", day.alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at"))


@query(
    "SELECT event_id, list_reverse(w) AS turned, w[2:3] AS middle, list_concat(w, [0]) AS longer, w[1] <= w[2] AND w[2] <= w[3] AS rising, len(list_filter(w, lambda x: x % 2 = 0)) > 0 AS any_even FROM (SELECT event_id, [event_id % 7, event_id % 11, event_id % 13] AS w FROM events)"
)
def array_steps(spark: SparkSession, d: str) -> DataFrame:
    """Arrays turned round, cut, joined and asked about all or any of their items."""
    w = F.array(*[F.col("event_id") % k for k in (7, 11, 13)])
    rows = table(spark, d, "events").select("event_id", w.alias("w"))
    rising = F.forall(F.sequence(F.lit(0), F.lit(1)), lambda k: F.get("w", k) <= F.get("w", k + 1))
    return rows.select("event_id", F.reverse("w").alias("turned"), F.slice("w", 2, 2).alias("middle"), F.concat("w", F.array(F.lit(0).cast("bigint"))).alias("longer"), rising.alias("rising"), F.exists("w", lambda x: x % 2 == 0).alias("any_even"))


@query(
    "SELECT user_id, event_id, done, 1000::DOUBLE * done / elapsed AS rate, (n - done)::DOUBLE * elapsed / 1000::DOUBLE / done AS eta_s FROM (SELECT user_id, event_id, row_number() OVER o AS done, count(*) OVER (PARTITION BY user_id) AS n, "
    "(epoch_us(ts) // 1000 - first_value(epoch_us(ts) // 1000) OVER o)::DOUBLE AS elapsed FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)) WHERE elapsed > 0"
)
def progress_eta(spark: SparkSession, d: str) -> DataFrame:
    """Rows a second so far, and the seconds that the rest will take at that rate."""
    user = Window.partitionBy("user_id")
    order = user.orderBy("event_id")
    rows = table(spark, d, "events").select("user_id", "event_id", epoch_ms(F.col("ts")).cast("bigint").alias("ms"))
    rows = rows.select("user_id", "event_id", F.row_number().over(order).cast("bigint").alias("done"), F.count("*").over(user).alias("n"), (F.col("ms") - F.first("ms").over(order)).cast("double").alias("elapsed")).where("elapsed > 0")
    left = (F.col("n") - F.col("done")).cast("double") * F.col("elapsed") / 1000 / F.col("done")
    return rows.select("user_id", "event_id", "done", (F.lit(1000.0) * F.col("done") / F.col("elapsed")).alias("rate"), left.alias("eta_s"))


@query(
    "SELECT conv_id, last_turn, text, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY last_turn DESC) AS rank FROM (SELECT conv_id, max(turn) AS last_turn, any_value(text) AS text FROM "
    "(SELECT *, sum(fresh::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn) <> text, true) AS fresh FROM conversations)) GROUP BY conv_id, run)) WHERE rank <= 50"
)
def history_log(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's log as it is kept: a text that repeats the one before only moves its time, and the newest fifty stay."""
    kept = history(table(spark, d, "conversations"), "conv_id", "turn", "text")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("last_turn").desc())).cast("bigint")
    return kept.select("conv_id", "last_turn", "text", rank.alias("rank")).where(F.col("rank") <= HISTORY_CAP)


_JITTER = "CAST(greatest(0, least(255, floor((v - 128) * (0.8::DOUBLE + img % 5 * 0.1::DOUBLE) + 128 + (img % 7 - 3) * 10 + 0.5))) AS BIGINT)"


@query(f"SELECT img, v, {_JITTER} AS jittered FROM (SELECT CAST(unnest(range(35)) AS BIGINT) AS img), (SELECT CAST(unnest(range(256)) AS BIGINT) AS v)")
def colour_jitter(spark: SparkSession, d: str) -> DataFrame:
    """Every brightness under every contrast and shift that a training sample may get, held to a byte."""
    rows = spark.range(35).withColumnRenamed("id", "img").withColumn("v", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(255).cast("bigint"))))
    img, v = F.col("img"), F.col("v")
    value = (v - 128) * (0.8 + img % 5 * 0.1) + 128 + (img % 7 - 3) * 10
    return rows.select("img", "v", F.greatest(F.lit(0), F.least(F.lit(255), F.floor(value + 0.5))).cast("bigint").alias("jittered"))


@query("SELECT CAST(unnest(range(258)) AS INT) AS cls")
def calibration_sequence(spark: SparkSession, d: str) -> DataFrame:
    """The classes in the order in which calibration shows them."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(CAL_CLASSES - 1))).alias("cls"))
