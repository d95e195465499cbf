"""Calibration and evaluation of a classifier from its slots, truth and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import ACCEPT_MARGIN, ACCEPT_P, ANCHOR_WINDOW, CAL_CLASSES
from ..operators import slots as S
from ..registry import query, table
from ..sources.views import observations, sql

_EXPECTED = f"""v_read AS (
    SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY slot_no) - 1 AS i FROM v_slots),
v_offset AS (
    SELECT stream_id, i, row_number() OVER (PARTITION BY stream_id ORDER BY i) AS r, ((cls - i) % {CAL_CLASSES} + {CAL_CLASSES}) % {CAL_CLASSES} AS off FROM v_read WHERE cls IS NOT NULL),
v_mode AS (
    SELECT stream_id, i, off FROM (
        SELECT *, row_number() OVER (PARTITION BY stream_id, i ORDER BY n DESC, first_r) AS k FROM (
            SELECT a.stream_id, a.i, b.off, count(*) AS n, min(b.r) AS first_r FROM v_offset a JOIN v_offset b ON a.stream_id = b.stream_id AND b.r BETWEEN a.r - {ANCHOR_WINDOW - 1} AND a.r GROUP BY ALL) WHERE n >= 2)
    WHERE k = 1),
v_anchor AS (
    SELECT a.stream_id, a.i, m.off FROM v_offset a LEFT JOIN v_mode m USING (stream_id, i)),
v_expect AS (
    SELECT r.stream_id, r.slot_no, r.i, r.cls AS got, CAST((a.off + r.i) % {CAL_CLASSES} AS INT) AS expected
    FROM v_read r ASOF JOIN v_anchor a ON a.stream_id = r.stream_id AND r.i >= a.i WHERE a.off IS NOT NULL)"""
_FRAMES = """v_judged AS (
    SELECT e.stream_id, e.slot_no, e.expected, e.got, f.cls FROM v_expect e JOIN v_islands f USING (stream_id, slot_no))"""


def _cal(body: str, *more: str) -> str:
    return ", ".join([sql("SELECT 1", "v_slots").removesuffix(" SELECT 1"), _EXPECTED, *more]) + " " + body


def expected(spark: SparkSession, d: str) -> DataFrame:
    """stream_id, slot_no, i, got, expected: classes shown in a fixed order are expected from the offset that the last readable slots agree on.

    The vote over a moving window is counted by joining each readable slot to the window's rows, so no list is built.
    """
    read = S.indexed(S.slots(S.islands(observations(spark, d)))).select("stream_id", "slot_no", F.col("index").cast("bigint").alias("i"), "cls")
    order = Window.partitionBy("stream_id").orderBy("i")
    offset = read.where("cls IS NOT NULL").select("stream_id", "i", F.row_number().over(order).alias("r"), F.pmod(F.col("cls") - F.col("i"), F.lit(CAL_CLASSES)).alias("off"))
    # Every offset votes in its own window and the 23 after it.
    votes = offset.select("stream_id", "off", F.col("r").alias("vote"), F.explode(F.sequence("r", F.col("r") + ANCHOR_WINDOW - 1)).alias("r"))
    counted = offset.select("stream_id", "i", "r").join(votes, ["stream_id", "r"]).groupBy("stream_id", "i", "off").agg(F.count("*").alias("n"), F.min("vote").alias("first"))
    best = counted.where("n >= 2").groupBy("stream_id", "i").agg(F.max(F.struct("n", (-F.col("first")).alias("o"), "off")).alias("b")).select("stream_id", "i", F.col("b.off").alias("anchor"))
    marked = read.join(best, ["stream_id", "i"], "left").withColumn("anchor", F.when(F.col("cls").isNotNull(), F.struct(F.col("anchor").alias("off"))))
    held = F.last("anchor", True).over(order.rowsBetween(Window.unboundedPreceding, 0))["off"]
    return marked.withColumn("a", held).where("a IS NOT NULL").select("stream_id", "slot_no", "i", F.col("cls").alias("got"), F.pmod(F.col("a") + F.col("i"), F.lit(CAL_CLASSES)).cast("int").alias("expected"))


def judged(spark: SparkSession, d: str) -> DataFrame:
    frames = S.islands(observations(spark, d)).select("stream_id", "slot_no", "cls")
    return expected(spark, d).drop("i").join(frames, ["stream_id", "slot_no"])


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


CAL_EXPECTED = _cal("SELECT stream_id, slot_no, i, got, expected FROM v_expect")


@query(CAL_EXPECTED)
def cal_expected(spark: SparkSession, d: str) -> DataFrame:
    return expected(spark, d)


_COUNTS = "count(DISTINCT (stream_id, slot_no)) AS slots, count(DISTINCT CASE WHEN got = expected THEN (stream_id, slot_no) END) AS slots_correct, count(*) AS frames, count(*) FILTER (cls IS NOT NULL AND cls <> 258) AS accepted, count(*) FILTER (cls = expected) AS correct"


def counts() -> list[Column]:
    slot = F.struct("stream_id", "slot_no")
    return [
        F.count_distinct(slot).alias("slots"),
        F.count_distinct(F.when(F.col("got") == F.col("expected"), slot)).alias("slots_correct"),
        F.count("*").alias("frames"),
        F.count_if(S.votable(F.col("cls"))).alias("accepted"),
        F.count_if(F.col("cls") == F.col("expected")).alias("correct"),
    ]


@query(_cal(f"SELECT expected, {_COUNTS} FROM v_judged GROUP BY expected", _FRAMES))
def cal_confusion(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).groupBy("expected").agg(*counts())


@query(_cal(f"SELECT expected, CAST(grouping(expected) AS TINYINT) AS total, {_COUNTS} FROM v_judged GROUP BY GROUPING SETS ((expected), ())", _FRAMES))
def cal_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """By class and over all, in one pass."""
    return judged(spark, d).groupingSets([["expected"], []], "expected").agg(F.grouping("expected").alias("total"), *counts()).select("expected", "total", "slots", "slots_correct", "frames", "accepted", "correct")


@query(
    _cal(
        f"SELECT slots, CASE WHEN slots > 0 THEN slots_correct / slots END AS slot_accuracy, frames, CASE WHEN accepted > 0 THEN correct / accepted END AS precision_accepted, CASE WHEN frames > 0 THEN (accepted - correct) / frames END AS false_accept_rate, "
        f"CASE WHEN frames > 0 THEN accepted / frames END AS accept_rate, classes_seen FROM (SELECT {_COUNTS}, count(DISTINCT expected) AS classes_seen FROM v_judged)",
        _FRAMES,
    )
)
def cal_summary(spark: SparkSession, d: str) -> DataFrame:
    t = judged(spark, d).agg(*counts(), F.count_distinct("expected").alias("classes_seen"))
    c = F.col
    return t.select("slots", ratio(c("slots_correct"), c("slots")).alias("slot_accuracy"), "frames", ratio(c("correct"), c("accepted")).alias("precision_accepted"), ratio(c("accepted") - c("correct"), c("frames")).alias("false_accept_rate"), ratio(c("accepted"), c("frames")).alias("accept_rate"), "classes_seen")


@query(
    _cal(
        f"SELECT c.expected AS cls, slots, slots_correct / slots AS slot_accuracy, CASE WHEN accepted > 0 THEN correct / accepted ELSE 1 END AS precision, accepted / frames AS accept_rate, coalesce(worst, '') AS confusions "
        f"FROM (SELECT expected, {_COUNTS} FROM v_judged GROUP BY expected) c LEFT JOIN (SELECT expected, string_agg(cls || ':' || n, ',' ORDER BY n DESC, cls) AS worst FROM (SELECT *, row_number() OVER (PARTITION BY expected ORDER BY n DESC, cls) AS r FROM "
        "(SELECT expected, cls, count(*) AS n FROM v_judged WHERE cls IS NOT NULL AND cls <> 258 AND cls <> expected GROUP BY ALL)) WHERE r <= 3 GROUP BY expected) USING (expected) "
        "WHERE slots_correct < slots OR (accepted > 0 AND correct / accepted < 0.98) ORDER BY slot_accuracy, precision, cls LIMIT 20",
        _FRAMES,
    )
)
def cal_problems(spark: SparkSession, d: str) -> DataFrame:
    """The twenty worst classes with their three commonest confusions."""
    rows = judged(spark, d)
    wrong = rows.where(S.votable(F.col("cls")) & (F.col("cls") != F.col("expected"))).groupBy("expected", "cls").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("expected").orderBy(F.col("n").desc(), "cls"))
    top = wrong.withColumn("r", r).where("r <= 3").groupBy("expected").agg(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(":", F.col("cls").cast("string"), F.col("n").cast("string")).alias("s")))).alias("x"))
    top = top.select("expected", F.array_join(F.transform("x", lambda y: y["s"]), ",").alias("worst"))
    c = F.col
    accuracy, precision = c("slots_correct") / c("slots"), F.coalesce(ratio(c("correct"), c("accepted")), F.lit(1.0))
    out = rows.groupBy("expected").agg(*counts()).join(top, "expected", "left").select(c("expected").alias("cls"), "slots", accuracy.alias("slot_accuracy"), precision.alias("precision"), (c("accepted") / c("frames")).alias("accept_rate"), F.coalesce("worst", F.lit("")).alias("confusions"))
    return out.where("slot_accuracy < 1 OR precision < 0.98").orderBy("slot_accuracy", "precision", "cls").limit(20)


# --- evaluation against a truth timeline: the even events are shown symbols, the others blend two

_TRUTH = "v_truth AS (SELECT event_id AS frame, CASE WHEN event_id % 5 = 4 THEN 'mixed' WHEN event_id % 5 = 3 THEN 'gap' ELSE 'symbol' END AS state, CAST(user_id % 70 AS INT) AS symbol FROM events)"
_LABELLED = """v_labelled AS (
    SELECT o.seq, o.gap, o.cls, CASE t.state WHEN 'symbol' THEN t.symbol::VARCHAR WHEN 'gap' THEN 'gap' END AS label FROM v_obs o JOIN v_truth t ON t.frame = o.seq)"""


def _truth(body: str) -> str:
    return sql("SELECT 1", "v_obs").removesuffix(" SELECT 1") + f", {_TRUTH}, {_LABELLED} {body}"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("event_id") % 5 == 4, "mixed").when(F.col("event_id") % 5 == 3, "gap").otherwise("symbol")
    truth = table(spark, d, "events").select(F.col("event_id").alias("frame"), state.alias("state"), (F.col("user_id") % 70).cast("int").alias("symbol"))
    label = F.when(F.col("state") == "symbol", F.col("symbol").cast("string")).when(F.col("state") == "gap", "gap")
    return observations(spark, d).join(truth, F.col("seq") == F.col("frame")).select("seq", "gap", "cls", label.alias("label"))


@query(_truth("SELECT seq, gap, cls, label FROM v_labelled"))
def eval_truth_join(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d)


_REPORT = """SELECT labelled, symbol_frames, accepted, right_, wrong, CASE WHEN accepted > 0 THEN right_ / accepted END AS precision, CASE WHEN labelled > 0 THEN wrong / labelled END AS far,
    CASE WHEN symbol_frames > 0 THEN right_ / symbol_frames END AS accept_rate, CASE WHEN gaps > 0 THEN gaps_found / gaps END AS gap_recall, coalesce(right_ / nullif(accepted, 0) >= 0.98, false) AND coalesce(wrong / nullif(labelled, 0) < 0.01, false) AS pass
    FROM (SELECT count(label) AS labelled, count(*) FILTER (label <> 'gap') AS symbol_frames, count(*) FILTER (label IS NOT NULL AND NOT gap AND cls < 258) AS accepted, count(*) FILTER (NOT gap AND cls < 258 AND cls::VARCHAR = label) AS right_,
    count(*) FILTER (label IS NOT NULL AND NOT gap AND cls < 258 AND cls::VARCHAR <> label) AS wrong, count(*) FILTER (label = 'gap') AS gaps, count(*) FILTER (label = 'gap' AND gap) AS gaps_found FROM v_labelled)"""


@query(_truth(_REPORT))
def eval_report(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    read, known = ~c("gap") & (c("cls") < 258), c("label").isNotNull()
    same = c("cls").cast("string") == c("label")
    t = labelled(spark, d).agg(
        F.count("label").alias("labelled"),
        F.count_if(c("label") != "gap").alias("symbol_frames"),
        F.count_if(known & read).alias("accepted"),
        F.count_if(read & same).alias("right_"),
        F.count_if(known & read & ~same).alias("wrong"),
        F.count_if(c("label") == "gap").alias("gaps"),
        F.count_if((c("label") == "gap") & c("gap")).alias("gaps_found"),
    )
    ok = F.coalesce(ratio(c("right_"), c("accepted")) >= 0.98, F.lit(False)) & F.coalesce(ratio(c("wrong"), c("labelled")) < 0.01, F.lit(False))
    return t.select("labelled", "symbol_frames", "accepted", "right_", "wrong", ratio(c("right_"), c("accepted")).alias("precision"), ratio(c("wrong"), c("labelled")).alias("far"), ratio(c("right_"), c("symbol_frames")).alias("accept_rate"), ratio(c("gaps_found"), c("gaps")).alias("gap_recall"), ok.alias("pass"))


@query(_truth("SELECT label, count(*) AS frames, count(*) FILTER (NOT gap AND cls < 258) AS accepted, count(*) FILTER (NOT gap AND cls::VARCHAR = label) AS correct, mode(cls) FILTER (false) IS NULL AS dummy FROM v_labelled WHERE label <> 'gap' GROUP BY label").replace(", mode(cls) FILTER (false) IS NULL AS dummy", ""))
def eval_per_class(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return labelled(spark, d).where("label <> 'gap'").groupBy("label").agg(F.count("*").alias("frames"), F.count_if(~c("gap") & (c("cls") < 258)).alias("accepted"), F.count_if(~c("gap") & (c("cls").cast("string") == c("label"))).alias("correct"))


@query(_truth("SELECT label, count(*) AS frames, count(*) FILTER (NOT gap AND cls < 258) AS accepted, count(*) FILTER (NOT gap AND cls::VARCHAR = label) AS correct FROM v_labelled WHERE label <> 'gap' GROUP BY label HAVING count(*) FILTER (NOT gap AND cls < 258) > count(*) FILTER (NOT gap AND cls::VARCHAR = label) OR count(*) FILTER (NOT gap AND cls < 258) < 0.3 * count(*) ORDER BY correct / frames, label LIMIT 40"))
def eval_problems(spark: SparkSession, d: str) -> DataFrame:
    """The forty labels that are read worst."""
    rows = eval_per_class(spark, d).where("accepted > correct OR accepted < 0.3 * frames")
    return rows.orderBy(F.col("correct") / F.col("frames"), "label").limit(40)


@query(_truth("SELECT label, cls, count(*) AS n FROM v_labelled WHERE label IS NOT NULL AND NOT gap AND cls IS NOT NULL AND cls::VARCHAR <> label GROUP BY ALL"))
def eval_confusions(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).where((F.col("label").isNotNull()) & ~F.col("gap") & F.col("cls").isNotNull() & (F.col("cls").cast("string") != F.col("label"))).groupBy("label", "cls").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n, avg((quality = (toxic = 0)::INT)::INT) AS acc, avg((quality = 1)::INT) FILTER (toxic = 0) AS acc_clean, avg((quality = 0)::INT) FILTER (toxic = 1) AS acc_toxic FROM documents JOIN labels USING (doc_id) GROUP BY source")
def val_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two labels by source, and on each value of one."""
    c = F.col
    hit = (c("quality") == (c("toxic") == 0).cast("int")).cast("int")
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.avg(hit).alias("acc"), F.avg(F.when(c("toxic") == 0, (c("quality") == 1).cast("int"))).alias("acc_clean"), F.avg(F.when(c("toxic") == 1, (c("quality") == 0).cast("int"))).alias("acc_toxic"))


# --- embeddings read as logits, their label as truth

TOP_SQL = """v_logit AS (SELECT vec_id, label, CAST(i AS INT) AS k, CAST(embedding[i + 1] AS DOUBLE) * 40 AS z FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings)),
v_soft AS (SELECT vec_id, label, k, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM v_logit),
v_prob AS (SELECT vec_id, label, k, e / sum(e) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS p FROM v_soft),
v_top AS (SELECT vec_id, label, arg_max(k, p) AS top1, round(max(p), 6) AS p1, round(list(p ORDER BY p DESC)[2], 6) AS p2 FROM v_prob GROUP BY ALL)"""


def top2(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, label, top1, p1, p2: softmax and the two best classes, row by row inside the JVM."""
    z = F.transform("embedding", lambda x: x.cast("double") * 40)
    rows = table(spark, d, "embeddings").select("vec_id", "label", z.alias("z"))
    rows = rows.withColumn("e", F.transform("z", lambda x: F.exp(x - F.array_max("z"))))
    rows = rows.withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, x: a + x)).withColumn("best", F.array_max("e"))
    second = F.get(F.sort_array("e", False), F.lit(1))
    return rows.select("vec_id", "label", (F.array_position("e", F.col("best")) - 1).cast("int").alias("top1"), F.round(F.col("best") / F.col("total"), 6).alias("p1"), F.round(second / F.col("total"), 6).alias("p2"))


@query(f"WITH {TOP_SQL} SELECT vec_id, label, top1, p1, p2 FROM v_top")
def softmax_top2(spark: SparkSession, d: str) -> DataFrame:
    return top2(spark, d)


@query(f"WITH {TOP_SQL} SELECT vec_id, top1, p1 >= {ACCEPT_P} AND round(p1 - p2, 6) >= {ACCEPT_MARGIN} AS accepted, CASE WHEN p1 >= {ACCEPT_P} AND round(p1 - p2, 6) >= {ACCEPT_MARGIN} THEN top1 END AS cls FROM v_top")
def accept_filter(spark: SparkSession, d: str) -> DataFrame:
    ok = (F.col("p1") >= ACCEPT_P) & (F.round(F.col("p1") - F.col("p2"), 6) >= ACCEPT_MARGIN)
    return top2(spark, d).select("vec_id", "top1", ok.alias("accepted"), F.when(ok, F.col("top1")).alias("cls"))


@query(f"""WITH {TOP_SQL} SELECT vec_id, residual, CASE WHEN residual < 2 THEN true ELSE top1 % 10 = 0 AND p1 >= 0.5 AND residual < 10 END AS gap
    FROM v_top JOIN (SELECT vec_id, CAST(vec_id % 23 AS DOUBLE) AS residual FROM embeddings) USING (vec_id)""")
def gap_rules(spark: SparkSession, d: str) -> DataFrame:
    """Flat frames are gaps without scoring; the scorer's branch runs on the rest only."""
    residual = (F.col("vec_id") % 23).cast("double")
    flat = table(spark, d, "embeddings").select("vec_id", residual.alias("residual")).where("residual < 2").withColumn("gap", F.lit(True))
    rest = top2(spark, d).withColumn("residual", residual).where("residual >= 2")
    soft = (F.col("top1") % 10 == 0) & (F.col("p1") >= 0.5) & (F.col("residual") < 10)
    return flat.unionByName(rest.select("vec_id", "residual", soft.alias("gap")))


CLASSIFIER_SQL = f"""v_pred AS (SELECT *, top1 % 10 AS pred, p1 >= {ACCEPT_P} AND round(p1 - p2, 6) >= {ACCEPT_MARGIN} AS ok FROM v_top)"""


def predicted(spark: SparkSession, d: str) -> DataFrame:
    ok = (F.col("p1") >= ACCEPT_P) & (F.round(F.col("p1") - F.col("p2"), 6) >= ACCEPT_MARGIN)
    return top2(spark, d).withColumn("pred", F.col("top1") % 10).withColumn("ok", ok)


@query(f"""WITH {TOP_SQL}, {CLASSIFIER_SQL} SELECT count(*) AS n, avg((pred = label)::INT) AS acc, avg((pred = label)::INT) FILTER (label <> 9) AS acc_symbol, avg((pred = label)::INT) FILTER (label = 9) AS acc_none,
    avg((pred = label)::INT) FILTER (ok AND pred <> 9) AS precision_accepted, avg((ok AND pred <> 9 AND pred <> label)::INT) AS far, avg((ok AND pred = label)::INT) FILTER (label <> 9) AS accept_rate FROM v_pred""")
def classifier_eval(spark: SparkSession, d: str) -> DataFrame:
    """Class 9 plays the class of nothing. The false-accept rate is over all rows."""
    c = F.col
    hit, used = (c("pred") == c("label")).cast("int"), c("ok") & (c("pred") != 9)
    return predicted(spark, d).agg(
        F.count("*").alias("n"),
        F.avg(hit).alias("acc"),
        F.avg(F.when(c("label") != 9, hit)).alias("acc_symbol"),
        F.avg(F.when(c("label") == 9, hit)).alias("acc_none"),
        F.avg(F.when(used, hit)).alias("precision_accepted"),
        F.avg((used & (c("pred") != c("label"))).cast("int")).alias("far"),
        F.avg(F.when(c("label") != 9, (c("ok") & (c("pred") == c("label"))).cast("int"))).alias("accept_rate"),
    )


@query(f"WITH {TOP_SQL}, {CLASSIFIER_SQL} SELECT label, pred, count(*) AS n FROM v_pred WHERE label <> pred GROUP BY ALL ORDER BY n DESC, label, pred LIMIT 10")
def confusion_top10(spark: SparkSession, d: str) -> DataFrame:
    wrong = predicted(spark, d).where("label <> pred").withColumn("pred", F.col("pred").cast("int"))
    return wrong.groupBy("label", "pred").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "label", "pred").limit(10)


@query("SELECT coalesce((SELECT variant FROM (SELECT unnest(['int8', 'fp16w']) AS variant, unnest([0.21725, 0.9675]) AS acc, unnest([1, 2]) AS priority) WHERE 0.9675 - acc <= 0.005 ORDER BY priority LIMIT 1), 'fp32') AS variant")
def variant_choice(spark: SparkSession, d: str) -> DataFrame:
    """The first smaller variant whose accuracy falls by no more than half a point, else the full one."""
    rows = spark.createDataFrame([("int8", 0.21725, 1), ("fp16w", 0.9675, 2)], "variant string, acc double, priority int")
    return rows.where(0.9675 - F.col("acc") <= 0.005).agg(F.coalesce(F.min_by("variant", "priority"), F.lit("fp32")).alias("variant"))


