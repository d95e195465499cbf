"""Messages to codewords and back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gf256
from ..functions import protocol as P
from ..functions.reed_solomon import messages
from ..operators.ordered import array_of
from ..registry import query, table
from ..shipping import ship
from ..sources.views import payloads, sql

KEYS = ["src", "id", "turn"]

_EXP = "[" + ",".join(map(str, gf256.EXP.tolist())) + "]"
_LOG = "[" + ",".join(map(str, gf256.LOG.tolist())) + "]"


def _mul(a: str, b: str) -> str:
    return f"CASE WHEN {a} = 0 OR {b} = 0 THEN 0 ELSE {_EXP}[{_LOG}[{a} + 1] + {_LOG}[{b} + 1] + 1] END"


#: Bytes, CRC, data symbols and the parity of unit polynomials, for the SQL oracles.
_BYTES = "v_bytes AS (SELECT src, id, turn, CAST(i AS INT) AS pos, CAST(('0x' || substr(h, 2 * i + 1, 2)) AS INT) AS byte FROM (SELECT src, id, turn, hex(encode(text)) AS h, unnest(range(strlen(text))) AS i FROM v_payload))"
_CRC = f"""crc_step AS (
    SELECT src, id, turn, hex(encode(text)) AS h, 0 AS i, 65535::BIGINT AS c FROM v_payload
    UNION ALL
    SELECT src, id, turn, h, i + 1, list_reduce(list_prepend(xor(c, CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT) << 8), range(8)), lambda a, k: CASE WHEN a & 32768 <> 0 THEN xor(a << 1, 4129) & 65535 ELSE (a << 1) & 65535 END)
    FROM crc_step WHERE i < length(h) / 2),
v_crc AS (SELECT src, id, turn, c AS crc, i AS len FROM crc_step WHERE i = length(h) / 2)"""
_DATA = """v_data AS (
    SELECT *, CAST(len + 3 AS INT) AS k, CAST(greatest(4, ceil((len + 3) / 3.0)) AS INT) AS nsym FROM (
        SELECT src, id, turn, len, 0 AS pos, CAST(len AS INT) AS sym FROM v_crc
        UNION ALL SELECT src, id, turn, len, pos + 1, byte FROM v_bytes JOIN v_crc USING (src, id, turn)
        UNION ALL SELECT src, id, turn, len, CAST(len + 1 AS INT), CAST(crc >> 8 AS INT) FROM v_crc
        UNION ALL SELECT src, id, turn, len, CAST(len + 2 AS INT), CAST(crc & 255 AS INT) FROM v_crc))"""
_DIM = f"""gen AS (
    SELECT 0 AS n, [1] AS g
    UNION ALL SELECT n + 1, list_transform(range(1, n + 3), lambda j: xor(coalesce(g[j], 0), {_mul("coalesce(g[j - 1], 0)", f"{_EXP}[n + 1]")})) FROM gen WHERE n < 64),
unit AS (
    SELECT n AS nsym, 0 AS deg, g, g[2:] AS r FROM gen WHERE n >= 4
    UNION ALL SELECT nsym, deg + 1, g, list_transform(range(1, nsym + 1), lambda j: xor(coalesce(r[j + 1], 0), {_mul("r[1]", "g[j + 1]")})) FROM unit WHERE deg + 1 < least(3 * nsym, 191)),
v_unit AS (SELECT nsym, deg, unnest(range(nsym)) AS j, unnest(r) AS coef FROM unit)"""
_PARITY = f"""v_parity AS (
    SELECT src, id, turn, k, d.nsym, CAST(k + j AS INT) AS pos, bit_xor(CAST({_mul("sym", "coef")} AS INT)) AS sym
    FROM v_data d JOIN v_unit u ON u.nsym = d.nsym AND u.deg = k - 1 - pos GROUP BY ALL)"""


def _oracle(body: str, *more: str) -> str:
    start = sql("SELECT 1", "v_payload", recursive=True).removesuffix(" SELECT 1")
    return start + ", " + ", ".join(more) + " " + body


def codeword_oracle(body: str) -> str:
    """``body`` over v_word (src, id, turn, pos, sym): whole codewords."""
    return _oracle(body, _BYTES, _CRC, _DATA, _DIM, _PARITY, "v_word AS (SELECT src, id, turn, pos, sym FROM v_data UNION ALL SELECT src, id, turn, pos, sym FROM v_parity)")


@query(_oracle("SELECT * FROM v_bytes", _BYTES))
def utf8_bytes(spark: SparkSession, d: str) -> DataFrame:
    return payloads(spark, d).select(*KEYS, F.posexplode(P.utf8_bytes(F.col("text"))).alias("pos", "byte"))


@query("SELECT 'turn' AS src, conv_id AS id, turn, strlen(text) AS n_bytes, CASE WHEN strlen(text) = 0 THEN 'empty' WHEN strlen(text) > 188 THEN 'too long' ELSE 'ok' END AS status FROM conversations")
def payload_guard(spark: SparkSession, d: str) -> DataFrame:
    n = F.octet_length("text").cast("bigint")
    status = F.when(n == 0, "empty").when(n > 188, "too long").otherwise("ok")
    return table(spark, d, "conversations").select(F.lit("turn").alias("src"), F.col("conv_id").alias("id"), "turn", n.alias("n_bytes"), status.alias("status"))


@query(_oracle("SELECT src, id, turn, CAST(crc AS INT) AS crc FROM v_crc", _CRC))
def crc16(spark: SparkSession, d: str) -> DataFrame:
    return payloads(spark, d).select(*KEYS, P.crc16(P.utf8_bytes(F.col("text"))).alias("crc"))


@query("SELECT len, n, n - len - 3 AS nsym FROM (SELECT len, CAST(len + 3 + greatest(4, ceil((len + 3) / 3.0)) AS BIGINT) AS n FROM (SELECT unnest(range(189)) AS len))")
def codeword_length(spark: SparkSession, d: str) -> DataFrame:
    return P.codeword_lengths(spark).select("len", "n", (F.col("n") - F.col("len") - 3).alias("nsym"))


@query("SELECT n, coalesce(len, -1) AS len FROM (SELECT unnest(range(256)) AS n) LEFT JOIN (SELECT len, CAST(len + 3 + greatest(4, ceil((len + 3) / 3.0)) AS BIGINT) AS n FROM (SELECT unnest(range(189)) AS len)) USING (n)")
def payload_length_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Payload length of every codeword length, -1 where there is none."""
    return spark.range(256).withColumnRenamed("id", "n").join(F.broadcast(P.codeword_lengths(spark)), "n", "left").select("n", F.coalesce("len", F.lit(-1)).alias("len"))


@query(_oracle("SELECT src, id, turn, k, nsym, pos, sym FROM v_data", _BYTES, _CRC, _DATA))
def frame_payload(spark: SparkSession, d: str) -> DataFrame:
    return P.exploded(payloads(spark, d), KEYS)


@query(_oracle("SELECT * FROM v_parity", _BYTES, _CRC, _DATA, _DIM, _PARITY))
def rs_parity(spark: SparkSession, d: str) -> DataFrame:
    return P.parity(P.exploded(payloads(spark, d), KEYS), KEYS)


@query(
    _oracle(
        "SELECT src, id, turn, CAST(count(*) AS INT) AS n, list_concat([256], list(sym ORDER BY pos), [257]) AS symbols FROM (SELECT src, id, turn, pos, sym FROM v_data UNION ALL SELECT src, id, turn, pos, sym FROM v_parity) GROUP BY ALL",
        _BYTES,
        _CRC,
        _DATA,
        _DIM,
        _PARITY,
    )
)
def transmission(spark: SparkSession, d: str) -> DataFrame:
    return P.transmissions(payloads(spark, d), KEYS)


@query(
    _oracle(
        f"SELECT src, id, turn, CAST(i AS INT) AS i, bit_xor(CAST({_EXP}[({_LOG}[sym + 1] + i * (k + nsym - 1 - pos)) % 255 + 1] AS INT)) AS syndrome FROM (SELECT *, unnest(range(nsym)) AS i FROM v_data WHERE sym <> 0) GROUP BY ALL",
        _BYTES,
        _CRC,
        _DATA,
    )
)
def rs_syndromes(spark: SparkSession, d: str) -> DataFrame:
    """Syndromes of words that arrived without their parity."""
    return P.syndromes(P.exploded(payloads(spark, d), KEYS), KEYS)


@query(sql("SELECT src, id, turn, 0 AS dirty, CAST(greatest(4, ceil((strlen(text) + 3) / 3.0)) AS BIGINT) AS nsym FROM v_payload", "v_payload"))
def rs_clean_words(spark: SparkSession, d: str) -> DataFrame:
    """Whole codewords: how many of their syndromes are not zero. Words without any need no decoder."""
    s = P.syndromes(P.codewords(payloads(spark, d), KEYS), KEYS)
    return s.groupBy(*KEYS).agg(F.count_if(F.col("syndrome") != 0).cast("int").alias("dirty"), F.count("*").alias("nsym"))


def _received(spark: SparkSession, d: str) -> DataFrame:
    """Codewords with a quarter of the parity's worth of erasures and as many errors, evenly spread."""
    words = P.codewords(payloads(spark, d), KEYS)
    hits = 2 * F.floor(F.col("nsym") / 4)
    step = F.floor((F.col("k") + F.col("nsym")) / hits)
    at = F.col("pos") - F.pmod(F.col("id"), step)
    hit = (hits > 0) & (F.pmod(at, step) == 0) & (at >= 0) & (F.floor(at / step) < hits)
    nth = F.floor(at / step)
    sym = F.when(hit & (nth % 2 == 0), None).when(hit, F.col("sym").bitwiseXOR(F.lit(85))).otherwise(F.col("sym"))
    return words.withColumn("sym", sym.cast("int")).withColumn("erased", F.col("sym").isNull())


def word_column() -> Column:
    """The symbols of a received word in order, null where erased."""
    return F.transform(F.array_sort(F.collect_list(F.struct("pos", "sym"))), lambda x: x["sym"]).alias("word")


@query(sql("SELECT src, id, turn, text, 'ok' AS status, CAST(2 * (CAST(greatest(4, ceil((strlen(text) + 3) / 3.0)) AS BIGINT) // 4) AS INT) AS corrected FROM v_payload", "v_payload"))
def rs_decode(spark: SparkSession, d: str) -> DataFrame:
    """Corrupted codewords decoded, those of one length together: the oracle is the message that was sent."""
    ship(spark)
    words = _received(spark, d).groupBy(*KEYS).agg(word_column())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = messages([array_of(w.values) for w in batch.column("word")])
            columns = [
                pa.array([m[0].decode("utf-8", "replace") if m else None for m in found], pa.string()),
                pa.array(["ok" if m else "failed" for m in found], pa.string()),
                pa.array([m[1] if m else None for m in found], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEYS), *columns], names=[*KEYS, "text", "status", "corrected"])

    return words.mapInArrow(run, "src string, id bigint, turn bigint, text string, status string, corrected int")


@query(sql("SELECT src, id, turn, list_sort(list(p)) AS positions FROM (SELECT DISTINCT src, id, turn, unnest([0, 1, id % 7, id % 5]) AS p FROM v_payload) GROUP BY ALL", "v_payload"))
def erasure_union(spark: SparkSession, d: str) -> DataFrame:
    """Explicit erasures and those read as null, each once."""
    explicit = F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))
    nulls = F.array(F.pmod("id", F.lit(7)), F.pmod("id", F.lit(5)))
    return payloads(spark, d).select(*KEYS, F.array_sort(F.array_union(explicit, nulls)).alias("positions"))


@query(sql("SELECT src, id, turn, list_sort(list(p)) AS errata FROM (SELECT DISTINCT src, id, turn, unnest([id % 7, id % 5, id % 11, 3]) AS p FROM v_payload) GROUP BY ALL", "v_payload"))
def errata_union_except(spark: SparkSession, d: str) -> DataFrame:
    """Erasures, and the errors that are not among them."""
    erased = F.array_distinct(F.array(F.pmod("id", F.lit(7)), F.pmod("id", F.lit(5))))
    errors = F.array(F.pmod("id", F.lit(11)), F.lit(3).cast("bigint"))
    return payloads(spark, d).select(*KEYS, F.array_sort(F.concat(erased, F.array_except(errors, erased))).alias("errata"))


@query(
    sql(
        "SELECT src, id, turn, CAST(i AS INT) AS i, 'insert' AS kind, list_concat(w[:i], [NULL], w[i + 1:]) AS word FROM (SELECT *, unnest(range(len(w) + 1)) AS i FROM (SELECT src, id, turn, [id % 251, turn, strlen(text)] AS w FROM v_payload)) "
        "UNION ALL SELECT src, id, turn, CAST(i AS INT), 'delete', list_concat(w[:i], w[i + 2:]) FROM (SELECT *, unnest(range(len(w))) AS i FROM (SELECT src, id, turn, [id % 251, turn, strlen(text)] AS w FROM v_payload))",
        "v_payload",
    )
)
def insert_delete_variants(spark: SparkSession, d: str) -> DataFrame:
    """A word with an erasure put in at each place, and with each symbol left out."""
    w = F.array(F.pmod("id", F.lit(251)), F.col("turn"), F.octet_length("text").cast("bigint"))
    words = payloads(spark, d).select(*KEYS, w.alias("w"))
    i = F.col("i")
    none = F.array(F.lit(None).cast("bigint"))
    put = words.select(*KEYS, "w", F.explode(F.sequence(F.lit(0), F.size("w"))).alias("i")).select(*KEYS, "i", F.lit("insert").alias("kind"), F.concat(F.slice("w", F.lit(1), i), none, F.slice("w", i + 1, F.size("w"))).alias("word"))
    out = words.select(*KEYS, "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("i")).select(*KEYS, "i", F.lit("delete").alias("kind"), F.concat(F.slice("w", F.lit(1), i), F.slice("w", i + 2, F.size("w"))).alias("word"))
    return put.unionByName(out)


@query("SELECT page_id, url, 'https://wa.me/?text=' || replace(replace(replace(replace(replace(url_encode(url), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS share FROM pages")
def share_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url", F.concat(F.lit("https://wa.me/?text="), P.share_encoded(F.col("url"))).alias("share"))


_URL = "https?://[^\\s<>\"']+"


@query("SELECT page_id, list_transform(regexp_extract_all(html, 'https?://[^\\s<>\"'']+'), lambda x: x) AS urls, len(regexp_extract_all(html, 'https?://[^\\s<>\"'']+'))::INT AS n FROM pages")
def url_extract(spark: SparkSession, d: str) -> DataFrame:
    urls = F.regexp_extract_all("html", F.lit(f"({_URL})"), F.lit(1))
    return table(spark, d, "pages").select("page_id", urls.alias("urls"), F.size(urls).alias("n"))


@query("SELECT page_id, regexp_replace(url, '(https?://[^\\s<>\"'']+)', '[\\1]', 'g') AS linked FROM pages")
def linkify(spark: SparkSession, d: str) -> DataFrame:
    """Links marked off from the text around them."""
    return table(spark, d, "pages").select("page_id", F.regexp_replace("url", f"({_URL})", "[$1]").alias("linked"))


@query("SELECT doc_id, base64(encode(text)) AS b64, text AS back FROM documents")
def base64_round_trip(spark: SparkSession, d: str) -> DataFrame:
    coded = F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", "")  # without the line breaks of MIME
    return table(spark, d, "documents").select("doc_id", coded.alias("b64"), P.lenient_text(F.unbase64(coded)).alias("back"))


@query(sql("SELECT src, id, turn, text || '\ufffd' || 'x' AS back FROM v_payload", "v_payload"))
def lenient_utf8(spark: SparkSession, d: str) -> DataFrame:
    """Texts that arrive with a byte-order mark before them and a byte in them that is no UTF-8."""
    data = F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"), F.unhex(F.lit("FF78")))
    return payloads(spark, d).select(*KEYS, P.lenient_text(data).alias("back"))
