"""Framing of messages: UTF-8 bytes, CRC-16, lengths, systematic Reed-Solomon parity, transmissions."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CRC_INIT, CRC_POLY, END, MAX_PAYLOAD, MIN_PARITY, START
from . import gf256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def utf8_bytes(text: Column) -> Column:
    """array<int> of the text's UTF-8 bytes."""

    def listed(code: Column) -> Column:
        at = F.sequence(F.lit(1), F.length(code), F.lit(2))
        return F.when(F.length(code) == 0, F.array().cast("array<int>")).otherwise(F.transform(at, lambda i: F.conv(code.substr(i, F.lit(2)), 16, 10).cast("int")))

    return bound(F.hex(F.encode(text, "UTF-8")), listed)


def _crc_of_bytes() -> list[int]:
    """What each byte in the register's upper half leaves in it after eight steps."""
    c = np.arange(256) << 8
    for _ in range(8):
        c = np.where(c & 0x8000, c << 1 ^ CRC_POLY, c << 1) & 0xFFFF
    return c.tolist()


def crc16(data: Column) -> Column:
    """CRC-16 with the CCITT polynomial, not reflected, of an array of bytes."""
    table = F.array(*map(F.lit, _crc_of_bytes()))
    byte = lambda c, x: F.get(table, F.shiftright(c, 8).bitwiseXOR(x)).bitwiseXOR(F.shiftleft(c, 8).bitwiseAND(0xFFFF))
    return F.aggregate(data, F.lit(CRC_INIT), byte)


def parity_count(k: Column) -> Column:
    return F.greatest(F.lit(MIN_PARITY), F.ceil(k / 3)).cast("int")


def codeword_length(length: Column) -> Column:
    k = length + 3
    return (k + parity_count(k)).cast("bigint")


def codeword_lengths(spark: SparkSession) -> DataFrame:
    """len, n: payload length and codeword length; one to one."""
    return spark.range(MAX_PAYLOAD + 1).select(F.col("id").alias("len"), codeword_length(F.col("id")).alias("n"))


def data_symbols(text: Column) -> Column:
    """LEN, payload, CRC high, CRC low."""
    framed = lambda d, c: F.concat(F.array(F.size(d)), d, F.array(F.shiftright(c, 8), c.bitwiseAND(255)))
    return bound(utf8_bytes(text), lambda d: bound(crc16(d), lambda c: framed(d, c)))


#: Parity symbols to a long, and longs that hold the parity of any word.
PACKED = 8
LONGS = -(-(-(-(MAX_PAYLOAD + 3) // 3)) // PACKED)


@cache
def _parity_rows() -> pa.Table:
    parts = []
    for nsym in range(MIN_PARITY, -(-(MAX_PAYLOAD + 3) // 3) + 1):
        # k data symbols have nsym parity symbols for k in (3 (nsym - 1), 3 nsym]; degrees run from 0 to k - 1.
        r = gf256.remainders(nsym, min(3 * nsym, MAX_PAYLOAD + 3))
        held = np.zeros((len(r), 8, LONGS * PACKED), np.uint8)
        held[:, :, :nsym] = gf256.mul(1 << np.arange(8)[None, :, None], r[:, None, :])
        longs = pa.array(held.view("<i8").ravel())
        parts.append(pa.table([pa.array(np.full(len(r), nsym, np.int32)), pa.array(np.arange(len(r), dtype=np.int32)), pa.FixedSizeListArray.from_arrays(longs, 8 * LONGS).cast(pa.list_(pa.int64()))], names=["nsym", "deg", "bits"]))
    return pa.concat_tables(parts)


def parity_table(spark: SparkSession) -> DataFrame:
    """nsym, deg, bits: the parity of each of the eight bits of a symbol at degree deg, in LONGS longs. 6,303 rows, fixed by the protocol."""
    return spark.createDataFrame(_parity_rows())


def product(a: Column, b: Column) -> Column:
    """GF(256) product by the logarithm tables."""
    exp, log = (F.array(*map(F.lit, t.tolist())) for t in (gf256.EXP, gf256.LOG))
    return F.when((a == 0) | (b == 0), 0).otherwise(F.get(exp, F.get(log, a) + F.get(log, b))).cast("int")


def power(e: Column) -> Column:
    return F.get(F.array(*map(F.lit, gf256.EXP[:255].tolist())), F.pmod(e, F.lit(255))).cast("int")


def exploded(messages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, k, nsym, pos, sym: data symbols of ``text`` one to a row."""
    # k is taken from the text and not from the symbols: the optimiser would compute these anew for every row made of them.
    k = (F.octet_length("text") + 3).cast("int")
    # Dealt by message while it is a short text, so that what is made of the symbols of each needs no exchange of them.
    dealt = messages.repartition(int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return dealt.select(*keys, k.alias("k"), parity_count(k).alias("nsym"), F.posexplode(data_symbols(F.col("text"))).alias("pos", "sym"))


def parity(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """keys, k, nsym, pos, sym of the parity symbols: the encoder is linear, so all of them are an XOR of what the bits of each symbol add."""
    held = symbols.withColumn("deg", F.col("k") - 1 - F.col("pos")).join(F.broadcast(parity_table(symbols.sparkSession)), ["nsym", "deg"])
    # All bits of a long set where the symbol has the bit, else none.
    mask = [-F.shiftright("sym", b).bitwiseAND(1).cast("bigint") for b in range(8)]
    added = [reduce(Column.bitwiseXOR, (m.bitwiseAND(F.get("bits", F.lit(b * LONGS + j))) for b, m in enumerate(mask))) for j in range(LONGS)]
    sums = held.groupBy(*keys, "k", "nsym").agg(*(F.bit_xor(x).alias(f"_{j}") for j, x in enumerate(added)))
    each = F.array(*(F.shiftright(f"_{j}", 8 * i).bitwiseAND(255).cast("int") for j in range(LONGS) for i in range(PACKED)))
    out = sums.select(*keys, "k", "nsym", F.posexplode(F.slice(each, F.lit(1), F.col("nsym"))).alias("j", "sym"))
    return out.select(*keys, "k", "nsym", (F.col("k") + F.col("j")).alias("pos"), "sym")


def codewords(messages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, k, nsym, pos, sym of whole codewords."""
    data = exploded(messages, keys)
    return data.unionByName(parity(data, keys))


def transmissions(messages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, symbols: START, codeword, END."""
    word = F.transform(F.array_sort(F.collect_list(F.struct("pos", "sym"))), lambda x: x["sym"])
    return codewords(messages, keys).groupBy(*keys).agg(word.alias("w")).select(*keys, F.size("w").alias("n"), F.concat(F.array(F.lit(START)), "w", F.array(F.lit(END))).alias("symbols"))


def syndromes(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, syndrome of received words (keys, k, nsym, pos, sym): the value at a^i, for each of nsym points."""
    n = F.col("k") + F.col("nsym")
    points = words.where("sym <> 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nsym") - 1)))
    term = product(F.col("sym"), power(F.col("i") * (n - 1 - F.col("pos"))))
    return points.groupBy(*keys, "i").agg(F.bit_xor(term).alias("syndrome"))


def share_encoded(text: Column) -> Column:
    """Percent-encoding that leaves A-Z a-z 0-9 and - _ . ! ~ * ' ( ) as they are."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def lenient_text(data: Column) -> Column:
    """Text of bytes; malformed ones become U+FFFD, a leading byte-order mark goes."""
    text = F.make_valid_utf8(data.cast("string"))
    return F.when(F.startswith(text, F.lit("﻿")), F.substring(text, 2, 1 << 30)).otherwise(text)
