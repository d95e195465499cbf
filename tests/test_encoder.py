"""The encoder on columns: every length and byte, and how much it makes of a symbol."""

import random

from pyspark.sql import functions as F

from quillstream.functions import protocol as P
from quillstream.functions import reed_solomon as R


def test_every_length(spark):
    r = random.Random(5)
    texts = ["".join(chr(r.randrange(1, 128)) for _ in range(n)) for n in range(189)] + ["é" * n for n in range(1, 95)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {x.id: x.symbols for x in P.transmissions(df, ["id"]).collect()}
    assert got == {i: [256, *R.encode(t.encode()), 257] for i, t in enumerate(texts)}


def test_every_byte_as_a_symbol(spark):
    words = [[x, (7 * x + 1) % 256, 255 - x] for x in range(256)]
    rows = [(x, 3, 4, pos, sym) for x, word in enumerate(words) for pos, sym in enumerate(word)]
    df = spark.createDataFrame(rows, "id int, k int, nsym int, pos int, sym int")
    whole = df.unionByName(P.parity(df, ["id"]))
    assert whole.count() == 256 * 7
    assert P.syndromes(whole, ["id"]).where("syndrome <> 0").count() == 0


def test_a_symbol_meets_one_row_of_coefficients(spark):
    table = P.parity_table(spark)
    assert table.groupBy("nsym", "deg").count().agg(F.max("count")).first()[0] == 1


def test_symbols_are_not_exchanged(spark):
    df = spark.range(50).select("id", F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"))
    plan = P.parity(P.exploded(df, ["id"]), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Exchange hashpartitioning") > plan.rindex("Generate ")  # of texts, under what makes symbols of them
