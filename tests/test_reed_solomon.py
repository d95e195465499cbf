import random

import numpy as np
import pytest

from quillstream.functions import gf256
from quillstream.functions import reed_solomon as R


def test_known_parity():
    rows = gf256.remainders(10, 11)[::-1]
    parity = np.bitwise_xor.reduce(gf256.mul(np.array(list(b"hello world"))[:, None], rows), axis=0)
    assert bytes(parity.tolist()).hex() == "ed2554c4fdfd89f3a8aa"


def test_known_crc():
    assert R.crc16(b"123456789") == 0x29B1


def test_lengths_are_one_to_one():
    assert len(R.PAYLOAD_OF) == 189
    assert R.codeword_length(188) == 255
    assert 3 not in R.PAYLOAD_OF


@pytest.mark.parametrize("seed", range(60))
def test_within_capacity(seed):
    r = random.Random(seed)
    payload = bytes(r.randrange(256) for _ in range(r.randrange(189)))
    word: list = R.encode(payload)
    nsym = len(word) - len(payload) - 3
    erased = r.randrange(nsym + 1) if seed % 3 else (0 if seed % 2 else nsym)
    errors = (nsym - erased) // 2
    hit = r.sample(range(len(word)), erased + errors)
    for p in hit[:erased]:
        word[p] = None
    for p in hit[erased:]:
        word[p] ^= r.randrange(1, 256)
    got, fixed = R.decode_message(word)
    assert got == payload
    assert set(fixed) <= set(hit)


@pytest.mark.parametrize("seed", range(40))
def test_beyond_capacity_is_never_wrong(seed):
    r = random.Random(seed)
    payload = bytes(r.randrange(256) for _ in range(60))
    word = [s ^ r.randrange(1, 256) if r.random() < 0.5 else s for s in R.encode(payload)]
    try:
        assert R.decode_message(word)[0] == payload
    except R.DecodeError:
        pass


@pytest.mark.parametrize("word", [[], [1, 2, 3], [0] * 300, [None] * 8])
def test_bad_words_fail_loudly(word):
    with pytest.raises(R.DecodeError):
        R.decode_message(word)


def test_linear_encoder_in_spark(spark):
    from quillstream.functions import protocol as P

    texts = ["", "a", "ñandú 🎈", "x" * 188, "hola mundo"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.symbols for r in P.transmissions(df, ["id"]).collect()}
    assert got == {i: [256, *R.encode(t.encode()), 257] for i, t in enumerate(texts)}
    dirty = P.syndromes(P.codewords(df, ["id"]), ["id"]).where("syndrome <> 0").count()
    assert dirty == 0


def test_lenient_text(spark):
    from pyspark.sql import functions as F

    from quillstream.functions import protocol as P

    df = spark.createDataFrame([(b"ok",), (b"\xef\xbb\xbfbom",), (b"a\xffb",), (None,)], "x binary")
    assert [r[0] for r in df.select(P.lenient_text(F.col("x"))).collect()] == ["ok", "bom", "a�b", None]
