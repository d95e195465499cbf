import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from helpers import corpus, empty

from quillstream.llm import token_counts, tokenizer
from quillstream.llm.queries import VOCABULARY
from quillstream.llm.text import text_bytes

PATH = public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def ours():
    with open(PATH, "rb") as f:
        return tokenizer.encoder(f.read())


@pytest.fixture(scope="module")
def theirs(ours):
    return tiktoken.Encoding("check", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})


@pytest.mark.parametrize("seed", range(4))
def test_random_strings(ours, theirs, seed):
    r = random.Random(seed)
    letters = "'stmdrevl SaZ19 \n\t\r!?.é中٣ 　\u0085😀́ⅷ"
    many = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(3000)]
    for text, packed in zip(many, ours.encode_step(*text_bytes(pa.array(many)))[0], strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == theirs.encode_ordinary(text), text


@pytest.mark.parametrize("text", ["", "a" * 5000, "' " * 300, "'s" * 500, "x" * 70 + "'ll'll've", "  a" * 100, "na" * 4000, "中" * 700, "\n" * 3000])
def test_long_runs(ours, theirs, text):
    assert ours.encode(text) == theirs.encode_ordinary(text)


def test_every_code_point(ours, theirs):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    many = [chr(c) + "'s a" + chr(c) for c in points]
    got = ours.encode_step(*text_bytes(pa.array(many)))[0]
    bad = [hex(c) for c, t, p in zip(points, many, got, strict=True) if np.frombuffer(p, "<u4").tolist() != theirs.encode_ordinary(t)]
    assert not bad


def test_scan_composes():
    r = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 5000):
        f = r.integers(0, 256, n).astype(np.uint8)
        state, want = 3, []
        for x in f.tolist():
            state = x >> 2 * state & 3
            want.append(state)
        assert (tokenizer.scan(f) >> 6).tolist() == want


def test_digests(spark, theirs):
    docs = corpus(spark)
    docs = docs.unionByName(docs.limit(3))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got = tokenizer.digests(docs, PATH).collect()
    assert len(got) == docs.count()
    for r in got:
        ids = theirs.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_encoded_offsets_decode(spark, ours):
    for r in tokenizer.encoded(corpus(spark), PATH, keep=("text", "lang")).collect():
        data = (r.text or "").encode()
        assert ours.decode(r.ids) == data
        begins = [0, *r.token_ends[:-1]]
        assert [data[a:b] for a, b in zip(begins, r.token_ends, strict=False)] == [ours.tokens[i] for i in r.ids]
        assert len(r.ids) == r.n_tokens


def test_empty_table(spark):
    assert tokenizer.digests(empty(spark), PATH).count() == 0
    assert token_counts.token_counts(empty(spark), PATH).count() == 0


def test_token_counts(spark, theirs):
    docs = corpus(spark)
    lengths = [len(theirs.encode_ordinary(r.text or "")) for r in docs.collect()]
    sums = token_counts.token_counts(docs, PATH)
    rows = {r.n_tokens: r for r in sums.collect()}
    assert set(rows) == set(lengths)
    for limit, r in rows.items():
        assert r.n_docs == lengths.count(limit)
        assert r.docs_longer == sum(n > limit for n in lengths)
        assert r.docs_fitting == sum(n <= limit for n in lengths)
        assert r.total_tokens == sum(lengths)
        assert r.tokens_fitting == sum(n for n in lengths if n <= limit)
        assert r.truncated_tokens == sum(min(n, limit) for n in lengths)
        assert r.share_fitting == pytest.approx(r.docs_fitting / len(lengths))
    for r in token_counts.at_limits(sums, [0, 7, 100, 10**6]).collect():
        assert r.truncated_tokens == sum(min(n, r.context_limit) for n in lengths)
        assert r.docs_longer == sum(n > r.context_limit for n in lengths)
    for r in token_counts.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == min(n for n in lengths if sum(x <= n for x in lengths) / len(lengths) >= r.share)


def test_report_of_lengths_limits_and_quantiles(spark, theirs):
    docs = corpus(spark)
    lengths = [len(theirs.encode_ordinary(r.text or "")) for r in docs.collect()]
    limits, shares = [0, 2, 7, 100, 10**6], [0.1, 0.5, 1.0]
    rows = token_counts.report(docs, PATH, limits, shares).collect()
    assert sorted(r.n_tokens for r in rows if r.what == "length") == sorted(set(lengths))
    assert sorted(r.n_tokens for r in rows if r.what == "limit") == limits
    assert sorted(r.share_fitting for r in rows if r.what == "quantile") == shares
    for r in rows:
        n = r.n_tokens
        want = (lengths.count(n), sum(x > n for x in lengths), sum(x <= n for x in lengths), sum(lengths), sum(x for x in lengths if x <= n), sum(min(x, n) for x in lengths))
        assert (r.n_docs, r.docs_longer, r.docs_fitting, r.total_tokens, r.tokens_fitting, r.truncated_tokens) == want
        if r.what == "quantile":
            assert n == min(x for x in lengths if sum(y <= x for y in lengths) / len(lengths) >= r.share_fitting)
        else:
            assert r.share_fitting == pytest.approx(want[2] / len(lengths))
    assert token_counts.report(empty(spark), PATH, limits, shares).count() == 0


def test_suffix_sums_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 8)
    h = spark.createDataFrame([(n, n % 3 + 1) for n in range(0, 60, 2)], "n_tokens bigint, n_docs bigint")
    for r in token_counts.suffix_sums(h).collect():
        assert r.docs_longer == sum(n % 3 + 1 for n in range(0, 60, 2) if n > r.n_tokens)
        assert r.truncated_tokens == sum((n % 3 + 1) * min(n, r.n_tokens) for n in range(0, 60, 2))
