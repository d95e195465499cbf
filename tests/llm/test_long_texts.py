"""Texts of more than a step of work (over a megabyte), whole: what stands at their ends counts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import shingles

from quillstream.llm import decontaminate, fingerprints, neardup, pii, queries, sentences, tokenizer, toxicity
from quillstream.llm.text import STEP_BYTES

WORDS = 260_000


@pytest.fixture(scope="module")
def long_text():
    r = random.Random(21)
    text = " ".join(f"{'abcdefghij'[r.randrange(10)]}{r.randrange(30_000)}{'.' if r.random() < 0.06 else ''}" for _ in range(WORDS))
    assert len(text) > 1.4 * STEP_BYTES
    return text


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_fingerprints(spark, long_text):
    docs = frame(spark, [(1, long_text), (2, long_text), (3, "short one")])
    got = {r.doc_id: r for r in fingerprints.document_fingerprints(docs).collect()}
    assert got[1].fingerprint == got[2].fingerprint and got[1].near_next == 1.0 and got[1].n_chars == len(long_text)
    assert got[1].edited_sha256 == hashlib.sha256(fingerprints.edited(long_text, long_text).encode()).hexdigest()


def test_tokens(spark, long_text):
    path = public_tokenizers.path(queries.VOCABULARY)
    with open(path, "rb") as f:
        ranks = tokenizer.encoder(f.read()).ranks
    theirs = tiktoken.Encoding("check", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = tokenizer.digests(frame(spark, [(1, long_text)]), path).first()
    ids = theirs.encode_ordinary(long_text)
    assert got.n_tokens == len(ids) and got.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert got.decoded_sha256 == hashlib.sha256(long_text.encode()).hexdigest()


def test_toxic_end(spark, long_text):
    r = random.Random(1)
    rows = [(k, " ".join(f"w{r.randrange(300)}" for _ in range(30)) + (" vileness grotty" if k % 4 == 0 else "")) for k in range(400)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, [*rows, (1000, long_text + " vileness grotty"), (1001, long_text)])
    got = {x.doc_id: x.predicted for x in toxicity.scored(docs, labels).where("doc_id >= 1000").collect()}
    assert got == {1000: 1, 1001: 0}


def test_personal_data_at_the_end(spark, long_text):
    text = f"é {long_text} mail me@host.example.org"
    got = pii.personal_data(frame(spark, [(1, text)])).first()
    assert got.n_email == 1 and got.spans.split(",")[-1] == f"email:{len(text) - 19}:{len(text)}"


def test_near_copies(spark, long_text):
    w = long_text.split()
    w[1000], w[-1000] = "changed", "too"
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, [(1, long_text), (2, " ".join(w)), (3, " ".join(w[: WORDS // 2]))]), words=3, percent=85).collect()}
    assert got[1] == (len(shingles(long_text, 3)), 1) and got[2][1] == 1 and got[3][1] == 3


def test_repeated_passage_at_the_end(spark, long_text):
    passage = long_text[-2000:].split(" ", 1)[1]
    got = {r.doc_id: (r.n_words_removed, r.text) for r in sentences.without_repeated_runs(frame(spark, [(1, long_text), (2, f"new words here {passage}")])).collect()}
    assert got == {1: (0, long_text), 2: (len(passage.split()), "new words here ")}


def test_item_at_the_end(spark, long_text):
    items = spark.createDataFrame([(1, "the very last words of a long text"), (2, "never said at all in any place")], "item_id bigint, text string")
    got = decontaminate.contaminated(frame(spark, [(1, long_text + " the very last words of a long text"), (2, long_text)]), items).collect()
    assert [(r.doc_id, r.item_id, r.likeness, r.end_word) for r in got] == [(1, 1, 1.0, WORDS + 8)]
