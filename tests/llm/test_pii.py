import hashlib
import random
import re
import time

import numpy as np
import pytest
from helpers import corpus, empty

from quillstream.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1]))
        return 12 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(kind, m[0])]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


@pytest.mark.parametrize("letters", ["ab.@-+ 0123456789()%é\n", "1.2 3@a-+5", "4111 -+.@x"])
def test_base_spans(letters):
    r = random.Random(1)
    for _ in range(20_000):
        text = "".join(r.choice(letters) for _ in range(r.randrange(40)))
        assert pii.base_spans(text) == brute(text), text


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "a@b." * 50_000, "+" + "1 " * 100_000])
def test_long_texts_take_linear_time(text):
    began = time.perf_counter()
    pii.base_spans(text)
    assert time.perf_counter() - began < 2


def at_place(text, start):
    data = np.frombuffer(text.encode(), np.uint8)
    places = pii.Places(data, np.array([0, len(data)]))
    k = np.flatnonzero(places.at == len(text[:start].encode()))
    return places.patterns[:, k[0]].tolist() if len(k) else None


def test_patterns_of_a_place():
    two, around, one, front = at_place("Mail7 to a@b.cc now", 9)
    assert two and around and one and not front
    assert at_place("é xx MAIL3\n to u@v.ww now", 15) == [two, around, one, front]  # case, digits and white space do not matter
    assert at_place("to a@b.cc", 3)[:2] == [0, 0] and at_place("to a@b.cc", 3)[2] == one
    assert at_place("a@b.cc", 0) == [0, 0, 0, 0]
    with_front = at_place("see mail:a@b.cc", 9)
    assert with_front[3] and with_front[3] == at_place("mail:x", 5)[3] and with_front[3] != at_place("post:x", 5)[3]
    assert at_place("see maila@b.cc", 9) is None and at_place('token = "04db"', 9)[2:] != at_place('other = "04db"', 9)[2:][::-1]
    long = "w" * 300_000  # words of any length
    assert at_place(f"{long} {long}: 123456", 600_003)[0] and at_place(f"{long} {long}: 123456", 600_003)[0] == at_place(f"x {long} {long}: 99", 600_005)[0]


def bootstrap_rows():
    rows = [(k, f"some words here Passport-Mail: user{k}@mail{k}.example.com and more of it {k}") for k in range(40)]
    rows += [(100 + k, f"Passport-Mail: agent{k}#x or Passport-Mail: zz-{k}77ab then") for k in range(3)]
    return rows + [(300, "user9@mail9.example.com first"), (301, "+1 (234) 555-0199"), (200, "the number 12345678 stands alone"), (201, None), (202, "")]


def test_contexts_find_unseen_identifiers(spark):
    docs = spark.createDataFrame(bootstrap_rows(), "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    text = dict(bootstrap_rows())
    for i, r in got.items():
        base = brute(text[i])
        assert r.base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, _, x in base) for k in PATTERNS)
        assert set(pii.listed(base).split(",")) - {""} <= set(r.spans.split(","))
    found = {i: text[i][int(a) : int(b)] for i in (100, 101, 102) for s in got[i].spans.split(",") if s for _, a, b in [s.split(":")] if "zz" in text[i][int(a) : int(b)]}
    assert found == {100: "zz-077ab", 101: "zz-177ab", 102: "zz-277ab"}
    assert got[200].spans == ""


def test_corpus_of_odd_texts(spark):
    docs = corpus(spark)
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id].spans == pii.listed(brute(r.text))
    assert pii.personal_data(empty(spark)).count() == 0


def test_common_words_are_no_patterns(spark):
    rows = [(k, f"of of of of of user{k}@mail.example.com of nothing else of all 12345x of it") for k in range(50)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.n_found for r in got} == {0}


def test_masked(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cc or 10.0.0.1 now", 9, "x"), (2, None, 0, "y")], "doc_id bigint, text string, n_chars bigint, spans string")
    got = {r.doc_id: r for r in pii.masked(docs).collect()}
    assert got[1].text == "mail <EMAIL> or <IP> now" and got[1].n_chars == len(got[1].text) and got[1].spans == "x"
    assert got[2].text is None


@pytest.mark.parametrize("seed", ["+1 (234) 555-0{:03}", "4111 1111 1111 1111"])
def test_contexts_of_seeds_with_short_first_words(spark, seed):
    rows = [(k, f"some words here Reach-Line: {seed.format(100 + k)} and more of it") for k in range(40)]
    rows += [(100 + k, f"Reach-Line: zz-{k}77ab then") for k in range(3)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[100 + k].n_found for k in range(3)] == [1, 1, 1]
    assert all(got[k].n_found == 0 and got[k].n_phone + got[k].n_card == 1 for k in range(40))


def test_patterns_are_kept_at_every_size_and_in_blocks(spark, monkeypatch):
    lines = [" ".join(f"user{k}.{n}@mail.example.com" for n in range(600)) for k in range(100)]  # 60,000 seeds
    rows = [(k, t) for k, t in enumerate(lines)] + [(200 + k, f"some words Passport-Mail: a{k}@b.cc and Other-Mail: c{k}@d.ee on") for k in range(8)]
    rows += [(300, "Passport-Mail: zz-177ab then"), (301, "Other-Mail: zz-277ab then")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = {r.pattern for r in pii.seed_patterns(docs).collect()}
    whole = pii.learnt(docs)
    monkeypatch.setattr(pii, "BLOCK", 2)
    assert len(known) > 2 and pii.learnt(docs) == whole and set(whole) <= known
    assert [pii.listed(pii.found_spans(t, pii.Matcher(whole))) for _, t in rows[-2:]] == ["email:15:23", "email:12:20"]


def test_secrets_are_found_by_what_stands_before_them(spark):
    r = random.Random(4)
    code = lambda: hashlib.sha1(str(r.random()).encode()).hexdigest()
    prose = lambda: " ".join(r.choices("lorem ipsum dolor sit amet the of".split(), k=8))
    rows = [(k, f'{prose()} token = "{code()}" {prose()}') for k in range(30)]
    rows += [(100, f'{prose()} TOKEN = "{code().upper()}" on'), (101, f'x token = "zz-77-not-hex-9" {prose()}')]
    rows += [(200, f"{prose()} {code()} {prose()}"), (201, f"commit {code()}"), (202, 'token = "none"')]
    text = dict(rows)
    got = {x.doc_id: [text[x.doc_id][int(a) : int(b)] for s in x.spans.split(",") if s for _, a, b in [s.split(":")]] for x in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[100] == [text[100].split('"')[1]] and got[101] == ["zz-77-not-hex-9"]
    assert got[200] == got[201] == got[202] == [] and all(got[k] == [text[k].split('"')[1]] for k in range(30))


def test_graph_scores_settle_at_the_means(spark):
    """Two patterns that share unseen strings, against the linear equations."""
    edges = [(1, 10, True, True, 8), (1, 20, False, False, 2), (2, 20, False, False, 1), (2, 30, False, False, 3), (2, 11, True, True, 4), (2, None, False, False, 2), (3, None, False, False, 9), (3, 12, True, True, 1)]
    got = {x.pattern: (x.confidence, x.new) for x in pii.confidence(spark.createDataFrame(edges, "pattern bigint, instance bigint, seed boolean, base boolean, n bigint")).collect()}
    # c1 = (8 + 2 x) / 11, c2 = (4 + x + 3 y) / 11, x = (2 c1 + c2) / 3, y = c2, c3 = 1 / 11
    a = np.array([[1, 0, -2 / 11, 0], [0, 1, -1 / 11, -3 / 11], [-2 / 3, -1 / 3, 1, 0], [0, -1, 0, 1]])
    c1, c2, _, _ = np.linalg.solve(a, [8 / 11, 4 / 11, 0, 0])
    assert abs(got[1][0] - c1) < 0.01 and abs(got[2][0] - c2) < 0.01 and abs(got[3][0] - 1 / 11) < 1e-9
    assert (got[1][1], got[2][1], got[3][1]) == (True, True, False)


def test_precision_and_recall_of_planted_identifiers(spark):
    """Member numbers after three field names, seen with e-mails too; decoys after other words."""
    r = random.Random(12)
    fields, other = ["Member-Contact:", "reach=", "Account owner"], ["total", "order", "page", "in"]
    prose = lambda n: " ".join(r.choices([f"word{chr(97 + k)}" for k in range(26)], k=n))
    rows, planted = [], {}
    for k in range(400):
        f = r.choice(fields)
        gap = "" if f.endswith("=") else " "
        hidden = r.random() < 0.25
        what = f"MB-{r.randrange(10**6):06d}" if hidden else f"u{k}@mail{k % 7}.example.org"
        t = f"{prose(5)} {f}{gap}"
        rows.append((k, f"{t}{what} {prose(5)} {r.choice(other)} {r.randrange(10**7, 10**8)} {prose(3)}"))
        planted[k] = {what} if hidden else set()
    text = dict(rows)
    found = {x.doc_id: {text[x.doc_id][int(a) : int(b)] for s in x.spans.split(",") if s for _, a, b in [s.split(":")]} for x in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    more = {k: {s for s in v if "@" not in s} for k, v in found.items()}
    hits = sum(len(more[k] & planted[k]) for k in more)
    assert hits >= 0.9 * sum(map(len, planted.values())) and hits >= 0.95 * sum(map(len, more.values()))
