"""Personal data by bootstrapped contextual extraction (operator 4).

Four base patterns find e-mail addresses, IP addresses, card numbers and phone numbers. These, and long hexadecimal strings
as seeds of a fifth kind (``secret``), start a bootstrap:

1. what stands around each seed makes lexical patterns: the front of its own word (``mail:``, ``key="``), the word or the two
   words before it together with that front, and the word before with the word after; letters in lower case, digits as 0. Those of
   at least ``LEAST_SEEDS`` seeds are kept, however large the corpus. A pattern is known by a 64-bit hash, so words of any
   length make one;
2. over all texts, for blocks of about ``BLOCK`` patterns at a time, each kept pattern's occurrences are counted, and the
   identifier-like strings that follow become instances of a pattern-instance graph, pre-aggregated in each task;
3. Spark scores the graph until it settles: a pattern's confidence is the mean of what follows it, weighted by support, with
   one doubt added, so that little support is never certain; an unseen string's is the mean of its patterns; a seed's is 1,
   and that of anything unlike an identifier is 0;
4. patterns of ``CONFIDENT`` or more that lead to strings which are not base matches are applied to all texts, and the
   identifier-like strings after them are added. A secret is only ever found so: a string of hexadecimal digits by itself is none.

Base matches always stay; a found string that overlaps one is not added. Null and empty texts have no spans. Texts are
taken whole, and every base pattern runs in time linear in the text, whatever it holds. Repeated rows give equal
results. An empty table gives no rows. Extra columns are ignored, or carried by ``masked``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import Lookup
from .runtime import cut
from .text import mixed, prefix_sums, slice_hash, steps, words

#: Base kinds, and the kind that only patterns find.
KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
_ALL = (*KINDS, SECRET)
LEAST_SEEDS = 5
#: Patterns that are broadcast at a time: 8 MB of hashes.
BLOCK = 1_000_000
CONFIDENT = 0.8
#: The graph has settled when no confidence moves by more than this; the rounds it may take for it.
SETTLED, ROUNDS = 0.005, 20

# The possessive runs and the look-behinds keep long runs of digits or letters from being read again and again.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])")
_IDENTIFIER = re.compile(r"[A-Za-z0-9._%+@/-]+")
#: Characters at which the front of a word may end.
GLUE = b":=([<\"'"

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[48:58] = 48
_GLUE, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_GLUE[list(GLUE)] = True
_MARK[list(b"0123456789@")] = True


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def emails(text: str) -> list[tuple[int, int]]:
    """Each match holds one ``@``, so it is found from there: the local part to its left, the domain to its right."""
    out, done, at = [], 0, text.find("@")
    back = text[::-1] if at >= 0 else ""
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        start = max(done, len(text) - _LOCAL.match(back, len(text) - at).end()) if m else at
        if m and start < at:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    if not text:
        return []
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if text.count(".") > 2:
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split("."))]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


def seeds(text: str | None) -> list[tuple[int, int, str]]:
    """Base spans, and the hexadecimal strings that do not overlap them."""
    spans = base_spans(text)
    for m in _SECRET.finditer(text or ""):
        if re.search("[0-9]", m[0]) and re.search("[A-Fa-f]", m[0]) and not any(a < m.end() and m.start() < b for a, b, _ in spans):
            spans.append((m.start(), m.end(), SECRET))
    return spans


def _identifier(text: str, start: int) -> str | None:
    """The identifier-like string at a place: it holds a digit or ``@``, and is six characters or longer."""
    m = _IDENTIFIER.match(text, start)
    s = m[0].rstrip("._%+@/-") if m else ""
    return s if len(s) >= 6 and re.search(r"[0-9@]", s) else None


def _hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


class Places:
    """Where identifiers may begin in texts end to end, with the patterns there: at every word, and after every front of a word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = _PLAIN[data]
        starts, ends, by_text = words(low, offsets)
        self.data, self.offsets = data, offsets
        # Code points up to each byte.
        self.points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        if not len(starts):
            self.at = self.end = self.text = np.zeros(0, np.int64)
            self.patterns = np.zeros((4, 0), np.uint64)
            return
        sums = prefix_sums(low)
        glue = np.flatnonzero(_GLUE[low])
        word = np.searchsorted(starts, glue, "right") - 1
        inside = glue + 1 < ends[word]
        inside[:-1] &= glue[1:] != glue[:-1] + 1  # a front ends at the last of several
        word = np.concatenate([np.arange(len(starts)), word[inside]])
        at = np.concatenate([starts, glue[inside] + 1])
        order = np.argsort(at, kind="stable")
        self.at, word = at[order], word[order]
        self.end = ends[word]
        of_word = np.repeat(np.arange(len(by_text) - 1), np.diff(by_text))
        self.text = of_word[word]
        own = mixed(slice_hash(sums, starts, ends))
        front = slice_hash(sums, starts[word], self.at)
        first, last = by_text[self.text], by_text[self.text + 1] - 1
        near = lambda k: own[np.clip(word + k, 0, len(own) - 1)]
        one = mixed(front * np.uint64(3) + near(-1))
        two = mixed(one * np.uint64(5) + near(-2))
        around = mixed(one * np.uint64(7) + near(1))
        # Two words, the words on both sides, one word, the front alone; 0 where there is no such thing.
        pick = lambda ok, x: np.where(ok, x | np.uint64(1), np.uint64(0))
        self.patterns = np.stack([pick(word - 2 >= first, two), pick((word > first) & (word < last), around), pick(word > first, one), pick(self.at > starts[word], mixed(front ^ np.uint64(0x5DEECE66D)))])

    def like_identifiers(self) -> np.ndarray:
        """Whether a word's rest may be an identifier: a digit or ``@`` in it, and six bytes or more."""
        marks = np.concatenate([[0], np.cumsum(_MARK[self.data])])
        return (self.end - self.at >= 6) & (marks[self.end] > marks[self.at])

    def may_begin_seeds(self) -> np.ndarray:
        """Whether a base match may begin at a place: all begin with a digit or ``+``, or have an ``@`` before white space."""
        ats = np.concatenate([[0], np.cumsum(self.data == 64)])
        head = self.data[self.at]
        return (head == 43) | ((head >= 48) & (head <= 57)) | (ats[self.end] > ats[self.at])

    def point(self, k) -> np.ndarray:
        """Code point of a place within its text."""
        return self.points[self.at[k]] - self.points[self.offsets[self.text[k]]]

    def string(self, t: int) -> str:
        return self.data[self.offsets[t] : self.offsets[t + 1]].tobytes().decode()


class Matcher:
    """A set of patterns (hash -> kind), found in many texts at once."""

    def __init__(self, kinds: dict[int, str]):
        self.look = Lookup(np.array(list(kinds), np.int64).view(np.uint64))
        self.kinds = [kinds[int(h)] for h in self.look.values.view(np.int64)]

    def hits(self, places: Places, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place, pattern) of every occurrence, at the places ``use``; the more telling sorts of pattern come first."""
        found = []
        for row in places.patterns:
            at, which = self.look.find(row if use is None else row[use])
            found.append((at if use is None else use[at], which))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Places]]:
    for rows, data, offsets in steps(batches):
        yield rows, Places(data, offsets)


def seed_patterns(docs: DataFrame) -> DataFrame:
    """pattern, kind, seeds: those of at least LEAST_SEEDS seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, places in _texts(batches):
            at, kind = [], []
            for t in range(rows.num_rows):
                text = places.string(t)
                own = seeds(text)
                if own:
                    base = int(places.offsets[t])
                    at += [base + (a if text.isascii() else len(text[:a].encode())) for a, _, _ in own]
                    kind += [k for _, _, k in own]
            at = np.array(at, np.int64)
            place = np.minimum(np.searchsorted(places.at, at), max(0, len(places.at) - 1))
            known = np.flatnonzero(places.at[place] == at) if len(places.at) else np.zeros(0, np.int64)
            for row in places.patterns:
                h = row[place[known]]
                some = np.flatnonzero(h)
                yield pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array([kind[k] for k in known[some].tolist()], pa.string())], names=["pattern", "kind"])

    counted = docs.select("text").mapInArrow(run, "pattern bigint, kind string").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    by_pattern = counted.groupBy("pattern").agg(F.sum("seeds").alias("seeds"), F.max_by("kind", F.struct("seeds", "kind")).alias("kind"))
    return by_pattern.where(F.col("seeds") >= LEAST_SEEDS)


def graph(docs: DataFrame, patterns: dict[int, str]) -> DataFrame:
    """pattern, instance (a hash; null: not like an identifier), seed, base (a seed of a base kind), n."""
    held = docs.sparkSession.sparkContext.broadcast(patterns)

    def given(pattern: np.ndarray, instance: pa.Array, seed: pa.Array, base: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pattern), instance, seed, base, pa.array(n)], names=["pattern", "instance", "seed", "base", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(held.value)
        names = matcher.look.values.view(np.int64)
        none = np.zeros(len(names), np.int64)  # what follows a pattern and is no identifier is counted once for all of a task
        for _, places in _texts(batches):
            place, which = matcher.hits(places)
            some = (places.like_identifiers() | places.may_begin_seeds())[place] if len(place) else np.zeros(0, bool)
            known: dict[int, tuple[str, dict[int, tuple[int, str]]]] = {}
            rows = []
            for p, w in zip(place[some].tolist(), which[some].tolist(), strict=True):
                t = int(places.text[p])
                if t not in known:
                    text = places.string(t)
                    known[t] = text, {a: (b, k) for a, b, k in seeds(text)}
                text, starts = known[t]
                at = int(places.point(p))
                if at in starts:
                    end, kind = starts[at]
                    rows.append((w, _hashed(text[at:end]), True, kind != SECRET))
                else:
                    s = _identifier(text, at)
                    rows.append((w, _hashed(s) if s else None, False, False))
            none += np.bincount(which[~some], minlength=len(names))
            w, instance, seed, base = zip(*rows, strict=True) if rows else ((),) * 4
            yield given(names[np.array(w, np.int64)], pa.array(instance, pa.int64()), pa.array(seed, pa.bool_()), pa.array(base, pa.bool_()), np.ones(len(w), np.int64))
        for a in range(0, len(names), 100_000):
            other = a + np.flatnonzero(none[a : a + 100_000])
            no = pa.array(np.zeros(len(other), bool))
            yield given(names[other], pa.nulls(len(other), pa.int64()), no, no, none[other])

    schema = "pattern bigint, instance bigint, seed boolean, base boolean, n bigint"
    return docs.select("text").mapInArrow(run, schema).groupBy("pattern", "instance", "seed", "base").agg(F.sum("n").alias("n"))


def confidence(edges: DataFrame) -> DataFrame:
    """pattern, confidence, new (whether it leads to anything like an identifier that is no base match).

    The rounds begin with unseen strings at 0, so confidences only rise, and stopping early errs on the side of doubt.
    """
    like = F.col("instance").isNotNull()
    fixed = cut(edges.groupBy("pattern").agg(F.sum(F.when(F.col("seed"), F.col("n")).otherwise(0)).alias("sure"), (F.sum("n") + 1).alias("total"), F.max(like & ~F.col("base")).alias("new")))
    open_ = cut(edges.where(~F.col("seed") & like).groupBy("pattern", "instance").agg(F.sum("n").alias("n")))
    now = cut(fixed.select("pattern", (F.col("sure") / F.col("total")).alias("confidence")))
    if open_.isEmpty():
        return now.join(fixed.select("pattern", "new"), "pattern")
    for _ in range(ROUNDS):
        mean = open_.join(now, "pattern").groupBy("instance").agg((F.sum(F.col("n") * F.col("confidence")) / F.sum("n")).alias("c"))
        more = open_.join(mean, "instance").groupBy("pattern").agg(F.sum(F.col("n") * F.col("c")).alias("more"))
        scored = fixed.join(more, "pattern", "left").select("pattern", ((F.col("sure") + F.coalesce("more", F.lit(0.0))) / F.col("total")).alias("confidence"))
        moved = cut(scored.join(now.withColumnRenamed("confidence", "before"), "pattern"))
        now = moved.select("pattern", "confidence")
        if moved.agg(F.coalesce(F.max(F.col("confidence") - F.col("before")), F.lit(0.0))).first()[0] <= SETTLED:
            break
    return now.join(fixed.select("pattern", "new"), "pattern")


def learnt(docs: DataFrame) -> dict[int, str]:
    """pattern -> kind, of the patterns to apply. Each block of the candidates takes one pass over the texts."""
    patterns = cut(seed_patterns(docs))
    blocks = -(-patterns.count() // BLOCK)
    edges = None
    for k in range(blocks):
        own = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k)
        part = cut(graph(docs, _kinds(own)))
        edges = part if edges is None else edges.unionByName(part)
    if edges is None:
        return {}
    good = confidence(edges).where((F.col("confidence") >= CONFIDENT) & F.col("new"))
    return _kinds(good.join(patterns, "pattern"))


def _kinds(patterns: DataFrame) -> dict[int, str]:
    found = patterns.select("pattern", "kind").toArrow()
    return dict(zip(found.column("pattern").to_pylist(), found.column("kind").to_pylist(), strict=True))


def _added(base: list[tuple[int, int, str]], text: str, hits: list[tuple[int, str]]) -> list[tuple[int, int, str]]:
    """``base`` and the identifier-like strings at the hits (code point, kind), as far as they overlap nothing before them; in order."""
    out, taken = list(base), [(a, b) for a, b, _ in base]
    for at, kind in sorted(hits, key=lambda x: x[0]):
        s = _identifier(text, at)
        if s and not any(a < at + len(s) and at < b for a, b in taken):
            out.append((at, at + len(s), kind))
            taken.append((at, at + len(s)))
    return sorted(out, key=lambda x: (x[0], _ALL.index(x[2]), x[1]))


def _all_spans(batches: Iterator[pa.RecordBatch], matcher: Matcher | None) -> Iterator[tuple[pa.RecordBatch, list[str | None], list, list]]:
    """(rows, texts, base spans, all spans), some rows at a time."""
    for rows, data, offsets in steps(batches):
        hits: dict[int, list[tuple[int, str]]] = {}
        if matcher is not None:
            places = Places(data, offsets)
            place, which = matcher.hits(places, np.flatnonzero(places.like_identifiers()))
            for t, at, w in zip(places.text[place].tolist(), places.point(place).tolist(), which.tolist(), strict=True):
                hits.setdefault(t, []).append((at, matcher.kinds[w]))
        texts = rows.column("text").to_pylist()
        base = [base_spans(t) for t in texts]
        yield rows, texts, base, [_added(b, texts[k], hits[k]) if k in hits else b for k, b in enumerate(base)]


def found_spans(text: str | None, matcher: Matcher | None) -> list[tuple[int, int, str]]:
    """Base spans and those that the patterns add, in order."""
    rows = pa.RecordBatch.from_arrays([pa.array([text], pa.string())], names=["text"])
    return next(iter(_all_spans(iter([rows]), matcher)))[3][0]


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_found (spans that the patterns add)."""
    patterns = docs.sparkSession.sparkContext.broadcast(learnt(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Matcher(patterns.value) if patterns.value else None
        for rows, _, base, spans in _all_spans(batches, known):
            counts = [pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in KINDS]
            digests = pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in base], pa.string())
            found = pa.array([len(s) - len(b) for s, b in zip(spans, base, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *counts, digests, pa.array(map(listed, spans), pa.string()), found], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_found bigint")


def mask(text: str | None, matcher: Matcher | None) -> str | None:
    """Each span replaced by its kind in capitals; overlapping spans become one."""
    return _masked(text, found_spans(text, matcher))


def _masked(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    if not spans:
        return text
    out, done = [], 0
    for a, b, k in spans:
        if a >= done:
            out += [text[done:a], f"<{k.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans in ``text`` masked, and n_chars, if there is one, counted anew."""
    patterns = docs.sparkSession.sparkContext.broadcast(learnt(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Matcher(patterns.value) if patterns.value else None
        for rows, texts, _, spans in _all_spans(batches, known):
            texts = [_masked(t, s) for t, s in zip(texts, spans, strict=True)]
            at = rows.schema.get_field_index("text")
            rows = rows.set_column(at, rows.schema.field(at), pa.array(texts, rows.schema.field(at).type))
            k = rows.schema.get_field_index("n_chars")
            if k >= 0:
                rows = rows.set_column(k, rows.schema.field(k), pa.array([None if t is None else len(t) for t in texts], rows.schema.field(k).type))
            yield rows

    return docs.mapInArrow(run, docs.schema)
