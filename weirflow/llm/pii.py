"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

Base spans are patterns with checks (``email``, ``ip``, ``card``, ``phone``); they are always reported. What patterns miss, above all
numbers that stand next to each other and are swallowed as one, comes from candidates: stretches of digit runs and of dotted runs (they may overlap),
numbers without a country code, mail addresses written with words. Labelers vote for, against or not at all on a candidate: regular expressions for exact
forms, checksums, gazetteers (issuers' prefixes, country codes, top-level domains, private networks) and the words and data around. Of the votes
over the whole corpus only the counts by pattern of votes and features are kept, a table that doesn't grow with the rows. From it
expectation-maximisation estimates, per kind, how reliable each labeler is (labelers are taken as independent given the truth), and a logistic
classifier is trained on the features with the posteriors as weights. It decides every candidate, in a second pass.

Defined results: null counts as empty; an empty text has no spans. Offsets are code points, ends exclusive. Ties in the start go by kind in the
order of ``KINDS``. Repeated rows each give a row; an empty table none; further columns are ignored. Without candidates the classifier accepts none.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import tables

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")
HAS_DIGIT = re.compile("[0-9]")

# Candidates beyond the base patterns.
DIGITS = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++){4,}+")
GROUP = re.compile("[0-9]+")
#: Digits of a card, at least and at most; a group of more digits is cut into cards of ``GLUED`` or more.
CARD_DIGITS, GLUED = (12, 19), 13
FORMED_PHONE = re.compile(r"(?<![0-9+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])")
FORMED_CARD = re.compile(r"(?<![0-9])(?:[0-9]{4}[\x20-]?){3}[0-9]{1,7}(?![0-9])|(?<![0-9])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])")
WORDED_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?[\[({]at[\])}]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[({]dot[\])}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{1,63}){1,4}")
#: Letters before and after a span that context labelers read.
AROUND = 40

# Gazetteers.
TOP_DOMAINS = frozenset("com org net edu gov info io de fr es uk eu us ch at it nl biz dev app".split())
ISSUERS = re.compile("4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38")
COUNTRY_CODES = re.compile(r"\+?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")
PRIVATE = re.compile(r"10\.|127\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.")
CONTEXT = {
    "email": re.compile(r"mail|contact|kontakt|write|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|host|server|address", re.I),
    "card": re.compile(r"card|visa|karte|carte|tarjeta|credit|payment", re.I),
    "phone": re.compile(r"phone|call|tel|fax|mobile|ruf|llam|appel", re.I),
}
AGAINST = re.compile(r"version|isbn|order|page|\bno\.|§|chapter", re.I)


#: What a digit counts in the check at odd places from the right, and at even ones.
ONCE, TWICE = (bytes.maketrans(b"0123456789", bytes(x)) for x in (range(10), (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))


def luhn(digits: str) -> bool:
    own = digits.encode()
    return (sum(own[::-2].translate(ONCE)) + sum(own[-2::-2].translate(TWICE))) % 10 == 0


def octet(part: str) -> bool:
    own = part.lstrip("0")
    return len(own) <= 3 and int(own or 0) <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: each @ takes what can stand before it, down to the last match."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            done = m.end()
            at = text.find("@", m.end())
        else:
            at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {"email": emails(text) if "@" in text else [], "ip": [], "card": [], "phone": []}
    if not HAS_DIGIT.search(text):
        return found
    if "." in text:
        found["ip"] = [m.span() for m in IP.finditer(text) if all(map(octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found["phone"].append(m.span())
    return found


class Checks:
    """Luhn checks of any stretch of a digit string, from sums of its beginnings."""

    def __init__(self, digits: str) -> None:
        d = np.frombuffer(digits.encode(), np.uint8).astype(np.int64) - 48
        twice = np.where(d > 4, 2 * d - 9, 2 * d)
        even = np.arange(len(d)) % 2 == 0
        # the sums if the digits at even, or at odd places count once
        self.sums = [np.concatenate([[0], np.cumsum(np.where(even == once, d, twice))]) for once in (True, False)]
        self.lists: list[list[int]] | None = None

    def __call__(self, a: int, b: int) -> bool:
        if self.lists is None:
            self.lists = [x.tolist() for x in self.sums]
        own = self.lists[(b - 1) % 2]
        return (own[b] - own[a]) % 10 == 0

    def all(self, length: int) -> np.ndarray:
        """The check of each stretch of this length, by its start."""
        n = len(self.sums[0])
        if n <= length:
            return np.zeros(0, bool)
        by_end = [(x[length:] - x[:-length]) % 10 == 0 for x in self.sums]
        return np.where((np.arange(n - length) + length - 1) % 2 == 0, by_end[0], by_end[1])


def glued(digits: str) -> Iterator[tuple[int, int]]:
    """Cards that a group of digits is made of without a rest, in all ways to cut it."""
    n, least, most = len(digits), GLUED, CARD_DIGITS[1]
    check = Checks(digits)
    fits = np.zeros(n + 1, np.int64)  # one bit for each length that passes
    for length in range(least, most + 1):
        own = check.all(length)
        fits[: len(own)] |= own.astype(np.int64) << (length - least)
    starts = fits.tolist()
    whole = bytearray(n + 1)  # what stands before is made of cards
    whole[0] = 1
    pieces = []
    a = 0
    while a >= 0:
        if starts[a] and ISSUERS.match(digits, a):
            for length in range(least, most + 1):
                if starts[a] >> (length - least) & 1:
                    whole[a + length] = 1
                    pieces.append((a, a + length))
        a = whole.find(1, a + 1)
    ends = bytearray(n + 1)
    ends[n] = 1
    for a, b in reversed(pieces):
        if ends[b]:
            ends[a] = 1
            yield a, b


def stretches(text: str) -> Iterator[tuple[str, int, int]]:
    """Whole groups of a digit run that make up a card, and four neighbours of a longer dotted run that make up an address."""
    for m in DIGITS.finditer(text):
        if m.end() - m.start() < CARD_DIGITS[0]:
            continue
        groups = [g.span() for g in GROUP.finditer(text, *m.span())]
        check = Checks(NOT_DIGIT.sub("", m[0]))
        first = 0  # the group's place among the run's digits
        for i, (a, b) in enumerate(groups):
            if b - a > CARD_DIGITS[1]:
                for x, y in glued(text[a:b]):
                    yield "card", a + x, a + y
            else:
                last = first
                for j in range(i, len(groups)):
                    x, y = groups[j]
                    last += y - x
                    if last - first > CARD_DIGITS[1]:
                        break
                    if last - first >= CARD_DIGITS[0] and check(first, last):
                        yield "card", a, y
            first += b - a
    if "." in text:
        for m in DOTTED.finditer(text):
            parts = [(*g.span(), octet(g[0])) for g in GROUP.finditer(text, *m.span())]
            for i in range(len(parts) - 3):
                if all(ok for _, _, ok in parts[i: i + 4]):
                    yield "ip", parts[i][0], parts[i + 3][1]


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[str, int, int]]:
    """Spans that overlap no base span, each once. They may overlap each other."""
    starts = sorted(a for own in base.values() for a, _ in own)
    ends = sorted(b for own in base.values() for _, b in own)

    def free(a: int, b: int) -> bool:
        return bisect_left(starts, b) == bisect_right(ends, a)

    if HAS_DIGIT.search(text):
        formed = ((kind, *m.span()) for kind, pattern in (("phone", FORMED_PHONE), ("card", FORMED_CARD)) for m in pattern.finditer(text))
        for kind, a, b in dict.fromkeys((*formed, *stretches(text))):
            if free(a, b):
                yield kind, a, b
    if " at " in text or "at]" in text or "at)" in text or "at}" in text:
        for m in WORDED_MAIL.finditer(text):
            if free(*m.span()):
                yield "email", *m.span()


#: Votes are 1 (for), -1 (against) and 0 (none); features are 0 or 1.
LABELERS = ("form", "checksum", "gazetteer", "context", "company")
FEATURES = ("plus", "brackets", "separated", "eleven or fewer digits", "sixteen digits", "one group", "issuer", "luhn", "top domain", "marked at", "repeated digit", "lettered before")


def judge(kind: str, text: str, a: int, b: int, near: bool) -> tuple[tuple[int, ...], tuple[int, ...]]:
    own, before, after = text[a:b], text[max(0, a - AROUND): a], text[b: b + AROUND]
    digits = NOT_DIGIT.sub("", own)
    marked = any(c in own for c in "[({")
    tail = re.split(r"[^A-Za-z]+", own)[-1].lower()
    repeated = len(set(digits)) <= 2 if digits else False
    if kind == "card":
        form = 1 if re.fullmatch(r"[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|3[47][0-9]{2}([\x20-])[0-9]{6}\2[0-9]{5}", own) else -1
        checksum = 1 if luhn(digits) and not repeated else -1
        gazetteer = 1 if ISSUERS.match(digits) else -1
    elif kind == "phone":
        form = 1 if own[0] == "+" or "(" in own else 0
        checksum = -1 if repeated else (1 if 9 <= len(digits) <= 15 else -1)
        gazetteer = (1 if COUNTRY_CODES.match(own) else -1) if own[0] == "+" else 0
    elif kind == "ip":
        parts = own.split(".")
        edges = re.search(r"[0-9]\.$", before) is None, re.match(r"\.[0-9]", after) is None
        form = 1 if any(edges) else -1
        checksum = 1 if all(str(int(p)) == p for p in parts) else -1
        gazetteer = 1 if PRIVATE.match(own) else (-1 if not 1 <= int(parts[0]) <= 223 else 0)
    else:
        form = 1 if marked else 0
        checksum = 0
        gazetteer = 1 if tail in TOP_DOMAINS else -1
    context = 1 if CONTEXT[kind].search(before) or CONTEXT[kind].search(after) else (-1 if AGAINST.search(before) else 0)
    votes = (form, checksum, gazetteer, context, 1 if near else 0)
    features = (own[0] == "+", "(" in own, any(c in own for c in " -."), len(digits) <= 11, len(digits) == 16, own.isdigit(),
                bool(ISSUERS.match(digits)), kind == "card" and luhn(digits), tail in TOP_DOMAINS, marked, repeated, bool(before[-1:].isalpha() or after[:1].isalpha()))
    return votes, tuple(map(int, features))


def judged(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int, tuple, tuple]]]:
    """Base spans, and candidates with their votes and features. A candidate has company if other data stand near; what overlaps it is another
    reading of the same data."""
    base = base_spans(text)
    found = list(candidates(text, base))
    if not found:
        return base, []
    spots = {s for own in base.values() for s in own} | {(a, b) for _, a, b in found}
    starts, ends = sorted(a for a, _ in spots), sorted(b for _, b in spots)
    out = []
    for kind, a, b in found:
        near = bisect_right(starts, b + AROUND) - bisect_left(ends, a - AROUND) > bisect_left(starts, b) - bisect_right(ends, a)
        out.append((kind, a, b, *judge(kind, text, a, b, near)))
    return base, out


def count_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update((kind, votes, features) for kind, _, _, votes, features in judged(text)[1])
    keys = list(seen)
    yield pa.record_batch({
        "kind": pa.array([k[0] for k in keys], pa.string()), "votes": pa.array([list(k[1]) for k in keys], pa.list_(pa.int32())),
        "features": pa.array([list(k[2]) for k in keys], pa.list_(pa.int32())), "n": pa.array([seen[k] for k in keys], pa.int64())})


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each pattern of votes, P(vote | truth) as (labeler, truth, vote + 1), and the prior, by expectation-maximisation."""
    told = votes.sum(axis=1)
    post = np.where(told > 0, 0.9, np.where(told < 0, 0.1, 0.5))  # a majority vote to begin with
    table, prior = np.zeros((votes.shape[1], 2, 3)), 0.5
    for _ in range(rounds):
        prior = float(np.clip((post * n).sum() / n.sum(), 0.02, 0.98))
        for j in range(votes.shape[1]):
            for truth, weight in ((0, (1 - post) * n), (1, post * n)):
                counts = np.array([weight[votes[:, j] == v].sum() for v in (-1, 0, 1)]) + np.array([1.0, 1.0, 1.0])
                # one vote that contradicts is believed in either class
                table[j, truth] = counts / counts.sum()
        logs = np.log(prior) - np.log(1 - prior) + sum(
            np.log(table[j, 1, votes[:, j] + 1]) - np.log(table[j, 0, votes[:, j] + 1]) for j in range(votes.shape[1]))
        new = 1 / (1 + np.exp(-np.clip(logs, -30, 30)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    if (post * n).sum() and np.average(told, weights=post * n + 1e-12) < np.average(told, weights=(1 - post) * n + 1e-12):
        post = 1 - post  # the classes have no names of their own: the one with more votes is the data
    return post, table, prior


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weights (the last is the bias) of a logistic model with soft labels, by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    n = n / n.sum() * len(n)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + 0.01 * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    weights: dict[str, np.ndarray]

    def accepts(self, kind: str, votes: tuple[int, ...], features: tuple[int, ...]) -> bool:
        w = self.weights.get(kind)
        return w is not None and float(np.dot(w[:-1], (*votes, *features)) + w[-1]) >= 0


def train(docs: DataFrame) -> Model:
    """From the votes on every candidate of every text. The counts have at most 3^5 x 2^12 rows a kind, whatever the corpus."""
    counted = docs.select(tables.whole("text").alias("t")).mapInArrow(count_votes, "kind string, votes array<int>, features array<int>, n bigint")
    rows = counted.groupBy("kind", "votes", "features").agg(F.sum("n").alias("n")).collect()
    weights = {}
    for kind in KINDS:
        own = sorted((tuple(r["votes"]), tuple(r["features"]), r["n"]) for r in rows if r["kind"] == kind)
        if own:
            votes, n = np.array([v for v, _, _ in own]), np.array([c for _, _, c in own], float)
            post, _, _ = reliabilities(votes, n)
            weights[kind] = logistic(np.hstack([votes, np.array([f for _, f, _ in own])]).astype(float), post, n)
    return Model(weights)


def find(text: str, model: Model) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans, and those that the classifier adds. Of added spans that overlap, the one with more votes stays, then the first by start, then the
    longer."""
    base, found = judged(text)
    added: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    taken = bytearray(len(text))
    for kind, a, b, votes, features in sorted(found, key=lambda x: (-sum(x[3]), x[1], -x[2], x[0])):
        if taken.find(1, a, b) < 0 and model.accepts(kind, votes, features):
            added[kind].append((a, b))
            taken[a:b] = b"\x01" * (b - a)
    return base, added


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, spans and n_added of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base, added = find(text, model)
                own = [(a, k, b) for k, kind in enumerate(KINDS) for a, b in base[kind]]
                more = [(a, k, b) for k, kind in enumerate(KINDS) for a, b in added[kind]]
                out.append((*(len(base[k]) for k in KINDS), hashlib.sha256(written(own).encode()).hexdigest(), written(own + more), len(more)))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)]
            yield pa.record_batch([batch.column(0), *columns], names=names)

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), tables.whole("text").alias("t")).mapInArrow(run, schema)
