"""Toxicity by a small convolutional text classifier: hashed word embeddings, filters over one, two and three words,
max pooling over the whole text and one output.

A word is known by the 32-bit hashes of its lower-cased letters and of its first ``PREFIX`` letters. Hashes whose texts differ by label beyond chance (a likelihood
ratio of ``EVIDENCE``, near copies counted once) have embeddings, which add up; all other words share one. Filters and embeddings are trained in numpy on a
bounded sample of labelled rows: ``SAMPLE`` rows of each label, the first by a hash of their ids. Scoring adds the products of embeddings and filters, tabled once per model, along the text. Texts
are read in blocks, so a very long one needs no more memory than another, and no word of it is left out.

Thresholds are calibrated by language on all labelled rows that the filters weren't trained on, long ones too, from counts of binned logits. Rows of a
label weigh as many as that label has, trained on or not, so the shares are those of the table at every size. The language is that whose
function words (``FUNCTION_WORDS``) the text has most of, never the table's column; texts with none have the overall threshold.
A score is 1 / (1 + exp(threshold - logit)), so 0.5 is the threshold in every language.

Defined results: null and empty texts score as a text with no words, which is the model's bias. Labels that are null or neither 0 nor 1 are not learned
from; without rows of both labels every score is 0. A row with a null id has no label and is never held out. Repeated rows each give a row. Further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm import tables

#: Labelled rows of each label that the classifier is fitted on, and their longest text in characters.
SAMPLE, SAMPLE_CHARS = 2500, 20_000
PREFIX, EVIDENCE = 4, 12.0
WIDTHS, FILTERS, DIM = (1, 2, 3), 8, 16
EPOCHS, STEPS, RATE, DOCS_PER_STEP, DECAY = 6, 300, 0.02, 64, 1e-4
#: Rows that only set thresholds, whatever the size of the table: the remainder of the id's checksum by 5.
CALIBRATE = 1
#: Bins a unit of the logit, and the largest logit that is told apart.
BINS, FAR = 64, 128
#: Labelled rows of either label that a language needs for a threshold of its own.
LEAST = 10
#: Words of a text that are held at once.
BLOCK = 200_000

# Frequent function words of the languages that thresholds are set for.
FUNCTION_WORDS = {
    "de": "der die und den von zu mit sich des auf für ist nicht das ein dem",
    "en": "the of and to in that is was for it with as his on be at by had",
    "es": "el la que los se del las un por con no una su para es y",
    "fr": "le les des et une du est que dans qui pour au pas sur par avec",
}

WORD = re.compile(r"\w+")


def hashed(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def blocks(text: str) -> Iterator[list[str]]:
    """Lower-cased words of a text."""
    part: list[str] = []
    if len(text) < 4 * BLOCK:
        yield WORD.findall(text.lower())
        return
    for m in WORD.finditer(text):
        part.append(m[0].lower())
        if len(part) == BLOCK:
            yield part
            part = []
    yield part


def start(word: str) -> str:
    return "^" + word[:PREFIX] if len(word) > PREFIX else ""


class Ids(dict):
    """Words to rows of the embeddings; row 0 is for words without one, the last row for padding."""

    def __init__(self, rows: dict[int, int]) -> None:
        super().__init__()
        self.rows = rows

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        at = self.rows.get(hashed(word))
        if at is None:
            at = self.rows.get(hashed(start(word)), 0)
        self[word] = at
        return at


@dataclass
class Model:
    rows: dict[int, int]  #: hash of a word or of its first letters to row
    embeddings: np.ndarray  #: (rows + 2, DIM): unknown, the rows, padding (zeros)
    filters: list[np.ndarray]  #: for each width, (width, DIM, FILTERS)
    filter_bias: np.ndarray
    out: np.ndarray
    bias: float
    thresholds: dict[str, float]  #: logits; "" is for texts of no known language

    def tabled(self) -> list[list[np.ndarray]]:
        return [[(self.embeddings @ f[k]).astype(np.float32) for k in range(len(f))] for f in self.filters]


def language(counts: Counter) -> str:
    found = {lang: sum(counts[w] for w in words.split()) for lang, words in FUNCTION_WORDS.items()}
    best = max(found, key=found.get)
    return best if found[best] else ""


def pooled(ids: np.ndarray, table: list[list[np.ndarray]], padding: int) -> np.ndarray:
    """Largest sum of each filter over one block of words."""
    best = []
    for own in table:
        width = len(own)
        x = ids if len(ids) >= width else np.concatenate([ids, np.full(width - len(ids), padding)])
        total = own[0][x[: len(x) - width + 1]]
        for k in range(1, width):
            total = total + own[k][x[k: len(x) - width + 1 + k]]
        best.append(total.max(axis=0))
    return np.concatenate(best)


def measured(texts: Iterator[str], model: Model) -> Iterator[tuple[float, str]]:
    """Logits as trained, and languages."""
    table, padding, ids = model.tabled(), len(model.embeddings) - 1, Ids(model.rows)
    function_words = {w for words in FUNCTION_WORDS.values() for w in words.split()}
    overlap = max(WIDTHS) - 1
    for text in texts:
        best, tail, counts = None, np.empty(0, np.int64), Counter()
        for words in blocks(text or ""):
            counts.update(w for w in words if w in function_words)
            own = np.concatenate([tail, np.fromiter(map(ids.__getitem__, words), np.int64, len(words))])
            now = pooled(own, table, padding)
            best = now if best is None else np.maximum(best, now)
            tail = own[-overlap:]
        hidden = np.maximum(best + model.filter_bias, 0)
        yield float(hidden @ model.out + model.bias), language(counts)


def logits(texts: Iterator[str], model: Model) -> Iterator[float]:
    """Calibrated logits: zero is the threshold of the text's language."""
    for logit, lang in measured(texts, model):
        yield logit - model.thresholds.get(lang, model.thresholds[""])


class Training:
    """Adam on the logistic loss. Max pooling lets a step change only the words where a filter is largest."""

    def __init__(self, texts: list[np.ndarray], labels: np.ndarray, made_of: np.ndarray, odds: np.ndarray) -> None:
        """Filter 0 begins with the log ``odds`` of the features, the others at random. ``made_of``: the two features (0: none) whose embeddings add up to that of each row but the first and last."""
        rng = np.random.default_rng(7)
        self.texts, self.labels, self.padding = texts, labels, len(made_of) + 1
        self.made_of = np.vstack([[[0, 0]], made_of, [[0, 0]]]).astype(int)
        width = FILTERS * len(WIDTHS)
        self.p = {"e": rng.normal(0, 0.1, (int(self.made_of.max()) + 1, DIM)), "fb": np.full(width, 0.1), "o": rng.normal(0, 0.1, width), "b": np.zeros(1)}
        self.p |= {f"f{w}": rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)) for w in WIDTHS}
        self.p["e"][:, 0] = np.clip(odds, -4, 4) / 2
        self.p["e"][0] = 0
        self.p["f1"][0, :, 0] = np.eye(DIM)[0]
        self.p["o"][0] = 1.0
        self.p["b"][0] = -1.0
        share = labels.mean()
        self.weights = np.where(labels > 0.5, 0.5 / share, 0.5 / (1 - share))
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.step_no = 0
        self.rng = rng

    def embeddings(self) -> np.ndarray:
        return self.p["e"][self.made_of].sum(axis=1)

    def step(self, batch: np.ndarray) -> None:
        p, n, e = self.p, len(batch), self.embeddings()
        table = [[e @ p[f"f{w}"][k] for k in range(w)] for w in WIDTHS]
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        rows = np.zeros_like(e)
        weight = 1.0 / n
        for d in batch:
            ids, at, best = self.texts[d], [], []
            for own in table:
                width = len(own)
                x = ids if len(ids) >= width else np.concatenate([ids, np.full(width - len(ids), self.padding)])
                total = own[0][x[: len(x) - width + 1]]
                for k in range(1, width):
                    total = total + own[k][x[k: len(x) - width + 1 + k]]
                where = total.argmax(axis=0)
                at.append([x[where + k] for k in range(width)])
                best.append(total[where, np.arange(FILTERS)])
            z = np.concatenate(best) + p["fb"]
            hidden = np.maximum(z, 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ p["o"] + p["b"][0], -30, 30))) - self.labels[d]) * weight * self.weights[d]
            grads["o"] += error * hidden
            grads["b"] += error
            back = error * p["o"] * (z > 0)
            grads["fb"] += back
            for i, w in enumerate(WIDTHS):
                own = back[i * FILTERS: (i + 1) * FILTERS]
                for k in range(w):
                    words = at[i][k]
                    grads[f"f{w}"][k] += e[words].T * own
                    np.add.at(rows, words, p[f"f{w}"][k].T * own[:, None])
        np.add.at(grads["e"], self.made_of, rows[:, None, :])
        grads["e"] += DECAY * p["e"]
        grads["e"][0] = 0  # a word without a row says nothing
        self.step_no += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            rate = RATE * np.sqrt(1 - 0.999 ** self.step_no) / (1 - 0.9 ** self.step_no)
            p[k] -= rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)

    def run(self) -> None:
        epochs = max(EPOCHS, -(-STEPS * DOCS_PER_STEP // max(1, len(self.texts))))
        for _ in range(epochs):
            order = self.rng.permutation(len(self.texts))
            for i in range(0, len(order), DOCS_PER_STEP):
                self.step(order[i: i + DOCS_PER_STEP])


def threshold(counts: dict[int, list[float]]) -> float:
    """From clean and toxic rows by bin, the middle of the widest gap among the cuts with the best F1; ties go to the higher cut."""
    bins = sorted(counts)
    n = np.array([counts[b] for b in bins])
    if len(bins) < 2:
        return (bins[-1] + 1) / BINS + 1
    above = np.cumsum(n[::-1], axis=0)[::-1]
    f1 = 2 * above[1:, 1] / (above[1:].sum(axis=1) + n[:, 1].sum())
    best = np.nonzero(f1 >= f1.max() - 1e-12)[0] + 1  # bins from this one on are toxic
    cut = max(best, key=lambda i: (bins[i] - bins[i - 1], i))
    return (bins[cut - 1] + 1 + bins[cut]) / 2 / BINS


def vocabulary(texts: list[set[str]], labels: list[int]) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
    """Rows of the embeddings by hash, the two features of each (the word's own and that of its first letters), and the features' log odds."""
    seen: dict[tuple, int] = {}
    kept = []
    for i, (own, label) in enumerate(zip(texts, labels)):
        x = np.fromiter(map(hashed, own), np.uint64, len(own))
        low = tuple(int(((x * np.uint64(k)) & np.uint64(0xFFFFFFFF)).min(initial=0xFFFFFFFF)) for k in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
        if seen.setdefault((low, label), i) == i:
            kept.append(i)
    n = [sum(1 for i in kept if labels[i] == y) for y in (0, 1)]
    counts: list[Counter] = [Counter(), Counter()]
    for i in kept:
        counts[labels[i]].update(texts[i] | {start(w) for w in texts[i]} - {""})
    total = sum(n)

    def evidence(f: str) -> float:
        told = 0.0
        for y in (0, 1):
            for found, whole in ((counts[y][f], counts[0][f] + counts[1][f]), (n[y] - counts[y][f], total - counts[0][f] - counts[1][f])):
                if found:
                    told += 2 * found * np.log(found * total / (n[y] * whole))
        return told

    features = {f: k + 1 for k, f in enumerate(sorted(f for f in counts[0].keys() | counts[1].keys() if evidence(f) >= EVIDENCE))}
    rows, made_of = {}, []
    for f in features:
        rows[hashed(f)] = len(rows) + 1
        made_of.append((features[f], 0 if f[0] == "^" else features.get(start(f), 0)))
    odds = [np.log((counts[1][f] + 0.5) / (n[1] + 1)) - np.log((counts[0][f] + 0.5) / (n[0] + 1)) for f in features]
    return rows, np.array(made_of, int).reshape(-1, 2), np.array([0.0, *odds])


def fit(sample: list[tuple[str, str, int]]) -> Model | None:
    """``sample``: id as text, text, label. None without rows of both labels. Thresholds are zero until they are calibrated."""
    if len({y for _, _, y in sample}) < 2:
        return None
    words = [[w for part in blocks(t) for w in part] for _, t, _ in sample]
    rows, made_of, odds = vocabulary([set(x) for x in words], [y for _, _, y in sample])
    ids = Ids(rows)
    texts = [np.fromiter(map(ids.__getitem__, x), np.int64, len(x)) for x in words]
    training = Training(texts, np.array([y for _, _, y in sample], float), made_of, odds)
    training.run()
    p = training.p
    return Model(rows, training.embeddings(), [p[f"f{w}"] for w in WIDTHS], p["fb"], p["o"], float(p["b"][0]), {"": 0.0})


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def learnable() -> Column:
    """Rows that labels may be learned from: the checksum of the id leaves a remainder by 5 that isn't 0."""
    return remainder() != 0


def told(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the ids that labels may be learned from."""
    return labels.where("toxic in (0, 1) and doc_id is not null").where(learnable()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def sampled(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE, chars: int = SAMPLE_CHARS) -> list[tuple[str, str, int]]:
    """At most ``per_label`` labelled texts of each label, the first by a hash of the id, one for each id. Rows that only set thresholds are left out, unless
    the others lack a label."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample: list[tuple[str, str, int]] = []
    for own in (told(labels).where(remainder() != CALIBRATE), told(labels)):
        ids = [r for y in (0, 1) for r in own.where(F.col("toxic") == y).orderBy(*order).limit(per_label).collect()]
        if not ids:
            continue
        label = {int(r["doc_id"]): int(r["toxic"]) for r in ids}
        texts = docs.where(F.col("doc_id").isin([*label])).where(F.char_length("text") <= chars)
        # of an id with several texts, the first by a hash; the others never leave the executors
        first = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first")).select("doc_id", "first.text")
        found = {int(r[0]): r[1] for r in first.toLocalIterator(prefetchPartitions=False)}
        sample = [(str(i), t, label[i]) for i, t in sorted(found.items())]
        if len({y for _, _, y in sample}) == 2:
            break
    return sample


def measures(docs: DataFrame, model: Model) -> Column:
    """Logit as trained and language of the column ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("logit double, language string")
    def measure(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame(list(measured(iter(part), shared.value)), columns=["logit", "language"])

    return measure(tables.whole(docs["text"]))


def rows_measured(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, long (too long to be trained on), logit, language of every row."""
    rows = docs.select("doc_id", (F.char_length(tables.whole("text")) > SAMPLE_CHARS).alias("long"), measures(docs, model).alias("m"))
    return rows.select("doc_id", "long", "m.logit", "m.language")


def counted(rows: DataFrame, labels: DataFrame, sample: list[tuple[str, str, int]]) -> dict[str, dict[int, list[float]]]:
    """By language ("" is for all rows), the clean and toxic rows of each bin of the logit, of labelled rows of ids that are not in the sample. Each counts
    for those of its label and length that were trained on as well, so the sums are those of all labelled rows."""
    at = F.floor(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.col("logit"))) * BINS).alias("bin")
    # equal rows are one row before they meet their label
    binned = rows.where(learnable()).groupBy("doc_id", "long", "language", at).agg(F.count("*").alias("n"))
    own = told(labels).withColumn("trained", F.col("doc_id").isin(sorted({int(i) for i, _, _ in sample})))
    found = binned.join(own, "doc_id").groupBy("language", "toxic", "long", "trained", "bin").agg(F.sum("n").alias("n")).collect()
    fresh = [r for r in found if not r["trained"]]
    if len({r["toxic"] for r in fresh}) < 2:
        fresh = found
    whole, kept = Counter(), Counter()
    for part, total in ((found, whole), (fresh, kept)):
        for r in part:
            total[r["toxic"], r["long"]] += r["n"]
    counts: dict[str, dict[int, list[float]]] = {}
    for r in fresh:
        weight = whole[r["toxic"], r["long"]] / kept[r["toxic"], r["long"]]
        for lang in {"", r["language"]}:
            counts.setdefault(lang, {}).setdefault(r["bin"], [0.0, 0.0])[r["toxic"]] += r["n"] * weight
    return counts


def calibrated(model: Model, counts: dict[str, dict[int, list[float]]]) -> Model:
    """``model`` with thresholds from the counts of all rows and of the languages that have enough of both labels."""
    for lang, own in counts.items():
        if min(sum(n[y] for n in own.values()) for y in (0, 1)) >= (LEAST if lang else 1):
            model.thresholds[lang] = threshold(own)
    return model


def score(model: Model, logit: Column, lang: Column) -> Column:
    own = F.create_map(*(F.lit(x) for pair in model.thresholds.items() for x in pair))
    x = logit - F.coalesce(own[lang], F.lit(model.thresholds[""]))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), x))))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    sample = sampled(docs, labels)
    model = fit(sample)
    if model is None:
        rows, own = docs, F.lit(0.0)
    else:
        rows = tables.keep(rows_measured(docs, model), "toxicity-logits")
        model = calibrated(model, counted(rows, labels, sample))
        own = score(model, F.col("logit"), F.col("language"))
    rows = rows.select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), own.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below 0.5. Texts are read twice, for the thresholds and for the scores."""
    sample = sampled(docs, labels)
    model = fit(sample)
    if model is None:
        return docs
    model = calibrated(model, counted(rows_measured(docs.where(learnable()), model), labels, sample))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    own = docs.select(whole.alias("row"), measures(docs, model).alias("m"))
    return own.where(score(model, F.col("m.logit"), F.col("m.language")) < 0.5).select("row.*")
