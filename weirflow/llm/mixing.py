"""Mixing sources to target weights by soft membership, in DataFrame functions only.

A multinomial classifier over hashed words, learned from the labelled table, gives each document a posterior over the domains. Nonnegative rates
per document are then fitted by projected gradient so that the expected tokens of each domain, sum over i of rate(i) * tokens(i) * posterior(i, domain),
meet the targets. The loss is the sum over domains of (expected - target)^2 / (2 * mass), with mass the expected tokens at rate 1. In the
metric of tokens its curvature is at most 1 (posteriors are rows of a stochastic matrix), so steps of size 1 converge:

    rate(i) <- max(least, rate(i) - sum over domains of posterior(i, domain) * (expected(domain) - target(domain)) / mass(domain))

``least`` is 0, or 1 where no document may go; the bound is part of the projection, so the totals that are reached are those of the rates that are used.

All rates start at 1. A round is one aggregation over a narrow table (tokens, posterior), and a document's rate is the fold
of that update over the rounds' gaps, so no rates are stored between rounds and there is no shuffle but that of the sums.

The classifier is fitted on at most ``SAMPLE`` labelled documents, the first by a hash of their ids. Its word log-likelihoods are divided by the
root of the text's length, which keeps memberships soft. Everything else covers all rows.

Defined results: a null or empty text has no tokens, the prior as its posterior and a rate like any other. A null domain of a labelled row teaches nothing. Domains
without a target have target 0; a target that no labelled row teaches can't be met, its share stays empty. What can't be met is shown beside what is reached by
:func:`report`, and by ``rates`` for each row's domain. No labelled row at all: every rate is 1 and the
posterior is empty. Repeated rows each give a row; further columns are ignored.
"""

from __future__ import annotations

import json
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm import tables

#: Labelled documents that the classifier is fitted on, and the buckets of hashed words.
SAMPLE, BUCKETS = 4000, 1024
#: Rounds at most; the share of all tokens by which totals may miss their targets, and that by which a round must still move them where they can't be met.
ROUNDS, GAP, STILL = 60, 1e-7, 1e-4
#: Domains with fewer expected tokens than this share of all take no part in the fit.
LEAST = 1e-9


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def buckets_of(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def classifier(docs: DataFrame, labels: DataFrame, domain: str, sample: int = SAMPLE) -> dict | None:
    """Priors and word log-likelihoods by domain, from a bounded sample of the documents that the labelled table names."""
    ids = labels.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # bounded by ``sample``
    own = docs.select("doc_id", F.col(domain).cast("string").alias("domain"), tables.whole("text").alias("text")).where("domain is not null")
    rows = own.join(F.broadcast(ids), "doc_id", "left_semi")
    # the narrow counts are used twice, and the texts read once
    seen = tables.keep(
        rows.select("domain", F.explode(F.concat(F.array(F.lit(-1)), buckets_of(F.col("text")))).alias("b")).groupBy("domain", "b").count(), "mixing-words")
    counts: dict[str, dict[int, int]] = {}
    for r in seen.collect():  # domains x (BUCKETS + 1)
        counts.setdefault(r["domain"], {})[r["b"]] = r["count"]
    if not counts:
        return None
    domains = sorted(counts)
    documents = [counts[d].pop(-1, 0) for d in domains]
    words = [sum(counts[d].values()) for d in domains]
    return {
        "domains": domains,
        "prior": [log(n / sum(documents)) for n in documents],
        "words": [[log((counts[d].get(b, 0) + 0.5) / (n + 0.5 * BUCKETS)) for b in range(BUCKETS)] for d, n in zip(domains, words)],
    }


def array_of(values: list, kind: str) -> Column:
    """A constant array; folded once, whatever its length."""
    return F.from_json(F.lit(json.dumps({"v": values})), f"v {kind}")["v"]


def memberships(docs: DataFrame, model: dict, *carried: Column) -> DataFrame:
    """The carried columns with n_tokens and posterior (array of doubles, in the order of the model's domains)."""
    rows = docs.select(*carried, buckets_of(tables.whole(docs["text"])).alias("_b"))
    n = F.size("_b")

    def likelihood(words: list[float]) -> Column:
        own = array_of(words, "array<double>")
        return F.aggregate("_b", F.lit(0.0), lambda s, b: s + F.get(own, b)) / F.sqrt(F.greatest(n, F.lit(1)))

    score = [F.lit(prior) + likelihood(words) for prior, words in zip(model["prior"], model["words"])]
    names = [c for c in rows.columns if c != "_b"]
    scored = rows.select(*names, n.cast("bigint").alias("n_tokens"), F.array(*score).alias("_s"))
    # less the largest, so that no power overflows
    weights = F.transform("_s", lambda s: F.exp(s - F.array_max("_s")))
    weighed = scored.select(*names, "n_tokens", weights.alias("_w"))
    total = F.aggregate("_w", F.lit(0.0), lambda a, x: a + x)
    return weighed.select(*names, "n_tokens", F.transform("_w", lambda x: x / total).alias("posterior"))


def rate(posterior: Column, gaps: list[list[float]], least: float = 0.0) -> Column:
    """The fold of the update over the relative gaps of the rounds so far."""
    if not gaps:
        return F.lit(1.0)
    step = lambda gap: F.aggregate(F.zip_with(posterior, gap, lambda p, g: p * g), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(array_of(gaps, "array<array<double>>"), F.lit(1.0), lambda r, gap: F.greatest(F.lit(least), r - step(gap)))


def expected(rows: DataFrame, n: int, gaps: list[list[float]], least: float = 0.0) -> list[float]:
    weight = rows.select("posterior", (rate(F.col("posterior"), gaps, least) * F.col("n_tokens")).alias("w"))
    out = weight.agg(*[F.sum(F.col("w") * F.get("posterior", F.lit(k))).alias(f"m{k}") for k in range(n)]).first()
    return [float(x or 0.0) for x in out]


def softened(mass: dict[str, float], power: float = 0.7) -> dict[str, float]:
    """Target tokens that flatten the domains' shares by ``power`` and take no domain below what it has."""
    raised = {d: m ** power for d, m in mass.items() if m > 0}
    if not raised:
        return {}
    scale = max(mass[d] / x for d, x in raised.items())
    return {d: scale * x for d, x in raised.items()}


def fit(rows: DataFrame, domains: list[str], targets: dict[str, float] | None, rounds: int = ROUNDS, gap: float = GAP, least: float = 0.0) -> dict:
    """Rounds until the expected tokens are within ``gap`` of the targets, or don't move any more. ``targets`` are shares of all tokens, or None for
    :func:`softened` totals. Returns the gaps that :func:`rate` folds, and the totals before, after and asked for."""
    mass = expected(rows, len(domains), [])
    whole = sum(mass)
    if targets is None:
        wanted = softened(dict(zip(domains, mass)))
    else:
        shares = {d: w for d, w in targets.items() if w > 0}
        wanted = {d: whole * w / sum(shares.values()) for d, w in shares.items()}
    aim = [wanted.get(d, 0.0) for d in domains]
    use = [m > LEAST * whole for m in mass]
    gaps: list[list[float]] = []
    now, before = mass, None
    while len(gaps) < rounds and whole and max(abs(e - a) for e, a, u in zip(now, aim, use) if u) > gap * whole:
        if before is not None and max(abs(e - b) for e, b in zip(now, before)) <= (STILL if least else 0) * whole:
            break
        gaps.append([(e - a) / m if u else 0.0 for e, a, m, u in zip(now, aim, mass, use)])
        before, now = now, expected(rows, len(domains), gaps, least)
    return {"gaps": gaps, "before": dict(zip(domains, mass)), "after": dict(zip(domains, now)), "aim": dict(zip(domains, aim)) | wanted}


def report(docs: DataFrame, labels: DataFrame, domain: str = "lang", targets: dict[str, float] | None = None, least: float = 0.0) -> DataFrame:
    """domain, tokens (expected at rate 1), target_tokens, reached_tokens of every domain that has labelled rows or a target."""
    spark, schema = docs.sparkSession, "domain string, tokens double, target_tokens double, reached_tokens double"
    model = classifier(docs, labels, domain)
    if model is None:
        return spark.createDataFrame([], schema)
    with tables.steps(spark, "mixing") as made:
        fitted = fit(made.save(memberships(docs, model)), model["domains"], targets, least=least)
    return spark.createDataFrame([(d, *(fitted[k].get(d, 0.0) for k in ("before", "aim", "after"))) for d in sorted(fitted["aim"])], schema)


def copies(rate_: Column, *key: Column) -> Column:
    """How often a row is taken: the whole part of its rate, and once more with the rest as its chance, drawn by a hash of ``key``."""
    draw = F.pmod(F.xxhash64(F.lit("mix"), *key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate_) + (draw < rate_ - F.floor(rate_)).cast("int")).cast("int")


def rates(docs: DataFrame, labels: DataFrame, domain: str = "lang", targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), membership (its posterior), rate, copies of every row, and the target_tokens and
    reached_tokens of its domain."""
    model = classifier(docs, labels, domain)
    if model is None:
        return docs.select("doc_id", F.size(words_of(tables.whole("text"))).cast("bigint").alias("n_tokens"), F.lit(None).cast("string").alias("domain"),
                           F.lit(None).cast("double").alias("membership"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"),
                           *[F.lit(None).cast("double").alias(c) for c in ("target_tokens", "reached_tokens")])
    rows = tables.keep(memberships(docs, model, docs["doc_id"], F.xxhash64(tables.whole(docs["text"])).alias("text_hash")), "mixing-rows")
    fitted = fit(rows, model["domains"], targets)
    gaps = fitted["gaps"]
    top = F.array_max("posterior")
    names = F.array(*[F.lit(d) for d in model["domains"]])
    totals = [F.round(F.create_map(*(F.lit(x) for d in model["domains"] for x in (d, float(fitted[k][d]))))[F.col("domain")], 3).alias(c)
              for k, c in (("aim", "target_tokens"), ("after", "reached_tokens"))]
    rated = rows.select("doc_id", "text_hash", "n_tokens", F.get(names, F.array_position("posterior", top).cast("int") - 1).alias("domain"),
                        top.alias("membership"), rate(F.col("posterior"), gaps).alias("rate"))
    return rated.select("doc_id", "n_tokens", "domain", F.round("membership", 9).alias("membership"), F.round("rate", 9).alias("rate"),
                        copies(F.col("rate"), F.col("doc_id"), F.col("text_hash")).alias("copies"), *totals)


def mix(docs: DataFrame, labels: DataFrame, domain: str = "lang", targets: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says. With the default targets every rate is 1 at least: rare domains are
    repeated and nothing is thinned out. Texts are classified twice rather than shuffled to their rates."""
    model = classifier(docs, labels, domain)
    if model is None:
        return docs
    least = 1.0 if targets is None else 0.0
    with tables.steps(docs.sparkSession, "mixing") as made:
        gaps = fit(made.save(memberships(docs, model)), model["domains"], targets, least=least)["gaps"]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    again = memberships(docs, model, whole).select("row", rate(F.col("posterior"), gaps, least).alias("rate"))
    # written before rows are repeated: a filter on the copies would else be pushed down, and the classifier run again in each of its terms
    taken = tables.keep(again.select("row", copies(F.col("rate"), F.col("row.doc_id"), F.xxhash64("row.text")).alias("copies")), "mixing-copies")
    return taken.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
