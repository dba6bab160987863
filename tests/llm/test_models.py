"""Learned operators: held-out accuracy, and the arithmetic against plain Python."""

from __future__ import annotations

import math
import zlib

import numpy as np

from weirflow.llm import mixing, toxicity

SCHEMA = "doc_id bigint, text string, lang string, score double, row string"


def corpus(spark, n=400):
    rng = np.random.default_rng(5)
    words = {"en": "the of and river stone green walk".split(), "de": "der die und fluss stein haus weg".split()}
    rows, labels = [], []
    for i in range(n):
        lang = "de" if i % 4 == 0 else "en"
        own = list(rng.choice(words[lang], 40)) + [f"{x:x}" for x in rng.integers(1 << 40, size=10)]
        toxic = i % 5 == 1
        if toxic:
            own[int(rng.integers(40))] = str(rng.choice(["scum", "idiot"]))
        rows.append((i, " ".join(own), lang, 0.1, "x"))
        labels.append((i, int(rng.integers(2)), int(toxic), "x"))
    odd = [(n, None, None, None, None), (n + 1, "", "en", None, None), (n + 2, "idiot", "en", None, None), rows[0]]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    return docs, spark.createDataFrame(labels + [(None, 1, 1, "x"), (3, None, None, "x")], "doc_id bigint, quality int, toxic int, text string"), labels


def test_toxicity_on_held_out_rows(llm):
    docs, labels, told = corpus(llm)
    got = [r for r in toxicity.scores(docs, labels).collect()]
    assert len(got) == 404
    by = {r.doc_id: r for r in got}
    for i, _, toxic, _ in told:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert by[i].predicted == toxic == int(by[i].score >= 0.5)
    assert by[400].score == by[401].score and by[400].predicted == 0 and by[402].predicted == 1
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in by.items() if not r.predicted}


def test_thresholds_see_the_shares_of_the_whole_table(llm, monkeypatch):
    """A word that most texts with it are clean is no reason to reject, though it would be one in a sample with as many toxic rows as clean ones."""
    monkeypatch.setattr(toxicity.sampled, "__defaults__", (60, toxicity.SAMPLE_CHARS))
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(1500):
        own = ["the", "of", *(f"{x:x}" for x in rng.integers(1 << 40, size=8))]
        toxic = i % 10 == 0
        word = ("scum" if i % 20 else "mild") if toxic else ("mild" if i % 10 < 4 else "calm")
        rows.append((i, " ".join([*own, word] if i % 7 else ["pad"] * 5000 + own + [word]), "en", 0.1, "x"))
        labels.append((i, 1, int(toxic)))
    docs, labels = llm.createDataFrame(rows, SCHEMA), llm.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.scores(docs, labels).collect()}
    short = [(i, text.split()[-1]) for i, text, *_ in rows if i % 7]
    assert all(got[i] == int(word == "scum") for i, word in short)
    assert {r.doc_id for r in toxicity.keep_clean(docs, labels).collect()} == {i for i, p in got.items() if not p}
    # every labelled row that may be learned from counts, long ones too, whatever the size of the sample
    sample = toxicity.sampled(docs, labels)
    counts = toxicity.counted(toxicity.rows_measured(docs, toxicity.fit(sample)), labels, sample)
    learnable = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5]
    assert np.allclose(np.sum(list(counts[""].values()), axis=0), [sum(i % 10 != 0 for i in learnable), sum(i % 10 == 0 for i in learnable)])


def test_a_repeated_id_gives_the_sample_one_text(llm):
    docs, labels, _ = corpus(llm, 40)
    again = llm.createDataFrame([(i, f"text {k}", "en", 0.1, "x") for i in (2, 6) for k in range(300)], SCHEMA)
    sample = toxicity.sampled(docs.unionByName(again), labels)
    ids = [i for i, _, _ in sample]
    assert len(set(ids)) == len(ids) <= 40 and {"2", "6"} & set(ids)
    assert toxicity.sampled(again.unionByName(docs), labels) == sample


def test_toxicity_without_labels_or_rows(llm):
    docs, labels, _ = corpus(llm, 8)
    assert {r.score for r in toxicity.scores(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.scores(docs.limit(0), labels).count() == 0


def test_long_texts_are_read_in_blocks_without_a_seam(llm, monkeypatch):
    sample = [(str(i), "a b c " * 5 + ("bad word here" if i % 2 else "good word here"), i % 2) for i in range(60)]
    model = toxicity.fit(sample)
    text = "a b c " * 300 + "bad word here " + "a b c " * 300
    whole = list(toxicity.logits(iter([text]), model))
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert np.allclose(list(toxicity.logits(iter([text]), model)), whole)


def test_mixing_meets_its_targets(llm):
    docs, labels, _ = corpus(llm)
    model = mixing.classifier(docs, labels, "lang")
    rows = mixing.memberships(docs, model, docs["doc_id"]).collect()
    assert model["domains"] == ["de", "en"] and all(abs(sum(r.posterior) - 1) < 1e-9 for r in rows)
    frame = mixing.memberships(docs, model, docs["doc_id"])
    for targets, near in (({"de": 0.7, "en": 0.3}, 1e-6), ({"en": 1.0}, 0.02), (None, 1e-6)):
        fitted = mixing.fit(frame, model["domains"], targets)
        total = sum(fitted["before"].values())
        assert all(abs(fitted["after"][d] - fitted["aim"][d]) <= near * total for d in model["domains"])
        reached = {r.domain: (r.tokens, r.target_tokens, r.reached_tokens) for r in mixing.report(docs, labels, "lang", targets).collect()}
        assert all(np.allclose(reached[d], (fitted["before"][d], fitted["aim"][d], fitted["after"][d])) for d in model["domains"])
        # the same steps in plain Python
        mass, rate = list(fitted["before"].values()), [1.0] * len(rows)
        for gap in fitted["gaps"]:
            now = [sum(r.n_tokens * r.posterior[k] * x for r, x in zip(rows, rate)) for k in range(2)]
            assert np.allclose(gap, [(e - a) / m for e, a, m in zip(now, fitted["aim"].values(), mass)], atol=1e-9)
            rate = [max(0.0, x - sum(p * g for p, g in zip(r.posterior, gap))) for r, x in zip(rows, rate)]
        assert min(rate) >= 0


def test_mixing_reports_what_it_cannot_meet(llm):
    docs, labels, _ = corpus(llm)
    told = {r.domain: r for r in mixing.report(docs, labels, "lang", {"de": 0.5, "xx": 0.5}).collect()}
    total = sum(r.tokens for r in told.values())
    assert told["xx"].reached_tokens == 0 and abs(told["xx"].target_tokens - total / 2) < 1e-6 and abs(told["de"].reached_tokens - total / 2) < 0.05 * total
    # no rate below 1: the totals are those of the rates that are used
    model = mixing.classifier(docs, labels, "lang")
    frame = mixing.memberships(docs, model)
    fitted = mixing.fit(frame, model["domains"], None, least=1.0)
    rows = frame.select("n_tokens", "posterior", mixing.rate(mixing.F.col("posterior"), fitted["gaps"], 1.0).alias("rate")).collect()
    assert min(r.rate for r in rows) >= 1
    for k, d in enumerate(model["domains"]):
        assert abs(sum(r.rate * r.n_tokens * r.posterior[k] for r in rows) - fitted["after"][d]) < 1e-6 * total


def test_posteriors_are_those_of_the_model(llm):
    docs, labels, _ = corpus(llm, 40)
    model = mixing.classifier(docs, labels, "lang")
    hashes = {w: h for w, h in docs.selectExpr("explode(split(text, ' ')) w").distinct().selectExpr("w", f"pmod(xxhash64(lower(w)), {mixing.BUCKETS})").collect()}
    for r in mixing.memberships(docs, model, docs["text"]).collect():
        own = [hashes[w] for w in (r.text or "").split()]
        score = [p + sum(words[b] for b in own) / math.sqrt(max(1, len(own))) for p, words in zip(model["prior"], model["words"])]
        e = [math.exp(s - max(score)) for s in score]
        assert r.n_tokens == len(own) and np.allclose(r.posterior, [x / sum(e) for x in e])


def test_mixing_repeats_and_never_drops_by_default(llm):
    docs, labels, _ = corpus(llm)
    out = mixing.mix(docs, labels)
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert out.columns == docs.columns and set(counts) == {r.doc_id for r in docs.collect()}
    got = mixing.rates(docs, labels).collect()
    assert len(got) == docs.count() and np.mean([r.rate for r in got if r.domain == "de"]) > 1.1 > np.mean([r.rate for r in got if r.domain == "en"])
    assert {r.rate for r in mixing.rates(docs, labels.limit(0)).collect()} == {1.0} and mixing.rates(docs.limit(0), labels).count() == 0
