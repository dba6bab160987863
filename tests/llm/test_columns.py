"""Every operator and stage with further columns whose names clash with its own or hold dots, null ids, and very long texts."""

from __future__ import annotations

import random
import sys
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weirflow.llm import bpe, chat, embeddings, exact, lexical, merkle, mixing, pii, secrets, simhash, toxicity, urls, warc

SF = "/root/testdata/sf0.001"
CLASHING = ["a.b", "_measured", "row", "key", "part", "t", "m", "logit", "bucket", "content", "points", "fingerprint", "posterior", "copies", "rate", "ids", "n_tokens", "toxic", "label2",
            "_gone_id", "text_hash", "block", "at", "node", "archive", "kind", "message", "spans"]


def wide(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


def rows(df):
    return sorted((tuple(str(x) for x in r) for r in df.collect()))


def operators(llm):
    docs, labels, pages, vectors, turns, items = (llm.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "pages", "embeddings", "conversations", "benchmark"))
    none = docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint"))
    docs = docs.unionByName(none)
    return {
        "secrets": lambda w: secrets.digests(w(docs)), "bpe": lambda w: bpe.encoded(w(docs)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"),
        "simhash": lambda w: simhash.groups(w(docs)), "warc": lambda w: warc.round_trip(w(pages)), "pii": lambda w: pii.scan(w(docs)), "exact": lambda w: exact.groups(w(docs)),
        "embeddings": lambda w: embeddings.linked(w(vectors)), "toxicity": lambda w: toxicity.scores(w(docs), labels),
        "mixing": lambda w: mixing.rates(w(docs), labels), "urls": lambda w: urls.judged(w(pages)), "merkle": lambda w: merkle.digests(w(docs)),
        "lexical": lambda w: lexical.search(w(docs), w(items)), "chat": lambda w: chat.digests(chat.events(w(turns))),
    }


@pytest.mark.parametrize("name", ["secrets", "bpe", "simhash", "warc", "pii", "exact", "embeddings", "toxicity", "mixing", "urls", "merkle", "lexical", "chat"])
def test_operator(llm, name):
    own = operators(llm)[name]
    assert rows(own(wide)) == rows(own(lambda df: df))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(llm, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    out = stage(llm, wide(docs), SF)
    plain = stage(llm, docs, SF)
    shared = [c for c in plain.columns if c not in ("n_tokens", "ids")]
    assert rows(out.select(*shared)) == rows(plain.select(*shared))
    assert set(out.columns) >= {*CLASHING} - {"n_tokens", "ids"} if name == "bpe" else out.columns == wide(docs).columns


def test_a_null_id_is_never_held_out(llm):
    docs, labels = (llm.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.scores(docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint"))), labels)
    assert [r.held_out for r in got.where("doc_id is null").collect()] == [False]


def test_every_code_point_is_split_as_the_library_does():
    tokenizer = bpe.Tokenizer(bpe.tokenizer_file(None))
    library = tokenizer.library
    points = [chr(i) for i in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(i)) not in ("Cs", "Co", "Cn")]
    for text in ("a{}b", "a{}\u0334b", "a\u0301{}b", "A{0}{0}\u0316"):
        for at in range(0, len(points), 64):
            own = [text.format(c) for c in points[at: at + 64]]
            # one at a time only where a block differs
            joined = "\n".join(own)
            if words(tokenizer, joined) != plain(tokenizer, library, joined):
                assert [t for t in own if words(tokenizer, t) != plain(tokenizer, library, t)] == []
            assert sum(len(words(tokenizer, t)) for t in own[:1]) == sum(len(plain(tokenizer, library, t)) for t in own[:1])


def words(tokenizer, text):
    return [w.encode() for w in tokenizer.split(text)]


def plain(tokenizer, library, text):
    found = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
    return [bytes(tokenizer.bytes[c] for c in w) for w, _ in found]


def test_personal_data_in_long_runs_of_digits():
    rng = random.Random(4)
    model = pii.Model({k: np.concatenate([np.zeros(17), [1.0]]) for k in ("card", "phone", "ip")})
    small = " ".join(str(rng.randint(1000, 9999)) for _ in range(20_000))
    start = time.perf_counter()
    pii.find(small, model)
    once = time.perf_counter() - start
    for text in (" ".join(str(rng.randint(1000, 9999)) for _ in range(200_000)), "".join(rng.choice("0123456789") for _ in range(1_000_000)), "4111111111111111" * 60_000, "1.2.3.4.5." * 100_000):
        start = time.perf_counter()
        pii.find(text, model)
        assert time.perf_counter() - start < 30 * max(once, 0.3)


def test_checks_are_luhns():
    rng = random.Random(6)
    digits = "".join(rng.choice("0123456789") for _ in range(400))
    check = pii.Checks(digits)
    assert all(check(a, a + n) == pii.luhn(digits[a: a + n]) for a in range(380) for n in range(1, 20))
    for n in (13, 16, 19):
        assert check.all(n).tolist() == [pii.luhn(digits[a: a + n]) for a in range(400 - n + 1)]
