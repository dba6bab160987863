"""The registered queries against their SQL, and the pipeline against its stages' own results."""

from __future__ import annotations

import zlib

import pytest

import corpus_pipeline
from tests.oracle import compare, connect
from weirflow.llm import simhash
from weirflow.llm.queries import ORACLES, QUERIES
from weirflow.plans.registry import Query

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("sf", [SMALL, MEDIUM])
def test_oracle(llm, name, sf):
    rows, difference = compare(llm, sf, Query(name, QUERIES[name], ORACLES[name]), connect(sf))
    assert difference == "" and rows > 0


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]


def test_native_queries_run_no_python(llm):
    for name in ("op1_secret_scans", "op9_mixing"):
        plan = QUERIES[name](llm, SMALL)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))


def test_pipeline(llm):
    docs = llm.read.parquet(f"{MEDIUM}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(llm, docs, MEDIUM)
        assert out.columns == columns, name
        docs = llm.createDataFrame(out.collect(), docs.schema)
        if name == "exact_dedup":
            texts = ["".join((r.text or "").split(" ")) for r in docs.collect()]
            assert len(set(texts)) == len(texts)
        if name == "simhash_near_dedup":
            prints = [simhash.fingerprint((r.text or "").encode(), 3) % 2**64 for r in docs.collect()]
            assert min((a ^ b).bit_count() for i, a in enumerate(prints) for b in prints[:i]) > 3
    last = corpus_pipeline.run(llm, MEDIUM)
    assert last.columns == [*[c for c in columns if c != "text"], "n_tokens", "ids"]
    rows = last.collect()
    assert all(len(r.ids) == r.n_tokens for r in rows)
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} and zlib.crc32(b"") == 0
