"""Questions, chunking and retrieval."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from weirflow.operators import corpus
from weirflow.operators import questions as q
from weirflow.session import local_table
from weirflow.vocabulary import STOP_WORDS

# Questions and the specialist that must come first.
GOLDEN = [
    ("Why is the vibration on WTP-01-PUMP-003 climbing?", "asset-health"),
    ("Is RES-03 chlorine still compliant?", "water-quality"),
    ("DMA-14 night flow looks high - do we have a leak?", "leak-detection"),
    ("Which pump is wasting the most energy at peak tariff?", "energy-optimizer"),
    ("WELL-09-GW-001 has stopped reporting", "fleet-operations"),
    ("What does the SOP say about chlorine residual sampling?", "knowledge-navigator"),
    ("Create a work order for the pump bearing", "maintenance-planner"),
    ("I'm not receiving any data from WTP-01-GW-001", "fleet-operations"),
    ("Should we issue a boil water notice?", "water-quality"),
]


def asked(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "questionId string, question string")


def test_words_of_the_ontology_add_to_a_score(spark):
    rows = asked(spark, "what about the pump, the Device and wo", "nothing of note", "")
    found = {r.questionId: r for r in q.route(q.entity_words(rows), entities="entities").collect()}
    plain = {r.questionId: r for r in q.route(rows).collect()}
    a, b, c = (found[k] for k in sorted(found))
    assert a.entities == ["device", "pump"] and b.entities == c.entities == []
    before = {s.name: s.score for s in plain[a.questionId].scores}
    # "pump" is also a trigger of the first specialist
    assert {s.name: s.score - before.get(s.name, 0.0) for s in a.scores} == {
        "asset-health": 2.0, "energy-optimizer": 1.0, "fleet-operations": 1.0, "maintenance-planner": 1.0
    }
    assert a.matchedOn == ["pump", "entity:device", "entity:pump"]


def test_golden_questions_reach_their_specialist(spark):
    got = q.route(asked(spark, *[t for t, _ in GOLDEN])).orderBy("questionId").collect()
    assert [r.specialists[0] for r in got] == [s for _, s in GOLDEN]


def test_routing_decisions(spark):
    brief, nothing, certificates = q.route(
        asked(spark, "Morning briefing please", "Hello", "Which certificates expire soon?")
    ).orderBy("questionId").collect()
    assert (brief.strategy, len(brief.specialists), brief.confidence) == ("parallel", 5, 1.0)
    assert (nothing.strategy, nothing.specialists, nothing.confidence) == ("plan", [], 0.0)
    # The singular of the plural is a trigger, and the rule adds its weight.
    assert certificates.specialists == ["fleet-operations"] and certificates.scores[0].score == 7.5


def test_entities_count_for_a_specialist(spark):
    rows = asked(spark, "leak").withColumn("entities", F.array(F.lit("dma"), F.lit("site"), F.lit("other")))
    (row,) = q.route(rows, entities="entities").collect()
    scores = {s.name: s.score for s in row.scores}
    assert scores["leak-detection"] == 3.5 and scores["water-quality"] == 1.0


def test_a_rule_can_be_filtered_on_without_growing_the_plan(spark):
    rows = q.route(asked(spark, "offline")).filter("strategy = 'direct'").select(F.explode("specialists"))
    assert len(rows._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    assert rows.count() == 1


def test_ids(spark):
    rows = q.extract_ids(asked(spark, "PUMP-003 at WTP-01", "res-03-cl2-001 and DMA-14", "nothing here")).orderBy("questionId")
    assert [(r.deviceIds, r.siteIds) for r in rows.collect()] == [
        (["WTP-01-PUMP-003"], ["WTP-01"]), (["RES-03-CL2-001"], ["DMA-14", "RES-03"]), ([], []),
    ]


def test_days(spark):
    got = q.days_hint(asked(spark, "in 60 days", "next 7days please", "soon"), 30).orderBy("questionId").collect()
    assert [r.days for r in got] == [60, 7, 30]


@pytest.mark.parametrize("term,entity", [
    ("pump", "Asset"), ("gateway", "EdgeDevice"), ("night flow", "DmaFlow"), ("chlorine", "WaterQuality"),
    ("work order", "WorkOrder"), ("site", "Site")])
def test_terms(spark, term, entity):
    terms = q.term_table(spark)
    assert [r.entity for r in terms.filter(F.col("term") == term).collect()] == [entity]
    # in a question, a single word that names the entity comes before a pair of words
    got = {r.entity: r.matchedTerm for r in q.resolve_terms(asked(spark, f"about {term}"), terms, "questionId").collect()}
    assert got[entity] in (term, *term.split())


def test_own_ontology_terms_can_be_added(spark):
    extra = spark.createDataFrame([("vibes", "Telemetry", "attributeSynonym", 5, 0)],
                                  "term string, entity string, via string, tier int, ordinal int")
    (row,) = q.resolve_terms(asked(spark, "vibes"), q.term_table(spark, extra), "questionId").collect()
    assert (row.entity, row.matchedVia) == ("Telemetry", "attributeSynonym")


def test_approvals_need_the_planner(spark):
    rows = q.approval_intent(q.route(asked(
        spark, "Raise a ticket for the crew", "Raise the pump speed", "Create a work order and assign the crew to it"
    ))).orderBy("questionId").collect()
    assert rows[0].pendingApprovals == ["create_work_order"] and rows[1].pendingApprovals == []
    assert rows[2].pendingApprovals == ["create_work_order", "assign_work_order"]


# ---------------------------------------------------------------- chunking, against a plain restatement of the rules

def sections(content):
    found = list(re.finditer(r"^\s{0,3}#{1,4}\s+(.+?)\s*$", content, re.M))
    if found:
        cuts = [(m.group(1).strip(), m.start(), m.end()) for m in found]
    else:
        found = list(re.finditer(r"^([A-Z][A-Z0-9 /&()\-,.']{4,80}?)\.\s+(?=[A-Z0-9])", content, re.M))
        if len(found) < 2:
            return [("", content.strip())]
        cuts = [(m.group(1).strip().rstrip("."), m.start(), m.start()) for m in found]
    out = [("", content[: cuts[0][1]].strip())] if len(content[: cuts[0][1]].strip()) >= 200 else []
    ends = [c[1] for c in cuts[1:]] + [len(content)]
    return out + [(h, content[s:e].strip()) for (h, _, s), e in zip(cuts, ends) if content[s:e].strip()]


def greedy(texts, full, target):
    groups, now, size = [], [], 0
    for i, t in enumerate(texts):
        if now and size + len(t) > full:
            groups.append(now)
            now, size = [], 0
        now, size = now + [i], size + len(t) + 2
        if target and size >= target:
            groups.append(now)
            now, size = [], 0
    return groups + [now] if now else groups


def chunks_by_hand(content):
    parts = sections(content)
    out = []
    for group in greedy([b for _, b in parts], 2400, 900):
        head = " / ".join(parts[i][0] for i in group if parts[i][0])
        body = "\n\n".join(parts[i][1] for i in group)
        paras = [p.strip() for p in body.split("\n\n") if p.strip()]
        pieces = [body] if len(body) <= 2400 else ["\n\n".join(paras[i] for i in g) for g in greedy(paras, 2400, None)]
        out += [(head, p) for p in pieces]
    return [c for i, c in enumerate(out) if i == 0 or len(c[1]) >= 200]


def para(n, word="water "):
    return (word * (n // len(word) + 1))[:n]


TEXTS = [
    "short",
    para(3000),
    "## A\n" + para(300) + "\n\n## B\n" + para(700) + "\n\n### C\n" + para(2000) + "\n## Empty\n\n## D\nx",
    para(250) + "\n# Only\n" + para(100),
    "tiny\n# Only\n" + para(100),
    "FIRST PART. " + para(500, "Alpha ") + "\n\nSECOND PART (B/C). " + para(600, "Beta ") + "\n\nTHIRD ONE. 5 steps. " + para(2500, "Gamma "),
    "ONE LABEL. Only one here. " + para(400),
    "## Long\n" + "\n\n".join(para(n) for n in (1000, 1000, 1000, 2500, 10, 2390, 20)),
    "\n\n".join(para(n) for n in (2400, 2400, 150)),
    "   \n\n  ",
    "## Últimas señales\n" + para(950, "agua potável ") + "\n  ## indented\n" + para(950),
]


def test_chunks_match_the_rules(spark):
    docs = spark.createDataFrame([(f"D{i}", t) for i, t in enumerate(TEXTS)], "id string, content string")
    got = corpus.chunk_corpus(docs).orderBy("documentId", "ordinal").collect()
    for i, t in enumerate(TEXTS):
        mine = [(r.heading, r.content) for r in got if r.documentId == f"D{i}"]
        assert mine == ([] if not t.strip() else chunks_by_hand(t)), i
    assert len({r.chunkId for r in got}) == len(got)


def test_chunks_of_the_given_documents_match_the_rules(spark):
    from weirflow.plans.knowledge import sectioned

    docs = sectioned(spark, "/root/testdata/sf0.001").select("id", "content")
    texts = {r.id: r.content for r in docs.collect()}
    got: dict[str, list] = {}
    for r in corpus.chunk_corpus(docs).orderBy("documentId", "ordinal").collect():
        got.setdefault(r.documentId, []).append((r.heading, r.content))
    assert got == {k: chunks_by_hand(t) for k, t in texts.items() if t.strip()}


# ---------------------------------------------------------------- retrieval

DOCS = [
    ("SOP-1", "Chlorine residual", "When the chlorine residual drops, flush the main. Chlorine, chlorine!", "sop", "internal", ["analyser"]),
    ("SOP-2", "Pump vibration", "Vibration of a pump against the standard.", "sop", "public", ["pump"]),
    ("SOP-3", "Secret dosing", "Secret chlorine residual dosing keys.", "policy", "confidential", []),
    ("REF-4", "Dechlorinated water", "aaaa dechlorinated; residuals and night flow.", "reference", "public", []),
]
DOC_SCHEMA = "id string, title string, content string, docType string, classification string, assetClasses array<string>"


def search_by_hand(docs, query, k, floor=0.25):
    terms = [t for t in re.split(r"\W+", query.lower()) if len(t) > 2 and t not in STOP_WORDS]
    scored = []
    for d in docs:
        hay = f"{d[1]} {d[2]}".lower()
        hit = [t for t in terms if t in hay]
        if terms and len(hit) >= min(2, len(terms)):
            scored.append((sum(hay.count(t) for t in hit) + 5 * sum(t in d[1].lower() for t in terms), d[0]))
    scored = sorted((x for x in scored if x[0]), key=lambda x: (-x[0], x[1]))[:k]
    return [(i, float(s)) for s, i in scored if s >= scored[0][0] * floor]


@pytest.mark.parametrize("ceiling", ["public", "internal", "confidential", "nonsense"])
def test_keyword_retrieval(spark, ceiling):
    asks = ["What if the chlorine residual drops?", "chlor", "aaa aaa", "the and for", "pump vibration standard", "night flow night"]
    docs = corpus.cleared(spark.createDataFrame(DOCS, DOC_SCHEMA), ceiling)
    queries = spark.createDataFrame([(str(i), a) for i, a in enumerate(asks)], "queryId string, query string")
    found: dict[str, list] = {}
    for r in corpus.retrieve_keyword(docs, queries, top_k=2).orderBy("queryId", F.col("score").desc(), "id").collect():
        found.setdefault(r.queryId, []).append((r.id, r.score))
    allowed = {"public": 1, "internal": 2, "confidential": 3, "nonsense": 2}[ceiling]
    mine = [d for d in DOCS if ["public", "internal", "confidential"].index(d[4]) < allowed]
    for i, a in enumerate(asks):
        assert found.get(str(i), []) == search_by_hand(mine, a, 2), a
    if ceiling != "confidential":
        assert not any(i == "SOP-3" for hits in found.values() for i, _ in hits)


def test_scope(spark):
    docs = spark.createDataFrame(DOCS, DOC_SCHEMA)
    assert {r.id for r in corpus.scoped(docs, asset_class="pump").collect()} == {"SOP-2", "SOP-3", "REF-4"}
    assert {r.id for r in corpus.scoped(docs, ["policy"]).collect()} == {"SOP-3"}


def test_vector_blocks_agree_with_one_pass(spark):
    vectors = spark.createDataFrame([(f"v{i}", [float(i % 5), 1.0, float(i % 3)]) for i in range(30)] + [("zero", [0.0] * 3)],
                                    "id string, vector array<double>")
    queries = vectors.filter("id < 'v15'").select(F.col("id").alias("queryId"), "vector")
    one = corpus.retrieve_vector(vectors, queries, top_k=4)
    many = corpus.retrieve_vector(vectors, queries, top_k=4, queries_per_pass=2)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert "zero" not in {r.id for r in one.collect()}


def test_citations_are_numbered(spark):
    docs = spark.createDataFrame(DOCS, DOC_SCHEMA).withColumn("effectiveDate", F.lit("2024-01-01"))
    hits = spark.createDataFrame([("q", "SOP-2", 3.0), ("q", "SOP-1", 9.0)], "queryId string, id string, score double")
    (row,) = corpus.citations(hits, docs).collect()
    assert [(c["index"], c["id"]) for c in row.citations] == [(1, "SOP-1"), (2, "SOP-2")]


def test_a_document_of_many_sections_is_cut_in_linear_time(spark):
    body = "\n\n".join(f"## Part {i}\n{para(300)}" for i in range(20_000))
    got = corpus.corpus_pieces(spark.createDataFrame([("D", body + "\n\n## Last\nshort")], "id string, content string")).collect()
    assert [(r.heading, r.content) for r in got if r.isChunk] == chunks_by_hand(body + "\n\n## Last\nshort")
    assert [r.ordinal for r in got if r.isChunk] == list(range(len(got) - sum(not r.isChunk for r in got)))


def test_short_pieces_are_reported(spark):
    docs = spark.createDataFrame([(f"D{i}", t, "public", "sop") for i, t in enumerate(TEXTS)], "id string, content string, classification string, docType string")
    whole = corpus.corpus_report(corpus.corpus_pieces(docs)).filter("classification IS NULL AND docType IS NULL").first()
    every = [p for t in TEXTS if t.strip() for p in [chunks_by_hand(t)]]
    assert whole.chunks == sum(map(len, every)) and whole.documents == len(every) and whole.droppedPieces > 0 and whole.droppedChars > 0


def test_terms_are_found_in_words_by_their_rarest_run(spark):
    rng = random.Random(8)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 12))) for _ in range(400)} | {"😀ab", "x" * 200_000 + "abc"}
    terms = {"".join(rng.choice("abcé") for _ in range(rng.randint(3, 5))) for _ in range(60)} | {"zzz", "aaa", "😀ab"}
    got = corpus.words_holding(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    assert sorted(map(tuple, got.collect())) == sorted((w, t, w.count(t)) for w in words for t in terms if t in w)


def test_keyword_retrieval_reads_the_documents_once(spark, tmp_path):
    spark.createDataFrame(DOCS, DOC_SCHEMA).write.parquet(str(tmp_path / "docs"))
    docs, queries = spark.read.parquet(str(tmp_path / "docs")), spark.createDataFrame([("q", "chlorine residual drops")], "queryId string, query string")
    found = corpus.retrieve_keyword(docs, queries, top_k=2)
    assert found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert final.count("FileScan") == 1


def test_counts_of_a_document_are_shuffled_once_in_pieces_that_grow_in_number(spark):
    rows = [*DOCS[:2], (*DOCS[0][:2], "chlorine again", *DOCS[0][3:]), ("NUL-1", None, "chlorine residual", *DOCS[0][3:]), ("NUL-2", "Chlorine residual", None, *DOCS[0][3:])]
    queries = local_table(spark, [("q", "chlorine residual drops")], "queryId string, query string")
    for splits in (1, 3):
        found = corpus.retrieve_keyword(spark.createDataFrame(rows, DOC_SCHEMA).coalesce(splits), queries, top_k=5)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"Exchange hashpartitioning\(id#\d+, {16 * splits}\), REPARTITION_BY_NUM", plan)
        assert not re.search(r"Exchange hashpartitioning\(id#\d+, (term|queryId)#", plan)
        # rows of one id count together (6 times chlorine, 3 residual, 1 drops, two terms in the title); one without a title or a text is no document
        assert [tuple(r) for r in found.select("queryId", "id", "score").collect()] == [("q", "SOP-1", 6 + 3 + 1 + 2 * 5.0)]


@pytest.mark.parametrize("said, entity, via, attribute", [
    ("chlorine", "WaterQuality", "attributeName", "chlorine_mg_l"), ("cloudiness", "WaterQuality", "attributeSynonym", "turbidity_ntu"),
    ("running hours", "Telemetry", "attributeSynonym", "runHours"), ("vendor", "Asset", "attributeSynonym", "manufacturer"),
    ("night", "DmaFlow", "attributeSynonym", "isNightWindow"), ("pump", "Asset", "allowedValue", None), ("oem", "Asset", "attributeSynonym", "manufacturer"),
])
def test_terms_tell_the_attribute(spark, said, entity, via, attribute):
    found = q.resolve_terms(asked(spark, f"about {said}"), q.term_table(spark), "questionId").collect()
    assert (entity, said, via, attribute) in [tuple(r)[1:] for r in found]
