"""Queries of the text, retrieval, conversation and integrity operators."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow import schemas
from weirflow import vocabulary as v
from weirflow.functions import text
from weirflow.operators import conversations as conv
from weirflow.operators import corpus, gold, integrity
from weirflow.operators import questions as q
from weirflow.plans import bindings as b
from weirflow.plans import tools as t
from weirflow.plans.oracle_views import NOW, VIEWS, listed, quoted, sql, values
from weirflow.plans.registry import query

WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"


def _tokens(column: str) -> str:
    w = WORDS.format(column)
    return (f"list_concat({w}, list_transform(list_filter({w}, lambda w: length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss'), "
            "lambda w: left(w, length(w) - 1)))")


@query("txt_tokenize", sql(f"SELECT questionId, array_to_string({_tokens('question')}, ' ') AS tokens FROM questions"))
def txt_tokenize(spark, sf_dir):
    rows = b.questions(spark, sf_dir)
    return rows.select("questionId", F.array_join(text.tokens(F.col("question")), " ").alias("tokens"))


VIEWS["ids"] = f"""
  SELECT *, list_sort(list_distinct(list_concat(sites, list_transform(devices,
              lambda d: array_to_string(string_split(d, '-')[1:2], '-'))))) AS siteIds
  FROM (SELECT *, list_sort(list_distinct(list_concat(found, CASE WHEN len(sites) > 0 THEN list_transform(list_filter(short,
                lambda x: NOT list_contains(sites, x) AND NOT regexp_matches(x, '^(WTP|WWTP|PS-|RES|DMA|WELL)')),
                lambda x: sites[1] || '-' || x) ELSE [] END))) AS devices
        FROM (SELECT questionId, question, regexp_extract_all(upper(question), {quoted(v.DEVICE_ID)}, 1) AS found,
                     list_sort(list_distinct(regexp_extract_all(upper(question), {quoted(v.SITE_ID)}, 1))) AS sites,
                     regexp_extract_all(upper(question), {quoted(v.SHORT_ID)}, 1) AS short FROM questions))"""


@query("txt_extract_ids", sql("""SELECT questionId, array_to_string(devices, ',') AS deviceIds,
    array_to_string(siteIds, ',') AS siteIds FROM ids"""))
def txt_extract_ids(spark, sf_dir):
    rows = q.extract_ids(b.questions(spark, sf_dir))
    return rows.select("questionId", *[F.array_join(c, ",").alias(c) for c in ("deviceIds", "siteIds")])


@query("txt_days_hint", sql(r"""SELECT questionId, coalesce(TRY_CAST(regexp_extract(lower(question), '(\d+)\s*days?', 1) AS INT), 30)
    AS days FROM questions"""))
def txt_days_hint(spark, sf_dir):
    return q.days_hint(b.questions(spark, sf_dir), 30).drop("question")


def _term_rows() -> list[tuple]:
    rows = []
    for i, (entity, synonyms, allowed) in enumerate(v.ENTITIES):
        rows += [(entity.lower(), entity, "entityName", "", 1, i, 0)] + [(s, entity, "entitySynonym", "", 2, i, 0) for s in synonyms]
        rows += [(x, entity, "allowedValue", "", 3, i, 0) for x in allowed]
        for j, name in enumerate(schemas.GOLD_ATTRIBUTES[entity]):
            rows += [(t, entity, "attributeName", name, 4, i, j) for t in (name.lower(), name.lower().split("_")[0])]
            rows += [(t, entity, "attributeSynonym", name, 4, i, j + 0.5) for t in v.ATTRIBUTE_SYNONYMS[entity].get(name, [])]
    return rows


VIEWS["terms"] = ("SELECT term, first(entity ORDER BY tier, ordinal, place) AS entity, first(via ORDER BY tier, ordinal, place) AS via, "
                  "nullif(first(attribute ORDER BY tier, ordinal, place), '') AS attribute FROM ("
                  + values(_term_rows()) + ") AS t(term, entity, via, attribute, tier, ordinal, place) GROUP BY term")


@query("txt_resolve_terms", sql(f"""
  WITH w AS (SELECT questionId, list_filter({WORDS.format('question')}, lambda w: length(w) > 2) AS ws FROM questions),
  p AS (SELECT questionId, list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS ps FROM w),
  e AS (SELECT questionId, unnest(ps) AS term, unnest(range(len(ps))) AS pos FROM p)
  SELECT questionId, entity, arg_min(term, pos) AS matchedTerm, arg_min(via, pos) AS matchedVia,
         arg_min({{'a': attribute}}, pos).a AS matchedAttribute
  FROM e JOIN terms USING (term) GROUP BY 1, 2"""))
def txt_resolve_terms(spark, sf_dir):
    return q.resolve_terms(b.questions(spark, sf_dir), q.term_table(spark), "questionId")


def _route_sql() -> str:
    own, forced, place = [], [], []
    known = listed(sorted({term for term, *_ in _term_rows()}))
    entities = f"list_sort(list_distinct(list_filter({WORDS.format('question')}, lambda w: length(w) > 2 AND list_contains({known}, w))))"
    for i, (name, triggers, wanted) in enumerate(v.SPECIALISTS):
        phrases = [x for x in triggers if " " in x]
        words = [x for x in triggers if " " not in x]
        score = " + ".join([f"CASE WHEN contains(low, {quoted(p)}) THEN 2.5 ELSE 0 END" for p in phrases]
                           + [f"len(list_intersect(toks, {listed(words)})) * 1.5"]
                           + [f"len(list_intersect(entities, {listed(wanted)}))" for _ in range(bool(wanted))])
        own.append(f"CAST({score} AS DOUBLE) AS o{i}")
        mine = [j for j, (_, agent) in enumerate(v.HARD_RULES) if agent == name]
        add = " + ".join([f"CASE WHEN r{j} THEN 6 ELSE 0 END" for j in mine] or ["0"])
        first = " ".join(f"WHEN r{j} THEN {100 + j}" for j in mine) or "WHEN FALSE THEN 0"
        forced.append(f"o{i} + {add} AS s{i}, CASE WHEN o{i} > 0 THEN {i} {first} ELSE 999 END AS p{i}")
        place.append(f"{{'m': -s{i}, 'p': p{i}, 'n': {quoted(name)}}}")
    hits = ", ".join(f"regexp_matches(low, {quoted(p)}) AS r{j}" for j, (p, _) in enumerate(v.HARD_RULES))
    agents = [f"CASE WHEN r{j} THEN {quoted(agent)} END" for j, (_, agent) in enumerate(v.HARD_RULES)]
    # First appearance of each forced specialist, in rule order.
    forced_list = f"list_filter([{', '.join(agents)}], lambda x: x IS NOT NULL)"
    return f"""
      SELECT questionId, question, entities, reason, specialists, conf,
             CASE WHEN reason IN ('no_match', 'ambiguous') THEN 'plan' WHEN reason = 'clear' AND len(specialists) = 1 THEN 'direct'
                  ELSE 'parallel' END AS strategy
      FROM (SELECT *, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS specialists
            FROM (SELECT *, CASE reason WHEN 'briefing' THEN {listed(v.BRIEFING_SPECIALISTS)}
                       WHEN 'clear' THEN list_concat(fl, [names[1]]) WHEN 'shared' THEN list_concat(names[1:2], fl)
                       ELSE names[1:3] END AS raw,
                     CASE WHEN reason = 'briefing' THEN 1.0 ELSE round(conf0, 3) END AS conf
                  FROM (SELECT *, CASE WHEN regexp_matches(low, {quoted(v.BRIEFING)}) THEN 'briefing' WHEN len(names) = 0 THEN 'no_match'
                              WHEN conf0 >= 0.55 AND top >= 3 THEN 'clear' WHEN runner >= 3 AND top - runner <= 2 THEN 'shared'
                              ELSE 'ambiguous' END AS reason
                        FROM (SELECT *, list_transform(ranked, lambda x: x.n) AS names, coalesce(-ranked[1].m, 0) AS top,
                                     coalesce(-ranked[2].m, 0) AS runner,
                                     coalesce(-ranked[1].m / list_sum(list_transform(ranked, lambda x: -x.m)), 0) AS conf0
                              FROM (SELECT *, list_sort(list_filter([{', '.join(place)}], lambda x: x.m < 0)) AS ranked,
                                           {forced_list} AS fl
                                    FROM (SELECT *, {', '.join(forced)}
                                          FROM (SELECT *, {', '.join(own)}, {hits}
                                                FROM (SELECT questionId, question, lower(question) AS low,
                                                             {_tokens('question')} AS toks, {entities} AS entities FROM questions))))))))"""


VIEWS["routed"] = _route_sql()


def routed(spark, sf_dir) -> DataFrame:
    return q.route(q.entity_words(b.questions(spark, sf_dir)), entities="entities")


@query("txt_route", sql("""SELECT questionId, reason, strategy, conf AS confidence, array_to_string(specialists, ',') AS specialists
    FROM routed"""))
def txt_route(spark, sf_dir):
    rows = routed(spark, sf_dir)
    return rows.select("questionId", "reason", "strategy", "confidence", F.array_join("specialists", ",").alias("specialists"))


def _approval_sql() -> str:
    names = r"(contains(low, 'work order') OR contains(low, 'workorder') OR regexp_matches(low, '\b(wo|ticket|job)\b'))"
    cases = []
    for action, verbs in v.GATED_ACTIONS:
        said = f"contains(low, {quoted(action.replace('_', ' '))}) OR contains(low, {quoted(action)})"
        verb = quoted(r"\b(" + "|".join(verbs) + ")")
        cases.append(f"CASE WHEN {said} OR ({names} AND regexp_matches(low, {verb})) THEN {quoted(action)} END")
    return f"""SELECT questionId, CASE WHEN list_contains(specialists, {quoted(v.GATED_SPECIALIST)})
        THEN concat_ws(',', {', '.join(cases)}) ELSE '' END AS pendingApprovals
      FROM (SELECT *, lower(question) AS low FROM routed)"""


@query("txt_approval_intent", sql(_approval_sql()))
def txt_approval_intent(spark, sf_dir):
    rows = q.approval_intent(routed(spark, sf_dir))
    return rows.select("questionId", F.array_join("pendingApprovals", ",").alias("pendingApprovals"))


# ---------------------------------------------------------------- corpus

def sectioned(spark, sf_dir) -> DataFrame:
    """Documents in the three shapes the chunker knows: headed, labelled and plain. Lines become paragraphs."""
    docs = b.knowledge(spark, sf_dir)
    lines = F.split("content", "\n")
    key = F.substring("id", 5, 20).cast("long")
    headed = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("## Part "), i.cast("string"), F.lit("\n"), x)), "\n\n")
    label = F.transform(lines, lambda x, i: F.concat(F.lit("SECTION NUMBER "), i.cast("string"), F.lit(". "), F.initcap(x)))
    plain = F.array_join(lines, "\n\n")
    shaped = F.when(key % 3 == 0, headed).when(key % 3 == 1, F.array_join(label, "\n\n")).otherwise(plain)
    return docs.withColumn("content", shaped)


# The rules once more: sections by markers that no text holds, and the greedy runs as recursions, one step for each section or paragraph.
VIEWS["blank"] = f"SELECT {' || '.join(f'chr({ord(c)})' for c in text.WHITE_SPACE)} AS ws, chr(64976) AS o, chr(64977) AS s, chr(10) || chr(10) AS gap"
VIEWS["sectioned"] = """
  SELECT * REPLACE (array_to_string(CASE CAST(substr(id, 5) AS BIGINT) % 3
      WHEN 0 THEN list_transform(lines, lambda x, i: '## Part ' || (i - 1) || chr(10) || x)
      WHEN 1 THEN list_transform(lines, lambda x, i: 'SECTION NUMBER ' || (i - 1) || '. ' ||
                  array_to_string(list_transform(string_split(lower(x), ' '), lambda w: CASE WHEN w LIKE 'ß%' THEN 'Ss' ELSE upper(substr(w, 1, 1)) END || substr(w, 2)), ' '))
      ELSE lines END, E'\\n\\n') AS content)
  FROM (SELECT *, string_split(content, chr(10)) AS lines FROM knowledge) CROSS JOIN blank"""
VIEWS["cut_up"] = r"""
  SELECT * EXCLUDE (parts, o), CASE WHEN len(heads) > 1 THEN heads WHEN len(labels) > 2 THEN labels END AS parts, len(heads) <= 1 AS labelled FROM (
  SELECT *, string_split(regexp_replace(content, '(?m)^\s{0,3}(#{1,4})\s+(.+?)\s*$', o || '\2' || s, 'g'), o) AS heads, NULL AS parts,
         string_split(regexp_replace(content, '(?m)^([A-Z][A-Z0-9 /&()\-,.'']{4,80}?)\.\s+([A-Z0-9])', o || '\1' || s || '\0', 'g'), o) AS labels
  FROM sectioned WHERE trim(coalesce(content, ''), ws) <> '')"""
VIEWS["section_rows"] = r"""
  SELECT id, generate_subscripts(own, 1) AS i, unnest(own, recursive := true) FROM (
  SELECT id, CASE WHEN parts IS NULL THEN [{'heading': '', 'body': trim(content, ws)}] ELSE
         list_filter([{'heading': '', 'body': trim(parts[1], ws)}], lambda x: length(x.body) >= 200) ||
         list_filter(list_transform(parts[2:], lambda p: {'heading': CASE WHEN labelled THEN regexp_replace(trim(split_part(p, s, 1), ws), '\.+$', '') ELSE trim(split_part(p, s, 1), ws) END,
                                                          'body': trim(substr(p, instr(p, s) + 1), ws)}), lambda x: x.body <> '') END AS own
  FROM cut_up)"""


def _greedy(rows: str, key: str, size: str, target: str) -> str:
    """(key, i, opens) of each row of ``rows``, in the order of i from 1."""
    after = lambda open_: f"CASE WHEN {open_} >= {target} THEN 0 ELSE {open_} END"
    return f"""
      WITH RECURSIVE walk(key, i, opens, open) AS (
        SELECT {key}, i, TRUE, {after(f'length({size}) + 2')} FROM {rows} WHERE i = 1
        UNION ALL
        SELECT w.key, r.i, w.open = 0 OR w.open + length({size}) > 2400,
               {after(f'(CASE WHEN w.open = 0 OR w.open + length({size}) > 2400 THEN 0 ELSE w.open END + length({size}) + 2)')}
        FROM walk w JOIN {rows} r ON w.key = r.{key} AND r.i = w.i + 1)
      SELECT key, i, sum(opens::INT) OVER (PARTITION BY key ORDER BY i) AS run FROM walk"""


VIEWS["section_runs"] = _greedy("section_rows", "id", "body", "900")
VIEWS["merged_sections"] = """
  SELECT id || '/' || run AS chunk, id, run, array_to_string(coalesce(list(heading ORDER BY i) FILTER (heading <> ''), []), ' / ') AS heading, array_to_string(list(body ORDER BY i), E'\\n\\n') AS body
  FROM section_rows JOIN (SELECT key AS id, i, run FROM section_runs) USING (id, i) CROSS JOIN blank GROUP BY id, run"""
VIEWS["paragraphs"] = """
  SELECT chunk, generate_subscripts(own, 1) AS i, unnest(own) AS p FROM (
  SELECT chunk, list_filter(list_transform(string_split(body, gap), lambda x: trim(x, ws)), lambda x: x <> '') AS own FROM merged_sections CROSS JOIN blank WHERE length(body) > 2400)"""
VIEWS["paragraph_runs"] = _greedy("paragraphs", "chunk", "p", "1e18")
VIEWS["pieces"] = """
  SELECT *, place = 1 OR length(content) >= 200 AS isChunk FROM (
  SELECT id, heading, content, row_number() OVER (PARTITION BY id ORDER BY run, piece) AS place FROM (
    SELECT id, run, 0 AS piece, heading, body AS content FROM merged_sections WHERE length(body) <= 2400
    UNION ALL
    SELECT id, m.run, p.run, heading, content FROM merged_sections m JOIN (
      SELECT chunk, run, array_to_string(list(p ORDER BY i), E'\\n\\n') AS content FROM paragraphs JOIN (SELECT key AS chunk, i, run FROM paragraph_runs) USING (chunk, i) CROSS JOIN blank GROUP BY chunk, run) p
    USING (chunk)))"""


@query("txt_chunk_corpus", sql("""
  SELECT sha1(concat_ws('|', id, ordinal::VARCHAR)) AS chunkId, id AS documentId, ordinal, heading, p.content, docType, classification
  FROM (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY place) - 1)::INT AS ordinal FROM pieces WHERE isChunk) p JOIN knowledge k USING (id)"""))
def txt_chunk_corpus(spark, sf_dir):
    rows = corpus.chunk_corpus(sectioned(spark, sf_dir))
    return rows.select("chunkId", "documentId", "ordinal", "heading", "content", "docType", "classification")


@query("agg_corpus_report", sql("""SELECT classification, docType, count(*) FILTER (isChunk) AS chunks, count(DISTINCT id) FILTER (isChunk) AS documents,
    round(avg(length(p.content)) FILTER (isChunk), 2) AS meanChars, count(*) FILTER (NOT isChunk) AS droppedPieces,
    coalesce(sum(length(p.content)) FILTER (NOT isChunk), 0)::BIGINT AS droppedChars
    FROM pieces p JOIN knowledge k USING (id) GROUP BY GROUPING SETS ((), (classification), (docType))"""))
def agg_corpus_report(spark, sf_dir):
    return corpus.corpus_report(corpus.corpus_pieces(sectioned(spark, sf_dir)))


@query("agg_corpus_report_documents", sql("""SELECT classification, docType, count(*) AS chunks, count(DISTINCT id) AS documents,
    round(avg(length(content)), 2) AS meanChars, 0 AS droppedPieces, 0 AS droppedChars FROM knowledge GROUP BY GROUPING SETS ((), (classification), (docType))"""))
def agg_corpus_report_documents(spark, sf_dir):
    return corpus.corpus_report(b.knowledge(spark, sf_dir).withColumnRenamed("id", "documentId"))


@query("flt_classification", sql("""SELECT id, classification, docType FROM knowledge
    WHERE classification IN ('public', 'internal', 'confidential')"""))
def flt_classification(spark, sf_dir):
    return corpus.cleared(b.knowledge(spark, sf_dir), "confidential").select("id", "classification", "docType")


def asked(spark, sf_dir) -> DataFrame:
    items = b.table(spark, sf_dir, "benchmark")
    return items.select(F.concat(F.lit("B-"), F.col("item_id").cast("string")).alias("queryId"), F.col("text").alias("query"))


VIEWS["hits"] = f"""
  SELECT queryId, id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY queryId ORDER BY score DESC, id) AS rn, max(score) OVER (PARTITION BY queryId) AS peak
    FROM (SELECT queryId, id, sum(uses) AS matched, CAST(sum(uses * (times + 5 * title)) AS DOUBLE) AS score, any_value(n) AS n
          FROM (SELECT k.id, d.term, (length(hay) - length(replace(hay, d.term, ''))) // length(d.term) AS times,
                       CASE WHEN contains(lower(k.title), d.term) THEN 1 ELSE 0 END AS title
                FROM (SELECT id, title, lower(title || ' ' || content) AS hay FROM knowledge
                      WHERE classification IN ('public', 'internal') AND (len(assetClasses) = 0 OR list_contains(assetClasses, 'en'))) k
                JOIN (SELECT DISTINCT term FROM asked_terms) d ON contains(k.hay, d.term)) c
          JOIN asked_terms USING (term) GROUP BY 1, 2)
    WHERE matched >= least(2, n) AND score > 0)
  WHERE rn <= 5 AND score >= peak * 0.25"""
VIEWS["asked_terms"] = f"""
  SELECT queryId, term, count(*) AS uses, any_value(n) AS n
  FROM (SELECT queryId, unnest(ts) AS term, len(ts) AS n
        FROM (SELECT 'B-' || item_id AS queryId, list_filter({WORDS.format('text')},
                     lambda w: length(w) > 2 AND NOT list_contains({listed(v.STOP_WORDS)}, w)) AS ts FROM benchmark))
  GROUP BY 1, 2"""


def hits(spark, sf_dir) -> DataFrame:
    docs = corpus.scoped(corpus.cleared(b.knowledge(spark, sf_dir), "internal"), asset_class="en")
    return corpus.retrieve_keyword(docs.select("id", "title", "content"), asked(spark, sf_dir), top_k=5)


@query("txt_retrieve_keyword", sql("SELECT * FROM hits"))
def txt_retrieve_keyword(spark, sf_dir):
    return hits(spark, sf_dir)


@query("txt_citations", sql("""SELECT queryId, string_agg(pos || ':' || id || ':' || docType || ':' || effectiveDate, ';' ORDER BY pos)
    AS citations FROM (SELECT h.*, docType, effectiveDate, row_number() OVER (PARTITION BY queryId ORDER BY score DESC, h.id) AS pos
                       FROM hits h JOIN knowledge k ON k.id = h.id) GROUP BY 1"""))
def txt_citations(spark, sf_dir):
    rows = corpus.citations(hits(spark, sf_dir), b.knowledge(spark, sf_dir))
    line = F.transform("citations", lambda c: F.concat_ws(
        ":", c["index"].cast("string"), c["id"], c["docType"], c["effectiveDate"].cast("string")))
    return rows.select("queryId", F.array_join(line, ";").alias("citations"))


def vector_queries(spark, sf_dir) -> DataFrame:
    """The centre of each label's vectors, one query per label."""
    cells = b.embeddings(spark, sf_dir).select("label", F.posexplode("embedding").alias("at", "x"))
    means = cells.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vector = F.sort_array(F.collect_list(F.struct("at", "x")))
    rows = means.groupBy("label").agg(F.transform(vector, lambda c: c["x"]).alias("vector"))
    return rows.select(F.concat(F.lit("L-"), F.col("label").cast("string")).alias("queryId"), "vector")


@query("txt_retrieve_vector", sql("""
  WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
  x AS (SELECT label, unnest(vec) AS v, unnest(range(len(vec))) AS pos FROM e),
  c AS (SELECT label, list(m ORDER BY pos) AS q FROM (SELECT label, pos, avg(v) AS m FROM x GROUP BY 1, 2) GROUP BY 1),
  s AS (SELECT 'L-' || c.label AS queryId, 'V-' || vec_id AS id, round(list_cosine_similarity(vec, q), 6) AS score FROM e, c)
  SELECT * FROM s WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY queryId ORDER BY score DESC, id) <= 15"""))
def txt_retrieve_vector(spark, sf_dir):
    vectors = b.embeddings(spark, sf_dir).select(
        F.concat(F.lit("V-"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    return corpus.retrieve_vector(vectors, vector_queries(spark, sf_dir), top_k=15, threshold=0.1)


@query("top_retrieval", sql("""SELECT queryId, count(*) AS found, max(score) AS best, min(score) AS weakest FROM hits GROUP BY 1"""))
def top_retrieval(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("queryId").agg(
        F.count(F.lit(1)).alias("found"), F.max("score").alias("best"), F.min("score").alias("weakest")
    )


@query("txt_stale_docs", sql(f"""SELECT id, effectiveDate, reviewDate, CASE WHEN effectiveDate > CAST({NOW} AS DATE)
    THEN 'not_yet_effective' ELSE 'review_overdue' END AS staleness FROM knowledge
    WHERE effectiveDate > CAST({NOW} AS DATE) OR reviewDate < CAST({NOW} AS DATE)"""), dates=("effectiveDate", "reviewDate",))
def txt_stale_docs(spark, sf_dir):
    rows = corpus.stale_docs(b.knowledge(spark, sf_dir), b.AS_OF)
    return rows.select("id", "effectiveDate", "reviewDate", "staleness")


# ---------------------------------------------------------------- conversations

@query("cnv_history", sql("""SELECT conversationId, turn, role, content, createdAt FROM turns
    QUALIFY row_number() OVER (PARTITION BY conversationId ORDER BY createdAt DESC, turn DESC) <= 4"""))
def cnv_history(spark, sf_dir):
    return conv.history(b.turns(spark, sf_dir), 4).select("conversationId", "turn", "role", "content", "createdAt")


@query("cnv_list", sql("""
  WITH c AS (SELECT userId, conversationId, substr(arg_min(content, turn), 1, 80) AS title, max(createdAt) AS createdAt
             FROM turns WHERE role = 'user' GROUP BY 1, 2)
  SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY userId ORDER BY createdAt DESC, conversationId) <= 25"""))
def cnv_list(spark, sf_dir):
    return conv.list_conversations(b.turns(spark, sf_dir))


@query("cnv_transcript", sql("""
  WITH r AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY conversationId ORDER BY createdAt DESC, turn DESC) <= 6)
  SELECT conversationId, string_agg(role || ': ' || content, chr(10) ORDER BY createdAt, turn) AS transcript FROM r GROUP BY 1"""))
def cnv_transcript(spark, sf_dir):
    return conv.transcript(b.turns(spark, sf_dir))


def expired(spark, sf_dir) -> DataFrame:
    """Conversations to remove: those that any system turn opened."""
    return b.turns(spark, sf_dir).filter("role = 'system'")


GONE = "(SELECT conversationId FROM turns WHERE role = 'system')"


@query("cnv_delete", sql(f"SELECT conversationId, turn, role FROM turns WHERE conversationId NOT IN {GONE}"))
def cnv_delete(spark, sf_dir):
    return conv.delete(b.turns(spark, sf_dir), expired(spark, sf_dir)).select("conversationId", "turn", "role")


@query("cnv_deletion_report", sql(f"""SELECT conversationId, count(*) AS deletedTurns FROM turns
    WHERE conversationId IN {GONE} GROUP BY 1"""))
def cnv_deletion_report(spark, sf_dir):
    return conv.deletion_report(b.turns(spark, sf_dir), expired(spark, sf_dir))


def traces(spark, sf_dir) -> DataFrame:
    rows = q.approval_intent(q.extract_ids(routed(spark, sf_dir)))
    rows = rows.withColumns({
        "elapsedMs": F.length("question").cast("long") * 7 % 2000, "userId": F.concat(F.lit("U-"), F.regexp_extract("questionId", "Q-([0-9]+)-", 1)),
    })
    # the first question of a conversation cites the document of the same number
    cited = b.knowledge(spark, sf_dir).select(F.concat(F.lit("Q-"), F.substring("id", 5, 20), F.lit("-0")).alias("id"), F.array("id").alias("citations"))
    return conv.trace_log(rows, citations=cited)


VIEWS["traced"] = """SELECT r.questionId AS id, entities, strategy, conf, specialists, devices, i.siteIds, length(r.question) * 7 % 2000 AS elapsedMs,
    'U-' || split_part(r.questionId, '-', 2) AS userId, coalesce(k.id, '') AS cited
    FROM routed r JOIN ids i ON i.questionId = r.questionId LEFT JOIN knowledge k ON r.questionId = 'Q-' || substr(k.id, 5) || '-0'"""


@query("cnv_trace_log", sql("""SELECT id, 'trace' AS type, strategy, conf AS confidence, array_to_string(specialists, ',') AS specialists,
    array_to_string(devices, ',') AS deviceIds, array_to_string(siteIds, ',') AS siteIds,
    array_to_string(entities, ',') AS entities, elapsedMs, userId, cited AS citations, 'rules' AS orchestrationMode,
    'devices=' || CASE WHEN len(devices) > 0 THEN 'ok' ELSE 'empty' END || ',knowledge=' || CASE WHEN cited <> '' THEN 'ok' ELSE 'empty' END
      || ',ontology=' || CASE WHEN len(entities) > 0 THEN 'ok' ELSE 'empty' END || ',routing=' || CASE WHEN len(specialists) > 0 THEN 'ok' ELSE 'empty' END
      || ',sites=' || CASE WHEN len(siteIds) > 0 THEN 'ok' ELSE 'empty' END AS layerStatus FROM traced"""))
def cnv_trace_log(spark, sf_dir):
    return traces(spark, sf_dir).select(
        "id", "type", "route.strategy", "route.confidence", F.array_join("route.specialists", ",").alias("specialists"),
        F.array_join("deviceIds", ",").alias("deviceIds"), F.array_join("siteIds", ",").alias("siteIds"),
        F.array_join("entities", ",").alias("entities"), "elapsedMs", "userId", F.array_join("citations", ",").alias("citations"), "orchestrationMode",
        F.array_join(F.array_sort(F.transform(F.map_entries("layerStatus"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("layerStatus"),
    )


@query("cnv_trace_report", sql("""SELECT strategy, count(*) AS turns, max(elapsedMs) AS maxMs,
    list_sort(list(elapsedMs))[CAST(ceil(count(*) * 0.5) AS INT)] AS p50Ms,
    list_sort(list(elapsedMs))[CAST(ceil(count(*) * CAST(0.95 AS DOUBLE)) AS INT)] AS p95Ms FROM traced GROUP BY 1"""))
def cnv_trace_report(spark, sf_dir):
    return conv.trace_report(traces(spark, sf_dir))


@query("cnv_specialist_report", sql("""SELECT specialist, count(*) AS turns, max(elapsedMs) AS maxMs,
    list_sort(list(elapsedMs))[CAST(ceil(count(*) * 0.5) AS INT)] AS p50Ms,
    list_sort(list(elapsedMs))[CAST(ceil(count(*) * CAST(0.95 AS DOUBLE)) AS INT)] AS p95Ms
    FROM (SELECT unnest(specialists) AS specialist, elapsedMs FROM traced) GROUP BY 1"""))
def cnv_specialist_report(spark, sf_dir):
    return conv.specialist_report(traces(spark, sf_dir))


# ---------------------------------------------------------------- integrity and views

def entity_tables(spark, sf_dir) -> dict[str, DataFrame]:
    from weirflow.operators.assets import failure_library

    return {
        "Site": b.sites(spark, sf_dir),
        "Asset": gold.gold_asset(b.assets(spark, sf_dir)),
        "EdgeDevice": b.devices(spark, sf_dir),
        "Telemetry": b.telemetry(spark, sf_dir),
        "WaterQuality": b.water_quality(spark, sf_dir),
        "Alarm": b.alarms(spark, sf_dir),
        "WorkOrder": b.work_orders(spark, sf_dir),
        "FailureMode": failure_library(spark),
    }


ENTITY_VIEWS = {"Site": "sites", "Asset": "assets", "EdgeDevice": "devices", "Telemetry": "telemetry", "WaterQuality": "wq",
                "Alarm": "alarms", "WorkOrder": "work_orders", "FailureMode": "failure_modes"}


def _fk_sql() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}.{ck}->{p}.{pk}' AS relationship, count(*) AS childRows,
            count(*) FILTER (WHERE {ck} NOT IN (SELECT {pk} FROM {ENTITY_VIEWS[p]})) AS orphanRows
            FROM {ENTITY_VIEWS[c]} WHERE {ck} IS NOT NULL""" for c, ck, p, pk in v.RELATIONSHIPS)


@query("jn_ontology_fk", sql(_fk_sql()))
def jn_ontology_fk(spark, sf_dir):
    return integrity.relationship_report(entity_tables(spark, sf_dir), v.RELATIONSHIPS)


@query("set_orphans", sql("""
  SELECT deviceId AS id, 'never_used' AS problem FROM devices WHERE deviceId NOT IN (SELECT deviceId FROM telemetry)
  UNION ALL SELECT DISTINCT deviceId, 'not_registered' FROM telemetry WHERE deviceId NOT IN (SELECT deviceId FROM devices)"""))
def set_orphans(spark, sf_dir):
    return integrity.orphans(b.devices(spark, sf_dir), b.telemetry(spark, sf_dir), "deviceId")


@query("tbl_row_counts", sql(" UNION ALL ".join(
    f"SELECT '{n}' AS tableName, count(*) AS rowCount FROM {view}" for n, view in ENTITY_VIEWS.items())))
def tbl_row_counts(spark, sf_dir):
    return integrity.row_counts(entity_tables(spark, sf_dir))


@query("sql_gold_views", sql("""SELECT siteId, assetClass, count(*) AS assets, avg(ratedPowerKw) AS meanKw FROM assets
    WHERE ratedPowerKw >= 20 GROUP BY 1, 2 ORDER BY assets DESC, siteId, assetClass LIMIT 100"""))
def sql_gold_views(spark, sf_dir):
    return integrity.sql_over(
        spark,
        {"gold_asset": gold.gold_asset(b.assets(spark, sf_dir))},
        """SELECT siteId, assetClass, count(*) AS assets, avg(ratedPowerKw) AS meanKw FROM {gold_asset}
           WHERE ratedPowerKw >= :kw GROUP BY siteId, assetClass ORDER BY assets DESC, siteId, assetClass""",
        {"kw": 20.0},
        limit=100,
    )


@query("set_union_layers", sql("""SELECT deviceId, value FROM (SELECT deviceId, max(value) AS value FROM series WHERE tag = 'power_kw'
    GROUP BY 1) UNION ALL SELECT deviceId, -1 FROM devices WHERE deviceId NOT IN (SELECT deviceId FROM telemetry)"""))
def set_union_layers(spark, sf_dir):
    from weirflow.sources.writers import merge_rows

    old = b.devices(spark, sf_dir).select("deviceId", F.lit(-1.0).alias("value"))
    new = t.points(spark, sf_dir).filter("tag = 'power_kw'").groupBy("deviceId").agg(F.max("value").alias("value"))
    return merge_rows(old, new, ["deviceId"])
