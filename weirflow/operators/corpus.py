"""Knowledge corpus: chunking by section, and governed retrieval by keyword and by vector."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow import params
from weirflow.functions import ordered, rules, text
from weirflow.vocabulary import STOP_WORDS

# Chunk sizes in characters, and what opens a section.
MAX_CHARS, TARGET_CHARS, MIN_CHARS = 2400, 900, 200
HEADING = r"(?md)^\s{0,3}(#{1,4})\s+(.+?)\s*$"
CAPS_LABEL = r"(?md)^([A-Z][A-Z0-9 /&()\-,.']{4,80}?)\.\s+(?=[A-Z0-9])"
# Two code points that Unicode reserves for internal use, so no text holds them.
OPEN, SPLIT = "\uFDD0", "\uFDD1"


def _cut(content: Column, pattern: str, replacement: str) -> Column:
    return F.split(F.regexp_replace(content, pattern, replacement), OPEN)


def _sections_of(parts: Column, heading_clean: str) -> Column:
    """Preamble (if it is long enough) and the non-empty sections."""
    preamble = text.strip(parts[0])
    first = F.filter(F.array(F.struct(F.lit("").alias("heading"), preamble.alias("body"))),
                     lambda s: F.length(s["body"]) >= MIN_CHARS)
    halves = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.split(p, SPLIT, 2))
    rest = F.transform(
        halves,
        lambda h: F.struct(
            F.regexp_replace(text.strip(h[0]), heading_clean, "").alias("heading"), text.strip(h[1]).alias("body")
        ),
    )
    return F.concat(first, F.filter(rest, lambda s: s["body"] != ""))


def split_sections(content: Column) -> Column:
    """Sections by markdown heading, else by ALLCAPS label (two at least), else the whole text."""
    whole = F.array(F.struct(F.lit("").alias("heading"), text.strip(content).alias("body")))

    def labelled(parts: Column) -> Column:
        return F.when(F.size(parts) > 2, _sections_of(parts, r"\.+\z")).otherwise(whole)

    def headed(parts: Column) -> Column:
        by_label = _cut(content, CAPS_LABEL, f"{OPEN}$1{SPLIT}$0")
        return F.when(F.size(parts) > 1, _sections_of(parts, r"\A\z")).otherwise(rules.let(by_label, labelled))

    return rules.let(_cut(content, HEADING, f"{OPEN}$2{SPLIT}"), headed)


RUNS = "array<struct<start:int,count:int>>"


def greedy_runs(texts: Column, body: Callable[[Column], Column], target: int | None) -> Column:
    """Neighbours that go together, as (start, count): a run ends before it would pass the ceiling, or once it is long enough.

    The fold carries the length of the open run and the starts so far; no text is copied, and an array grows only where a run starts.
    """
    sized = F.transform(texts, lambda t, i: F.struct((i + 1).alias("at"), F.length(body(t)).alias("size")))
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("open"))

    def step(s: Column, x: Column) -> Column:
        opens = (s["open"] == 0) | (s["open"] + x["size"] > MAX_CHARS)
        size = F.when(opens, 0).otherwise(s["open"]) + x["size"] + 2
        return F.struct(
            F.when(opens, F.concat(s["starts"], F.array(x["at"]))).otherwise(s["starts"]).alias("starts"),
            (size if target is None else F.when(size >= target, 0).otherwise(size)).cast("int").alias("open"),
        )

    def counted(starts: Column) -> Column:
        after = lambda a, i: F.coalesce(F.get(starts, i + 1), F.size(texts) + 1)
        return F.transform(starts, lambda a, i: F.struct(a.alias("start"), (after(a, i) - a).alias("count")))

    return rules.let(F.aggregate(sized, start, step, lambda s: s["starts"]), counted).cast(RUNS)


def coalesce_sections(sections: Column) -> Column:
    """Merge neighbours greedily until a chunk is long enough, without passing the ceiling."""

    def joined(own: Column) -> Column:
        heads = F.filter(F.transform(own, lambda x: x["heading"]), lambda h: h != "")
        bodies = F.transform(own, lambda x: x["body"])
        return F.struct(F.array_join(heads, " / ").alias("heading"), F.array_join(bodies, "\n\n").alias("body"))

    def chunks(every: Column) -> Column:
        runs = greedy_runs(every, lambda x: x["body"], TARGET_CHARS)
        return F.transform(runs, lambda r: rules.let(F.slice(every, r["start"], r["count"]), joined))

    return rules.let(sections, chunks)


def pack(body: Column) -> Column:
    """Pieces of an oversized section, split between paragraphs only."""

    def pieces(every: Column) -> Column:
        return F.transform(greedy_runs(every, lambda p: p, None), lambda r: F.array_join(F.slice(every, r["start"], r["count"]), "\n\n"))

    paragraphs = F.filter(F.transform(F.split(body, "\n\n"), text.strip), lambda p: p != "")
    return F.when(F.length(body) <= MAX_CHARS, F.array(body)).otherwise(rules.let(paragraphs, pieces))


def corpus_pieces(docs: DataFrame) -> DataFrame:
    """One row per piece of a document, and whether it is a chunk: all but short ones after the first. Chunks are numbered from 0. A document's fold is
    row-local; documents are independent, so there is no shuffle.

    The outer explode keeps the optimizer from inferring a filter that would run the fold a second time.
    """
    rest = [c for c in docs.columns if c not in ("id", "content")]
    rows = docs.filter(text.strip(F.coalesce("content", F.lit(""))) != "")

    def cut(chunk: Column) -> Column:
        return F.transform(pack(chunk["body"]), lambda b: F.struct(chunk["heading"].alias("heading"), b.alias("content")))

    def numbered(every: Column) -> Column:
        long = lambda p, i: (i == 0) | (F.length(p["content"]) >= MIN_CHARS)
        row = lambda number, p: F.struct(number.cast("int").alias("ordinal"), p["heading"].alias("heading"), p["content"].alias("content"))
        chunks = F.transform(F.filter(every, long), lambda p, i: row(i, p))
        short = F.transform(F.filter(every, lambda p, i: ~long(p, i)), lambda p: row(F.lit(None), p))
        return F.concat(chunks, short)

    pieces = rules.let(F.flatten(F.transform(coalesce_sections(split_sections(F.col("content"))), cut)), numbered)
    rows = rows.select(F.col("id").alias("documentId"), *rest, F.explode_outer(pieces).alias("_piece"))
    return rows.filter(F.col("_piece").isNotNull()).select("documentId", "_piece.*", F.col("_piece.ordinal").isNotNull().alias("isChunk"), *rest)


def chunk_corpus(docs: DataFrame) -> DataFrame:
    """One row per chunk."""
    rest = [c for c in docs.columns if c not in ("id", "content")]
    return corpus_pieces(docs).filter("isChunk").select(
        rules.stable_id("documentId", F.col("ordinal").cast("string"), length=40).alias("chunkId"), "documentId", "ordinal", "heading", "content", *rest)


def corpus_report(pieces: DataFrame) -> DataFrame:
    """Chunks, documents and mean size, and the short pieces that became no chunk and their characters, in total, by class and by type, in one pass. A table without
    ``isChunk`` holds chunks only."""
    chunk = F.col("isChunk") if "isChunk" in pieces.columns else F.lit(True)
    size = F.length("content")
    return (
        pieces.groupingSets([[], [F.col("classification")], [F.col("docType")]], "classification", "docType")
        .agg(
            F.count_if(chunk).alias("chunks"),
            F.countDistinct(F.when(chunk, F.col("documentId"))).alias("documents"),
            rules.steady(F.avg(F.when(chunk, size)), 2).alias("meanChars"),
            F.count_if(~chunk).alias("droppedPieces"),
            F.coalesce(F.sum(F.when(~chunk, size)), F.lit(0)).alias("droppedChars"),
        )
    )


def cleared(docs: DataFrame, ceiling: str) -> DataFrame:
    """Documents up to the caller's clearance; an unknown clearance means internal. Applied before any scoring."""
    rank = params.CLEARANCE.index(ceiling) if ceiling in params.CLEARANCE else 1
    return docs.filter(F.col("classification").isin(params.CLEARANCE[: rank + 1]))


def scoped(docs: DataFrame, doc_types: list[str] | None = None, asset_class: str | None = None) -> DataFrame:
    """Optional type and asset filters; a document without asset classes concerns every asset."""
    if doc_types:
        docs = docs.filter(F.col("docType").isin(doc_types))
    if asset_class:
        docs = docs.filter((F.size("assetClasses") == 0) | F.array_contains("assetClasses", asset_class))
    return docs


def query_terms(queries: DataFrame) -> DataFrame:
    """Search terms of each query with their number of uses, and how many terms the query has in all."""
    keep = F.filter(text.words(F.col("query")), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))
    rows = queries.select("queryId", keep.alias("_terms")).withColumn("termCount", F.size("_terms"))
    rows = rows.select("queryId", "termCount", F.explode("_terms").alias("term"))
    return rows.groupBy("queryId", "termCount", "term").agg(F.count(F.lit(1)).alias("uses"))


def grams(word: Column) -> Column:
    """The different runs of three characters in a word, in time linear in it."""
    return F.array_distinct(F.regexp_extract_all(word, F.lit("(?s)(?=(...))"), F.lit(1)))


def words_holding(vocabulary: DataFrame, terms: DataFrame) -> DataFrame:
    """(word, term, times): the words that have a term in them, of those that are given.

    An inverted index over the words: each is filed under its runs of three characters, each term is looked up under the one that fewest words have,
    and only the words found there are read. Terms have three characters at least.
    """
    postings = vocabulary.select("word", F.explode(grams(F.col("word"))).alias("gram"))
    spread = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = terms.select("term", F.explode(grams(F.col("term"))).alias("gram")).join(spread, "gram", "left").groupBy("term").agg(
        F.min_by("gram", F.struct(F.coalesce("_n", F.lit(0)), "gram")).alias("gram"))
    found = postings.join(rarest, "gram").filter(F.contains("word", "term"))
    return found.select("word", "term", text.occurrences(F.col("word"), F.col("term")).alias("inWord"))


#: Pieces that the counts of one input split are dealt to.
PIECES = 16


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each term occurs, as a substring, in each document, and whether its title has it.

    A term has word characters only, so each occurrence lies inside one word of the document. The documents are read once, as the counts of their words;
    terms meet them through the different words. Nothing pairs every document with every term.

    What is found is dealt out by document, in pieces whose number grows with the input, and not counted before: rows come in the order of their words, so few would
    fall together. Counts and scores of a document are then made where its rows are.
    """
    fields = F.array(F.struct(F.col("title").alias("said"), F.lit(1).alias("inTitle")), F.struct(F.col("content").alias("said"), F.lit(0).alias("inTitle")))
    rows = docs.filter(F.col("title").isNotNull() & F.col("content").isNotNull()).select("id", F.inline(fields))
    words = rows.select("id", "inTitle", F.explode(F.split(F.lower("said"), text.NON_WORD)).alias("word")).filter("word <> ''")
    said = words.groupBy("word", "id").agg(F.count(F.lit(1)).alias("said"), F.max("inTitle").alias("inTitle"))
    # the conditions always hold: they need the columns that the join below needs, so both read the same shuffled words
    vocabulary = said.groupBy("word").agg(F.sum("said").alias("said"), F.max("inTitle").alias("inTitle")).filter("said > 0 AND inTitle >= 0").select("word")
    holds = words_holding(vocabulary, terms)
    found = said.join(holds, "word").select("id", "term", (F.col("inWord") * F.col("said")).alias("times"), "inTitle")
    return (
        found.repartition(PIECES * docs.rdd.getNumPartitions(), "id")
        .groupBy("id", "term")
        .agg(F.sum("times").alias("times"), F.max("inTitle").alias("inTitle"))
    )


def retrieve_keyword(docs: DataFrame, queries: DataFrame, *, top_k: int, floor: float = 0.25) -> DataFrame:
    """Best documents of each query: occurrences plus five per title hit, weak tails cut relative to the best."""
    asked = query_terms(queries)
    counts = term_counts(docs, asked.select("term").distinct())
    scored = (
        counts.join(asked, "term")
        .groupBy("id", "queryId", "termCount")
        .agg(
            F.sum("uses").alias("_matched"),
            F.sum(F.col("uses") * (F.col("times") + F.col("inTitle") * 5)).cast("double").alias("score"),
        )
        .filter(F.col("_matched") >= F.least(F.lit(2), F.col("termCount")))
        .drop("_matched", "termCount")
    )
    return _best(scored, top_k, floor)


def _best(scored: DataFrame, top_k: int, floor: float | None = None) -> DataFrame:
    best = ordered.newest_n(scored, ["queryId"], [F.col("score").desc(), F.col("id")], top_k)
    if floor is not None:
        # The best document is among the top k, so the floor can be applied to those alone.
        peak = F.max("score").over(Window.partitionBy("queryId"))
        best = best.withColumn("_peak", peak).filter(F.col("score") >= F.col("_peak") * floor).drop("_peak")
    return best


def retrieve_vector(
    corpus: DataFrame, queries: DataFrame, *, top_k: int, threshold: float | None = None, queries_per_pass: int = 1000
) -> DataFrame:
    """Nearest vectors by exact cosine. ``queries`` (queryId, vector) go to the corpus in blocks of bounded size;
    each block is one pass over the corpus, which itself never moves."""
    total = queries.count()
    blocks = max(1, -(-total // queries_per_pass))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x))
    queries = queries.withColumn("norm", norm).filter("norm > 0")
    corpus = corpus.withColumn("norm", norm).filter("norm > 0")
    found = None
    for block in range(blocks):
        mine = queries.filter(F.pmod(F.xxhash64("queryId"), F.lit(blocks)) == block)
        asked = mine.agg(F.collect_list(F.struct("queryId", "vector", "norm"))).scalar()
        dot = F.aggregate(F.zip_with("vector", "_q.vector", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
        pairs = corpus.withColumn("_q", F.explode(asked))
        pairs = pairs.select(
            F.col("_q.queryId").alias("queryId"), "id", rules.steady(dot / (F.col("norm") * F.col("_q.norm")), 6).alias("score")
        )
        if threshold is not None:
            pairs = pairs.filter(F.col("score") >= threshold)
        found = pairs if found is None else found.unionByName(pairs)
    return _best(found, top_k)


def citations(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Numbered citation list of each query (at most top-k entries)."""
    facts = docs.select("id", "title", "docType", "effectiveDate")
    entry = F.struct((-F.col("score")).alias("_minus"), "id", "title", "docType", "effectiveDate")
    listed = hits.join(facts, "id").groupBy("queryId").agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    numbered = F.transform(
        "_all",
        lambda c, i: F.struct((i + 1).alias("index"), c["id"].alias("id"), c["title"].alias("title"),
                              c["docType"].alias("docType"), c["effectiveDate"].alias("effectiveDate")),
    )
    return listed.select("queryId", numbered.alias("citations"))


def stale_docs(docs: DataFrame, as_of: str) -> DataFrame:
    """Documents past their review date or not yet in force."""
    today = F.lit(as_of).cast("date")
    state = F.when(F.col("effectiveDate") > today, "not_yet_effective").when(F.col("reviewDate") < today, "review_overdue")
    return docs.withColumn("staleness", state).filter(F.col("staleness").isNotNull())
