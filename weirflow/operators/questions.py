"""Rule-based understanding of a question log: ids, terms, routing and approval intent, a row per question.

Everything is a row-local expression except the term lookup, so a log of any size needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow import schemas
from weirflow import vocabulary as v
from weirflow.functions import rules, text
from weirflow.session import local_table


def extract_ids(rows: DataFrame, question: str = "question") -> DataFrame:
    """Devices and sites named in the text. A device implies its site; a short id belongs to the first site."""
    upper = F.upper(question)

    def found(pattern: str) -> Column:
        return F.regexp_extract_all(upper, F.lit(pattern), F.lit(1))

    def devices(sites: Column) -> Column:
        def is_short(x: Column) -> Column:
            return ~F.array_contains(sites, x) & ~rules.any_of([x.startswith(p) for p in v.SITE_PREFIXES])

        named = F.transform(F.filter(found(v.SHORT_ID), is_short), lambda x: F.concat(sites[0], F.lit("-"), x))
        every = F.when(F.size(sites) > 0, F.concat(found(v.DEVICE_ID), named)).otherwise(found(v.DEVICE_ID))
        return F.array_sort(F.array_distinct(every))

    def both(sites: Column) -> Column:
        return rules.let(devices(sites), lambda d: F.struct(
            d.alias("deviceIds"),
            F.array_sort(F.array_union(sites, F.transform(d, lambda x: F.substring_index(x, "-", 2)))).alias("siteIds"),
        ))

    ids = rules.let(F.array_sort(F.array_distinct(found(v.SITE_ID))), both)
    return rows.withColumn("_ids", ids).select(*rows.columns, "_ids.*")


def days_hint(rows: DataFrame, default: int, question: str = "question") -> DataFrame:
    found = F.regexp_extract(F.lower(question), r"(\d+)\s*days?", 1)
    return rows.withColumn("days", F.coalesce(found.try_cast("int"), F.lit(default)))


def _terms() -> list[tuple[str, str, str, str | None, int, int]]:
    """(term, entity, via, attribute, tier, ordinal). Attributes count in their order, the name of one before its synonyms."""
    rows = []
    for i, (entity, synonyms, allowed) in enumerate(v.ENTITIES):
        rows.append((entity.lower(), entity, "entityName", None, 1, i * 1000))
        rows += [(s, entity, "entitySynonym", None, 2, i * 1000) for s in synonyms]
        rows += [(a, entity, "allowedValue", None, 3, i * 1000) for a in allowed]
        for j, name in enumerate(schemas.GOLD_ATTRIBUTES[entity]):
            rows += [(t, entity, "attributeName", name, 4, i * 1000 + 2 * j) for t in {name.lower(), name.lower().split("_")[0]}]
            rows += [(t, entity, "attributeSynonym", name, 4, i * 1000 + 2 * j + 1) for t in v.ATTRIBUTE_SYNONYMS[entity].get(name, [])]
    return rows


def term_table(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """Term to entity: name, synonym, allowed value, attribute by name or synonym, in this order of strength.

    ``extra`` adds terms of one's own ontology as (term, entity, via, tier, ordinal), and ``attribute`` if there is one.
    """
    table = local_table(spark, _terms(), "term string, entity string, via string, attribute string, tier int, ordinal int")
    if extra is not None:
        table = table.unionByName(extra, allowMissingColumns=True)
    return table.groupBy("term").agg(
        F.min_by(F.struct("entity", "via", "attribute"), F.struct("tier", "ordinal", "entity")).alias("hit")
    ).select("term", "hit.*")


def resolve_terms(rows: DataFrame, terms: DataFrame, key: str, question: str = "question") -> DataFrame:
    """Entities a question mentions, each with the first word or word pair that named it, and the attribute that this names."""
    rows = rows.select(key, F.filter(text.words(F.col(question)), lambda w: F.length(w) > 2).alias("_words"))
    pairs = F.zip_with(
        F.slice("_words", 1, F.greatest(F.size("_words") - 1, F.lit(0))),
        F.slice("_words", 2, F.greatest(F.size("_words") - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    said = rows.select(key, F.posexplode(F.concat("_words", pairs)).alias("_at", "term"))
    return (
        said.join(terms, "term")
        .groupBy(key, "entity")
        .agg(F.min_by(F.struct("term", "via", "attribute"), "_at").alias("_first"))
        .select(
            key, "entity", F.col("_first.term").alias("matchedTerm"), F.col("_first.via").alias("matchedVia"),
            F.col("_first.attribute").alias("matchedAttribute"),
        )
    )


def entity_words(rows: DataFrame, question: str = "question", extra: Sequence[str] = ()) -> DataFrame:
    """The single words of a question that are terms of the ontology, as ``entities``: what :func:`route` scores.

    ``extra`` are terms of one's own ontology. A row-local expression, as the ontology is a short list.
    """
    known = sorted({t for t, *_ in _terms()} | {t.lower() for t in extra})
    said = F.filter(text.words(F.col(question)), lambda w: F.length(w) > 2)
    return rows.withColumn("entities", F.array_sort(F.array_intersect(said, text.literals(known))))


def _hits(said: Column) -> Column:
    """Triggers found, one list per specialist."""

    def found(t: Column) -> Column:
        return F.when(_is_phrase(t), F.contains(said["low"], t)).otherwise(F.array_contains(said["tokens"], t))

    return F.array(*[F.filter(text.literals(triggers), found) for _, triggers, _ in v.SPECIALISTS])


def _is_phrase(trigger: Column) -> Column:
    return F.contains(trigger, F.lit(" "))


def _score(i: int, said: Column, facts: Column) -> Column:
    """Score and place in a tie: those with words of their own first, in registry order, then those that only a
    rule brought in, in rule order."""
    name, _, wanted = v.SPECIALISTS[i]
    rules_of = [j for j, (_, agent) in enumerate(v.HARD_RULES) if agent == name]
    by_rule = sum((F.when(facts["rules"][j], 6.0).otherwise(0.0) for j in rules_of), F.lit(0.0))
    first_rule = F.coalesce(*[F.when(facts["rules"][j], F.lit(100 + j)) for j in rules_of], F.lit(999))
    own = F.aggregate(
        facts["hits"][i], F.lit(0.0), lambda acc, t: acc + F.when(_is_phrase(t), 2.5).otherwise(1.5)
    ) + F.size(F.array_intersect(said["entities"], text.literals(wanted)))
    named = F.filter(text.literals(wanted), lambda w: F.array_contains(said["entities"], w))
    matched = F.concat(
        facts["hits"][i], F.transform(named, lambda w: F.concat(F.lit("entity:"), w)),
        F.array_compact(F.array(*[F.when(facts["rules"][j], F.lit("rule")) for j in rules_of])) if rules_of else text.literals([]),
    )
    return rules.let(
        own,
        lambda o: F.struct(
            (-(o + by_rule)).alias("minus"), F.when(o > 0, F.lit(i)).otherwise(first_rule).alias("place"),
            F.lit(name).alias("name"), F.slice(matched, 1, 6).alias("hits"),
        ),
    )


def _decide(said: Column, facts: Column, ranked: Column) -> Column:
    names = F.transform(ranked, lambda s: s["name"])
    forced = F.array_distinct(
        F.array_compact(F.array(*[F.when(facts["rules"][j], F.lit(agent)) for j, (_, agent) in enumerate(v.HARD_RULES)]))
    )
    top = F.coalesce(-F.try_element_at(ranked, F.lit(1))["minus"], F.lit(0.0))
    runner = F.coalesce(-F.try_element_at(ranked, F.lit(2))["minus"], F.lit(0.0))
    total = F.aggregate(ranked, F.lit(0.0), lambda acc, s: acc - s["minus"])

    def judged(d: Column) -> Column:
        reason = (
            F.when(said["low"].rlike(v.BRIEFING), "briefing")
            .when(F.size(d["names"]) == 0, "no_match")
            .when((d["confidence"] >= 0.55) & (d["top"] >= 3.0), "clear")
            .when((d["runner"] >= 3.0) & (d["top"] - d["runner"] <= 2.0), "shared")
            .otherwise("ambiguous")
        )
        return rules.let(reason, lambda why: chosen(d, why))

    def chosen(d: Column, why: Column) -> Column:
        agents = (
            F.when(why == "briefing", text.literals(v.BRIEFING_SPECIALISTS))
            .when(why == "clear", F.array_union(d["forced"], F.slice(d["names"], 1, 1)))
            .when(why == "shared", F.array_union(F.slice(d["names"], 1, 2), d["forced"]))
            .otherwise(F.slice(d["names"], 1, 3))
        )
        return rules.let(agents, lambda a: result(d, why, a))

    def result(d: Column, why: Column, agents: Column) -> Column:
        strategy = (
            F.when(why.isin("no_match", "ambiguous"), "plan")
            .when((why == "clear") & (F.size(agents) == 1), "direct")
            .otherwise("parallel")
        )
        return F.struct(
            why.alias("reason"),
            agents.alias("specialists"),
            F.when(why == "briefing", 1.0).otherwise(rules.steady(d["confidence"], 3)).alias("confidence"),
            strategy.alias("strategy"),
            F.transform(ranked, lambda s: F.struct(s["name"].alias("name"), (-s["minus"]).alias("score"))).alias("scores"),
            F.try_element_at(ranked, F.lit(1))["hits"].alias("matchedOn"),
        )

    measured = F.struct(
        names.alias("names"), forced.alias("forced"), top.alias("top"), runner.alias("runner"),
        F.coalesce(F.try_divide(top, total), F.lit(0.0)).alias("confidence"),
    )
    return rules.let(measured, judged)


def route(rows: DataFrame, question: str = "question", entities: str | None = None) -> DataFrame:
    """Score the specialists and decide who answers, and how: one expression per question, no shuffle.

    ``entities`` names the column of ontology words (see :func:`entity_words`); each that a specialist knows adds a point.
    """
    none = F.array().cast("array<string>")
    said = F.struct(
        F.lower(question).alias("low"), text.tokens(F.col(question)).alias("tokens"),
        (none if entities is None else F.col(entities)).alias("entities"),
    )

    def with_facts(s: Column) -> Column:
        rule_hits = F.array(*[s["low"].rlike(pattern) for pattern, _ in v.HARD_RULES])
        facts = F.struct(rule_hits.alias("rules"), _hits(s).alias("hits"))
        return rules.let(facts, lambda f: rules.let(ranking(s, f), lambda r: _decide(s, f, r)))

    def ranking(s: Column, f: Column) -> Column:
        scored = F.array(*[_score(i, s, f) for i in range(len(v.SPECIALISTS))])
        return F.sort_array(F.filter(scored, lambda x: x["minus"] < 0))

    return rows.withColumn("_route", rules.let(said, with_facts)).select(*rows.columns, "_route.*")


def approval_intent(rows: DataFrame, question: str = "question") -> DataFrame:
    """Gated actions that the text implies, when the specialist that may take them was chosen."""
    low = F.lower(question)
    names_it = F.contains(low, F.lit("work order")) | F.contains(low, F.lit("workorder")) | low.rlike(r"\b(wo|ticket|job)\b")
    hits = []
    for action, verbs in v.GATED_ACTIONS:
        said = F.contains(low, F.lit(action.replace("_", " "))) | F.contains(low, F.lit(action))
        implied = names_it & low.rlike(r"\b(" + "|".join(verbs) + ")")
        hits.append(F.when(said | implied, F.lit(action)))
    chosen = F.array_contains("specialists", v.GATED_SPECIALIST)
    none = F.array().cast("array<string>")
    return rows.withColumn("pendingApprovals", F.when(chosen, F.array_compact(F.array(*hits))).otherwise(none))
