"""URL filtering by pattern rules that are indexed by their rarest literal token.

Host rules (:class:`HostRule`) come first: the longest that fits a URL decides. Pattern rules decide the rest. A pattern rule is text in which ``*`` stands for
anything, ``^`` for a separator or the end, a leading ``||`` for the start of the host or of a label of it, and ``|`` at either end for that
end of the URL; everything else is literal. A run of letters and digits that a URL must hold as a whole token is a literal
token of the rule. How many URLs hold each token is counted over the whole table, and every rule is filed under its rarest token.
A URL's tokens fetch the rules filed under them, and only those run their regular expressions. Rules without a whole token are
tried on every URL. An allowing rule outranks blocking ones; no rule that fits means allow.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule and the verdict allow, unless a pattern fits its
text. Repeated rows each give a row, an empty table none; further columns are ignored. The rules are a parameter of at most
``MOST_RULES``, which bounds what is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import tables

MOST_RULES = 200_000
TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    verdict: str
    pattern: str

    def regex(self) -> str:
        """A regular expression for the lower-cased URL."""
        own = self.pattern.lower()
        start, end = "", ""
        if own.startswith("||"):
            start, own = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*[.@])?", own[2:]
        elif own.startswith("|"):
            start, own = "^", own[1:]
        if own.endswith("|"):
            end, own = "$", own[:-1]
        body = "".join(".*" if c == "*" else r"(?:[^a-z0-9_.%-]|$)" if c == "^" else "\\" + c if c in r".+?()[]{}|$\^" else c for c in own)
        return start + body + end

    def tokens(self) -> list[str]:
        """Runs that every fitting URL holds between other characters or at an end."""
        own = self.pattern.lower()
        fixed_start, fixed_end = own.startswith("|"), own.endswith("|")
        own = own.strip("|")
        found = []
        for m in TOKEN.finditer(own):
            left = own[m.start() - 1] != "*" if m.start() else fixed_start
            right = own[m.end()] != "*" if m.end() < len(own) else fixed_end
            if left and right:
                found.append(m[0])
        return found


HOST_RULES = (
    HostRule("allow", "org", "/"), HostRule("block", "example.org", "/es/"), HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"), HostRule("block", "com", "/de/"),
)
PATTERN_RULES = (
    PatternRule("block", "-pills."), PatternRule("block", ".casino-*.example."), PatternRule("block", "||ads.*^"),
    PatternRule("block", "/adserver/*"), PatternRule("block", "&click_id="), PatternRule("block", "/doubleclick^"),
    PatternRule("block", "||tracker.^"), PatternRule("block", ".exe|"), PatternRule("block", "/cheap-*-online/"),
    PatternRule("block", ".adult-*.example."), PatternRule("block", "free-casino"), PatternRule("allow", "||docs.example.net^"),
)


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return ascii_lower(host), rest[:end]


UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_lower(x: str) -> str:
    return x.translate(UPPER)


class HostIndex:
    """Host rules by host; a URL asks for each of its host's suffixes."""

    def __init__(self, rules: tuple[HostRule, ...]) -> None:
        self.by_host: dict[str, list[HostRule]] = {}
        for rule in sorted(rules, key=lambda r: (-len(r.path), r.path)):
            self.by_host.setdefault(rule.host, []).append(rule)

    def find(self, host: str, path: str) -> HostRule | None:
        best, at = None, 0
        while at >= 0 and host:
            for rule in self.by_host.get(host[at:], ()):
                if path.startswith(rule.path) and (best is None or len(rule.name) > len(best.name)):
                    best = rule
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        return best


class PatternIndex:
    """Pattern rules by their rarest token."""

    def __init__(self, rules: tuple[PatternRule, ...], seen: dict[str, int]) -> None:
        self.by_token: dict[str, list[tuple[re.Pattern, PatternRule]]] = {}
        self.always: list[tuple[re.Pattern, PatternRule]] = []
        for rule in rules:
            compiled = re.compile(rule.regex(), re.DOTALL), rule
            tokens = rule.tokens()
            if tokens:
                self.by_token.setdefault(min(tokens, key=lambda t: (seen.get(t, 0), -len(t), t)), []).append(compiled)
            else:
                self.always.append(compiled)

    def find(self, url: str) -> PatternRule | None:
        own, best = ascii_lower(url), None
        tried = list(self.always)
        for token in dict.fromkeys(TOKEN.findall(own)):
            tried += self.by_token.get(token, ())
        for pattern, rule in tried:
            if (best is None or (best.verdict == "block" and rule.verdict == "allow")) and pattern.search(own):
                best = rule
                if rule.verdict == "allow":
                    break
        return best


def token_counts(pages: DataFrame, rules: tuple[PatternRule, ...]) -> dict[str, int]:
    """For the tokens of the rules, how many URLs hold them."""
    wanted = sorted({t for r in rules for t in r.tokens()})
    if not wanted:
        return {}
    lowered = F.translate(F.col("url"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), 0))).alias("token"))
    return {r[0]: r[1] for r in tokens.where(F.col("token").isin(wanted)).groupBy("token").count().collect()}


def judged(pages: DataFrame, host_rules: tuple[HostRule, ...] = HOST_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern (the pattern rule that decided, else null) of every row."""
    if len(host_rules) + len(pattern_rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    shared = pages.sparkSession.sparkContext.broadcast((host_rules, pattern_rules, token_counts(pages, pattern_rules)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts, patterns, seen = shared.value
        by_host, by_token = HostIndex(hosts), PatternIndex(patterns, seen)
        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = parts(url)
                rule = by_host.find(host, path)
                pattern = by_token.find(url) if rule is None and url else None
                verdict = (rule or pattern).verdict if rule or pattern else "allow"
                out.append((host, path, rule and rule.name, verdict, pattern and pattern.pattern))
            columns = [pa.array(x, pa.string()) for x in zip(*out)] if out else [pa.array([], pa.string())] * 5
            yield pa.record_batch([batch.column(0), *columns], names=["page_id", "host", "path", "rule", "verdict", "pattern"])

    schema = "page_id bigint, host string, path string, rule string, verdict string, pattern string"
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, schema)


def oracle(host_rules: tuple[HostRule, ...] = HOST_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES) -> str:
    """The same without an index: every rule on every URL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    lowered = "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = lambda r: f"(host = {quote(r.host)} OR ends_with(host, {quote('.' + r.host)})) AND starts_with(path, {quote(r.path)})"
    by_length = sorted(host_rules, key=lambda r: (-len(r.name), r.name))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN {quote(r.name)}" for r in by_length) + " END"
    told = "CASE rule " + " ".join(f"WHEN {quote(r.name)} THEN {quote(r.verdict)}" for r in by_length) + " END"
    hit = lambda r: f"regexp_matches(lowered, {quote(r.regex())}, 's')"
    ranked = [r for r in pattern_rules if r.verdict == "allow"] + [r for r in pattern_rules if r.verdict != "allow"]
    pattern = "CASE WHEN rule IS NOT NULL OR url IS NULL THEN NULL " + " ".join(f"WHEN {hit(r)} THEN {quote(r.verdict)}" for r in ranked) + " END"
    return f"""
WITH cut AS (SELECT page_id, url, {lowered} AS lowered,
                    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, url, lowered, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
named AS (SELECT page_id, url, lowered, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
ruled AS (SELECT *, {rule} AS rule FROM named)
SELECT page_id, host, path, rule, coalesce({told}, {pattern}, 'allow') AS verdict FROM ruled"""
