"""The Merkle manifest, ranked search and chat formatting against brute force, on odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirflow.llm import chat, lexical, merkle

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, key string, at string, node string, total string, n bigint, `a.b` int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", None, "z", 1, 2) for r in rows], DOCS)


# --- manifest --------------------------------------------------------------------------------------------------------


def digest(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row) -> str:
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i: i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def plain_manifest(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: levels([leaf(r) for r in own[s]]) for s in sources}
    crown = levels([trees[s][-1][0] for s in sources])
    for place, s in enumerate(sources):
        for i, row in enumerate(own[s]):
            changed = list(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                changed[4] = re.sub("[A-Z]", lambda m: m[0].lower(), row[4])
            node, seen = leaf(changed), ""
            for tree, at in ((trees[s], i), (crown, place)):
                for level in tree[:-1]:
                    run, slot = level[at // 16 * 16: at // 16 * 16 + 16], at % 16
                    seen += "".join(run[:slot] + run[slot + 1:])
                    node, at = digest("".join([*run[:slot], node, *run[slot + 1:]])), at // 16
            yield (row[0], leaf(row), trees[s][-1][0], crown[-1][0], digest(seen), node, node == crown[-1][0])


ODD = [(1, None, "en", 3, "aBc"), (None, "a", None, None, None), (None, "a", None, None, None), (5, "a", "e", 1, "É" * 10), (6, "", "", 0, ""), (7, "é", "e", 1, "Z" * 3_000_000),
       *[(i, "b", "e", i, f"T{i}") for i in range(300)], *[(10, "b", "e", i % 2, "X") for i in range(40)], *[(i, f"s{i}", "e", i, "Q") for i in range(30)]]


def test_manifest(llm):
    got = [tuple(r) for r in merkle.digests(docs(llm, ODD)).collect()]
    assert sorted(got, key=repr) == sorted(plain_manifest(ODD), key=repr) and 0 < sum(r[-1] for r in got) < len(got)


def test_manifest_with_more_than_one_round_of_blocks(llm):
    rows = [(i, "a", "e", 1, f"T{i}") for i in range(4096 + 17)]
    got = [tuple(r) for r in merkle.digests(docs(llm, rows)).collect()]
    assert sorted(got, key=repr) == sorted(plain_manifest(rows), key=repr)
    rows = [(i, f"s{i}", "e", 1, f"T{i}") for i in range(4096 + 17)]
    got = [tuple(r) for r in merkle.digests(docs(llm, rows)).collect()]
    assert sorted(got, key=repr) == sorted(plain_manifest(rows), key=repr)


def test_manifest_proofs_and_empty_table(llm):
    rows = [(i, "ab"[i % 2], "e", 1, f"T{i}") for i in range(40)]
    got = merkle.manifest(docs(llm, rows), {"text": F.lit("other")}, F.col("doc_id") == 3, proofs=True).collect()
    assert all(digest("".join(r.proof)) == r.proof_sha256 for r in got) and [r.doc_id for r in got if not r.verified] == [3]
    assert merkle.digests(docs(llm, [])).collect() == [] and merkle.digests(docs(llm, rows[:1])).first().subroot == leaf(rows[0])


def test_folding_resumes_the_state_of_the_slot():
    nodes = [digest(str(i)).encode() for i in range(5)]
    slots, top = merkle.parent(nodes)
    assert top.decode() == digest("".join(x.decode() for x in nodes))
    for i, slot in enumerate(slots):
        assert slot.state.hexdigest() == hashlib.sha256(b"".join(nodes[:i])).hexdigest() and slot.fold(nodes[i]) == top
        assert slot.fold(b"x" * 64).decode() == hashlib.sha256(b"".join(nodes[:i] + [b"x" * 64] + nodes[i + 1:])).hexdigest()


# --- search ----------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in TERM.findall(text or "")]


def plain_search(rows, items, k):
    found = [(d, Counter(words(t))) for d, t in rows]
    found = [(d, c, sum(c.values())) for d, c in found if c]
    n_docs, n_terms = len(found), sum(n for _, _, n in found)
    df = Counter(w for _, c, _ in found for w in c)
    for item, text in items:
        scores = []
        for d, c, n in found:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in words(text) if w in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        yield from ((item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1))


def searched(llm, rows, items, k=20):
    items = llm.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    return sorted((tuple(r) for r in lexical.search(docs(llm, [(d, None, None, None, t) for d, t in rows]), items, k).collect()), key=repr)


def random_texts(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [" ".join(f"W{min(x, vocabulary)}" for x in rng.zipf(1.3, rng.integers(1, 120))) for _ in range(n)]


ODD_TEXTS = [(0, None), (1, ""), (2, "..."), (3, "É é Été ÀÉ naïve"), (4, "same same SAME"), (4, "same same SAME"), (4, "same"), (None, "same same SAME"),
             (5, "a_b-c 9x\x00y\x7fz"), (6, "long " * 300_000 + "tail"), (7, "q" * 2_500_000 + " same"), *[(100 + i, "tie tie") for i in range(50)]]
ODD_ITEMS = [(1, "same SAME tie tie"), (1, "tie"), (None, "été naïve é"), (2, None), (3, "..."), (4, "tail long absent"), (5, "b c y z 9x")]


def test_search_odd_rows(llm):
    assert searched(llm, ODD_TEXTS, ODD_ITEMS) == sorted(plain_search(ODD_TEXTS, ODD_ITEMS, 20), key=repr)
    assert searched(llm, [], ODD_ITEMS) == [] and searched(llm, ODD_TEXTS, []) == [] and searched(llm, ODD_TEXTS[:3], ODD_ITEMS) == []


def test_search_random_rows_in_several_passes(llm, monkeypatch):
    rows = list(enumerate(random_texts(1, 1500)))
    items = list(enumerate(random_texts(2, 12)))
    monkeypatch.setattr(lexical, "ITEMS", 5)
    assert searched(llm, rows, items, 7) == sorted(plain_search(rows, items, 7), key=repr)


def test_trees_prune_and_miss_nothing():
    rng = np.random.default_rng(3)
    vectors = [np.unique(np.minimum(rng.zipf(1.2, rng.integers(1, 60)), 300)).astype(np.int32) for _ in range(3000)]
    asked = rng.choice(np.arange(30, 300), 8, replace=False)
    vectors[::100] = [np.unique(np.concatenate([v, asked])).astype(np.int32) for v in vectors[::100]]
    tf = [rng.integers(1, 6, len(v)) for v in vectors]
    start = np.concatenate([[0], np.cumsum([len(v) for v in vectors])])
    tree = lexical.Tree(list(range(3000)), rng.integers(80, 200, 3000), start, np.concatenate(vectors), np.concatenate(tf))
    assert len(tree.bundles) > 20
    scores = np.zeros(3000, np.int64)
    weight = np.zeros(302, np.int64)
    weight[asked] = 1000
    for i in range(3000):
        own = slice(tree.start[i], tree.start[i + 1])
        scores[tree.ids[i]] = (weight[tree.term[own]] * tree.part[own]).sum()
    best, seen = lexical.Best(20), []
    few = tree.few
    tree.few = lambda s, b: seen.append(len(s)) or few(s, b)
    tree.search(weight, best)
    want = sorted((-int(s), i) for i, s in enumerate(scores) if s > 0)[:20]
    assert best.rows == want and sum(seen) < 3000


def test_search_reads_every_tree_of_a_task(llm):
    rows = [(i, "needle hay hay hay" if i % 50 == 0 else "hay") for i in range(lexical.DOCS)] + [(lexical.DOCS + i, "needle " * (i + 2)) for i in range(60)]
    items = llm.createDataFrame([(1, "needle"), (2, "hay needle")], "item_id bigint, text string")
    got = lexical.search(docs(llm, [(d, None, None, None, t) for d, t in rows]).coalesce(1), items, 20).collect()
    assert sorted(map(tuple, got)) == sorted(plain_search(rows, [(1, "needle"), (2, "hay needle")], 20))


# --- chat ------------------------------------------------------------------------------------------------------------

FRAGMENTS = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "</SYS>>", "role", "/role>", "=", ">", "\n", " ", "x", "é", "😀", "</s>\n", " [/INST]\n"]
TEXTS = st.lists(st.sampled_from(FRAGMENTS), max_size=12).map("".join)
ROLES = st.one_of(st.none(), st.sampled_from(["user", "assistant", "system", "tool", ""]), TEXTS)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(ROLES, TEXTS), max_size=6))
def test_templates_are_read_back(turns):
    rendered = [chat.render(*t) for t in turns]
    assert list(chat.parse("".join(x[0] for x in rendered))) == turns
    for (role, text), (out, start, end) in zip(turns, rendered):
        assert chat.unescape(out[start:end]) == (text if role == "assistant" else "")
        assert not any(c + rest in chat.escape(text) for c, rests in chat.CONTROL.items() for rest in rests)


CHAT = "conv_id bigint, turn bigint, role string, text string, message string, seq string, kind string"


def plain_chat(rows):
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or ""))
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        yield (conv, len(own), digest("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), len(said), digest(said), sum(len(chat.render(r[2], r[3] or "")[0]) for r in own))


def test_chat_odd_rows(llm):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 2, None, "x"), (None, 0, "user", "a"), (2, None, "user", "a"), (2, 1, "assistant", "é😀" * 5000),
            (2, 1, "assistant", "é😀" * 5000), (2, 1, "user", "tie"), (3, 5, "a>b\\", "</role>"), (-1, 0, "user", chat.HOSTILE), (4, 0, "assistant", "y" * 3_000_000),
            *[(9, i, "assistant" if i % 2 else "user", f"turn {i} [INST]\\") for i in range(3000)]]
    got = chat.digests(chat.events(llm.createDataFrame([(*r, "m", "s", "k") for r in rows], CHAT))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_chat(rows), key=repr)
    empty = chat.digests(chat.events(chat.with_hostile(llm.createDataFrame([], CHAT)))).collect()
    assert [tuple(r) for r in empty] == list(plain_chat([(-1, 0, "user", chat.HOSTILE), (-1, 1, "assistant", chat.HOSTILE)]))


LOG = "conv_id bigint, message int, seq bigint, kind string, role string, text string"


def test_events_are_folded_in_order(llm):
    log = [(1, 0, 0, "start", "user", "hi"), (1, 1, 5, "delta", None, "there"), (1, 1, 1, "start", "assistant", ""), (1, 1, 2, "delta", None, "bad"), (1, 1, 3, "regenerate", None, None),
           (1, 1, 4, "delta", None, "hello "), (1, 0, 9, "edit", None, "hi!"), (1, 0, 10, "delta", None, "?"), (1, 2, 1, "delta", None, "no start"), (1, 2, 2, "unknown", None, "x"),
           (1, None, 1, "start", "system", None), (1, 3, 1, None, None, "x"), (2, 0, 1, "start", "user", "a"), (2, 0, 2, "start", "assistant", "b")]
    out = chat.formatted(llm.createDataFrame(log, LOG)).collect()
    text = {c: "".join(r.formatted for r in out if r.conv_id == c) for c in (1, 2)}
    assert list(chat.parse(text[1])) == [("system", ""), ("user", "hi!?"), ("assistant", "hello there"), (None, "no start"), (None, "")]
    assert list(chat.parse(text[2])) == [("assistant", "b")]
    assert [r.formatted[r.loss_start: r.loss_end] for r in out if r.loss_end > r.loss_start] == ["hello there", "b"]


def test_the_given_turns_come_as_every_kind_of_event(llm):
    log = chat.events(llm.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"start", "delta", "edit", "regenerate"}
