"""BPE encoding and decoding with a lexicon of frequent words as a minimal acyclic automaton.

The vocabulary, merges, normalisation and word pattern come from a public tokenizer file (lower case, end-of-word suffix).
The corpus' most frequent words, counted over all documents, are encoded once; a minimal acyclic automaton over their
bytes (suffixes shared, built from the sorted words after Daciuk et al., 2000) gives each word its number by the sums of
the words under its edges, and the number gives its ids. The automaton is a few flat arrays in one file, which every
Python worker maps into memory. Words that it doesn't know are merged exactly, lowest rank first. Words are bounded by the pattern, so a document is the ids of its words in turn.

Defined results: null and empty texts have no ids and decode to the empty text. The tokenizer's special tokens in a text become
their ids, as its library does. Very long texts and words are handled whole (long words merge over a heap). Repeated rows each give a row;
further columns are ignored. Decoding joins token texts by one space where the file names no decoder.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import struct
import sys
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm import tables

#: Words of the lexicon at most: those with the highest counts in the corpus.
LEXICON = 1 << 18
#: Distinct words that a task counts before it sends them on, and beyond the lexicon's that a worker remembers the ids of.
REMEMBERED = 200_000
#: Bytes of the longest word that the lexicon takes; longer ones are merged whenever they occur.
WORD_BYTES = 64
FILE = "word_bpe_49k.json"
#: Below this, all letters have long been settled.
HIGH = re.compile("[\u0530-\U0010ffff]")


@cache
def unlike() -> frozenset[str]:
    """Characters that the tokenizer library normalises otherwise than Python does, alone or beside combining marks of low, middle and high classes."""
    nfc = tokenizers.normalizers.NFC().normalize_str
    marks = "\u0334\u0316\u0301"
    own = (chr(i) for i in range(0x300, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)
    composed = (c for c in own if unicodedata.combining(c) or unicodedata.decomposition(c))
    return frozenset(c for c in composed for m in ("", *marks) for t in (f"a{c}{m}", f"a{m}{c}") if nfc(t) != unicodedata.normalize("NFC", t))


def is_latin1(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def latin1_pattern(pattern: str) -> re.Pattern | None:
    """The word pattern for texts within Latin 1, its classes spelled out; None if it has others than letters, numbers and white space."""
    chars = [chr(i) for i in range(256)]
    classes = {
        r"\p{L}": [c for c in chars if unicodedata.category(c)[0] == "L"],
        r"\p{N}": [c for c in chars if unicodedata.category(c)[0] == "N"],
        r"\p{White_Space}": [c for c in chars if regex.match(r"\p{White_Space}", c)],
    }
    for name, own in classes.items():
        pattern = pattern.replace(name, "".join(map(re.escape, own)))
    return None if r"\p" in pattern.lower() else re.compile(pattern)


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Tokenizer:
    """What a tokenizer file says, as far as words and merges need it."""

    def __init__(self, text: str) -> None:
        told = json.loads(text)
        model = told["model"]
        kinds = [n["type"] for n in told["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or told["decoder"] is not None or model["dropout"]:
            raise ValueError("only tokenizers with NFC, white space, lower case, BPE and no decoder are known")
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.letters, self.unlike = byte_letters(), unlike()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): (i, self.vocab[a + b]) for i, (a, b) in enumerate(pairs)}
        self.first = [self.vocab[c] for c in self.letters]
        self.last = [self.vocab[c + self.suffix] for c in self.letters]
        self.tokens = {i: t for t, i in self.vocab.items()} | {x["id"]: x["content"] for x in told["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.at_special = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)))
        pattern = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # the file's library takes white space as Unicode does; U+001C to U+001F are not white space there
        pattern = pattern.replace(r"\s", r"\p{White_Space}")
        self.words, self.latin1_words = regex.compile(pattern, regex.V0), latin1_pattern(pattern)
        self.library = tokenizers.Tokenizer.from_str(text)
        self.bytes = {c: b for b, c in enumerate(self.letters)}

    def pieces(self, text: str) -> Iterator[tuple[str, int]]:
        """Parts of a text between special tokens, and the special token after each (-1: none)."""
        at = 0
        if "<|" in text:
            for m in self.at_special.finditer(text):
                yield text[at: m.start()], self.special[m[0]]
                at = m.end()
        yield text[at:], -1

    def split(self, text: str) -> list[str]:
        """Words of a part without special tokens."""
        if self.latin1_words is not None and is_latin1(text):  # composed already, and lower case stays within Latin 1
            return self.latin1_words.findall(text.lower())
        if HIGH.search(text) and any(c in self.unlike or unicodedata.category(c) == "Cn" for c in set(text)):
            # code points of which the library's Unicode tables say something else than Python's: the library decides where words end
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(self.bytes[c] for c in word).decode() for word, _ in found]
        # lower case letter by letter, as the file's library does: a final sigma is no exception
        return self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: merge the pair of lowest rank, the leftmost of these, until no pair has a rank."""
        ids = [self.first[b] for b in word[:-1]] + [self.last[word[-1]]]
        if len(ids) > 40:
            return self.merge_long(ids)
        ranks = self.ranks
        while len(ids) > 1:
            best, at, new = 1 << 60, -1, 0
            for i in range(len(ids) - 1):
                found = ranks.get((ids[i], ids[i + 1]))
                if found is not None and found[0] < best:
                    best, new = found
                    at = i
            if at < 0:
                break
            ids[at: at + 2] = [new]
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same over a heap of pairs and a linked list."""
        n, ranks = len(ids), self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (found := ranks.get((ids[i], ids[after[i]]))) is not None:
                heapq.heappush(heap, (found[0], i, ids[i], ids[after[i]], found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = after[i]
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids)


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """Words with their ids as one file: a header of five counts, then the arrays of :class:`Lexicon`."""
    # states are tuples of (byte, target) with a mark for words that end there; equal ones are stored once
    registry: dict[tuple, int] = {}
    states: list[tuple] = []

    def register(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in registry:
            registry[key] = len(states)
            states.append(key)
        return registry[key]

    path: list[list] = [[False, []]]  # nodes of the word last added; each is [ends, edges that are complete]
    previous = b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            node = path.pop()
            path[-1][1].append((previous[len(path) - 1], register(node)))

    ordered = sorted(words)
    for word in ordered:
        common = 0
        while common < min(len(word), len(previous)) and word[common] == previous[common]:
            common += 1
        close(common)
        previous = word
        path.extend([False, []] for _ in range(len(word) - common))
        path[-1][0] = True
    close(0)
    root = register(path[0])

    under = np.zeros(len(states), np.uint32)  # words below a state; targets are registered before their sources
    first = np.zeros(len(states) + 1, np.uint32)
    labels, targets, skips = bytearray(), [], []
    for s, (ends, edges) in enumerate(states):
        total = int(ends)
        for byte, target in edges:
            labels.append(byte)
            targets.append(target)
            skips.append(total)
            total += int(under[target])
        under[s] = total
        first[s + 1] = len(labels)
    ends = np.fromiter((s[0] for s in states), np.uint8, len(states))
    ids = np.fromiter((i for w in ordered for i in words[w]), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(words[w]) for w in ordered])]).astype(np.uint32)
    arrays = [first, np.array(targets, np.uint32), np.array(skips, np.uint32), starts, ids, ends]
    head = struct.pack("<5Q", len(states), len(labels), len(ordered), len(ids), root)
    return head + b"".join(a.tobytes() for a in arrays) + bytes(labels)


class Lexicon:
    """A compiled lexicon, mapped into memory from a file that has no name any more."""

    def __init__(self, data: bytes) -> None:
        with tempfile.TemporaryFile() as file:
            file.write(data)
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        n_states, n_edges, n_words, n_ids, self.root = struct.unpack_from("<5Q", self.map)
        at = 40

        def array(n: int, kind: type = np.uint32) -> memoryview:
            nonlocal at
            own = np.frombuffer(self.map, kind, n, at)
            at += own.nbytes
            return memoryview(own)

        self.first, self.targets, self.skips = array(n_states + 1), array(n_edges), array(n_edges)
        self.starts, self.ids, self.ends = array(n_words + 1), array(n_ids), array(n_states, np.uint8)
        self.labels = at

    def find(self, word: bytes) -> list[int] | None:
        state, number, find, base = self.root, 0, self.map.find, self.labels
        first, targets, skips = self.first, self.targets, self.skips
        for i in range(len(word)):
            edge = find(word[i: i + 1], base + first[state], base + first[state + 1]) - base
            if edge < 0:
                return None
            number += skips[edge]
            state = targets[edge]
        return self.ids[self.starts[number]: self.starts[number + 1]].tolist() if self.ends[state] else None


class Words(dict):
    """Words to (number of ids, ids as text, token texts): those of the lexicon once they were looked up, others of late."""

    def __init__(self, tokenizer: Tokenizer, lexicon: Lexicon) -> None:
        super().__init__()
        self.tokenizer, self.lexicon = tokenizer, lexicon
        self.others: dict[str, tuple[int, str, str]] = {}

    def __missing__(self, word: str) -> tuple[int, str, str]:
        found = self.others.get(word)
        if found is not None:
            return found
        own = word.encode()
        known = self.lexicon.find(own) if len(own) <= WORD_BYTES else None
        ids = self.tokenizer.merge(own) if known is None else known
        found = len(ids), " ".join(map(str, ids)), self.tokenizer.decode(ids)
        if known is not None:
            self[word] = found  # no more than the lexicon has
        elif len(own) <= WORD_BYTES:
            if len(self.others) >= REMEMBERED:
                self.others.clear()
            self.others[word] = found
        return found

    def document(self, text: str) -> tuple[int, list[str], list[str]]:
        n, ids, tokens = 0, [], []
        for part, special in self.tokenizer.pieces(text):
            words = self.tokenizer.split(part)
            if words:
                ns, a, b = zip(*map(self.__getitem__, words))
                n += sum(ns)
                ids += a
                tokens += b
            if special >= 0:
                n += 1
                ids.append(str(special))
                tokens.append(self.tokenizer.tokens[special])
        return n, ids, tokens


def count_words(told: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, seen = Tokenizer(told), Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part, _ in tokenizer.pieces(text):
                    seen.update(tokenizer.split(part))
                if len(seen) > REMEMBERED:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return run


def frequent(docs: DataFrame, told: str, size: int = LEXICON) -> list[str]:
    """The words with the highest counts over all texts, at most ``size``: those above the lowest cut on a scale of sixteenths of a
    doubling that leaves no more. No task or driver sees more than that many words for it."""
    counted = docs.select(tables.whole("text").alias("t")).mapInArrow(count_words(told), "word string, n bigint")
    short = counted.where(F.octet_length("word") <= WORD_BYTES)
    again = tables.keep(short.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").withColumn("level", F.floor(F.log2("n") * 16).cast("int")), "bpe-words")
    total, cut = 0, None
    for level, n in sorted(again.groupBy("level").count().collect(), reverse=True):
        total += n
        if total > size:
            break
        cut = level
    return [] if cut is None else [r[0] for r in again.where(F.col("level") >= cut).select("word").collect()]


def lexicon(docs: DataFrame, told: str, size: int = LEXICON) -> bytes:
    tokenizer = Tokenizer(told)
    return compile_lexicon({w: tokenizer.merge(w) for w in (x.encode() for x in frequent(docs, told, size))})


#: The last lexicon that this worker used.
_mapped: list[tuple[bytes, Words]] = []


def words_of(told: str, data: bytes) -> Words:
    key = hashlib.sha256(data).digest()
    if not _mapped or _mapped[0][0] != key:
        _mapped[:] = [(key, Words(Tokenizer(told), Lexicon(data)))]
    return _mapped[0][1]


def tokenizer_file(spark: SparkSession, path: str | None = None) -> str:
    with open(path or public_tokenizers.path(FILE), encoding="utf-8") as file:
        return file.read()


def encoded(docs: DataFrame, path: str | None = None, size: int = LEXICON, digests: bool = True) -> DataFrame:
    """The columns of ``docs`` but the text, with n_tokens and either the digests of ids and decoded text or the ids as an array.

    ``path`` is that of the tokenizer file, as the driver sees it. The lexicon (``size`` words of at most ``WORD_BYTES`` bytes)
    and the file are broadcast; both are bounded.
    """
    spark = docs.sparkSession
    told = tokenizer_file(spark, path)
    shared = spark.sparkContext.broadcast((told, lexicon(docs, told, size)))
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]
    names = [c for c in docs.columns if c != "text"]
    rows = docs.select(tables.whole(docs["text"]).alias("t"), *others)
    new = [("n_tokens", "bigint"), *((("ids_sha256", "string"), ("decoded_sha256", "string")) if digests else (("ids", "array<int>"),))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(*shared.value)
        for batch in batches:
            ns, a, b = [], [], []
            for text in batch.column(0).to_pylist():
                n, ids, tokens = words.document(text)
                ns.append(n)
                if digests:
                    a.append(hashlib.sha256(" ".join(ids).encode()).hexdigest())
                    b.append(hashlib.sha256(" ".join(tokens).encode()).hexdigest())
                else:
                    a.append(np.array(" ".join(ids).split(), np.int32))
            made = [pa.array(ns, pa.int64()), *((pa.array(a, pa.string()), pa.array(b, pa.string())) if digests else (pa.array(a, pa.list_(pa.int32())),))]
            yield pa.record_batch([*batch.columns[1:], *made], names=[*batch.schema.names[1:], *(x for x, _ in new)])

    schema = T.StructType([*rows.schema.fields[1:], *T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in new)).fields])
    out = rows.mapInArrow(run, schema)
    own = [n for n, _ in new]
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c != "text" and c not in own], *own)


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) to (doc_id, text): token texts joined by one space; null ids count as none."""
    shared = rows.sparkSession.sparkContext.broadcast(tokenizer_file(rows.sparkSession, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(shared.value)
        for batch in batches:
            texts = [tokenizer.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")
