"""Benchmark decontamination with an FM-index per training shard.

A shard is a batch of documents inside one task.  Its words become integers,
one symbol for each word of the benchmark; a word that no benchmark item holds
can be part of no occurrence, so any run of such words is one separator, and
runs of benchmark words shorter than the shortest phrase are left out.  Over
that sequence the shard builds

* the suffix array by prefix doubling (kept only while the index is built),
* the Burrows-Wheeler transform as a wavelet matrix, whose rank tables answer
  "how often does symbol c stand before row i" in one step a bit,
* the suffix positions of every ``SAMPLE``-th text position.

All phrases are searched backwards at once, one symbol a step; occurrences are
located by walking back to a sampled position, and merged into the removal
spans of their documents.  Documents never leave their task: there is no
shuffle, and memory follows the shard, not the table.

The phrases travel to the tasks in blocks of bounded size, one pass over the
documents for each block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausefold.llm.common import WORD_BYTES, append_columns, binary, named, written

#: Words of a phrase.
WINDOW = 10
#: Every so many text positions one suffix position is kept.
SAMPLE = 16
#: UTF-8 bytes of text that a shard holds, but for a single longer document.
SHARD_BYTES = 4 << 20
#: UTF-8 bytes of benchmark text in a block of phrases.
BLOCK_BYTES = 4 << 20
#: Blocks that are searched in one go.
PASSES = 4

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


@dataclass
class Phrases:
    """A block of phrases: ``vocabulary`` maps words to symbols from 2 up,
    ``windows`` are the distinct phrases by length, as symbol matrices with the
    numbers of their items, and ``names`` has the items' ids as text."""

    vocabulary: dict[bytes, int]
    windows: list[tuple[np.ndarray, list[np.ndarray]]]
    names: list[str]
    shortest: int


def phrases_of(items: list[tuple[str, bytes]], window: int = WINDOW) -> Phrases | None:
    """Every run of ``window`` words of an item; an item of fewer words, but
    not none, is one phrase.  None if there is no phrase."""
    vocabulary: dict[bytes, int] = {}
    found: dict[int, dict[tuple[int, ...], set[int]]] = {}
    for number, (_, text) in enumerate(items):
        words = [vocabulary.setdefault(w, len(vocabulary) + 2) for w in text.translate(WORD_BYTES).split()]
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            found.setdefault(size, {}).setdefault(tuple(words[k : k + size]), set()).add(number)
    if not found:
        return None
    windows = [(np.array(list(by), dtype=np.int32), [np.array(sorted(x)) for x in by.values()]) for _, by in sorted(found.items())]
    return Phrases(vocabulary, windows, [name for name, _ in items], min(found))


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order; the last symbol must be the only
    smallest one.  Prefix doubling, on the suffixes not yet told apart."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    heads = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, dtype=np.int64)
    # a group's rank is the place of its first member, so it stays valid
    # while other groups are still being split
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    length = 1
    while True:
        alone = heads & np.append(heads[1:], True)
        places = np.flatnonzero(~alone)
        if not len(places):
            return order
        at = order[places]
        behind = at + length
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        inner = np.argsort(key, kind="stable")
        at, key = at[inner], key[inner]
        order[places] = at
        first = np.concatenate([[True], key[1:] != key[:-1]])
        heads[places] = first
        rank[at] = np.maximum.accumulate(np.where(first, places, 0))
        length *= 2


class FMIndex:
    """Backward search and location over a sequence of symbols, of which 0 is
    used for nothing but the end."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        text = np.append(symbols.astype(np.int64), 0)
        order = suffix_array(text)
        self.n = len(text)
        bwt = text[order - 1]
        self.bits = max(1, int(text.max()).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.bits))])
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        # wavelet matrix: level by level from the highest bit, zeros first
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(self.n - self.ones[-1][-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        sampled = order % sample == 0
        self.marks = np.concatenate([[0], np.cumsum(sampled, dtype=np.int32)]).astype(np.int32)
        self.positions = order[sampled].astype(np.int32)

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before its row."""
        low, high = np.zeros_like(row), row
        for b, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            one = (symbol >> b) & 1 == 1
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low

    def symbol(self, row: np.ndarray) -> np.ndarray:
        """The symbol of the transform at each row."""
        out = np.zeros_like(row)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[row + 1] - ones[row]
            out = out * 2 + bit
            row = np.where(bit == 1, zeros + ones[row], row - ones[row])
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern (a row) the range of suffixes that begin with it;
        an empty range if there is none."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.n, dtype=np.int64)
        alive = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, k].astype(np.int64)
            known = c < 1 << self.bits
            high[alive[~known]] = low[alive[~known]]
            alive, c = alive[known], c[known]
            low[alive] = self.before[c] + self.rank(c, low[alive])
            high[alive] = self.before[c] + self.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of suffixes, by steps back to a sampled one."""
        out = np.empty(len(rows), dtype=np.int64)
        todo, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            hit = self.marks[at + 1] > self.marks[at]
            out[todo[hit]] = self.positions[self.marks[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            c = self.symbol(at)
            at = self.before[c] + self.rank(c, at)
            steps += 1
        return out


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of all ranges, and the range that each is from."""
    count = high - low
    owner = np.repeat(np.arange(len(low)), count)
    first = np.cumsum(count) - count
    return low[owner] + np.arange(len(owner)) - first[owner], owner


def find_in_shard(texts: list[bytes], phrases: Phrases) -> tuple[np.ndarray, list[np.ndarray], list[set[int]]]:
    """For a shard's documents: their numbers of words, merged spans of hit
    words (begin, end) and the numbers of the items found."""
    get = phrases.vocabulary.get
    n_words = np.zeros(len(texts), dtype=np.int64)
    kept, docs, words = [], [], []
    for d, text in enumerate(texts):
        own = text.translate(WORD_BYTES).split()
        n_words[d] = len(own)
        symbols = np.fromiter((get(w, 1) for w in own), dtype=np.int32, count=len(own))
        known = np.concatenate([[0], (symbols > 1).astype(np.int8), [0]])
        change = np.diff(known)
        begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        long = end - begin >= phrases.shortest
        begin, end = begin[long], end[long]
        if not len(begin):
            continue
        # each run and the separator behind it
        at, run = _expand(begin, end + 1)
        value = np.ones(len(at), dtype=np.int32)
        inside = at < end[run]
        value[inside] = symbols[at[inside]]
        kept.append(value)
        docs.append(np.full(len(at), d, dtype=np.int32))
        words.append(at)
    spans = [np.zeros((0, 2), dtype=np.int64) for _ in texts]
    items: list[set[int]] = [set() for _ in texts]
    if not kept:
        return n_words, spans, items
    symbols, doc, word = np.concatenate(kept), np.concatenate(docs), np.concatenate(words)
    index = FMIndex(symbols)
    cover = np.zeros(len(symbols) + 1, dtype=np.int64)
    for patterns, owners in phrases.windows:
        low, high = index.search(patterns)
        some = np.flatnonzero(high > low)
        rows, owner = _expand(low[some], high[some])
        place = index.locate(rows)
        cover += np.bincount(place, minlength=len(cover)) - np.bincount(place + patterns.shape[1], minlength=len(cover))
        which = some[owner]
        for d, w in np.unique(np.stack([doc[place].astype(np.int64), which]), axis=1).T if len(place) else ():
            items[d].update(owners[w].tolist())
    hit = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
    if len(hit):
        # hits are in the order of documents and words; a break of either ends a span
        cut = np.flatnonzero((np.diff(doc[hit]) != 0) | (np.diff(word[hit]) != 1))
        first, last = hit[np.append(0, cut + 1)], hit[np.append(cut, len(hit) - 1)]
        own = doc[first]
        for d in np.unique(own):
            spans[d] = np.stack([word[first[own == d]], word[last[own == d]] + 1], axis=1)
    return n_words, spans, items


def merge_spans(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The union of two sets of spans, touching ones joined."""
    both = np.concatenate([a, b])
    both = both[np.argsort(both[:, 0], kind="stable")]
    if len(both) < 2:
        return both
    reach = np.maximum.accumulate(both[:, 1])
    new = np.append(True, both[1:, 0] > reach[:-1])
    return np.stack([both[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(both) - 1)]], axis=1)


def without_spans(text: bytes, spans: np.ndarray) -> bytes:
    """``text`` without the words of ``spans``: from the first to the last
    word of each, with all between."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for begin, end in spans:
        out.append(text[at : places[begin][0]])
        at = places[end - 1][1]
    return b"".join([*out, text[at:]])


def _shards(batches: Iterator[list[pa.Array]]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch in shards of bounded size; with how many are left."""
    for columns in batches:
        texts = [t or b"" for t in binary(columns[0])]
        start = 0
        while start < len(texts):
            stop, held = start, 0
            while stop < len(texts) and (stop == start or held + len(texts[stop]) <= SHARD_BYTES):
                held += len(texts[stop])
                stop += 1
            yield len(texts) - stop, texts[start:stop]
            start = stop


SPAN = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(SPAN)),
    T.StructField("items", T.ArrayType(T.StringType())),
]
_ARROW_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _search_pass(docs: DataFrame, phrases: Phrases | None, names: list[str], first: bool) -> DataFrame:
    """Add what one block of phrases finds to the columns ``names``."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(phrases) if phrases else None)
    n_name, s_name, i_name = names
    fields = [T.StructField(n, f.dataType) for n, f in zip(names, FOUND, strict=True)]

    def work(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        block = Phrases(**sent.value) if sent.value else None
        earlier: list[list[pa.Array]] = []

        def feed() -> Iterator[list[pa.Array]]:
            for columns in batches:
                earlier.append(columns)
                yield columns

        done: tuple[list, list, list] = ([], [], [])
        for left, texts in _shards(feed()):
            if block is None:
                found = np.array([len(t.translate(WORD_BYTES).split()) for t in texts], dtype=np.int64), [np.zeros((0, 2), np.int64)] * len(texts), [set()] * len(texts)
            else:
                found = find_in_shard(texts, block)
            done[0].extend(found[0].tolist())
            done[1].extend(found[1])
            done[2].extend([block.names[k] for k in x] if x else [] for x in found[2])
            if left:
                continue
            columns = earlier.pop(0)
            spans, items = list(done[1]), list(done[2])
            if not first:
                old_spans, old_items = columns[1].to_pylist(), columns[2].to_pylist()
                spans = [merge_spans(np.array([(s["begin"], s["end"]) for s in o], dtype=np.int64).reshape(-1, 2), s) for o, s in zip(old_spans, spans, strict=True)]
                items = [[*o, *x] for o, x in zip(old_items, items, strict=True)]
            yield [
                pa.array(done[0], pa.int64()),
                pa.array([[{"begin": int(a), "end": int(b)} for a, b in s] for s in spans], _ARROW_SPANS),
                pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
            ]
            done = ([], [], [])

    return append_columns(docs, ["text"] if first else ["text", s_name, i_name], fields, work)


def find_contamination(docs: DataFrame, benchmark: DataFrame, names: tuple[str, str, str] = ("n_words", "spans", "items")) -> DataFrame:
    """All rows and columns of ``docs`` with ``n_words``, ``spans`` (merged,
    in words, end exclusive) and ``items`` (ids of the benchmark items with an
    occurring phrase, as text, sorted, each once).

    Null texts and empty texts have no words; items without words have no
    phrase; an item without an id is named by the empty string; equal items
    all count; repeated documents are found one by one.  Without a benchmark
    nothing is hit.  The new names replace columns of the same name.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    held = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = 1 + int(held) // BLOCK_BYTES
    out = docs
    for k in range(blocks):
        # blocks are dealt by hash, so each is near BLOCK_BYTES at any size
        own = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k).collect()
        phrases = phrases_of([(r["name"], r["text"].encode()) for r in own])
        out = _search_pass(out, phrases, list(names), k == 0)
        if (k + 1) % PASSES == 0 and k + 1 < blocks:
            # each pass has a worker of its own in every task: a large
            # benchmark's passes run a few at a time
            out = written(out, "contamination")
    return out


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; ``n_items``
    counts distinct ids, so items that share one (or have none) count once."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    rows = found.select("doc_id", "n_words", hit.alias("n_hit"), "items")
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the removal spans: from each span's first to its last
    word the text is cut out.  Clean documents, null texts included, stay as
    they are; a document of nothing but spans keeps an empty or blank text.
    ``n_chars``, if there is such a column, follows a cut text."""
    names = ("__n_words", "__spans", "__items")
    found = find_contamination(docs, benchmark, names)

    def cut(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        for text, spans in batches:
            out = text.to_pylist()
            raw = None
            for i, own in enumerate(spans.to_pylist()):
                if own:
                    raw = raw or binary(text)
                    out[i] = without_spans(raw[i], np.array([(s["begin"], s["end"]) for s in own])).decode()
            yield [pa.array(out, pa.string())]

    done = append_columns(found, ["text", "__spans"], [T.StructField("__text", T.StringType())], cut)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("__text").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.size("__spans") > 0, F.length("__text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            columns.append(named(c))
    return done.select(*columns)


def item_hash(names: list[str]) -> str:
    """The digest of a list of item ids, as the query gives it."""
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
