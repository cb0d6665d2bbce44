"""Lines that many documents share, found with two Bloom filters.

1. Every task keeps two filters over the hashes of its lines: *once* holds all
   hashes it has met, *twice* those that it met in a second document.
2. The filters of all tasks meet segment by segment: what is in two once
   filters, or in a twice filter, is in the merged twice filter.  A bit is
   never lost on the way, so a line of two documents is always in it.
3. Only lines in the twice filter (suspected repeats, and a few others by
   accident) are shuffled, as 128-bit digests, and counted exactly: documents
   per line, and the first place if one is to stay.
4. The confirmed lines leave their documents.

The filters follow the number of lines up to ``MAX_BITS``; beyond that more
lines are suspected by accident, and the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausefold.llm.common import append_columns, binary, bound_batches, named, written

#: White space that a line's key is stripped of.
BLANK = b" \t\n\v\f\r"

#: Bits that a filter has for each line, and its bounds.
BITS_PER_LINE, MIN_BITS, MAX_BITS = 16, 1 << 16, 1 << 29

#: 64-bit words of a segment, in which filters travel.
SEGMENT = 1 << 12

#: Confirmed lines that are sent to all tasks; more are joined.
SENT_KEYS = 1 << 18


def lines_of(raw: bytes | None, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """A text's lines and their keys; None where a key is too short to count."""
    lines = (raw or b"").split(b"\n")
    keys = [x.strip(BLANK).lower() for x in lines]
    return lines, [k if len(k) >= min_chars and (min_chars < 2 or len(k.decode()) >= min_chars) else None for k in keys]


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def row_digest(own_id: object, raw: bytes | None) -> bytes:
    """Names a document; documents of equal id and text share a name."""
    h = hashlib.blake2b(repr(own_id).encode(), digest_size=16)
    h.update(b"\x00" if raw is None else b"\x01" + raw)
    return h.digest()


def places(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of a filter of ``words`` words that each hash falls on, and
    its two bits there."""
    one = np.uint64(1)
    at = (hashes >> np.uint64(32)) & np.uint64(words - 1)
    mask = (one << (hashes & np.uint64(63))) | (one << ((hashes >> np.uint64(6)) & np.uint64(63)))
    return at.astype(np.int64), mask


def held(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter may hold."""
    at, mask = places(hashes, len(words))
    return (words[at] & mask) == mask


def hashes_of(keys: list[bytes | None]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys if k is not None), dtype=np.uint64)


class Filters:
    """A task's pair of filters."""

    def __init__(self, words: int) -> None:
        self.once, self.twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)

    def add(self, hashes: np.ndarray) -> None:
        """Take in hashes, each once for each document that it is in."""
        distinct, n = np.unique(hashes, return_counts=True)
        at, mask = places(distinct, len(self.once))
        again = (n > 1) | ((self.once[at] & mask) == mask)
        np.bitwise_or.at(self.twice, at[again], mask[again])
        np.bitwise_or.at(self.once, at, mask)

    def segments(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """Segment, its words that are not zero, and both filters there."""
        full = np.flatnonzero(self.once)
        cuts = np.flatnonzero(np.diff(full // SEGMENT)) + 1
        for at in np.split(full, cuts) if len(full) else []:
            yield int(at[0] // SEGMENT), (at % SEGMENT).astype(np.uint16).tobytes(), self.once[at].tobytes(), self.twice[at].tobytes()


def _merged(rows: Iterator[tuple[int, bytes, bytes, bytes]]) -> Iterator[tuple[int, bytes, bytes]]:
    """The merged twice filter, from rows that are sorted by segment; one
    segment is held at a time."""
    own, pair = None, None

    def done() -> Iterator[tuple[int, bytes, bytes]]:
        if own is not None and pair[1].any():
            at = np.flatnonzero(pair[1])
            yield own, at.astype(np.uint16).tobytes(), pair[1][at].tobytes()

    for segment, at, once, twice in rows:
        if segment != own:
            yield from done()
            own, pair = segment, np.zeros((2, SEGMENT), np.uint64)
        at, once, twice = np.frombuffer(at, np.uint16), np.frombuffer(once, np.uint64), np.frombuffer(twice, np.uint64)
        pair[1][at] |= twice | (pair[0][at] & once)
        pair[0][at] |= once
    yield from done()


def _arrays(rows: Iterator[tuple], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    """Rows in batches of ``size``."""
    piece: list[tuple] = []
    for row in chain(rows, [None]):
        if row is not None:
            piece.append(row)
        if piece and (row is None or len(piece) == size):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*piece, strict=True), schema, strict=True)], schema=schema)
            piece = []


def filter_words(docs: DataFrame, text: str = "text") -> int:
    """Words of the filters: a power of two that follows the lines."""
    breaks = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    n = docs.agg(F.sum(breaks.cast("long"))).first()[0] or 0
    return min(MAX_BITS, max(MIN_BITS, 1 << (int(n) * BITS_PER_LINE - 1).bit_length() if n else 0)) // 64


def twice_seen(docs: DataFrame, min_chars: int, words: int, text: str = "text") -> np.ndarray:
    """The filter of lines that at least two documents may have."""
    bound_batches(docs.sparkSession)
    fields = [("segment", pa.int64()), ("at", pa.binary()), ("once", pa.binary()), ("twice", pa.binary())]
    built, folded = pa.schema(fields), pa.schema([*fields[:2], ("twice", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filters(words)
        for batch in batches:
            seen = [hashes_of(list(set(lines_of(raw, min_chars)[1]))) for raw in binary(batch.column(0))]
            if seen:
                own.add(np.concatenate(seen))
        yield from _arrays(own.segments(), built)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield from _arrays(_merged(rows), folded)

    parts = docs.select(text).mapInArrow(build, "segment long, at binary, once binary, twice binary")
    met = parts.repartition("segment").sortWithinPartitions("segment")
    out = np.zeros(words, np.uint64)
    # at most MAX_BITS, whatever the table
    for segment, at, twice in met.mapInArrow(fold, "segment long, at binary, twice binary").toLocalIterator():
        out[segment * SEGMENT + np.frombuffer(at, np.uint16).astype(np.int64)] = np.frombuffer(twice, np.uint64)
    return out


def suspects(docs: DataFrame, twice: np.ndarray, min_chars: int, order: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, own_id, key): each suspected line once for each document."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(twice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: tuple[list, list, list] = ([], [], [])
            for i, raw in enumerate(binary(batch.column(1))):
                keys = [k for k in set(lines_of(raw, min_chars)[1]) if k is not None]
                hits = np.flatnonzero(held(sent.value, hashes_of(keys))).tolist()
                if hits:
                    out[0].extend([row_digest(ids[i], raw)] * len(hits))
                    out[1].extend([i] * len(hits))
                    out[2].extend(digest(keys[k]) for k in hits)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), batch.column(0).take(pa.array(out[1], pa.int64())), pa.array(out[2], pa.binary())], names=["row", "own_id", "key"])

    rows = docs.select(F.col(order).alias("own_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("row", T.BinaryType()), rows.schema["own_id"], T.StructField("key", T.BinaryType())]))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", order: str = "doc_id",
                sent_keys: int = SENT_KEYS) -> DataFrame:
    """``docs`` without the lines that at least ``min_docs`` documents have.

    A text is split at ``\\n``; a line's key is the line without white space at
    both ends and with A-Z lower-cased.  Keys of at least ``min_chars`` code
    points in at least ``min_docs`` (two or more) documents lose all their
    lines; with ``keep="first"`` their first line in the document of smallest
    ``order`` stays (a null comes first; of equal ids the one of smaller
    digest).  ``text`` holds the other lines, joined by ``\\n``; ``n_lines``
    counts a text's lines and ``n_dropped`` those that went.

    Null and empty texts are one empty line, which never goes; a null text
    stays null.  Every row is a document, repeated rows too; rows of equal id
    and text count one by one and lose or keep the same lines.  An empty table
    stays empty.  Other columns stay; ``n_lines`` and ``n_dropped`` replace
    columns of the same name.
    """
    if min_docs < 2 or min_chars < 1 or keep not in ("none", "first"):
        raise ValueError("min_docs is at least 2, min_chars at least 1, keep is none or first")
    spark = docs.sparkSession
    twice = twice_seen(docs, min_chars, filter_words(docs))
    found = written(suspects(docs, twice, min_chars, order), "suspected-lines")
    counted = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("own_id", "row")).alias("first"))
    keeper: Column = F.col("first.row") if keep == "first" else F.lit(None).cast("binary")
    confirmed = written(counted.where(F.col("n") >= min_docs).select("key", keeper.alias("keeper")), "repeated-lines")
    new = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), docs.schema["text"]]

    def without(raw: bytes | None, own_id: object, keeper_of: dict[bytes, bytes | None], names: list[bytes | None]) -> tuple[int, int, str | None]:
        """``names`` are the digests of the text's lines, None for a line that
        can't go."""
        lines = (raw or b"").split(b"\n")
        me, stay, first = None, [], set()
        for line, name in zip(lines, names, strict=True):
            if name is not None and name in keeper_of:
                if keeper_of[name] is None or name in first:
                    continue
                me = me or row_digest(own_id, raw)
                if keeper_of[name] != me:
                    continue
                first.add(name)
            stay.append(line)
        return len(lines), len(lines) - len(stay), None if raw is None else b"\n".join(stay).decode()

    def columns(rows: list[tuple[int, int, str | None]]) -> list[pa.Array]:
        n, dropped, text = zip(*rows, strict=True) if rows else ((), (), ())
        return [pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(text, pa.string())]

    if confirmed.count() <= sent_keys:
        known = spark.sparkContext.broadcast({bytes(r["key"]): r["keeper"] and bytes(r["keeper"]) for r in confirmed.collect()})
        sent = spark.sparkContext.broadcast(twice)

        def drop(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
            for ids, texts in batches:
                own, rows = ids.to_pylist(), []
                for i, raw in enumerate(binary(texts)):
                    keys = lines_of(raw, min_chars)[1]
                    at = [k for k, key in enumerate(keys) if key is not None]
                    names: list[bytes | None] = [None] * len(keys)
                    for k in np.flatnonzero(held(sent.value, hashes_of(keys))).tolist():
                        names[at[k]] = digest(keys[at[k]])
                    rows.append(without(raw, own[i], known.value, names))
                yield columns(rows)

        return append_columns(docs, [order, "text"], new, drop).select(*_in_order(docs, new))

    def name_rows(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        for ids, texts in batches:
            yield [pa.array([row_digest(i, raw) for i, raw in zip(ids.to_pylist(), binary(texts), strict=True)], pa.binary())]

    def drop_joined(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        for ids, texts, gone in batches:
            own, rows = ids.to_pylist(), []
            for i, (raw, hits) in enumerate(zip(binary(texts), gone.to_pylist(), strict=True)):
                keeper_of = {h["key"]: h["keeper"] for h in hits or []}
                keys = lines_of(raw, min_chars)[1]
                rows.append(without(raw, own[i], keeper_of, [digest(k) if k is not None and keeper_of else None for k in keys]))
            yield columns(rows)

    gone = found.join(confirmed, "key").groupBy(F.col("row").alias("__row")).agg(F.collect_set(F.struct("key", "keeper")).alias("__gone"))
    named = append_columns(docs, [order, "text"], [T.StructField("__row", T.BinaryType())], name_rows)
    return append_columns(named.join(gone, "__row", "left"), [order, "text", "__gone"], new, drop_joined).select(*_in_order(docs, new))


def _in_order(docs: DataFrame, new: list[T.StructField]) -> list[Column]:
    """The columns of ``docs`` as they stood, then the new ones."""
    names = docs.columns + [f.name for f in new if f.name not in docs.columns]
    return [named(c) for c in names]


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the kept lines of each
    document, for lines of ten or more documents.  A null or empty text is one
    empty line, kept: the digest of nothing."""
    kept = dedup_lines(docs.select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
