"""Language identification with a bidirectional gated recurrent network over
bytes.

Two gated recurrent layers read a window of bytes, one in each direction; at
every position their two states give a probability for each language, and the
mean over a document's positions is its prediction.  Gates use the piecewise
linear forms of sigmoid and tanh.  The network is trained in numpy by
backpropagation through time (Adam on the cross-entropy of all positions), on
a bounded sample: ``SAMPLE_DOCS`` documents of each language, ``SAMPLE_WINDOWS``
windows of each.  Prediction reads whole texts, window after window, in one
narrow pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausefold.llm.common import append_columns, binary, named, uniform

#: Bytes of a window, units of a layer.
LENGTH, UNITS = 128, 8
#: Bounds of the training sample: documents of each language, windows of a
#: document.  Every language is learned.
SAMPLE_DOCS, SAMPLE_WINDOWS = 400, 6
#: Steps and windows of a step; with more than ``MANY`` languages both grow.
STEPS, BATCH, RATE = 200, 192, 0.012
MANY = 16
#: Windows that are read at once, and probabilities of each of their positions
#: that are held at once.
LANES, HELD = 1024, 1 << 16
UNKNOWN = "und"
#: The symbol behind a window's last byte.
PAD = 256

#: Upper case is read as lower case.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)] + [PAD], dtype=np.int64)


@dataclass
class Network:
    """For each direction a table of byte inputs (257 x 3H: update, reset,
    new), recurrent weights (H x 3H), and the output layer (2H x C, C)."""

    languages: list[str]
    inputs: np.ndarray
    recurrent: np.ndarray
    output: np.ndarray
    bias: np.ndarray


def _new_network(languages: list[str], units: int, rng: np.random.Generator) -> Network:
    scale = 1 / np.sqrt(units)
    return Network(
        languages, rng.normal(0, 0.5, (2, PAD + 1, 3 * units)), rng.normal(0, scale, (2, units, 3 * units)),
        rng.normal(0, scale, (2 * units, len(languages))), np.zeros(len(languages)))


def _forward(net: Network, symbols: np.ndarray) -> tuple[np.ndarray, list]:
    """States (T, 2, B, H) of both directions, each at its own step, and what
    the way back needs.  Padding leaves a state as it is."""
    batch, length = symbols.shape
    h_units = net.recurrent.shape[1]
    h = np.zeros((2, batch, h_units))
    states, kept = np.empty((length, 2, batch, h_units)), []
    for t in range(length):
        now = np.stack([symbols[:, t], symbols[:, length - 1 - t]])
        x = np.stack([net.inputs[0][now[0]], net.inputs[1][now[1]]])
        g = np.matmul(h, net.recurrent)
        raw = (g + x)[..., : 2 * h_units] * 0.25 + 0.5
        zr = np.clip(raw, 0, 1)
        z, r = zr[..., :h_units], zr[..., h_units:]
        alive = (now != PAD)[..., None]
        z = np.where(alive, z, 1.0)
        inner = g[..., 2 * h_units :]
        pre = x[..., 2 * h_units :] + r * inner
        n = np.clip(pre, -1, 1)
        kept.append((now, h, z, r, inner, n, alive & (raw[..., :h_units] > 0) & (raw[..., :h_units] < 1), (raw[..., h_units:] > 0) & (raw[..., h_units:] < 1), np.abs(pre) < 1))
        h = n + z * (h - n)
        states[t] = h
    return states, kept


def _softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def gradients(net: Network, symbols: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions that are not padding, and its
    gradients in the order inputs, recurrent, output, bias."""
    states, kept = _forward(net, symbols)
    length, _, batch, u = states.shape
    both = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1)
    weight = (symbols.T != PAD).astype(float)
    weight /= max(1.0, weight.sum())
    p = _softmax(both @ net.output + net.bias)
    loss = -(weight * np.log(p[:, np.arange(batch), labels] + 1e-12)).sum()
    p[:, np.arange(batch), labels] -= 1
    p *= weight[..., None]
    d_out = both.reshape(-1, 2 * u).T @ p.reshape(-1, p.shape[-1])
    d_both = p @ net.output.T
    d_state = np.stack([d_both[..., :u], d_both[::-1, :, u:]], axis=1)
    d_in, d_rec = np.zeros_like(net.inputs), np.zeros_like(net.recurrent)
    d_h = np.zeros((2, batch, u))
    for t in range(length - 1, -1, -1):
        now, h, z, r, inner, n, z_on, r_on, n_on = kept[t]
        d = d_h + d_state[t]
        d_n = d * (1 - z) * n_on
        d_z = d * (h - n) * z_on * 0.25
        d_r = d_n * inner * r_on * 0.25
        d_g = np.concatenate([d_z, d_r, d_n * r], axis=-1)
        d_x = np.concatenate([d_z, d_r, d_n], axis=-1)
        d_rec += np.matmul(h.transpose(0, 2, 1), d_g)
        for side in (0, 1):
            # equal bytes of a batch share a row: sums by sorting
            order = np.argsort(now[side], kind="stable")
            there, start = np.unique(now[side][order], return_index=True)
            d_in[side][there] += np.add.reduceat(d_x[side][order], start, axis=0)
        d_h = d * z + np.matmul(d_g, net.recurrent.transpose(0, 2, 1))
    return float(loss), [d_in, d_rec, d_out, p.sum(axis=(0, 1))]


def schedule(languages: int) -> tuple[int, int]:
    """Windows of each language in a step, and steps."""
    return max(BATCH // languages, BATCH // MANY), round(STEPS * max(1.0, 1 + float(np.log2(languages / MANY))))


def train(windows: list[bytes], labels: list[int], languages: list[str], units: int = UNITS, steps: int | None = None, seed: int = 3) -> Network:
    """Fit a network to windows of bytes; no window or one language gives a
    network that knows no difference.  A step reads as many windows of each
    language, never fewer than ``BATCH // MANY``; steps grow with the logarithm
    of the number of languages."""
    rng = np.random.default_rng(seed)
    net = _new_network(languages, units, rng)
    if not windows or len(languages) < 2:
        return net
    symbols = _windows(windows, LENGTH // 2)[0]
    own = np.repeat(labels, [max(1, -(-len(w) // (LENGTH // 2))) for w in windows])
    there = [at for at in (np.flatnonzero(own == c) for c in range(len(languages))) if len(at)]
    each, enough = schedule(len(languages))
    steps = enough if steps is None else steps
    weights = [net.inputs, net.recurrent, net.output, net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        # as many windows of each language
        chosen = np.concatenate([at[rng.integers(0, len(at), each)] for at in there])
        _, slopes = gradients(net, _FOLD[symbols[chosen]], own[chosen])
        norm = np.sqrt(sum((s * s).sum() for s in slopes))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, s, a, b in zip(weights, slopes, first, second, strict=True):
            s *= min(1.0, 1.0 / (norm + 1e-9))
            a += 0.1 * (s - a)
            b += 0.01 * (s * s - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


def _windows(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts as windows of symbols, the last of a text padded (an empty
    text has one of padding), and the first window of each text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    number = np.maximum(1, -(-sizes // length))
    first = np.cumsum(number) - number
    out = np.full(int(number.sum()) * length, PAD, dtype=np.int16)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    starts = np.cumsum(sizes) - sizes
    for i in range(len(texts)):
        out[first[i] * length : first[i] * length + sizes[i]] = raw[starts[i] : starts[i] + sizes[i]]
    return out.reshape(-1, length), first


class Reader:
    """A trained network, laid out for reading many windows at once."""

    def __init__(self, net: Network):
        u = self.units = net.recurrent.shape[1]
        self.languages = net.languages
        # the gates' scale and offset go into the weights; padding holds its update gate open
        table = net.inputs.copy()
        table[..., : 2 * u] = table[..., : 2 * u] * 0.25 + 0.5
        table = table[:, _FOLD]
        table[:, PAD, :u] = 1e6
        self.gates = np.ascontiguousarray(table[..., : 2 * u].reshape(-1, 2 * u), dtype=np.float32)
        self.new = np.ascontiguousarray(table[..., 2 * u :].reshape(-1, u), dtype=np.float32)
        self.u_gates = np.ascontiguousarray(net.recurrent[..., : 2 * u] * 0.25, dtype=np.float32)
        self.u_new = np.ascontiguousarray(net.recurrent[..., 2 * u :], dtype=np.float32)
        self.output, self.bias = net.output.astype(np.float32), net.bias.astype(np.float32)

    def positions(self, symbols: np.ndarray) -> np.ndarray:
        """Probabilities (windows, length, languages) of every position."""
        lanes, length = symbols.shape
        u = self.units
        order = np.concatenate([symbols.T, symbols.T[::-1] + np.int16(PAD + 1)], axis=1).astype(np.intp)
        h = np.zeros((2 * lanes, u), dtype=np.float32)
        gates, x = np.empty((2 * lanes, 2 * u), np.float32), np.empty((2 * lanes, 2 * u), np.float32)
        new, y, states = np.empty_like(h), np.empty_like(h), np.empty((length, 2 * lanes, u), np.float32)
        z, r = gates[:, :u], gates[:, u:]
        for t in range(length):
            for side in (0, 1):
                at = slice(side * lanes, (side + 1) * lanes)
                np.matmul(h[at], self.u_gates[side], out=gates[at])
                np.matmul(h[at], self.u_new[side], out=new[at])
            np.take(self.gates, order[t], axis=0, out=x, mode="clip")
            np.take(self.new, order[t], axis=0, out=y, mode="clip")
            gates += x
            np.clip(gates, 0, 1, out=gates)
            new *= r
            new += y
            np.clip(new, -1, 1, out=new)
            h = states[t]
            np.subtract(states[t - 1] if t else np.zeros_like(new), new, out=h)
            h *= z
            h += new
        out = states[:, :lanes] @ self.output[:u]
        out += states[::-1, lanes:] @ self.output[u:]
        out += self.bias
        np.exp(out - out.max(axis=-1, keepdims=True), out=out)
        out /= out.sum(axis=-1, keepdims=True)
        return out.transpose(1, 0, 2)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities of each document's positions."""
        symbols, first = _windows(texts, LENGTH)
        lanes = max(1, min(LANES, HELD // len(self.languages)))
        owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(symbols))))
        total = np.zeros((len(first), len(self.languages)))
        for at in range(0, len(symbols), lanes):
            block = symbols[at : at + lanes]
            np.add.at(total, owner[at : at + lanes], np.where((block != PAD)[..., None], self.positions(block), 0).sum(axis=1, dtype=np.float64))
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-9)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_windows(docs: DataFrame) -> tuple[list[bytes], list[int], list[str]]:
    """The bounded sample of windows with their labels."""
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["lang"]: r["n"] for r in counts.collect()}
    languages = sorted(counts)
    number = {c: i for i, c in enumerate(languages)}
    if not languages:
        return [], [], []
    u = uniform(F.lit("sample"), F.col("doc_id"))
    share = docs.sparkSession.createDataFrame([(c, 3.0 * SAMPLE_DOCS / n) for c, n in counts.items()], "lang string, share double")
    drawn = labelled.select("doc_id", "lang", "text", u.alias("u")).join(F.broadcast(share), "lang").where("u <= share")
    size = F.length("text")
    places = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)), lambda k: F.substr(
        F.col("text"), (F.floor(uniform(F.lit("place"), F.col("doc_id"), k) * F.greatest(size - LENGTH, F.lit(0))) + 1).cast("int"), F.lit(LENGTH)))
    few = drawn.select("lang", "u", "doc_id", F.array_distinct(places).alias("w"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id"))
    rows = few.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_DOCS).orderBy("lang", "u", "doc_id", "w").collect()
    windows = [(w.encode(), number[r["lang"]]) for r in rows for w in r["w"] if w]
    return [w for w, _ in windows], [c for _, c in windows], languages


def fit(docs: DataFrame) -> Network:
    """Learn from the text and language of the documents that are not held
    out, and of these from the bounded sample."""
    return train(*training_windows(docs))


def has_letter(text: Column) -> Column:
    """Never null; a null text has none."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, net: Network, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All rows and columns of ``docs`` with the predicted language and its
    probability, from nothing but the whole text.

    A text that is null or has no letter is ``und`` with score 0, and so is
    every text if nothing could be learned.  New names replace columns of the
    same name.
    """
    parts = (net.languages, net.inputs, net.recurrent, net.output, net.bias)

    def work(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        reader = Reader(Network(*parts)) if parts[0] else None
        for text, letter in batches:
            texts, ok = [t or b"" for t in binary(text)], np.array(letter.to_pylist(), dtype=bool)
            best, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            some = np.flatnonzero(ok) if reader else []
            # a MB of text at a time
            start = 0
            while start < len(some):
                stop, held = start, 0
                while stop < len(some) and (stop == start or held < 1 << 20):
                    held += len(texts[some[stop]])
                    stop += 1
                own = some[start:stop]
                p = reader.documents([texts[i] for i in own])
                top = p.argmax(axis=1)
                best[own] = [reader.languages[k] for k in top]
                score[own] = np.clip(p[np.arange(len(own)), top], 0, 1)
                start = stop
            yield [pa.array(best.tolist(), pa.string()), pa.array(score)]

    marked = docs.withColumn("__letter", has_letter(F.col("text")))
    fields = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
    return append_columns(marked, ["text", "__letter"], fields, work).drop("__letter")


def language_digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, repeated ones too.
    Null texts and texts without a letter are ``und`` with score 0; so are all
    if no document is labelled.  An empty table gives no rows."""
    found = identify(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, net: Network) -> DataFrame:
    """The documents whose language is identified, or could be if there were a
    network that knows languages; texts that are null or have no letter go.
    A null ``lang`` becomes the network's answer; a given one stays, and so
    does a null one where the network knows no language."""
    answer, score = "__lang", "__score"
    found = identify(docs, net, (answer, score)).where((F.col(answer) != UNKNOWN) | has_letter(F.col("text")))
    own = {f.name: f.dataType for f in docs.schema.fields}
    filled = F.coalesce("lang", F.when(F.col(answer) != UNKNOWN, F.col(answer)).cast(own["lang"])).alias("lang") if "lang" in own else None
    return found.select(*[filled if c == "lang" else named(c) for c in docs.columns])
