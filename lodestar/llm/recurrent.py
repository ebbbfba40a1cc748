"""Log-likelihood of whole documents under a gated recurrent language model.

Tokens are words (A-Z lower-cased) and one end per document. Counts of all training tokens are made in Spark. The model's own
words are the most frequent ones, dealt into classes; all other words are one more class, inside which a word's probability
follows its corpus count (unseen words share the place of one more token), so every word's count matters and probabilities sum
to one. A gated recurrent unit reads the tokens; the output is a softmax over classes times a softmax inside the class.

The network's weights are fitted in numpy by truncated backpropagation on every training document: each is read in one of
``rounds`` rounds, whatever the size of the table. Tasks of about ``shard_docs`` documents train side by side;
after each round their weights are averaged, ``merge`` at a time, in tasks too. Scoring carries the state across windows from a
document's first token to its end, for many documents at a time.

Frequent words' counts go to the tasks (a bounded table); all other words are joined with the counts table.

A null or empty text is its end token alone. With no training document all counts are 0 and every token has probability 1 by
the formulas. Repeated rows are scored alike and each counts in training. Columns of other names stay with
``score_documents``; its own names and working names replace theirs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lodestar.llm.language import fold
from lodestar.llm.rows import rest
from lodestar.llm.text import as_long, map_arrow, slices, words
from lodestar.session import stored

END = np.uint64(0x452821E638D01377)      # hash of the end token
PIECE = 1 << 19                          # bytes whose words are found at once
Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class Recurrent:
    known: int = 1 << 18      # at most so many frequent words whose counts every task holds
    vocabulary: int = 2048    # words of the model's own
    classes: int = 40
    hidden: int = 16
    window: int = 24          # tokens of a truncated backpropagation
    streams: int = 48         # documents read side by side in training
    fit_docs: int = 0         # documents of a round at least, for callers who want small tables read again: 0 reads every table once
    shards: int = 6           # training tasks side by side: at least so many (averaging steadies a small fit) ...
    shard_docs: int = 500     # ... and more where a task would get more documents than this, in expectation
    merge: int = 32           # sets of weights averaged in one task, and at most so many for the driver
    rounds: int = 3           # averages of their weights
    rate: float = 0.015
    slice: int = 8 << 20      # text bytes scored at once


@dataclass(frozen=True)
class Counts:
    total: int                # N
    distinct: int             # V
    hashes: np.ndarray        # of frequent words, sorted
    counts: np.ndarray
    word: np.ndarray          # their places in the model's vocabulary, or its size


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of each text, its end included, and their offsets. Words are found in pieces of ``PIECE`` bytes (a longer text alone),
    which stay in the processor's cache."""
    n = len(offsets) - 1
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(offsets, offsets[cuts[-1]] + PIECE, "right")) - 1))
    out, sizes = [], [np.zeros(1, np.int64)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        w = words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        h = np.full(len(w.hash) + b - a, END, np.uint64)
        size = np.diff(w.of)
        h[np.arange(len(w.hash)) + np.repeat(np.arange(b - a), size)] = w.hash
        out.append(h)
        sizes.append(size + 1)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.cumsum(np.concatenate(sizes))


def count_tokens(texts: DataFrame) -> DataFrame:
    """``h``, ``n``: every token of column ``text``."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h)
            h, n = h[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return h[first], np.add.reduceat(n, first)

        for _, data, offsets in slices(batches):
            h, n = np.unique(_tokens(data, offsets)[0], return_counts=True)
            held.append((h, n))
            if sum(len(x) for x, _ in held) > 2_000_000:
                held[:] = [merged()]
                if len(held[0][0]) > 1_000_000:                      # a task's table stays bounded; Spark adds up the parts
                    yield pa.RecordBatch.from_arrays([as_long(held[0][0]), pa.array(held[0][1])], ["h", "n"])
                    held.clear()
        if held:
            h, n = merged()
            yield pa.RecordBatch.from_arrays([as_long(h), pa.array(n)], ["h", "n"])

    return map_arrow(texts.select("text"), each, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def gather(counts: DataFrame, model: Recurrent) -> Counts:
    """Totals, and the frequent words: those above the lowest count (in steps of 1/8 of a power of two) that at most ``known`` words reach,
    and the end token whatever its count: it always has a place of its own in the model, the last one if it is rare."""
    step = F.floor(F.log2("n") * 8).cast("int")
    per = sorted((r["s"], r["n"], r["t"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("t")).collect())
    cut, held = 1 << 30, 0
    for s, n, _ in reversed(per):
        if held + n > model.known:
            break
        cut, held = s, held + n
    top = counts.where((step >= cut) | (F.col("h") == int(END.view(np.int64)))).toPandas()
    h, n = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.lexsort((h, -n))
    place = np.full(len(h), model.vocabulary, np.int64)
    own, end = order[:model.vocabulary].copy(), np.flatnonzero(h == END)
    if len(end) and end[0] not in own:
        own[-1] = end[0]
    place[own] = np.arange(len(own))
    place[place == model.vocabulary] = min(len(h), model.vocabulary)
    by = np.argsort(h)
    return Counts(sum(t for *_, t in per), sum(n for _, n, _ in per), h[by], n[by], place[by])


def _look(c: Counts, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in the table of frequent words, and whether the token is there."""
    if not len(c.hashes):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(c.hashes, h), len(c.hashes) - 1)
    return at, c.hashes[at] == h


def class_starts(frequency: np.ndarray, classes: int) -> np.ndarray:
    """First word of each class (words by falling frequency) and the number of words: classes of like sums of square roots."""
    k = len(frequency)
    if not k:
        return np.zeros(1, np.int64)
    part = np.cumsum(np.sqrt(frequency))
    first = np.searchsorted(part, np.arange(classes) * part[-1] / classes)
    return np.append(np.unique(np.minimum(first, k - 1)), k)


def initial(frequency: np.ndarray, rest: float, starts: np.ndarray, model: Recurrent) -> Weights:
    """Weights whose outputs begin as the corpus frequencies."""
    r, k, h = np.random.default_rng(7), len(frequency), model.hidden
    by_class = np.array([frequency[a:b].sum() for a, b in zip(starts[:-1], starts[1:], strict=True)] + [rest], float)
    return {"x": r.normal(0, 0.1, (k + 1, 3 * h)).astype(np.float32), "u": (r.normal(0, 1, (h, 3 * h)) / math.sqrt(h)).astype(np.float32),
            "c": r.normal(0, 0.05, (h, len(by_class))).astype(np.float32), "cb": np.log(by_class + 1e-3).astype(np.float32),
            "w": r.normal(0, 0.05, (k, h)).astype(np.float32), "wb": np.log(np.maximum(frequency, 1e-3)).astype(np.float32)}


def _softmax(x: np.ndarray) -> np.ndarray:
    """Of each column, in place."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def _with_ones(h: np.ndarray) -> np.ndarray:
    """States with a last column of ones: biases are then one more row of the weights."""
    return np.concatenate([h, np.ones((len(h), 1), h.dtype)], 1)


def _joined(w: Weights) -> Weights:
    """Weights as the loops below use them: biases beside their weights, the gates' parts of ``x`` and ``u`` negated, ``u`` turned."""
    sign = np.repeat(np.array([-1, -1, 1], np.float32), len(w["u"]))
    return {"c": np.vstack([w["c"], w["cb"]]), "u": np.ascontiguousarray((w["u"] * sign).T), "w": np.column_stack([w["w"], w["wb"]]), "x": w["x"] * sign}


def _parted(j: Weights) -> Weights:
    sign = np.repeat(np.array([-1, -1, 1], np.float32), j["u"].shape[1])
    return {"x": j["x"] * sign, "u": j["u"].T * sign, "c": j["c"][:-1].copy(), "cb": j["c"][-1].copy(), "w": j["w"][:, :-1].copy(), "wb": j["w"][:, -1].copy()}


def _read(j: Weights, before: np.ndarray, h: np.ndarray, goes_on: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """States (first ``h``), gates, candidates and sums of ``u`` while words ``before`` (time x text) are read; all are time x unit x text,
    so that every step works on whole runs of memory. ``goes_on`` is 0 where a text begins."""
    steps, size = before.shape
    n = len(h)
    x = np.ascontiguousarray(j["x"][before].transpose(0, 2, 1))
    states, gates = np.empty((steps + 1, n, size), np.float32), np.empty((steps, 2 * n, size), np.float32)
    new, sums = np.empty((steps, n, size), np.float32), np.empty((steps, 3 * n, size), np.float32)
    states[0] = h
    begins = (goes_on == 0).any(1).tolist() if goes_on is not None else [False] * steps
    for i, (x_gate, x_new, s, c, g, z, r, g_gate, g_new, h_next) in enumerate(zip(
            x[:, :2 * n], x[:, 2 * n:], gates, new, sums, gates[:, :n], gates[:, n:], sums[:, :2 * n], sums[:, 2 * n:], states[1:], strict=True)):
        h = states[i] * goes_on[i] if begins[i] else states[i]
        np.dot(j["u"], h, out=g)
        np.add(x_gate, g_gate, out=s)
        np.exp(s, out=s)
        np.add(s, 1, out=s)
        np.reciprocal(s, out=s)
        np.multiply(r, g_new, out=c)
        np.add(c, x_new, out=c)
        np.tanh(c, out=c)
        np.subtract(h, c, out=h_next)
        np.multiply(h_next, z, out=h_next)
        np.add(h_next, c, out=h_next)
    return states, gates, new, sums


def _rows(x: np.ndarray) -> np.ndarray:
    """time x unit x text as one row per time and text."""
    return x.transpose(0, 2, 1).reshape(-1, x.shape[1])


@dataclass(frozen=True)
class _Inner:
    """Own words by class: their softmaxes lie one after the other in one array."""
    order: np.ndarray         # rows of own words, by class
    first: np.ndarray         # where each row's softmax begins
    width: np.ndarray
    chosen: np.ndarray        # place of the row's word
    size: int
    spans: list[list[int]]    # a class, its rows in ``order`` and its part of the array

    def logits(self, by_class: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Less the largest of their softmax, with the part of each span as a matrix. ``by_class``: the words' weights."""
        flat = np.empty(self.size, np.float32)
        parts = [flat[p:q].reshape(f - e, -1) for _, e, f, p, q in self.spans]
        for (k, e, f, _, _), part in zip(self.spans, parts, strict=True):
            np.dot(rows[e:f], by_class[k].T, out=part)
        flat -= np.repeat(np.maximum.reduceat(flat, self.first), self.width)
        return flat, parts


def _inner(cls: np.ndarray, word: np.ndarray, starts: np.ndarray) -> _Inner:
    size = np.diff(starts)
    order = np.argsort(cls.astype(np.uint16) if len(starts) < 1 << 16 else cls, kind="stable")
    edge = np.searchsorted(cls[order], np.arange(len(starts)))
    order = order[:edge[-1]]
    own = cls[order]
    width = size[own]
    at = np.concatenate([[0], np.cumsum(width)])
    k = np.flatnonzero(np.diff(edge))
    spans = np.stack([k, edge[k], edge[k + 1], at[edge[k]], at[edge[k + 1]]], 1).tolist()
    return _Inner(order, at[:-1], width, at[:-1] + word[order] - starts[own], int(at[-1]), spans)


def _class_of(starts: np.ndarray) -> np.ndarray:
    """Class of each own word; the last one for all others."""
    return np.repeat(np.arange(len(starts)), np.append(np.diff(starts), 1))


def _by_class(w: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    return [w[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]


def _log_outputs(j: Weights, by_class: list[np.ndarray], starts: np.ndarray, classes: np.ndarray, h: np.ndarray, word: np.ndarray) -> np.ndarray:
    rows, cls = _with_ones(h), classes[word]
    x = j["c"].T @ rows.T
    x -= x.max(0)
    out = x[cls, np.arange(len(h))] - np.log(np.exp(x, out=x.copy()).sum(0))
    inner = _inner(cls, word, starts)
    if inner.size:
        flat, _ = inner.logits(by_class, rows[inner.order])
        out[inner.order] += flat[inner.chosen] - np.log(np.add.reduceat(np.exp(flat), inner.first))
    return out


def log_outputs(w: Weights, starts: np.ndarray, h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Log probability of each word's class and, for the model's own words, of the word in it."""
    j = _joined(w)
    return _log_outputs(j, _by_class(j["w"], starts), starts, _class_of(starts), h, word)


class _Adam:
    """Steps on joined weights, one vector that ends in ``x``. Only rows of ``x`` that were read have a slope; the others move by what
    is left of earlier ones, as if theirs were 0. Both means fade by a common factor that is kept apart (``fade``, ``dim``), the second as its root."""

    BLOCK = 1 << 14           # weights moved at once stay in the processor's cache

    def __init__(self, j: Weights, rate: float):
        self.flat = np.concatenate([j[k].ravel() for k in sorted(j)])
        self.dense = len(self.flat) - j["x"].size
        self.slope = np.zeros(self.dense, np.float32)
        self.w, self.grad = _views(self.flat, j), _views(self.slope, {k: v for k, v in j.items() if k != "x"})
        self.m, self.root, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat), np.empty(self.BLOCK, np.float32)
        self.mx, self.root_x = (_views(v, j)["x"] for v in (self.m, self.root))
        self.rate, self.t, self.fade, self.dim = rate, 0, 1.0, 1.0

    def step(self, seen: np.ndarray, slope: np.ndarray) -> None:
        """``slope``: of the rows ``seen`` of ``x``; ``self.grad`` has the others'."""
        self.t += 1
        self.fade *= 0.9
        self.dim *= math.sqrt(0.999)
        for m, root, at, g in ((self.m, self.root, slice(self.dense), self.slope), (self.mx, self.root_x, seen, slope)):
            np.clip(g, -5, 5, out=g)
            m[at] += g * np.float32(0.1 / self.fade)
            g *= np.float32(math.sqrt(0.001) / self.dim)
            g *= g
            r = root[at]
            root[at] = np.sqrt(r * r + g)
        scale = self.dim / math.sqrt(1 - 0.999 ** self.t)
        least, rate = np.float32(1e-6 / scale), np.float32(self.rate / (1 - 0.9 ** self.t) * self.fade / scale)
        for a in range(0, len(self.flat), self.BLOCK):
            w, m = self.flat[a:a + self.BLOCK], self.m[a:a + self.BLOCK]
            v = np.add(self.root[a:a + self.BLOCK], least, out=self.v[:len(w)])
            np.divide(m, v, out=v)
            v *= rate
            w -= v
        self.slope[:] = 0
        if self.fade < 1e-4:
            self.m *= np.float32(self.fade)
            self.root *= np.float32(self.dim)
            self.fade = self.dim = 1.0


def fit_shard(w: Weights, starts: np.ndarray, docs: list[np.ndarray], end: int, model: Recurrent, seed: int) -> Weights:
    """One pass of truncated backpropagation (Adam) over documents of word places that end in ``end``."""
    r = np.random.default_rng(seed)
    order = r.permutation(len(docs))
    rows: list[list[np.ndarray]] = [[] for _ in range(min(model.streams, len(docs)))]
    filled = [0] * len(rows)
    for i in order:
        k = int(np.argmin(filled))
        rows[k].append(docs[i])
        filled[k] += len(docs[i])
    if not rows:
        return {k: v.copy() for k, v in w.items()}
    length, size = max(filled), len(rows)
    target = np.full((length + 1, size), -1, np.int64)
    for k, parts in enumerate(rows):
        x = np.concatenate(parts)
        target[1:len(x) + 1, k] = x
    adam, classes = _Adam(_joined(w), model.rate), _class_of(starts)
    j, grad = adam.w, adam.grad
    by_class, slopes = _by_class(j["w"], starts), _by_class(grad["w"], starts)
    n, h = model.hidden, np.zeros((model.hidden, size), np.float32)
    small = np.uint16 if len(classes) < 1 << 16 else np.int64         # short keys sort faster
    for begin in range(1, length + 1, model.window):
        now = target[begin:begin + model.window]
        before = target[begin - 1:begin - 1 + len(now)].copy()
        if begin == 1:
            before[0] = end
        live = np.flatnonzero(now.ravel() >= 0)
        ws = now.ravel()[live]
        if not len(ws):
            break
        goes_on = (before != end).astype(np.float32)                  # 0 where a document begins
        states, gates, c, sums = _read(j, np.maximum(before, 0), h, goes_on)
        h = states[-1].copy()
        hs = _with_ones(_rows(states[1:])[live])
        scale = np.float32(50 / len(ws))
        cls = classes[ws]
        p = _softmax(j["c"].T @ hs.T)
        p[cls, np.arange(len(ws))] -= 1
        p *= scale
        np.dot(hs.T, p.T, out=grad["c"])
        dh = p.T @ j["c"].T
        inner = _inner(cls, ws, starts)
        if inner.size:
            own = hs[inner.order]
            q, parts = inner.logits(by_class, own)
            np.exp(q, out=q)
            q *= np.repeat(scale / np.add.reduceat(q, inner.first), inner.width)
            q[inner.chosen] -= scale
            down = np.empty_like(own)
            for (k, e, f, _, _), part in zip(inner.spans, parts, strict=True):
                np.dot(part.T, own[e:f], out=slopes[k])
                np.dot(part, by_class[k], out=down[e:f])
            dh[inner.order] += down
        out = np.zeros((before.size, n), np.float32)
        out[live] = dh[:, :n]
        out = np.ascontiguousarray(out.reshape(*before.shape, n).transpose(0, 2, 1))
        z, g, old = gates[:, :n], gates[:, n:], states[:-1] * goes_on[:, None]
        by_c = 1 - c * c
        by_c *= 1 - z
        by = np.empty((len(now), 3, n, size), np.float32)              # slopes of the gates' negated sums and of the new state's by the new state
        by_g = by_c * g
        np.multiply((c - old) * z, 1 - z, out=by[:, 0])
        np.multiply(by_g * sums[:, 2 * n:], g - 1, out=by[:, 1])
        by[:, 2] = by_g
        dg, carried, turned = np.empty_like(by), z * goes_on[:, None], np.ascontiguousarray(j["u"].T)
        back, through, begins = np.zeros((n, size), np.float32), np.empty((n, size), np.float32), (goes_on == 0).any(1).tolist()
        for i in range(len(now) - 1, -1, -1):
            o, d = out[i], dg[i]
            o += back
            np.multiply(by[i], o, out=d)
            np.dot(turned, d.reshape(3 * n, size), out=through)
            if begins[i]:
                through *= goes_on[i]
            np.multiply(o, carried[i], out=back)
            back += through
        across = lambda x: x.reshape(len(now), -1, size).transpose(1, 0, 2).reshape(-1, len(now) * size)
        slope = across(dg)
        np.dot(slope, across(old).T, out=grad["u"])
        slope[2 * n:] = across(out * by_c)
        key = before.ravel()
        seen = np.argsort((key + 1).astype(small), kind="stable")
        seen = seen[np.count_nonzero(key < 0):]
        word = key[seen]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        adam.step(word[first], np.add.reduceat(slope.take(seen, 1), first, 1).T)
    return _parted(j)


def _views(flat: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _pack(w: Weights) -> bytes:
    return b"".join(w[k].astype(np.float32).tobytes() for k in sorted(w))


def _unpack(blob: bytes, like: Weights) -> Weights:
    return {k: v.copy() for k, v in _views(np.frombuffer(blob, np.float32), like).items()}


def _trainer(now, like: Weights, starts: np.ndarray, end: int, model: Recurrent, seed: int):
    def train(group: pa.Table) -> pa.Table:
        docs = [np.frombuffer(b, np.int32).astype(np.int64) for b in sorted(group.column("words").to_pylist())]
        got = fit_shard(_unpack(now.value, like), starts, docs, end, model, seed + group.column("shard")[0].as_py())
        return pa.table({"shard": group.column("shard")[:1], "n": [sum(map(len, docs))], "blob": pa.array([_pack(got)], pa.binary())})

    return train


SETS = "shard int, n long, blob binary"


def _mean(sets: list[tuple[int, bytes]]) -> bytes:
    """Mean of packed weights, by the tokens they were trained on."""
    total = sum(n for n, _ in sets)
    return sum(np.frombuffer(b, np.float32).astype(np.float64) * (n / total) for n, b in sets).astype(np.float32).tobytes()


def averaged(sets: DataFrame, shards: int, merge: int) -> bytes | None:
    """Mean of the weights of all shards (numbered from 0). Each level leaves one set in ``merge``; the driver gets ``merge`` sets at most."""
    def each(group: pa.Table) -> pa.Table:
        held = sorted(zip(group.column("shard").to_pylist(), group.column("n").to_pylist(), group.column("blob").to_pylist(), strict=True))
        return pa.table({"shard": pa.array([held[0][0] // merge], pa.int32()), "n": [sum(n for _, n, _ in held)], "blob": pa.array([_mean([x[1:] for x in held])], pa.binary())})

    while shards > merge:
        shards = -(-shards // merge)
        sets = sets.groupBy((F.col("shard") / merge).cast("int").alias("_of")).applyInArrow(each, SETS)
    got = sorted((r["shard"], r["n"], bytes(r["blob"])) for r in sets.collect())
    return _mean([x[1:] for x in got]) if got else None


def fit(texts: DataFrame, c: Counts, model: Recurrent) -> tuple[Weights, np.ndarray]:
    """Weights and class starts. The number of tasks grows with the table; a task's documents and weights don't."""
    own = min(len(c.hashes), model.vocabulary)
    frequency = np.zeros(own)
    frequency[c.word[c.word < own]] = c.counts[c.word < own]
    starts = class_starts(frequency, model.classes)
    w = initial(frequency, max(0, c.total - frequency.sum()) + 1, starts, model)
    at, there = _look(c, np.array([END], np.uint64))
    if not own or not there[0] or c.word[at[0]] >= own:
        return w, starts
    end = int(c.word[at[0]])
    sc = texts.sparkSession.sparkContext
    table = sc.broadcast(c)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in slices(batches):
            h, of = _tokens(data, offsets)
            at, there = _look(table.value, h)
            word = np.where(there, table.value.word[at], own).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([word[a:b].tobytes() for a, b in zip(of[:-1], of[1:], strict=True)], pa.binary())], ["words"])

    n = texts.count()
    passes = max(1, min(model.rounds, -(-model.rounds * model.fit_docs // max(n, 1))))      # rounds that read a document
    shards = max(model.shards, -(-n * passes // (model.rounds * model.shard_docs)))
    alike = map_arrow(texts.select("text"), places, "words binary").groupBy("words").agg(F.count(F.lit(1)).alias("n"))      # rows alike to the network
    each = alike.select("words", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))         # repeated rows go to different tasks
    key = F.xxhash64("words", "copy")
    sample = stored(each.select("words", F.pmod(key, F.lit(model.rounds)).cast("int").alias("turn"), F.pmod(F.shiftright(key, 32), F.lit(shards)).cast("int").alias("shard")))
    for k in range(model.rounds):
        train = _trainer(sc.broadcast(_pack(w)), {name: np.zeros_like(v) for name, v in w.items()}, starts, end, model, 100 * k)
        part = sample.where((F.col("turn") + k) % model.rounds < passes).select("shard", "words")
        mean = averaged(part.groupBy("shard").applyInArrow(train, SETS), shards, model.merge)
        if mean is not None:
            w = _unpack(mean, w)
    return w, starts


def log_likelihoods(w: Weights, starts: np.ndarray, word: np.ndarray, of: np.ndarray, end: int, window: int = 32, width: int = 256) -> np.ndarray:
    """Natural log of the class and own-word probabilities, summed for each document. State goes from window to window;
    ``width`` documents of like lengths are read side by side."""
    size = np.diff(of)
    order = np.argsort(-size, kind="stable")
    out, j, classes = np.zeros(len(size)), _joined(w), _class_of(starts)
    by_class = _by_class(j["w"], starts)
    for a in range(0, len(order), width):
        docs = order[a:a + width]
        left, start = size[docs], of[docs]
        h = np.zeros((w["u"].shape[0], len(docs)), np.float32)
        for begin in range(0, int(left[0]), window):
            b = int(np.searchsorted(-left, -begin, "left"))           # documents longer than ``begin``
            at = np.arange(begin, min(begin + window, int(left[0])))[:, None]
            live = at < left[:b]
            here = np.where(live, start[:b] + at, 0)
            before = np.where(live & (at > 0), word[np.maximum(here - 1, 0)], end)
            states = _read(j, before, h[:, :b])[0]
            h = states[-1].copy()
            live = np.flatnonzero(live.ravel())
            got = _log_outputs(j, by_class, starts, classes, _rows(states[1:])[live], word[here.ravel()[live]])
            out[docs[:b]] += np.bincount(live % b, weights=got, minlength=b)
    return out


def score_documents(docs: DataFrame, training, text: str = "text", model: Recurrent = Recurrent()) -> DataFrame:
    """Columns of ``docs`` but the text, with ``n_tokens n_known train_tokens base_score score``. ``training``: a condition on rows of ``docs``."""
    learn = docs.where(training).select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = stored(count_tokens(learn))
    c = gather(counts, model)
    w, starts = fit(learn, c, model)
    own = len(w["w"])
    at, there = _look(c, np.array([END], np.uint64))
    end = int(c.word[at[0]]) if there[0] else own
    mine = int(c.counts[c.word < own].sum())
    beyond = (c.total - mine) + (c.distinct - own) + 1
    shipped = docs.sparkSession.sparkContext.broadcast((c, w))
    inner = ("_id", "_known", "_log", "_own", "_outside", "_h", "_n", "_more", "_seen")
    others = rest(docs, text, "n_tokens", "n_known", "train_tokens", "base_score", "score", *inner)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, w = shipped.value
        task = TaskContext.get()
        serial = (task.partitionId() if task else 0) << 40
        log_count = np.log10(c.counts + 1.0)
        for batch, data, offsets in slices(batches, text, model.slice):
            h, of = _tokens(data, offsets)
            n = len(of) - 1
            doc = np.repeat(np.arange(n), np.diff(of))
            at, there = _look(c, h)
            word = np.where(there, c.word[at], own) if len(c.hashes) else np.full(len(h), own)
            own_log = log_likelihoods(w, starts, word, of, end) / math.log(10)
            value = np.where(there, log_count[at], 0.0) if len(c.hashes) else np.zeros(len(h))
            sums = lambda x: np.bincount(doc, weights=x, minlength=n)
            outside = (word == own).astype(float)
            far = np.flatnonzero(~there)
            d, x = doc[far], h[far]
            order = np.lexsort((x, d))
            d, x = d[order], x[order]
            first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (d[1:] != d[:-1])])) if len(x) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(x))).astype(np.int32)
            lists = pa.array(np.searchsorted(d[first], np.arange(n + 1)), pa.int32())
            ids = serial + np.arange(n)
            serial += n
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(k)) for k in others], pa.array(ids), pa.array(np.diff(of)), pa.array(sums(there.astype(float)).astype(np.int64)),
                 pa.array(sums(value)), pa.array(own_log + sums(value * outside)), pa.array(sums(outside).astype(np.int64)),
                 pa.ListArray.from_arrays(lists, as_long(x[first])), pa.ListArray.from_arrays(lists, pa.array(times))],
                [*others, "_id", "n_tokens", "_known", "_log", "_own", "_outside", "_h", "_n"])

    fields = ", ".join([*[f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in others],
                        "_id long, n_tokens long, _known long, _log double, _own double, _outside long, _h array<long>, _n array<int>"])
    rows = stored(map_arrow(docs.select(*others, text), each, fields))
    rare = rows.select("_id", F.explode(F.arrays_zip("_h", "_n")).alias("x")).select("_id", F.col("x._h").alias("h"), F.col("x._n").alias("m"))
    rare = rare.join(counts, "h", "left").groupBy("_id").agg(F.sum(F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("_more"), F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("_seen"))
    more = F.coalesce("_more", F.lit(0.0))
    return rows.join(rare, "_id", "left").select(
        *others, "n_tokens", (F.col("_known") + F.coalesce("_seen", F.lit(0))).cast("long").alias("n_known"), F.lit(c.total).cast("long").alias("train_tokens"),
        (F.col("_log") + more - F.col("n_tokens") * math.log10(c.total + c.distinct + 1)).alias("base_score"),
        (F.col("_own") + more - F.col("_outside") * math.log10(beyond)).alias("score"))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = fold(F.col("doc_id"), 7) == 2
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return score_documents(rows, ~F.col("held_out"))
