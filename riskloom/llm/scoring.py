"""Masked pseudo-likelihood of documents under a bidirectional window network over embedded words.

Words are maximal runs outside ``[\\x20\\x09-\\x0D]``, A-Z folded. Words that occur at least
MIN_COUNT times (the most frequent MAX_WORDS if more do) are the vocabulary; each has an embedding and a
leaf in a binary tree of its own, weight-balanced over the words in order of their endings. Of each token, the
embeddings of the WINDOW words on either side pass a layer with weights of its own per place and a tanh; the token's
probability is the product of the branches on the way to its leaf, each a logistic function of what comes out, so
probabilities sum to one. A
rarer word goes to the leaf of its shape (ending, capital, length, digits) and is then spelled byte by
byte, each byte given the one before and the shape; no words share a probability by hashing. Words beyond a document's
ends are a border that has an embedding too.

Training reads every token of the corpus in streamed batches and predicts a share MASKED of them from the words around: in
each of ROUNDS rounds, every task trains on its
rows of that round from the same weights, and the changes of each row of weights are averaged over the tasks that
touched it. Corpora of fewer than SMALL tokens are gone over more often. Scoring predicts every token.

Scale: scans of whole texts; word counts and weight changes are summed by Spark, the latter as one byte a weight. Drivers and
workers hold the model, of at most MAX_WORDS embeddings and branches. The branches of the first TOP levels of the tree are one
matrix product; only the few below are gathered per token.

Defined results: null, empty and word-free texts have no tokens, a sum of 0 and a null mean;
repeated rows count and are scored alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskloom.functions.shared import materialize
from riskloom.llm.textbytes import text_chunks, word_bounds, word_hashes
from riskloom.llm.workers import arrow_scope, enter, remember

SHAPES = 48
MIN_COUNT, MAX_WORDS, DIM, WINDOW = 5, 1 << 19, 24, 3
TOP = 7
ROUNDS, SMALL, MASKED, LEAST, MOST, SPEED = 2, 1_000_000, 0.25, 64, 8192, 0.15
ROWS, FLUSH, BYTES, TASKS, LONG, SPAN = 512, 1 << 20, 257, 8, 32, 2048
_U = np.uint64
_ASCII = np.arange(256)
_UPPER = (_ASCII >= 65) & (_ASCII <= 90)
_DIGIT = (_ASCII >= 48) & (_ASCII <= 57)
_LOWER = np.where(_UPPER, _ASCII + 32, _ASCII)
_ENDING = np.where(_ASCII == ord("."), 1, np.where(_ASCII == ord(","), 2, np.where((_ASCII < 128) & ~_UPPER & ~_DIGIT & ~((_ASCII >= 97) & (_ASCII <= 122)), 3, 0)))
_AROUND = np.array([*range(-WINDOW, 0), *range(1, WINDOW + 1)])


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    digits = np.append(0, np.cumsum(_DIGIT[data]))
    length = ends - starts
    band = (length > 3).astype(np.int64) + (length > 7)
    return ((_ENDING[data[ends - 1]] * 2 + _UPPER[data[starts]]) * 3 + band) * 2 + (digits[ends] > digits[starts])


def _words(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk of rows: bytes, starts and ends of all words, and the first word of each row."""
    for _, data, off in text_chunks(text):
        yield data, *word_bounds(data, off)


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])


def _run_sums(g: np.ndarray, order: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each run of ``size`` places of ``order`` from ``at`` on, the sum of the rows of ``g`` they name."""
    out, k, live = g.take(order[at], axis=0), 1, np.flatnonzero(size > 1)
    while k < LONG and len(live):
        out[live] += g.take(order[at[live] + k], axis=0)
        k += 1
        live = live[size[live] > k]
    for i in live.tolist():
        out[i] += g.take(order[at[i] + k : at[i] + size[i]], axis=0).sum(axis=0)
    return out


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word, count and last three bytes (the last one leads), summed over up to FLUSH words."""
    enter("training")
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, n, tail = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h)
        at = _runs(h[order])
        return h[order[at]], np.add.reduceat(n[order], at), tail[order[at]]

    def batch(word: np.ndarray, n: np.ndarray, tail: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n), pa.array(tail)], ["word", "n", "tail"])

    for b in batches:
        for data, starts, ends, _ in _words(b.column(0)):
            if not len(starts):
                continue
            tail = sum(np.where(ends - k > starts, _LOWER[data[np.maximum(ends - 1 - k, 0)]], 0) << (16 - 8 * k) for k in range(3))
            held.append((word_hashes(data, starts, ends), np.ones(len(starts), np.int64), tail))
            if sum(len(x[0]) for x in held) > FLUSH:
                held = [summed()]
                if len(held[0][0]) > FLUSH // 2:
                    yield batch(*held.pop())
    if held:
        yield batch(*summed())


@dataclass
class Tree:
    """Vocabulary and tree. Leaves are the words in order of endings, then the shapes; branch i parts the leaves < i from others.

    The way to a leaf is row ``group_of[leaf]`` of ``top_path`` (places in ``top``, its length where the way has ended) with the
    sides it takes in ``top_side`` (1, -1, or 0 at its end), then ``below[below_at[leaf] : below_at[leaf + 1]]``.
    """

    sorted_words: np.ndarray
    leaf_of: np.ndarray
    first_at: np.ndarray
    shift: int
    bias: np.ndarray
    top: np.ndarray
    top_path: np.ndarray
    top_side: np.ndarray
    group_of: np.ndarray
    below: np.ndarray
    below_at: np.ndarray

    @property
    def words(self) -> int:
        return len(self.leaf_of)

    @property
    def entries(self) -> int:
        return len(self.leaf_of) + SHAPES

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """The leaf of every word, or -1."""
        out = np.full(len(words), -1, np.int64)
        if not self.words:
            return out
        slot = (words >> _U(self.shift)).astype(np.int64)
        at, end = self.first_at[slot], self.first_at[slot + 1]
        live = np.flatnonzero(at < end)
        while len(live):
            hit = self.sorted_words[at[live]] == words[live]
            out[live[hit]] = self.leaf_of[at[live[hit]]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out


def _branches(mass: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(bias, levels) of a tree that halves the mass; a level has (leaves that go on, the branch each comes to)."""
    total, n = np.append(0.0, np.cumsum(mass)), len(mass)
    bias = np.zeros(n, np.float32)
    leaf, low, high = np.arange(n), np.zeros(n, np.int64), np.full(n, n)
    levels = []
    while True:
        on = high - low > 1
        leaf, low, high = leaf[on], low[on], high[on]
        if not len(leaf):
            return bias, levels
        at = np.searchsorted(total, (total[low] + total[high]) / 2)
        at -= ((total[low] + total[high]) / 2 - total[at - 1] < total[at] - (total[low] + total[high]) / 2).astype(np.int64)
        at = np.clip(at, low + 1, high - 1)
        bias[at] = np.log((total[high] - total[at]) / (total[at] - total[low]))
        levels.append((leaf.astype(np.int32), at.astype(np.int32)))
        right = leaf >= at
        low, high = np.where(right, at, low), np.where(right, high, at)


def grow_tree(words: np.ndarray, counts: np.ndarray, tails: np.ndarray, rare: int) -> Tree:
    """``rare``: tokens outside the vocabulary; the shapes share them at first."""
    order = np.lexsort((words, tails))
    mass = np.append(counts[order].astype(float), np.full(SHAPES, rare / SHAPES + 1.0))
    n = len(mass)
    bias, levels = _branches(mass)
    top = np.unique(np.concatenate([at for _, at in levels[:TOP]]))
    way = np.full((n, TOP), 2 * len(top), np.int16)
    for k, (leaf, at) in enumerate(levels[:TOP]):
        way[leaf, k] = 2 * np.searchsorted(top, at) + (leaf >= at)
    ways, group_of = np.unique(way, axis=0, return_inverse=True)
    top_path, top_side = ways >> 1, np.where(ways == 2 * len(top), 0, 2 * (ways & 1) - 1).astype(np.float32)
    size = np.zeros(n, np.int64)
    for leaf, _ in levels[TOP:]:
        size[leaf] += 1
    below_at = np.append(0, np.cumsum(size))
    below = np.zeros(below_at[-1], np.int32)
    for k, (leaf, at) in enumerate(levels[TOP:]):
        below[below_at[leaf] + k] = at
    bits = max(1, len(words)).bit_length()
    place = np.argsort(words)
    leaf = np.empty(len(words), np.int64)
    leaf[order] = np.arange(len(words))
    slots = np.arange((1 << bits) + 1, dtype=np.float64)
    first_at = np.searchsorted((words[place] >> _U(64 - bits)).astype(np.int64), slots)
    return Tree(words[place], leaf[place].astype(np.int32), first_at, 64 - bits, bias, top, top_path, top_side, group_of.ravel().astype(np.int32), below, below_at)


def new_weights(entries: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(1)
    width = 2 * WINDOW * DIM
    return {
        "e": rng.normal(0, 0.3, (entries + 1, DIM)).astype(np.float32), "o": np.zeros((entries, DIM), np.float32), "ob": np.zeros((entries, 1), np.float32),
        "h": rng.normal(0, width**-0.5, (width, DIM)).astype(np.float32), "hb": np.zeros((1, DIM), np.float32),
    }


_SPARSE, _DENSE = ("e", "o", "ob"), ("h", "hb")


def _summed(rows: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sum of their gradients, and how often each came."""
    order = np.argsort(rows)
    mine = rows[order]
    at = _runs(mine)
    size = np.diff(np.append(at, len(mine)))
    return mine[at], _run_sums(g, order, at, size), size


def _row_starts(table: np.ndarray) -> np.ndarray:
    """Where each row begins in the flat table, as a column."""
    return np.arange(0, table.size, table.shape[1])[:, None]


class WindowNetwork:
    """log p(leaf | words around), and steps of training (Adagrad, one rate a row)."""

    def __init__(self, tree: Tree, weights: dict[str, np.ndarray]):
        self.tree, self.w = tree, {k: v.astype(np.float32) for k, v in weights.items()}  # copies
        self.path = tree.top_path.astype(np.int64)
        self.fixed = None

    def learn(self) -> WindowNetwork:
        self.speed = {k: np.full((len(v), 1) if k in _SPARSE else v.shape, 0.1, np.float32) for k, v in self.w.items()}
        self.hits = {k: np.zeros(len(self.w[k]), np.int32) for k in ("e", "o")}
        return self

    def freeze(self) -> WindowNetwork:
        """For scoring alone: the biases of all branches are added up once."""
        self.fixed = self._output()
        return self

    def _output(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The weights and biases of the top's branches, and all biases."""
        top, bias = self.tree.top, self.tree.bias + self.w["ob"][:, 0]
        return np.ascontiguousarray(self.w["o"][top].T), bias[top], bias

    def _hidden(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        around = ids[at[:, None] + _AROUND]
        x = self.w["e"].take(around.ravel(), axis=0).reshape(len(at), -1)
        return around, x, np.tanh(x @ self.w["h"] + self.w["hb"])

    def _branch(self, h: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, ...]:
        """The signed scores of the branches on the ways to the leaves: in the top (a row each) and below (flat)."""
        w, tree = self.w, self.tree
        group = tree.group_of[leaf]
        path, side = self.path.take(group, axis=0), tree.top_side.take(group, axis=0)
        top_o, top_bias, bias = self.fixed or self._output()
        score = h @ top_o
        score += top_bias
        first, size = tree.below_at[leaf], tree.below_at[leaf + 1] - tree.below_at[leaf]
        row = np.arange(len(leaf)).repeat(size)
        branch = tree.below[np.arange(len(row)) + (first - (np.cumsum(size) - size)).repeat(size)]
        o, hr = w["o"].take(branch, axis=0), h.repeat(size, axis=0)
        under = np.where(leaf.repeat(size) >= branch, np.float32(1), np.float32(-1))
        below = under * (np.einsum("ij,ij->i", hr, o) + bias.take(branch))
        top = side * score.ravel().take(np.minimum(path, len(tree.top) - 1) + _row_starts(score))
        return path, side, top, row, branch, under, below, o, hr

    def log_p(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log p of the leaves at places ``at`` of ``ids``, which has WINDOW borders at both ends."""
        return self._log_p(self._hidden(ids, at)[2], ids[at])

    def log_p_all(self, ids: np.ndarray) -> np.ndarray:
        """The same for every place of ``ids`` that is no border, but the WINDOW places at both ends."""
        n, w = len(ids) - 2 * WINDOW, self.w
        layer, e = w["h"].reshape(2 * WINDOW, DIM, DIM), w["e"].take(ids, axis=0)
        sums = w["hb"].repeat(n, axis=0)
        for k, place in enumerate(_AROUND.tolist()):
            sums += e[WINDOW + place : WINDOW + place + n] @ layer[k]
        inner = ids[WINDOW : WINDOW + n]
        words = inner != self.tree.entries
        return self._log_p(np.tanh(sums[words]), inner[words])

    def _log_p(self, h: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        _, side, top, row, _, _, below, _, _ = self._branch(h, leaf)
        cost = lambda s: np.log(1 + np.exp(-np.maximum(s, -60)))
        return -(cost(top) * np.abs(side)).sum(axis=1, dtype=np.float64) - np.bincount(row, cost(below), len(leaf))

    def train(self, ids: np.ndarray, at: np.ndarray) -> None:
        """One step up the log p of the leaves at ``at``."""
        w, tree = self.w, self.tree
        around, x, h = self._hidden(ids, at)
        path, side, top, row, branch, under, below, o, hr = self._branch(h, ids[at])
        wide = np.zeros((len(at), len(tree.top) + 1), np.float32)
        wide.ravel()[path + _row_starts(wide)] = side / (1 + np.exp(np.minimum(top, 60)))
        wide = wide[:, :-1]
        d = (under / (1 + np.exp(np.minimum(below, 60))))[:, None]
        dh = wide @ w["o"][tree.top]
        if len(row):
            start = _runs(row)
            dh[row[start]] += _run_sums(d * o, np.arange(len(row)), start, np.diff(np.append(start, len(row))))
        dz = dh * (1 - h * h)
        dx = (dz @ w["h"].T).reshape(-1, DIM)
        for k, g in (("h", x.T @ dz), ("hb", dz.sum(axis=0, keepdims=True))):
            g = g / len(at) ** 0.5
            self.speed[k] += g * g
            w[k] += 0.3 * SPEED * g / np.sqrt(self.speed[k])
        self._step("e", *_summed(around.ravel(), dx))
        used = np.bincount(path.ravel(), minlength=len(tree.top) + 1)[:-1]
        hit = np.flatnonzero(used)
        self._step("o", tree.top[hit], (wide.T @ h)[hit], used[hit])
        self._step("ob", tree.top[hit], wide.sum(axis=0)[hit, None], None)
        rows, g, hits = _summed(branch, d * hr)
        self._step("o", rows, g, hits)
        self._step("ob", rows, np.bincount(branch, d[:, 0], len(self.hits["o"]))[rows, None].astype(np.float32), None)

    def _step(self, k: str, rows: np.ndarray, g: np.ndarray, hits: np.ndarray | None) -> None:
        speed = self.speed[k][:, 0]
        now = speed.take(rows) + np.einsum("ij,ij->i", g, g) / np.float32(g.shape[1])
        speed[rows] = now
        g *= (SPEED / np.sqrt(now))[:, None]
        g += self.w[k].take(rows, axis=0)
        self.w[k][rows] = g
        if hits is not None:
            self.hits[k][rows] += hits.astype(np.int32)


def _encode(text: pa.Array, tree: Tree) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Per chunk of rows: leaves with WINDOW borders around each row, the places of the words in them, the first word of each
    row, and the spelling of the rarer words: (word, code) of each byte and end."""
    for data, starts, ends, first in _words(text):
        entry = tree.lookup(word_hashes(data, starts, ends)) if len(starts) else np.zeros(0, np.int64)
        rare = np.flatnonzero(entry < 0)
        shape = _shapes(data, starts[rare], ends[rare]) if len(rare) else rare
        entry[rare] = tree.words + shape
        rows = np.arange(len(first) - 1).repeat(np.diff(first))
        place = np.arange(len(entry)) + WINDOW * (rows + 1)
        ids = np.full(len(entry) + WINDOW * len(first), tree.entries, np.int64)
        ids[place] = entry
        long = ends[rare] - starts[rare] + 1
        word = np.arange(len(rare)).repeat(long)
        step = np.arange(len(word)) - (np.cumsum(long) - long).repeat(long)
        at = starts[rare].repeat(long) + step
        now = np.where(step == (long - 1).repeat(long), BYTES - 1, _LOWER[data[np.minimum(at, len(data) - 1)]])
        before = np.where(step == 0, BYTES - 1, _LOWER[data[np.maximum(at - 1, 0)]])
        yield ids, place, first, (rare, word, (shape.repeat(long) * BYTES + before) * BYTES + now)


_CHANGES = "part string, block long, at binary, hits binary, scale binary, change binary"


def _change(part: str, block: int, at: np.ndarray, hits: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
    """A row of ``_CHANGES``; each row of ``change`` has a scale and one byte a weight."""
    scale = np.abs(change).max(axis=1, initial=1e-12).astype(np.float32) / 127
    cells = (at.astype(np.uint16), hits.astype(np.uint32), scale, np.rint(change / scale[:, None]).astype(np.int8))
    return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([block], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], ["part", "block", "at", "hits", "scale", "change"])


def _read_change(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, hits, scale = np.frombuffer(row["at"], np.uint16), np.frombuffer(row["hits"], np.uint32), np.frombuffer(row["scale"], np.float32)
    return at.astype(np.int64), hits.astype(np.int64), np.frombuffer(row["change"], np.int8).reshape(len(at), -1) * scale[:, None]


def _train_rows(batches: Iterable[pa.RecordBatch], shared, again: int) -> Iterator[pa.RecordBatch]:
    """Trains on the task's rows; gives the changes of weights by blocks of ROWS rows, and the counts of spelling."""
    enter("training")  # drops the network of an earlier scoring
    tree, start = shared.value
    net = WindowNetwork(tree, start).learn()
    rng = np.random.default_rng(3)
    spelled = np.zeros(SHAPES * BYTES * BYTES, np.int32)
    kept, seen = [], 0

    def go(ids: np.ndarray, place: np.ndarray) -> None:
        nonlocal seen
        masked = place[rng.random(len(place)) < MASKED]
        done = 0
        while done < len(masked):
            at = masked[done : done + min(MOST, LEAST + seen // 32)]
            net.train(ids, at)
            done += len(at)
            seen += len(at)

    for b in batches:
        for ids, place, _, (_, _, code) in _encode(b.column(0), tree):
            c, n = np.unique(code, return_counts=True)
            spelled[c] += n.astype(np.int32)
            go(ids, place)
            if again > 1:
                kept.append((ids, place))
    for _ in range(again - 1):
        for part in kept:
            go(*part)
    if not spelled.any() and not seen:
        return
    for k, hits in (("e", net.hits["e"]), ("o", net.hits["o"]), ("ob", net.hits["o"])):
        for a in range(0, len(hits), ROWS):
            at = np.flatnonzero(hits[a : a + ROWS])
            if len(at):
                yield _change(k, a // ROWS, at, hits[a + at], net.w[k][a + at] - start[k][a + at].astype(np.float32))
    if seen:
        for k in _DENSE:
            change = (net.w[k] - start[k].astype(np.float32)).reshape(len(net.w[k]), -1)
            yield _change(k, 0, np.arange(len(change)), np.full(len(change), seen), change)
    codes = np.flatnonzero(spelled)
    for block in np.unique(codes >> 16).tolist():
        mine = codes[codes >> 16 == block]
        yield _change("spell", block, mine & 0xFFFF, spelled[mine], np.zeros((len(mine), 1)))


def _merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean change of each row of a block, weighted by how often tasks used it; spelling counts are summed."""
    part, block = key[0].as_py(), key[1].as_py()
    hits = change = None
    for b in parts:
        for row in b.to_pylist():
            at, n, c = _read_change(row)
            if hits is None:
                hits = np.zeros(1 << 16 if part == "spell" else max(ROWS, 2 * WINDOW * DIM), np.int64)
                change = np.zeros((len(hits), c.shape[1]))
            hits[at] += n
            if part != "spell":
                change[at] += c * n[:, None]
    at = np.flatnonzero(hits)
    yield _change(part, block, at, hits[at], change[at] / hits[at, None])


@dataclass
class Scorer:
    """A fitted model; ``spelling`` is log p(byte | shape, byte before)."""

    tree: Tree
    weights: dict[str, np.ndarray]
    spelling: np.ndarray


def fit_scorer(docs: DataFrame) -> Scorer:
    """Train on the column ``text`` of all rows."""
    context = docs.sparkSession.sparkContext
    counted = docs.select("text").mapInArrow(_count_words, "word long, n long, tail long").groupBy("word").agg(F.sum("n").alias("n"), F.min("tail").alias("tail"))
    counted = materialize(counted, "scoring")
    tokens = counted.agg(F.sum("n")).first()[0] or 0
    sizes = counted.where(F.col("n") >= MIN_COUNT).groupBy(F.least("n", F.lit(100_000)).alias("n")).count().orderBy(F.desc("n")).collect()  # at most 100,000 rows
    least, held = MIN_COUNT, 0
    for r in sizes:
        held += r["count"]
        if held > MAX_WORDS:
            least = r["n"] + 1
            break
    words = counted.where(F.col("n") >= least).toArrow()  # at most MAX_WORDS rows
    word, n, tail = (words.column(c).to_numpy() for c in ("word", "n", "tail"))
    tree = grow_tree(word.view(np.uint64), n, tail, int(tokens - n.sum()))
    weights = new_weights(tree.entries)
    small = lambda: {k: v.astype(np.float16) if k in _SPARSE else v for k, v in weights.items()}
    spelled = np.zeros(SHAPES * BYTES * BYTES, np.int64)
    again = int(np.clip(SMALL // max(tokens, 1), 1, 40))
    parts = docs.rdd.getNumPartitions()
    tasks = max(2 * context.defaultParallelism, -(-parts // TASKS))  # each sends its changes of the whole model
    for r in range(ROUNDS):
        shared = context.broadcast((tree, small()))
        rows = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == r).select("text")
        rows = rows.coalesce(tasks) if tasks < parts else rows
        changes = rows.mapInArrow(partial(_train_rows, shared=shared, again=again), _CHANGES).groupBy("part", "block").applyInArrow(_merge, _CHANGES)
        for x in changes.toArrow().to_pylist():  # the size of the model
            at, hits, change = _read_change(x)
            if x["part"] == "spell":
                spelled[(x["block"] << 16) + at] += hits
            else:
                weights[x["part"]][(0 if x["part"] in _DENSE else x["block"] * ROWS) + at] += change.astype(np.float32)
        shared.destroy()
    spelled = spelled.reshape(-1, BYTES) + 0.1
    spelling = np.log(spelled / spelled.sum(axis=1, keepdims=True)).astype(np.float32).reshape(-1)
    return Scorer(tree, small(), spelling)


_network: list[tuple[Scorer, WindowNetwork]] = []


def _worker_network(scorer: Scorer) -> WindowNetwork:
    """One per task, not one per batch."""
    if not _network or _network[0][0] is not scorer:
        _network[:] = [(scorer, WindowNetwork(scorer.tree, scorer.weights).freeze())]
    return _network[0][1]


def token_scores(text: pa.Array, scorer: Scorer) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per chunk of rows: log p of every token, and the first token of each row (rows + 1 entries)."""
    net = _worker_network(scorer)
    for ids, _, first, (rare, word, code) in _encode(text, scorer.tree):
        inside = range(WINDOW, len(ids) - WINDOW, SPAN)
        parts = [net.log_p_all(ids[a - WINDOW : min(a + SPAN, len(ids) - WINDOW) + WINDOW]) for a in inside]
        logp = np.concatenate(parts) if parts else np.zeros(0)
        logp[rare] += np.bincount(word, scorer.spelling[code], len(rare))
        yield logp, first


def _score_rows(batches: Iterable[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    enter("scoring")
    remember("scoring", _network.clear)
    for b in batches:
        sums, counts = [], []
        for logp, first in token_scores(b.column(1), shared.value):
            running = np.append(0.0, np.cumsum(logp))
            sums.append(running[first[1:]] - running[first[:-1]])
            counts.append(np.diff(first))
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        total = np.concatenate(sums) if sums else np.zeros(0)
        mean = pa.array(total / np.maximum(n, 1), pa.float64(), mask=n == 0)
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(total, pa.float64()), mean], ["doc_id", "n_words", "log_likelihood", "mean_log_prob"])


def score_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, log_likelihood (summed), mean_log_prob (per token)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with arrow_scope(docs.sparkSession) as done:
        shared = docs.sparkSession.sparkContext.broadcast(fit_scorer(docs))  # at most MAX_WORDS words
        scores = docs.mapInArrow(partial(_score_rows, shared=shared), "doc_id long, n_words long, log_likelihood double, mean_log_prob double")
        out = done(scores)
        shared.destroy()  # the scores are written
        return out
