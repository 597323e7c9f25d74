"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Examples are a bounded sample of labelled rows (MAX_EXAMPLES per class, whole texts); only rows that ``may_learn`` allows are used. Terms are
words and their first HEAD bytes, cut at ASCII punctuation and white space, A-Z folded; the
vocabulary are all terms of the examples. A term's TF-IDF weight is scaled by its label association
(1 if G2 reaches MIN_G2, FLOOR otherwise), so none leaves the product or the norm, and a copy of an example has cosine 1
with it. Document frequencies are counted over all documents. A constant component stands beside the terms, so a text without any
has neighbours as well.

Every query meets every example: terms that many examples have by a dense matrix product, all others by
postings, so the K neighbours are exact
(all that tie with the K-th vote too). Their votes, weighted by similarity and by how many
labelled rows an example stands for, are calibrated by isotonic regression on the examples' own
leave-one-out votes. Labels, lang, source and doc_id are no input of a score.

Defined results: null, empty and term-free texts score like their nearest (term-free)
examples; without labels, or with one class only, every score is that class's rate (0
without labels); of texts that share a labelled doc_id the one of least term hashes teaches; repeated rows are scored alike; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.llm.textbytes import PUNCTUATION, mix, text_chunks, word_bounds, word_hashes
from riskloom.llm.workers import arrow_scope

MAX_EXAMPLES = 2000
MIN_G2, FLOOR, HEAD = 25.0, 0.05, 5
BLOCK, K, COMMON, TIE = 128, 25, 1 / 16, 1e-6
BIAS = 1.0
_U = np.uint64


def text_terms(text: pa.Array) -> Iterator[np.ndarray]:
    """The term hashes of every row, with repeats."""
    for _, data, off in text_chunks(text):
        starts, ends, first = word_bounds(data, off, PUNCTUATION)
        words = word_hashes(data, starts, ends)
        heads = mix(word_hashes(data, starts, ends, head=HEAD) ^ _U(0x1B873593))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.concatenate([words[a:b], heads[a:b]])


def _example_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        terms, counts = [], []
        for t in text_terms(b.column(2)):
            u, n = np.unique(t, return_counts=True)
            terms.append(u.tobytes())
            counts.append(n.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "toxic", "terms", "counts"])


def _vocabulary(sets: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted terms of all examples, and 1 for those that differ between the classes, FLOOR for others."""
    if not len(sets) or toxic.all() or not toxic.any():
        return np.zeros(0, _U), np.zeros(0)
    flat = np.concatenate(sets)
    mine = np.repeat(toxic, [len(s) for s in sets])
    terms, inverse = np.unique(flat, return_inverse=True)
    a = np.bincount(inverse, mine, len(terms))
    b = np.bincount(inverse, 1 - mine, len(terms))
    na, nb = float(toxic.sum()), float((1 - toxic).sum())
    rate = (a + b) / (na + nb)
    g2 = np.zeros(len(terms))
    for seen, n in ((a, na), (b, nb), (na - a, None), (nb - b, None)):
        if n is None:
            continue
        for x, p in ((seen, rate), (n - seen, 1 - rate)):
            with np.errstate(divide="ignore", invalid="ignore"):
                g2 += 2 * np.where(x > 0, x * np.log(x / (n * p)), 0)
    return terms, np.where(g2 >= MIN_G2, 1.0, FLOOR)


def term_vector(terms: np.ndarray, vocabulary: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF vector with the constant component: (positions, weights); position 0 is the constant."""
    weight, at = np.array([BIAS]), np.zeros(1, np.int64)
    if len(vocabulary) and len(terms):
        place = np.searchsorted(vocabulary, terms)
        place[place == len(vocabulary)] = 0
        found, n = np.unique(place[vocabulary[place] == terms], return_counts=True)
        at = np.append(at, found + 1)
        weight = np.append(weight, (1 + np.log(n)) * idf[found])
    return at, weight / np.sqrt((weight**2).sum())


class BlockMaxIndex:
    """Exact cosine of unit sparse vectors: common terms as a dense matrix, all others as postings."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.n, self.width = len(vectors), width
        owner = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        often = np.bincount(term, minlength=width) > max(8, COMMON * self.n)
        self.column = np.where(often, np.cumsum(often) - 1, -1)
        self.dense = np.zeros((int(often.sum()), self.n), np.float32)
        mine = often[term]
        self.dense[self.column[term[mine]], owner[mine]] = weight[mine]
        order = np.lexsort((owner[~mine], term[~mine]))
        self.owner, self.weight = owner[~mine][order].astype(np.int32), weight[~mine][order].astype(np.float32)
        self.at = np.searchsorted(term[~mine][order], np.arange(width + 1))

    def scores(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The cosine of every query (few at a time) with every vector."""
        common, out = np.zeros((len(vectors), len(self.dense)), np.float32), np.zeros((len(vectors), self.n), np.float32)
        for q, (terms, weights) in enumerate(vectors):
            column = self.column[terms]
            common[q, column[column >= 0]] = weights[column >= 0]
            rest, w = terms[column < 0], weights[column < 0]
            first, size = self.at[rest], self.at[rest + 1] - self.at[rest]
            place = np.arange(size.sum()) + (first - (np.cumsum(size) - size)).repeat(size)
            out[q] = np.bincount(self.owner[place], self.weight[place] * w.repeat(size), self.n)
        return out + common @ self.dense

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        score = self.scores([(terms, weights)])[0]
        ids = np.lexsort((np.arange(self.n), -score))[:k]
        return ids, score[ids]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing weighted fit by pooling adjacent violators: knots and values."""
    knots, inverse = np.unique(x, return_inverse=True)
    weight = np.bincount(inverse, w)
    value = np.bincount(inverse, w * y) / weight
    pools: list[list[float]] = []
    for i in range(len(knots)):
        pools.append([value[i], weight[i], 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, m, c = pools.pop()
            u = pools[-1]
            u[0] = (u[0] * u[1] + v * m) / (u[1] + m)
            u[1] += m
            u[2] += c
    return knots, np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


class ToxicityModel:
    """Index, votes and calibration."""

    def __init__(self, ids: list[int], toxic: np.ndarray, stands_for: np.ndarray, terms: list[np.ndarray], vocabulary: np.ndarray, idf: np.ndarray):
        vectors = [term_vector(t, vocabulary, idf) for t in terms]
        order = np.argsort(toxic, kind="stable")
        self.vocabulary, self.idf = vocabulary, idf
        self.ids = np.array(ids, np.int64)[order]
        self.toxic, self.stands_for = toxic[order].astype(float), stands_for[order]
        vectors = [vectors[i] for i in order]
        self.index = BlockMaxIndex(vectors, len(vocabulary) + 1)
        self.rate = float((self.toxic * self.stands_for).sum() / self.stands_for.sum()) if len(ids) else 0.0
        self.curve = None
        if 0 < self.rate < 1:
            own = np.concatenate([[v for v, _ in self.votes(vectors[a : a + BLOCK], skip=a)] for a in range(0, len(vectors), BLOCK)])
            self.curve = isotonic(own, self.toxic, self.stands_for)

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], skip: int | None = None) -> list[tuple[float, np.ndarray]]:
        """Vote and neighbours of each query; those from example ``skip`` on do not see themselves."""
        scores, out = self.index.scores(vectors), []
        for q, score in enumerate(scores):
            if skip is not None:
                score[skip + q] = -1
            ids = np.flatnonzero(score >= np.partition(score, -K)[-K] - TIE) if len(score) > K else np.arange(len(score))
            ids = ids[np.lexsort((ids, -score[ids]))]
            ids = ids[score[ids] >= 0]
            weight = self.stands_for[ids] * np.maximum(score[ids], 1e-9).astype(float) ** 4
            out.append((float((weight * self.toxic[ids]).sum() / weight.sum()) if len(ids) else self.rate, ids))
        return out

    def score(self, texts: list[np.ndarray]) -> list[tuple[float, list[int]]]:
        """Scores and nearest examples of at most BLOCK texts."""
        if self.curve is None:
            return [(self.rate, [])] * len(texts)
        votes = self.votes([term_vector(t, self.vocabulary, self.idf) for t in texts])
        return [(float(np.interp(vote, *self.curve)), self.ids[near[:5]].tolist()) for vote, near in votes]


def _df_rows(batches: Iterable[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    vocabulary = shared.value
    seen, rows = np.zeros(len(vocabulary), np.int64), 0
    for b in batches:
        for t in text_terms(b.column(0)):
            rows += 1
            if len(vocabulary) and len(t):
                place = np.searchsorted(vocabulary, t)
                place[place == len(vocabulary)] = 0
                seen[np.unique(place[vocabulary[place] == t])] += 1
    hit = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(seen[hit], rows))], ["term", "n"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, may_learn: Column) -> ToxicityModel:
    """``may_learn`` is a condition over ``labels`` columns."""
    marked = labels.where(F.col("toxic").isNotNull() & may_learn).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}  # two rows
    some = [marked.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_EXAMPLES) for c in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # at most 2 * MAX_EXAMPLES rows
    texts = docs.join(chosen, "doc_id").select("doc_id", "toxic", "text")
    rows = texts.mapInArrow(_example_rows, "doc_id long, toxic int, terms binary, counts binary").collect()
    order = lambda r: (r["doc_id"], bytes(r["terms"]), bytes(r["counts"]))
    rows = sorted({r["doc_id"]: r for r in sorted(rows, key=order, reverse=True)}.values(), key=order)  # one text an id
    sets = [np.frombuffer(r["terms"], _U) for r in rows]
    toxic = np.array([r["toxic"] for r in rows], np.int64)
    vocabulary, association = _vocabulary(sets, toxic)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    counts = docs.select("text").mapInArrow(partial(_df_rows, shared=shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = counts.toArrow()  # one row a term of the examples, and the number of documents at -1
    df = np.zeros(len(vocabulary) + 1)
    df[counts.column("term").to_numpy()] = counts.column("n").to_numpy()
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * association
    used = {c: max(1, int((toxic == c).sum())) for c in (0, 1)}
    stands_for = np.array([sizes.get(c, 0) / used[c] for c in toxic.tolist()])
    terms = [np.repeat(s, np.frombuffer(r["counts"], np.int32)) for s, r in zip(sets, rows, strict=True)]
    return ToxicityModel([r["doc_id"] for r in rows], toxic, stands_for, terms, vocabulary, idf)


def _score_rows(batches: Iterable[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model: ToxicityModel = shared.value
    for b in batches:
        found, held = [], []
        for t in text_terms(b.column(1)):
            held.append(t)
            if len(held) == BLOCK:
                found += model.score(held)
                held = []
        found += model.score(held) if held else []
        yield pa.RecordBatch.from_arrays(
            [b.column(0).cast(pa.int64()), pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(pa.int64()))], ["doc_id", "score", "evidence"]
        )


def score_toxicity(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None) -> DataFrame:
    """Per document: doc_id, score in [0, 1], evidence (ids of the nearest examples)."""
    may_learn = F.lit(True) if may_learn is None else may_learn
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with arrow_scope(docs.sparkSession) as done:
        shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, may_learn))  # at most 2 * MAX_EXAMPLES texts
        return done(docs.mapInArrow(partial(_score_rows, shared=shared), "doc_id long, score double, evidence array<long>"))
