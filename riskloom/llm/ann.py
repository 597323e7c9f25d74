"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors x become (x / M, sqrt(1 - |x|^2 / M^2)) with M the greatest norm, queries (q / |q|, 0), which
turns the largest inner product into the smallest Euclidean distance. Each of TABLES tables hashes
with ``bits`` p-stable functions floor((a . x + b) / width), a Gaussian. A query visits its bucket
and perturbed ones, one step up or down in some coordinates, in order of estimated success: the
expected squared distances to the sorted cell borders give one template of perturbation
sets, applied to each query's own order of borders. Candidates of all tables are merged and
ranked by their exact inner product in double precision.

The number of probes is fitted on at most SAMPLE_ROWS rows and SAMPLE_QUERIES queries so that
recall there reaches AIM against brute force; every row is indexed.

Scale: rows and probes meet by bucket in ``groups`` tasks; a task multiplies blocks of
queries and vectors and sends each query's best k on. A vector travels once to each group that holds one of its
buckets, in the precision it came in. Buckets beyond HOT rows (and a
thousandth of the table, so there are at most 1000 per table) are split by a salt and their probes
copied to each part. Queries whose buckets hold fewer than k vectors, though the table has more, meet all rows in blocks.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, as queries or candidates; a query has ``k`` rows, or all candidates if the table has
fewer; ties go to the smaller id; repeated ids count
once per query; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from riskloom.functions.shared import materialize
from riskloom.llm.textbytes import mix
from riskloom.llm.workers import arrow_scope

TABLES, WIDTH = 4, 2.5
SAMPLE_ROWS, SAMPLE_QUERIES, AIM = 20_000, 200, 0.96
HOT = 50_000
#: Components of the vectors of a group, and those gathered by a map task before they are dealt out.
GROUP_VALUES, FLUSH_VALUES = 2_500_000, 2_000_000
_U = np.uint64


def probe_template(bits: int, limit: int) -> list[tuple[int, ...]]:
    """Perturbation sets over the 2 * bits borders by rank, by falling expected success."""
    j = np.arange(1, bits + 1)
    low = j * (j + 1) / (4 * (bits + 1) * (bits + 2))
    high = 1 - j / (bits + 1) + low
    cost = np.append(low, high[::-1]).tolist()  # rank r and 2 * bits - 1 - r are sides of one coordinate
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < limit:
        c, s = heapq.heappop(heap)
        if all(2 * bits - 1 - r not in s for r in s):
            out.append(s)
        if s[-1] + 1 < 2 * bits:
            heapq.heappush(heap, (c - cost[s[-1]] + cost[s[-1] + 1], (*s[:-1], s[-1] + 1)))
            heapq.heappush(heap, (c + cost[s[-1] + 1], (*s, s[-1] + 1)))
    return out


@dataclass
class Hashing:
    """The hash functions of all tables."""

    dim: int
    bits: int
    scale: float  # greatest norm
    tables: int = TABLES
    width: float = WIDTH
    seed: int = 7
    probes: int = 1
    hot: dict[int, int] = field(default_factory=dict)  # bucket code -> parts

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.a = rng.standard_normal((self.dim + 1, self.tables * self.bits))
        self.b = rng.random(self.tables * self.bits) * self.width
        self.odd = rng.integers(1, 2**62, self.bits, dtype=np.uint64) * _U(2) + _U(1)

    def _cells(self, x: np.ndarray) -> np.ndarray:
        return ((x @ self.a + self.b) / self.width).reshape(len(x), self.tables, self.bits)

    def _code(self, cells: np.ndarray) -> np.ndarray:
        """int64 code of integer coordinates (..., tables, bits)."""
        table = mix(np.arange(self.tables, dtype=_U) + _U(1))
        return mix((cells.astype(np.int64).view(_U) * self.odd).sum(axis=-1, dtype=_U) + table).view(np.int64)

    def index_codes(self, x: np.ndarray) -> np.ndarray:
        norms = (x**2).sum(axis=1) / self.scale**2
        lifted = np.concatenate([x / self.scale, np.sqrt(np.maximum(0, 1 - norms))[:, None]], axis=1)
        return self._code(np.floor(self._cells(lifted)))

    def probe_codes(self, q: np.ndarray, probes: int | None = None) -> np.ndarray:
        """Codes (query, probe, table), most promising first."""
        unit = q / np.sqrt((q**2).sum(axis=1))[:, None]
        cells = self._cells(np.concatenate([unit, np.zeros((len(q), 1))], axis=1))
        base = np.floor(cells)
        down = cells - base
        border = np.concatenate([down, 1 - down], axis=2)  # distances to the lower and upper borders
        rank = np.argsort(border, axis=2, kind="stable")
        sets = probe_template(self.bits, probes or self.probes)
        out = np.empty((len(q), len(sets), self.tables), np.int64)
        rows, tables = np.ogrid[: len(q), : self.tables]
        for i, s in enumerate(sets):
            moved = base.copy()
            for r in s:
                side = rank[:, :, r]
                moved[rows, tables, side % self.bits] += np.where(side < self.bits, -1, 1)
            out[:, i] = self._code(moved)
        return out


def exact_top(q: np.ndarray, x: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
    """Brute force: positions of each query's k nearest; ``own`` is the query's position in x."""
    s = q @ x.T
    s[np.arange(len(q)), own] = -np.inf
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


def fit_probes(hashing: Hashing, x: np.ndarray, queries: np.ndarray, k: int) -> tuple[int, float]:
    """The least number of probes that reaches AIM on a sample, and its recall; ``queries`` are positions in x."""
    limit = 1024
    codes = hashing.index_codes(x)
    true = exact_top(x[queries], x, min(k, len(x) - 1), queries)
    asked = hashing.probe_codes(x[queries], limit)
    first = np.full(true.shape, asked.shape[1])  # the probe at which each true neighbour is met
    for i in range(len(queries)):
        for t in range(hashing.tables):
            order = np.argsort(asked[i, :, t], kind="stable")
            at = np.searchsorted(asked[i, order, t], codes[true[i], t])
            at[at == len(order)] = 0
            hit = asked[i, order[at], t] == codes[true[i], t]
            first[i] = np.where(hit, np.minimum(first[i], order[at]), first[i])
    recall = np.cumsum(np.bincount(first.ravel(), minlength=asked.shape[1] + 1)) / first.size
    probes = min(int(np.searchsorted(recall[:-1], AIM)) + 1, asked.shape[1])
    return probes, float(recall[probes - 1])


def usable(vector: Column, dim: int | None = None) -> Column:
    """Whether a vector takes part."""
    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = vector.isNotNull() & (F.size(vector) > 0) & whole & F.exists(vector, lambda v: v != 0)
    return F.coalesce(good if dim is None else good & (F.size(vector) == dim), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


_BLOB = "grp int, is_query boolean, ids binary, vectors binary, counts binary, codes binary"
_NAMES = ("grp", "is_query", "ids", "vectors", "counts", "codes")


def _blobs(ids: np.ndarray, x: np.ndarray, row: np.ndarray, code: np.ndarray, home: np.ndarray, is_query: bool, kind: str) -> Iterator[pa.RecordBatch]:
    """One row per group in ``home``: its ids and vectors, and the codes of each; entry i says that ``row[i]`` is under ``code[i]``.

    32 bits of a code travel: two buckets that agree in them are searched as one.
    """
    order = np.lexsort((row, home))
    row, code, home = row[order], code[order].astype(np.int32), home[order]
    out = []
    for a, b in zip(*(v.tolist() for v in _runs(home)), strict=True):
        mine, counts = np.unique(row[a:b], return_counts=True)
        out.append((int(home[a]), is_query, ids[mine].tobytes(), x[mine].astype(kind).tobytes(), counts.astype(np.int32).tobytes(), code[a:b].tobytes()))
    if out:
        kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], list(_NAMES))


def _by_code(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, groups: int, is_query: bool, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows by the group of their codes; codes is (rows, any)."""
    flat = codes.ravel()
    yield from _blobs(ids, x, np.repeat(np.arange(len(x)), codes.shape[1]), flat, (flat.view(_U) % _U(groups)).astype(np.int64), is_query, kind)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    at = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, np.int64)
    return at, np.append(at[1:], len(sorted_values)) if len(at) else at


def _gathered(batches: Iterable[pa.RecordBatch], values: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of at least ``values`` components at a time, but for the last ones."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        if len(b):
            held.append((b.column(0).to_numpy(), _matrix(b.column(1))))
            if sum(x.size for _, x in held) >= values:
                yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
                held = []
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _index_rows(batches: Iterable[pa.RecordBatch], hashing: Hashing, groups: int, kind: str) -> Iterator[pa.RecordBatch]:
    for ids, x in _gathered(batches, FLUSH_VALUES):
        codes = hashing.index_codes(x)
        for code, parts in hashing.hot.items():
            hit = codes == code
            salt = np.broadcast_to((ids % parts)[:, None], codes.shape)[hit]
            codes[hit] = mix(np.full(len(salt), code, np.int64).view(_U) ^ mix(salt.astype(_U))).view(np.int64)
        yield from _by_code(ids, x, codes, groups, False, kind)


def _query_rows(batches: Iterable[pa.RecordBatch], hashing: Hashing, groups: int, kind: str) -> Iterator[pa.RecordBatch]:
    some = max(16, FLUSH_VALUES // (hashing.probes * hashing.tables))
    for ids, x in _gathered(batches, some * hashing.dim):
        for a in range(0, len(ids), some):
            mine, q = ids[a : a + some], x[a : a + some]
            codes = hashing.probe_codes(q).reshape(len(q), -1)
            yield from _by_code(mine, q, codes, groups, True, kind)
            for code, parts in hashing.hot.items():
                who = np.flatnonzero((codes == code).any(axis=1))
                if len(who):
                    salted = mix(np.full(parts, code, np.int64).view(_U) ^ mix(np.arange(parts, dtype=_U))).view(np.int64)
                    yield from _by_code(mine[who], q[who], np.tile(salted, (len(who), 1)), groups, True, kind)


def _block_rows(batches: Iterable[pa.RecordBatch], blocks: int, is_query: bool, kind: str) -> Iterator[pa.RecordBatch]:
    """Every row under one code: vectors in one block each, queries in all."""
    for ids, x in _gathered(batches, FLUSH_VALUES // (blocks if is_query else 1)):
        n = len(ids)
        if is_query:
            row, home = np.tile(np.arange(n), blocks), np.repeat(np.arange(blocks), n)
        else:
            row, home = np.arange(n), (mix(ids.view(_U)) % _U(blocks)).astype(np.int64)
        yield from _blobs(ids, x, row, np.zeros(len(row), np.int64), home, is_query, kind)


def _code_rows(batches: Iterable[pa.RecordBatch], hashing: Hashing) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if len(b):
            code, n = np.unique(hashing.index_codes(_matrix(b.column(0))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])


class _Best:
    """The best k candidates of each query, pruned as they come; ties go to the smaller id."""

    def __init__(self, q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.x, self.ids, self.k = q, x, ids, k
        self.floor = np.full(len(q), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, query: np.ndarray, row: np.ndarray) -> None:
        self.held.append((query, row))
        self.size += len(query)
        if self.size > 2 * self.k * len(self.q) + 200_000:
            self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        query, row = (np.concatenate(c) for c in zip(*self.held, strict=True))
        pair = np.unique(query * len(self.ids) + row)  # a pair may meet in several tables
        query, row = np.divmod(pair, len(self.ids))
        # row by row, so that equal vectors get equal scores
        score = np.concatenate([np.einsum("ij,ij->i", self.q[query[a : a + 50_000]], self.x[row[a : a + 50_000]]) for a in range(0, len(pair), 50_000)] or [np.zeros(0)])
        order = np.lexsort((self.ids[row], -score, query))
        query, row, score = query[order], row[order], score[order]
        start, end = _runs(query)
        full = end - start >= self.k
        # block products differ from these in the last bits
        self.floor[query[start[full]]] = score[start[full] + self.k - 1] - 1e-9
        keep = np.arange(len(query)) - np.repeat(start, end - start) < self.k
        self.held, self.size = [(query[keep], row[keep])], int(keep.sum())
        return query[keep], row[keep], score[keep]


def _meet(batches: Iterable[pa.RecordBatch], dim: int, k: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Exact scores of what meets in a bucket; rows of a group come together."""
    names = ["query_id", "vec_id", "score"]

    def side(parts: list[tuple[bytes, bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids = [np.frombuffer(p[0], np.int64) for p in parts]
        shift = np.append(0, np.cumsum([len(i) for i in ids]))
        row = np.concatenate([np.arange(len(i)).repeat(np.frombuffer(p[2], np.int32)) + s for p, i, s in zip(parts, ids, shift, strict=False)])
        code = np.concatenate([np.frombuffer(p[3], np.int32) for p in parts])
        order = np.argsort(code, kind="stable")
        x = np.concatenate([np.frombuffer(p[1], kind).reshape(-1, dim) for p in parts]).astype(np.float64)
        return np.concatenate(ids), x, row[order], code[order]

    def close(held: dict[bool, list]) -> Iterator[pa.RecordBatch]:
        if not held[True] or not held[False]:
            return
        ids, x, row, code = side(held[False])
        q_ids, q, q_row, q_code = side(held[True])
        at, end = _runs(code)
        q_at, q_end = _runs(q_code)
        _, mine, theirs = np.intersect1d(code[at], q_code[q_at], assume_unique=True, return_indices=True)
        best = _Best(q, x, ids, k)
        for m, t in zip(mine.tolist(), theirs.tolist(), strict=True):
            rows = row[at[m] : end[m]]
            for a in range(q_at[t], q_end[t], 2048):
                some = q_row[a : min(a + 2048, q_end[t])]
                for c in range(0, len(rows), 4096):
                    block = rows[c : c + 4096]
                    score = q[some] @ x[block].T
                    i, j = np.nonzero(score >= best.floor[some][:, None])
                    i_q, j_r = some[i], block[j]
                    other = q_ids[i_q] != ids[j_r]
                    best.add(i_q[other], j_r[other])
        query, found, score = best.prune()
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[query]), pa.array(ids[found]), pa.array(score)], names)

    group, held = None, {True: [], False: []}
    for b in batches:
        for g, is_query, *parts in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if g != group:
                yield from close(held)
                group, held = g, {True: [], False: []}
            held[is_query].append(tuple(parts))
    yield from close(held)


def fit_hashing(rows: DataFrame, k: int) -> Hashing | None:
    """Hash functions for a table (id, vector), fitted on a bounded sample; None without usable vectors."""
    sizes = rows.where(usable(F.col("vector"))).groupBy(F.size("vector").alias("dim")).count()
    top = sizes.orderBy(F.desc("count"), "dim").first()
    if top is None:
        return None
    dim, n = top["dim"], top["count"]
    good = rows.where(usable(F.col("vector"), dim))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    scale = good.agg(F.max(norm)).first()[0]
    sample = good.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toArrow()
    x = _matrix(sample.column("vector").combine_chunks())
    asked = np.arange(min(SAMPLE_QUERIES, len(x)))
    bits = int(np.clip(np.round(np.log2(max(n, 2) / 40)), 2, 16))
    while True:
        hashing = Hashing(dim, bits, scale * (1 + 1e-9))
        if len(x) < 3:
            hashing.probes = 3**bits
            return hashing
        hashing.probes, recall = fit_probes(hashing, x, asked, k)
        if recall >= AIM or bits == 1:
            return hashing
        bits -= 1  # larger buckets


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query row's k nearest found: (query_id, rank, vec_id, score), the query itself left out."""
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    single = dict(rows.dtypes)[vector_col] == "array<float>"
    vector = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    marked = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), is_query.alias("asks"))
    with arrow_scope(spark) as done:
        hashing = fit_hashing(marked, k)
        if hashing is None:
            return spark.createDataFrame([], schema)
        kind = "<f4" if single else "<f8"
        good = marked.where(usable(F.col("vector"), hashing.dim))
        size = good.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).first()
        n = size["n"]
        floor = max(HOT, n // 1000)
        codes = good.select("vector").mapInArrow(partial(_code_rows, hashing=hashing), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
        hashing.hot = {r["code"]: -(-r["n"] // floor) for r in codes.where(F.col("n") > floor).collect()}  # at most 1000 a table
        asking = good.where("asks").select("id", "vector")

        def meet(index: Callable, queries: Callable, asked: DataFrame, groups: int) -> DataFrame:
            sides = good.select("id", "vector").mapInArrow(index, _BLOB).unionByName(asked.mapInArrow(queries, _BLOB))
            met = sides.repartitionById(groups, "grp").sortWithinPartitions("grp")
            found = met.mapInArrow(partial(_meet, dim=hashing.dim, k=k, kind=kind), "query_id long, vec_id long, score double")
            return materialize(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "ann-found")

        groups = max(16, n * hashing.tables * hashing.dim // GROUP_VALUES)
        options = {"hashing": hashing, "groups": groups, "kind": kind}
        found = meet(partial(_index_rows, **options), partial(_query_rows, **options), asking, groups)
        enough = found.groupBy("query_id").count().where(F.col("count") >= min(k, size["ids"] - 1))
        short = materialize(asking.join(enough, F.col("id") == F.col("query_id"), "left_anti"), "ann-short")
        if size["ids"] > 1 and not short.isEmpty():
            blocks = max(1, n * hashing.dim // GROUP_VALUES)
            options = {"blocks": blocks, "kind": kind}
            rest = meet(partial(_block_rows, is_query=False, **options), partial(_block_rows, is_query=True, **options), short, blocks)
            found = found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
        return done(ranked.select("query_id", "rank", "vec_id", "score"))
