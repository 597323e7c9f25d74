"""Exact vector search and similarity in double precision: SQL expressions, and blocks of vectors as matrices."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.shared import materialize
from riskloom.operators.graph import top_per_key

#: Vectors of a block; also the rows of a group among which leaders are chosen in turn, so that these make one block.
BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    """Inner product summed from left to right in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def normalized(a: Column) -> Column:
    """The unit vector; a zero vector stays."""
    size = norm(a)
    return F.when(size == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / size))


def _packed(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows (keys.., size, cols.., vector) that come sorted by keys and size as blocks (keys.., size, arrays of cols.., data)."""
    held, group = [], None

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            head = [_one(rows.column(k).slice(0, 1)) for k in range(keys)]
            whole = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), _one(rows.column(c))) for c in range(keys, rows.num_columns - 1)]
            values = _one(rows.column(rows.num_columns - 1)) if rows.column(keys - 1)[0].as_py() >= 0 else None
            data = b"" if values is None else values.flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()
            yield pa.RecordBatch.from_arrays([*head, *whole, pa.array([data], pa.binary())], names=[*rows.column_names[:-1], "data"])
            held.clear()

    n = 0
    for batch in batches:
        marks = list(zip(*(batch.column(k).to_pylist() for k in range(keys)), strict=True))
        start = 0
        for i in range(len(marks) + 1):
            if i == len(marks) or marks[i] != group or n + i - start == BLOCK:
                if i > start:
                    held.append(batch.slice(start, i - start))
                    n += i - start
                start = i
                if i < len(marks):
                    yield from close()
                    group, n = marks[i], 0
    yield from close()


def _one(column: pa.ChunkedArray) -> pa.Array:
    out = column.combine_chunks()
    return out if isinstance(out, pa.Array) else pa.concat_arrays(out.chunks)


def blocks(df: DataFrame, cols: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """Blocks (keys.., size, arrays of cols.., data) of up to ``BLOCK`` vectors of one length, in ``order``; vectors that are null or hold nulls have size -1."""
    whole = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    rows = df.select(*keys, F.when(whole, F.size("vector")).otherwise(-1).alias("size"), *cols, F.col("vector").cast("array<double>").alias("vector"))
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "size int", *(f"`{c}` array<{types[c]}>" for c in cols), "data binary"])
    return rows.sortWithinPartitions(*keys, "size", *order).mapInArrow(partial(_packed, keys=len(keys) + 1), schema)


def _matrix(data: pa.Scalar, n: int, size: int) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), "<f8").reshape(n, max(size, 0)) if size > 0 else np.zeros((n, 0))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row what ``dot`` gives: summed from left to right."""
    out = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for d in range(a.shape[1]):
            out += a[:, d] * b[:, d]
    return out


def _pair_dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``_dots`` of rows i of ``a`` with rows j of ``b``, some at a time."""
    parts = [slice(s, s + 50_000) for s in range(0, len(i), 50_000)]
    return np.concatenate([np.zeros(0), *(_dots(a[i[p]], b[j[p]]) for p in parts)])


def _products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """All inner products, and how far they may lie from those of ``_dots`` (0: not at all)."""
    with np.errstate(all="ignore"):
        if np.abs(a).max(initial=0) < 1e100 and np.abs(b).max(initial=0) < 1e100:  # so neither holds NaN
            return a @ b.T, 8 * np.finfo(float).eps * (a.shape[1] + 1) * np.linalg.norm(a, axis=1).max(initial=0) * np.linalg.norm(b, axis=1).max(initial=0)
        out = np.zeros((len(a), len(b)))
        for d in range(a.shape[1]):
            out += a[:, d, None] * b[None, :, d]
        return out, 0.0


def _best(batches: Iterator[pa.RecordBatch], k: int, least: float | None, but: bool) -> Iterator[pa.RecordBatch]:
    """The k best of each query in each pair of blocks; of equal scores those that come first."""
    floors: dict[int, np.ndarray] = {}
    for batch in batches:
        for r in range(batch.num_rows):
            row = {n: batch.column(n)[r] for n in batch.schema.names}
            ids, queries = row["id"].values, row["query"].values
            n, size, q_size = len(ids), row["size"].as_py(), row["q_size"].as_py()
            banned = np.zeros((len(queries), n), bool) if but else None
            if but:
                at: dict = {}
                for j, x in enumerate(ids.to_pylist()):
                    at.setdefault(x, []).append(j)
                for i, x in enumerate(row["but"].values.to_pylist()):
                    banned[i, at.get(x, [])] = True
            if size != q_size or size < 0:  # null scores come last
                if least is not None:
                    continue
                allowed = ~banned if but else np.ones((len(queries), n), bool)
                i, j = np.nonzero(allowed & (np.cumsum(allowed, 1) <= k))
                score = pa.nulls(len(i), pa.float64())
            else:
                q, x = _matrix(row["q_data"], len(queries), size), _matrix(row["data"], n, size)
                near, off = _products(q, x)
                key = np.where(np.isnan(near), np.inf, near)
                if but:
                    key[banned] = -np.inf
                floor = floors.setdefault(row["q_no"].as_py(), np.full(len(queries), -np.inf))
                here = np.partition(key, n - k, axis=1)[:, n - k] if n > k else np.full(len(queries), -np.inf)
                np.maximum(floor, here - off, out=floor)
                wanted = key >= floor[:, None] - off
                if least is not None:
                    wanted &= key >= least - off
                if but:
                    wanted &= ~banned
                i, j = np.nonzero(wanted)
                exact = _pair_dots(q, x, i, j)
                order = np.lexsort((j, -exact, ~np.isnan(exact), i))
                i, j, exact = i[order], j[order], exact[order]
                first = np.searchsorted(i, i)
                keep = np.arange(len(i)) - first < k
                if least is not None:
                    keep &= ~(exact < least)
                i, j = i[keep], j[keep]
                score = pa.array(exact[keep])
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(i)), ids.take(pa.array(j)), score], names=["query", "id", "score"])


def search(index: DataFrame, queries: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """(query, id, score): the k best of ``index`` (id, vector) per row of ``queries`` (query, qvec), ties to the smaller id.

    Blocks of vectors meet as matrices, so that only the best of a pair of blocks become rows; their scores are those
    of ``dot``. A column ``but`` of the queries names an id that a query leaves out.
    """
    spark = index.sparkSession
    but = "but" in queries.columns
    rows = blocks(index.select("id", "vector").repartition(2 * spark.sparkContext.defaultParallelism, "id"), ["id"], [], ["id"])
    asked = blocks(queries.withColumnRenamed("qvec", "vector"), ["query", "but"] if but else ["query"], [], ["query"])
    asked = materialize(asked.withColumnsRenamed({"size": "q_size", "data": "q_data"}).withColumn("q_no", F.monotonically_increasing_id()), "search-queries")
    kinds = dict(index.dtypes) | dict(queries.dtypes)
    found = rows.crossJoin(asked).mapInArrow(partial(_best, k=k, least=least, but=but), f"query {kinds['query']}, id {kinds['id']}, score double")
    return top_per_key(found, ["query"], [F.desc("score"), "id"], k)


def prototypes(labelled: DataFrame) -> DataFrame:
    """(label, vector): mean vector per label from (label, vector)."""
    flat = labelled.select("label", F.posexplode("vector").alias("i", "x"))
    mean = flat.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = mean.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))  # one entry per dimension
    return rows.select("label", F.transform("v", lambda e: e["x"]).alias("vector"))


def leader_clusters(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Greedy leader clustering: (id, leader) for items (id, place) and similar pairs (a, b).

    In order of ``place`` an item joins the first leader before it that is similar, else leads.
    Item j leads exactly when no similar item before it leads: recomputed until nothing changes.
    """
    place = items.select("id", "place")
    before = pairs.join(place.withColumnsRenamed({"id": "a", "place": "pa"}), "a").join(place.withColumnsRenamed({"id": "b", "place": "pb"}), "b")
    before = before.select(F.when(F.col("pa") < F.col("pb"), F.col("a")).otherwise(F.col("b")).alias("first"), F.when(F.col("pa") < F.col("pb"), F.col("b")).otherwise(F.col("a")).alias("then"), F.least("pa", "pb").alias("at"))
    before = materialize(before.where("first <> then").distinct(), "leader-pairs")
    leads = materialize(place.select(F.col("id").alias("first")), "leaders")
    mark = None
    while True:
        led = before.join(leads, "first", "left_semi").select(F.col("then").alias("first")).distinct()
        new = materialize(place.select(F.col("id").alias("first")).join(led, "first", "left_anti"), "leaders")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("first").cast("decimal(38,0)"))).first()
        leads = new
        if now == mark:
            break
        mark = now
    best = before.join(leads, "first", "left_semi").groupBy("then").agg(F.min_by("first", "at").alias("leader"))
    own = leads.select(F.col("first").alias("id"), F.lit(True).alias("leading"))
    out = items.join(own, "id", "left").join(best, F.col("id") == F.col("then"), "left")
    return out.select("id", F.when(F.col("leading"), F.col("id")).otherwise(F.col("leader")).alias("leader"))


def _similar(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows have an inner product of at least ``least`` (NaN counts as greatest, as in SQL)."""
    near, off = _products(a, b)
    out = near >= least  # NaN is looked at again below
    i, j = np.nonzero(~(np.abs(near - least) > off))
    out[i, j] = ~(_pair_dots(a, b, i, j) < least)
    return out


def _lead(table: pa.Table, least: float) -> pa.Table:
    """(id, place, leader) of one group's next rows, taken in turn."""
    table = table.sort_by([("place", "ascending"), ("id", "ascending")])
    n, size = len(table), table.column("size")[0].as_py()
    x = _one(table.column("vector")).flatten().to_numpy(zero_copy_only=False).reshape(n, size) if size > 0 else np.zeros((n, 0))
    leader, leads = np.full(n, -1), np.zeros(0, np.int64)
    for start in range(0, n, 512):
        some = np.arange(start, min(start + 512, n))
        if len(leads):
            hit = _similar(x[some], x[leads], least)
            leader[some] = np.where(hit.any(1), leads[hit.argmax(1)], -1)
        left = some[leader[some] < 0]
        alike = _similar(x[left], x[left], least)
        for i in range(len(left)):
            if leader[left[i]] < 0:
                follow = left[i + 1 :][alike[i, i + 1 :]]
                leader[follow[leader[follow] < 0]] = left[i]
                leader[left[i]] = left[i]
        leads = np.append(leads, left[leader[left] == left])
    ids = _one(table.column("id"))
    return table.append_column("leader", ids.take(pa.array(leader)))


def _follow(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(by, id, place, vector, leader) of a block's rows: the first of the leaders' block that is similar; who found one needs no vector any more."""
    for batch in batches:
        for r in range(batch.num_rows):
            row = {n: batch.column(n)[r] for n in batch.schema.names}
            ids, leads, size = row["id"].values, row["lead"].values, row["size"].as_py()
            x = _matrix(row["data"], len(ids), size)
            hit = _similar(x, _matrix(row["l_data"], len(leads), size), least)
            some = hit.any(1)
            leader = leads.take(pa.array(hit.argmax(1), mask=~some))
            count = np.where(some, 0, size)
            vectors = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(x[~some].ravel()))
            by = batch.column("by").slice(r, 1).take(pa.array(np.zeros(len(ids), np.int64)))
            yield pa.RecordBatch.from_arrays([by, pa.array(np.full(len(ids), size, np.int32)), ids, row["place"].values, vectors, leader], names=["by", "size", "id", "place", "vector", "leader"])


def leader_search(items: DataFrame, least: float, by: str) -> DataFrame:
    """Greedy leader clustering: (id, leader) for items (id, place, vector, ``by``), similar by an inner product of at least ``least`` within ``by``.

    As ``leader_clusters``, without a table of pairs: of the rows that follow no leader yet, the first of each group
    choose among themselves in turn, the others then meet those leaders in blocks. Leaders found later stand later, so
    the first similar one found is the first of all.
    """
    whole = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()) & F.col(by).isNotNull() & F.col("id").isNotNull()
    apart = items.where(~F.coalesce(whole, F.lit(False))).select("id", F.col("id").alias("leader"))  # similar to nothing
    open_ = items.where(whole).select(F.col(by).alias("by"), F.size("vector").alias("size"), "id", "place", F.col("vector").cast("array<double>").alias("vector"))
    parallel = 2 * items.sparkSession.sparkContext.defaultParallelism
    open_ = materialize(open_.repartition(parallel, "id"), "leader-open")
    kinds = dict(open_.dtypes)
    schema = f"by {kinds['by']}, size int, id {kinds['id']}, place {kinds['place']}, vector array<double>, leader {kinds['id']}"
    out = [apart]

    def lead(table: pa.Table) -> pa.Table:
        return _lead(table, least)

    while not open_.isEmpty():
        head = top_per_key(open_, ["by", "size"], ["place", "id"], BLOCK)
        head = materialize(head.groupBy("by", "size").applyInArrow(lead, schema), "leader-head")
        out.append(head.select("id", "leader"))
        rest = open_.join(head.select("id"), "id", "left_anti")
        leads = blocks(head.where("id = leader").repartition("by"), ["id", "place"], ["by"], ["place", "id"]).drop("place")
        leads = leads.select("by", "size", F.col("id").alias("lead"), F.col("data").alias("l_data"))
        met = blocks(rest, ["id", "place"], ["by"], []).join(leads, ["by", "size"])
        done = materialize(met.mapInArrow(partial(_follow, least=least), schema), "leader-met")
        out.append(done.where("leader is not null").select("id", "leader"))
        open_ = done.where("leader is null").drop("leader")
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result
