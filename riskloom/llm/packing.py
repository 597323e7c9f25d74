"""Vector best-fit packing of token sequences.

A document is its token ids and one separator id. Documents longer than a sequence
are cut into full pieces and a rest; nothing else is cut. Pieces are then
placed, longest first, into bins under three capacities: tokens, documents and attention
cost (sum of squared piece lengths). Among the open bins in which a piece fits under
every constraint, the one with the least weighted norm of what would remain (or the greatest
weighted dot product of piece and residual) is taken.

Scale: pieces are dealt by a hash into groups of about GROUP_PIECES rows which are packed
on their own, so a task's memory is bounded and a group wastes at most about one bin.

Defined results: null or empty text is a document of the separator alone; repeated
rows are packed as often as they come; an empty table gives no rows; extra columns
are ignored; a piece that alone exceeds a capacity raises an error, as the limits
would make it impossible to place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskloom.functions.shared import materialize
from riskloom.llm.tokens import worker_encoder
from riskloom.llm.workers import arrow_scope, enter, remember

GROUP_PIECES = 16_000


@dataclass(frozen=True)
class Capacity:
    """Limits of a sequence; the attention cost of a full sequence is tokens squared."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)
    rule: str = "norm"  # or "dot"


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece."""
    limit = np.array([capacity.tokens, capacity.documents, capacity.attention], np.float64)
    weight = np.array(capacity.weights) / limit
    lengths = np.asarray(lengths, np.int64)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    if not len(lengths):
        return bins, offsets
    if lengths.max() > capacity.tokens or float(lengths.max()) ** 2 > capacity.attention or capacity.documents < 1:
        raise ValueError("a piece exceeds the capacity of an empty sequence")
    full = np.flatnonzero(lengths == capacity.tokens)  # nothing joins a full piece
    bins[full] = np.arange(len(full))
    order = np.argsort(-lengths, kind="stable")[len(full) :]
    least = int(lengths.min())
    room = np.empty((3, 1024))  # residual capacities of open bins, one row each, so that numpy works along the bins
    name = np.empty(1024, np.int64)
    n_open, used = 0, len(full)
    for i in order.tolist():
        size = int(lengths[i])
        item = np.array([size, 1.0, float(size) * size])
        at = -1
        if n_open:
            rest = room[:, :n_open] - item[:, None]
            fits = (rest[0] >= 0) & (rest[1] >= 0) & (rest[2] >= 0)
            if fits.any():
                if capacity.rule == "norm":
                    rest *= weight[:, None]
                    rest *= rest
                    score = -(rest[0] + rest[1] + rest[2])
                else:
                    score = (room[:, :n_open] * weight[:, None]).T @ (item * weight)
                score[~fits] = -np.inf
                at = int(score.argmax())
        if at < 0:
            if n_open == len(name):
                room, name = np.concatenate([room, np.empty_like(room)], axis=1), np.concatenate([name, np.empty_like(name)])
            at = n_open
            room[:, at], name[at] = limit, used
            n_open += 1
            used += 1
        bins[i], offsets[i] = name[at], capacity.tokens - int(room[0, at])
        room[:, at] -= item
        if room[0, at] < least or room[1, at] < 1 or room[2, at] < float(least) * least:
            n_open -= 1  # closed: nothing fits any more
            room[:, at], name[at] = room[:, n_open], name[n_open]
    return bins, offsets


def _piece_rows(batches: Iterable[pa.RecordBatch], tokenizer: str, tokens: int, separator: int) -> Iterator[pa.RecordBatch]:
    enter("token ids")
    remember("token ids", worker_encoder.cache_clear)
    encode = worker_encoder(tokenizer).encode
    end = int(separator).to_bytes(4, "little")
    for b in batches:
        docs, pieces, starts, lengths, sums = [], [], [], [], []
        texts = [t or "" for t in b.column(1).to_pylist()]
        for doc, ids in zip(b.column(0).to_pylist(), encode(texts), strict=True):
            ids += end
            for p, a in enumerate(range(0, len(ids), 4 * tokens)):
                part = ids[a : a + 4 * tokens]
                docs.append(doc)
                pieces.append(p)
                starts.append(a // 4)
                lengths.append(len(part) // 4)
                sums.append(zlib.crc32(part))
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def _pack_group(rows: pd.DataFrame, capacity: Capacity) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id", "piece", "start"], kind="stable")  # the same plan however rows arrive
    bins, offsets = best_fit(rows["length"].to_numpy(), capacity)
    return rows.assign(sequence_id=(rows["grp"].to_numpy() << 32) + bins, offset=offsets).drop(columns="grp")


def token_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", tokens: int = 2048, separator: int = 0) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        partial(_piece_rows, tokenizer=tokenizer, tokens=tokens, separator=separator), schema
    )


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: Capacity = Capacity(), separator: int = 0) -> DataFrame:  # noqa: B008
    """Every piece with its place: the pieces' columns, sequence_id and offset."""
    with arrow_scope(docs.sparkSession) as done:
        pieces = materialize(token_pieces(docs, tokenizer, capacity.tokens, separator), "pack-pieces")
        # a full piece is a sequence of its own wherever it goes, so groups are dealt by all pieces alike
        groups = max(1, -(-pieces.count() // GROUP_PIECES))

        def pack_group(rows: pd.DataFrame) -> pd.DataFrame:
            return _pack_group(rows, capacity)

        # equal rows (repeated documents) are spread by the partition they lie in as well
        dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", F.spark_partition_id()), F.lit(groups)))
        packed = dealt.groupBy("grp").applyInPandas(pack_group, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
        return done(packed)
