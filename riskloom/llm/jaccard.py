"""N-gram Jaccard join with PartEnum signatures.

Two sets link when ``den * |A n B| >= num * |A u B|``. For two sets of one size
band (or neighbouring bands) at most ``k`` shingles differ. The shingle domain is cut
into ``n1`` ranges and each range into ``n2`` parts. At least ``n1 - floor(k / (k2 + 1))``
ranges hold at most ``k2`` differences, and in such a range one of the subsets of
``n2 - k2`` parts is the same on both sides. Each set emits a signature per range and
subset, so linked sets share one. With ``n1 = floor(k / (k2 + 1)) + 1 + e`` linked
sets agree in ``1 + e`` ranges; a set of which at most ``e`` ranges have a subset of
fewer than two shingles leaves such subsets out, which keeps near-empty ones from
pairing strangers, and still meets every partner in another range.

Scale: signatures are combined inside each map task (only the least set of a
bucket and a spanning forest travel on), a range of buckets yields a forest and never all
pairs. Their number is counted before, so that a range of them holds about PART_SIGNATURES and goes
to a task chosen by its number. A large candidate group, which shared passages may have chained together, is first cut by its sets' rarest shingles,
counted in the group: linked sets share one of as many as may differ, and one more. Candidate groups are then linked exactly in blocks of bounded size: first
inside each block, then between one member per (block, component). Where a group still has two components, the
sets outside its largest one visit the blocks that hold one of their rarest shingles. Nothing is dropped.

Defined results: null or empty text (or text without words) has an empty set,
links with nothing and is its own component; equal sets always link; repeated
``doc_id`` rows count as documents with the same id; rows without ``doc_id`` link like all others, and a component of such
rows alone has no id; extra columns are ignored;
an empty table gives no rows. Set ids are 64-bit hashes of the whole set.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.shared import drop_shuffles, materialize, release
from riskloom.llm.native import SPACES
from riskloom.llm.textbytes import mix, shingle_sets
from riskloom.llm.workers import arrow_scope, enter
from riskloom.operators.components import connected_components

#: Signatures held by a map task before they are combined and sent on.
FLUSH = 500_000
#: Signatures (or counted shingles) of a range; a task takes one range, or several in turn beyond MAX_TASKS ranges.
PART_SIGNATURES, LEAST_PARTS, MAX_TASKS = 1_000_000, 64, 20_000
#: Bounds of one block of a candidate group.
BLOCK_SHINGLES, BLOCK_DOCS = 4_000_000, 8192
#: A group beyond this share of a block's bounds is first cut by rare shingles.
CUT_SHARE = 8
_U = np.uint64


class Bands:
    """Size bands and partition numbers for a threshold of num / den.

    ``few`` says that few sets are left to sign, so that many signatures of large subsets are affordable.
    """

    def __init__(self, num: int, den: int, few: bool = False):
        if not 0 < num <= den:
            raise ValueError("the threshold must lie above 0 and at most 1")
        self.num, self.den, self.few, self.ends, self._parts = num, den, few, [0], {}

    def index(self, size: int) -> int:
        while self.ends[-1] < size:
            low = self.ends[-1] + 1
            self.ends.append(max(low, low * self.den // self.num * self.den // self.num))
        return int(np.searchsorted(self.ends, size))

    def differences(self, band: int) -> int:
        """The most differing shingles of a linked pair whose smaller set lies in ``band``."""
        self.index(self.ends[-1] if band < len(self.ends) else self.ends[-1] + 1)
        high = self.ends[band]
        return (high + high * self.den // self.num) * (self.den - self.num) // (self.den + self.num)

    def parts(self, band: int) -> tuple[int, int, int, int]:
        """(n1, n2, k2, e) for a band.

        Few differences: larger subsets of a few ranges. Many: three parts a range, one
        left out, and spare ranges for about two deviations of near-empty subsets.
        """
        if band not in self._parts:
            k = self.differences(band)
            if k < 8:
                k2 = min(k, 3)
                self._parts[band] = (k // (k2 + 1) + 1, k2 + 3, k2, 0)
            elif self.few:  # four of seven parts; some spare ranges
                base = k // 4 + 1
                e = int(0.15 * base)
                self._parts[band] = (base + e, 7, 3, e)
            elif k < 40:
                self._parts[band] = (k // 3 + 1, 5, 2, 0)
            else:
                base = k // 2 + 1
                middle = (self.ends[band - 1] + self.ends[band]) / 2
                e = 0
                while e < base:
                    mean = middle / (base + e) * 2 / 3
                    light = min(1.0, 2.6 * np.exp(-mean) * (1 + mean))
                    if e >= (base + e) * light + 2 * np.sqrt((base + e) * light * (1 - light)):
                        break
                    e += 1
                self._parts[band] = (base + e, 3, 1, e)
        return self._parts[band]

    def keys(self, size: int) -> list[int]:
        """Bands under which a set of this size emits: its own, and the one below if a linked set may lie there."""
        band = self.index(size)
        if band > 1 and self.num * size <= self.den * self.ends[band - 1]:
            return [band, band - 1]
        return [band]

    def count(self, size: int) -> int:
        """The most signatures of a set of this size."""
        out = 0
        for band in self.keys(size) if size else ():
            n1, n2, k2, _ = self.parts(band)
            out += n1 * comb(n2, k2) if self.differences(band) else 1
        return out


def set_id(s: np.ndarray) -> int:
    """A 64-bit id of a sorted set."""
    total = mix(np.array([np.sum(mix(s), dtype=_U) ^ mix(np.array([len(s)], _U))[0]], _U))
    return int(total.view(np.int64)[0])


@lru_cache
def _subsets(n2: int, k2: int) -> np.ndarray:
    """Columns mark the subsets of n2 - k2 out of n2 parts."""
    kept = list(combinations(range(n2), n2 - k2))
    out = np.zeros((n2, len(kept)), np.int64)
    for i, c in enumerate(kept):
        out[list(c), i] = 1
    return out


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    """PartEnum signatures of one sorted set of uint64 shingles."""
    out = []
    mixed = mix(s ^ _U(0x5851F42D4C957F2D))
    running = np.zeros(len(s) + 1, _U)
    np.cumsum(mixed, out=running[1:], dtype=_U)
    top = (s >> _U(11)).astype(np.float64)  # 53 bits, exact and in order
    for band in bands.keys(len(s)):
        n1, n2, k2, spare = bands.parts(band)
        if bands.differences(band) == 0:
            out.append(mix(running[-1:] + mix(np.array([band + 1], _U))))
            continue
        edges = np.searchsorted(top, np.arange(n1 * n2 + 1) * (2.0**53 / (n1 * n2)))
        edges[0], edges[-1] = 0, len(s)
        chosen = _subsets(n2, k2)
        count = np.diff(edges).reshape(n1, n2) @ chosen
        content = (running[edges[1:]] - running[edges[:-1]]).reshape(n1, n2) @ chosen.astype(_U)
        light = count < 2
        place = np.arange(content.size, dtype=_U).reshape(content.shape) + (_U(band) << _U(32))
        sig = mix(content + mix(place + _U(1)))
        if int(light.any(axis=1).sum()) <= spare:
            sig = sig[~light]
        out.append(sig.ravel())
    return np.unique(np.concatenate(out)) if len(out) > 1 else out[0]


#: The share of the shingle domain in which frequencies are counted for the prefilter: the hashes below this.
COUNTED = _U(2**64 // 3)


_DOCS = "doc_id long, th long, n_shingles long, sid long, n_counted long, n_sigs long"


def _doc_rows(batches: Iterable[pa.RecordBatch], width: int, num: int, den: int, few: bool) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, th, text): the size and id of each set, its counted shingles and the most signatures it may have."""
    enter("jaccard")
    bands = Bands(num, den, few)
    for b in batches:
        sizes, ids, counted, sigs = [], [], [], []
        for s in shingle_sets(b.column(2), width):
            sizes.append(len(s))
            ids.append(set_id(s) if len(s) else None)
            counted.append(int(np.searchsorted(s, COUNTED)))
            sigs.append(bands.count(len(s)))
        columns = [pa.array(c, pa.int64()) for c in (sizes, ids, counted, sigs)]
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), *columns], ["doc_id", "th", "n_shingles", "sid", "n_counted", "n_sigs"])


def _frequency_rows(batches: Iterable[pa.RecordBatch], width: int, parts: int) -> Iterator[pa.RecordBatch]:
    """The counted shingles of all sets by range: 32 hash bits each and the set they belong to."""
    held: list[np.ndarray] = []
    owners: list[int] = []
    n, seen = 0, set()

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        flat = np.concatenate(held)
        owner = np.repeat(np.array(owners, np.int64), [len(s) for s in held])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        edges = np.searchsorted(flat.astype(np.float64), np.arange(parts + 1) * (float(COUNTED) / parts))
        edges[0], edges[-1] = 0, len(flat)
        value = (mix(flat) & _U(0xFFFFFFFF)).astype(np.uint32)
        rows: list[tuple] = []
        for p in range(parts):
            a, b = edges[p], edges[p + 1]
            if b > a:
                who, place = np.unique(owner[a:b], return_inverse=True)
                kind = np.uint16 if len(who) < 65536 else np.uint32
                rows.append((p, value[a:b].tobytes(), len(who).to_bytes(4, "little") + who.tobytes() + place.astype(kind).tobytes()))
        held.clear()
        owners.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "vals", "ids"])

    for b in batches:
        for s in shingle_sets(b.column(0), width):
            if len(s) and (i := set_id(s)) not in seen:
                seen.add(i)
                held.append(s[: np.searchsorted(s, COUNTED)])
                owners.append(i)
                n += len(held[-1])
                if n >= FLUSH:
                    yield from flush()
                    n, seen = 0, set()
    yield from flush()


def _unpack_ids(i: bytes, n: int) -> np.ndarray:
    m = int.from_bytes(i[:4], "little")
    return np.frombuffer(i, np.int64, m, 4)[np.frombuffer(i, np.uint16 if m < 65536 else np.uint32, n, 4 + 8 * m)]


def _shared_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range and set: how many of its shingles another set may have too; sets without any give no row."""
    part, vals, ids = None, [], []

    def close() -> Iterator[pa.RecordBatch]:
        if vals:
            value, owner = np.concatenate(vals), np.concatenate(ids)
            vals.clear()
            ids.clear()
            order = np.argsort(value, kind="stable")
            value, owner = value[order], owner[order]
            twin = np.zeros(len(value), bool)
            same = value[1:] == value[:-1]
            twin[1:] |= same
            twin[:-1] |= same
            who, n = np.unique(owner[twin], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(n)], ["sid", "shared"])

    for b in batches:
        for p, v, i in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if p != part:
                yield from close()
                part, vals, ids = p, [], []
            vals.append(np.frombuffer(v, np.uint32))
            ids.append(_unpack_ids(i, len(v) // 4))
    yield from close()


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Pairs (least, other) that join the same ids as ``pairs`` do, one for each id but the least of its component."""
    if not len(pairs):
        return pairs
    nodes, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for hooked in (a, b, label[a], label[b]):
            np.minimum.at(new, hooked, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[label[other]], nodes[other]], 1)


def _star(sig: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct signatures, the least id of each, and a forest that joins the ids of each."""
    order = np.lexsort((ids, sig))
    sig, ids = sig[order], ids[order]
    new = np.append(True, sig[1:] != sig[:-1]) if len(sig) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    least = ids[at]
    mine = least[np.cumsum(new) - 1] if len(sig) else ids
    off = mine != ids
    return sig[at], least, _forest(np.stack([mine[off], ids[off]], 1))


_BLOB = pa.schema([("part", pa.int32()), ("sigs", pa.binary()), ("ids", pa.binary()), ("pairs", pa.binary())])


def _flush(held: list[tuple[np.ndarray, int]], parts: int) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    sig = np.concatenate([s for s, _ in held])
    ids = np.repeat(np.array([i for _, i in held], np.int64), [len(s) for s, _ in held])
    sig, least, pairs = _star(sig, ids)
    # signatures are sorted: a part is a range of them, and their top bits need not travel
    edges = np.searchsorted(sig >> _U(32), np.arange(parts + 1, dtype=np.float64) * (2.0**32 / parts))
    edges[0], edges[-1] = 0, len(sig)
    home = (pairs[:, 0].view(_U) % _U(parts)).astype(np.int64)
    rows: list[tuple] = []
    for p in range(parts):
        a, b = edges[p], edges[p + 1]
        own = pairs[home == p] if len(pairs) else pairs
        if b > a or len(own):
            who, place = np.unique(least[a:b], return_inverse=True)
            kind = np.uint16 if len(who) < 65536 else np.uint32
            low = sig[a:b]
            packed = (low & _U(0xFFFFFFFF)).astype(np.uint32).tobytes() + ((low >> _U(32)) & _U(0xFFFF)).astype(np.uint16).tobytes()
            rows.append((p, len(low).to_bytes(4, "little") + packed, len(who).to_bytes(4, "little") + who.tobytes() + place.astype(kind).tobytes(), own.tobytes()))
    held.clear()
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _BLOB.types, strict=True)], schema=_BLOB)


def _signature_rows(batches: Iterable[pa.RecordBatch], width: int, num: int, den: int, parts: int, few: bool) -> Iterator[pa.RecordBatch]:
    enter("jaccard")
    bands, held, n, seen = Bands(num, den, few), [], 0, set()
    for b in batches:
        for s in shingle_sets(b.column(0), width):
            if len(s) and (i := set_id(s)) not in seen:
                seen.add(i)  # copies within the flush emit once
                held.append((signatures(s, bands), i))
                n += len(held[-1][0])
                if n >= FLUSH:
                    yield from _flush(held, parts)
                    n, seen = 0, set()
    yield from _flush(held, parts)


def _candidate_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of each part to a forest that joins their ids; rows of one part come together."""
    part, sigs, ids, pairs = None, [], [], []

    def close() -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        found = [*pairs]
        if sigs:
            sig, who = np.concatenate(sigs), np.concatenate(ids)
            sigs.clear()
            ids.clear()
            found.append(_star(sig, who)[2])
        all_pairs = _forest(np.concatenate(found)) if found else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(all_pairs[:, 0]), pa.array(all_pairs[:, 1])], ["a", "b"])

    for b in batches:
        for p, s, i, q in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if p != part:
                yield from close()
                part, sigs, ids, pairs = p, [], [], []
            n = int.from_bytes(s[:4], "little")
            sigs.append(np.frombuffer(s, np.uint32, n, 4).astype(_U) | (np.frombuffer(s, np.uint16, n, 4 + 4 * n).astype(_U) << _U(32)))
            ids.append(_unpack_ids(i, n))
            pairs.append(np.frombuffer(q, np.int64).reshape(-1, 2))
    yield from close()


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def link_block(sets: list[np.ndarray], num: int, den: int, labels: list | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets``; ``labels`` marks sets already known to be joined.

    The most typical set goes first; after it only sets outside the largest
    component are compared with all, since every open pair has such an end.
    """
    n = len(sets)
    forest, links = _Forest(n), []
    if labels is not None:
        first: dict = {}
        for i, x in enumerate(labels):
            forest.join(first.setdefault(x, i), i)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(n, dtype=np.int32), size)[order]
    del order
    same = flat[1:] == flat[:-1]
    keep = np.append(same, False) | np.append(False, same)  # shingles of one set alone make no intersection
    flat, owner = flat[keep], owner[keep]
    del same, keep
    new = np.append(True, flat[1:] != flat[:-1])[: len(flat)]
    at = np.append(np.flatnonzero(new), len(flat))
    df = np.diff(at)
    term = (np.cumsum(new) - 1).astype(np.int32)
    del flat, new
    weight = np.bincount(owner, df[term], n)
    terms = term[np.argsort(owner, kind="stable")]
    ends = np.append(0, np.cumsum(np.bincount(owner, minlength=n)))
    del term

    def compare(i: int) -> None:
        t = terms[ends[i] : ends[i + 1]]
        if not len(t):
            return
        lens = df[t]
        index = np.arange(int(lens.sum())) + np.repeat(at[t] - np.append(0, np.cumsum(lens)[:-1]), lens)
        both = np.bincount(owner[index], minlength=n)
        for j in np.flatnonzero(den * both >= num * (size[i] + size - both)).tolist():
            if forest.join(i, j):
                links.append((i, j))

    todo = np.argsort(-weight, kind="stable").tolist()
    compare(todo[0])
    roots = [forest.find(i) for i in range(n)]
    largest = max(set(roots), key=roots.count) if n < 64 else int(np.bincount(roots).argmax())
    for i in todo[1:]:
        if roots[i] != largest:
            compare(i)
    return links


def _link_rows(batches: Iterable[pa.RecordBatch], width: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (group, sid, label, text) with the rows of a group together to forest links (a, b)."""
    group, sids, labels, sets, seen = None, [], [], [], set()

    def close() -> list[tuple[int, int]]:
        if len(sids) < 2 or len(set(labels)) < 2:
            return []
        return [(sids[i], sids[j]) for i, j in link_block(sets, num, den, labels)]

    for b in batches:
        out: list[tuple[int, int]] = []
        rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), shingle_sets(b.column(3), width), strict=True)
        for g, sid, label, s in rows:
            if g != group:
                out += close()
                group, sids, labels, sets, seen = g, [], [], [], set()
            if sid not in seen:  # rows that repeat an id may bring a set twice
                seen.add(sid)
                sids.append(sid)
                labels.append(label)
                sets.append(s)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])
    out = close()
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])


def _grouped_links(rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Link the sets of each group exactly; ``rows`` has (grp, sid, label, text)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(partial(_link_rows, width=width, num=num, den=den), "a long, b long")


def _group_shingle_rows(batches: Iterable[pa.RecordBatch], width: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (grp, sid, text) to the shingles by range, those of unlike groups told apart, with the sets they belong to and their sizes."""
    held: list[np.ndarray] = []
    owners: list[int] = []
    n, seen = 0, set()

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        sizes, ids = np.array([len(s) for s in held], np.int32), np.array(owners, np.int64)
        flat = np.concatenate(held)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(held)), sizes)[order]
        edges = np.searchsorted(flat >> _U(32), np.arange(parts + 1, dtype=np.float64) * (2.0**32 / parts))
        edges[0], edges[-1] = 0, len(flat)
        rows: list[tuple] = []
        for p in range(parts):
            a, b = edges[p], edges[p + 1]
            if b > a:
                who, place = np.unique(owner[a:b], return_inverse=True)
                kind = np.uint16 if len(who) < 65536 else np.uint32
                rows.append((p, flat[a:b].tobytes(), len(who).to_bytes(4, "little") + ids[who].tobytes() + place.astype(kind).tobytes(), sizes[who].tobytes()))
        held.clear()
        owners.clear()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _BLOB.types, strict=True)], ["part", "vals", "ids", "sizes"])

    for b in batches:
        for g, sid, s in zip(b.column(0).to_numpy().view(_U), b.column(1).to_pylist(), shingle_sets(b.column(2), width), strict=True):
            if sid not in seen:
                seen.add(sid)
                held.append(mix(s ^ mix(np.array([g], _U))))
                owners.append(sid)
                n += len(s)
                if n >= FLUSH:
                    yield from flush()
                    n, seen = 0, set()
    yield from flush()


def _key_rows(batches: Iterable[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Shingles of each range that several sets of a group have, as keys that order by frequency first, dealt by set."""
    part, vals, ids, sizes = None, [], [], []

    def close() -> Iterator[pa.RecordBatch]:
        if not vals:
            return
        value, owner, size = np.concatenate(vals), np.concatenate(ids), np.concatenate(sizes)
        order = np.argsort(value, kind="stable")
        value, owner, size = value[order], owner[order], size[order]
        at = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        times = np.diff(np.append(at, len(value)))
        times = np.repeat(times, times)
        many = times > 1
        value, owner, size = value[many], owner[many], size[many]
        level = np.minimum(127, 4 * np.log2(times[many])).astype(_U)  # a key is a function of shingle and group alone
        key = ((level << _U(56)) | (mix(value) >> _U(8))).view(np.int64)
        home = owner.view(_U) % _U(parts)
        order = np.argsort(home, kind="stable")
        owner, size, key = owner[order], size[order], key[order]
        edges = np.searchsorted(home[order], np.arange(parts + 1, dtype=_U))
        rows = [(p, key[a:b].tobytes(), owner[a:b].tobytes(), size[a:b].tobytes()) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _BLOB.types, strict=True)], ["part", "vals", "ids", "sizes"])

    for b in batches:
        for p, v, i, n in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if p != part:
                yield from close()
                part, vals, ids, sizes = p, [], [], []
            vals.append(np.frombuffer(v, _U))
            m = int.from_bytes(i[:4], "little")
            place = np.frombuffer(i, np.uint16 if m < 65536 else np.uint32, len(v) // 8, 4 + 8 * m)
            ids.append(np.frombuffer(i, np.int64, m, 4)[place])
            sizes.append(np.frombuffer(n, np.int32)[place])
    yield from close()


def rarest(owner: np.ndarray, size: np.ndarray, key: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of the least keys of each set, so many that linked sets have one in common.

    Linked sets share ceil(num / den * size) shingles or more, so the least they share is among the first
    size - ceil(num / den * size) + 1 of either. Shingles without a key (no other set has them) come first.
    """
    order = np.lexsort((key, owner))
    owner, size, key = owner[order], size[order].astype(np.int64), key[order]
    once = np.append(True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1]))[: len(owner)]
    owner, size, key = owner[once], size[once], key[once]
    at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)])
    count = np.diff(np.append(at, len(owner)))
    rank = np.arange(len(owner)) - np.repeat(at, count)
    first = rank < np.repeat(count, count) + 1 + (-num * size // den)
    return owner[first], key[first]


def _rarest_rows(batches: Iterable[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Keys dealt by set to the (sid, key) that ``rarest`` leaves."""
    part, vals, ids, sizes = None, [], [], []

    def close() -> Iterator[pa.RecordBatch]:
        if vals:
            owner, key = rarest(np.concatenate(ids), np.concatenate(sizes), np.concatenate(vals), num, den)
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(key)], ["sid", "key"])

    for b in batches:
        for p, v, i, n in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if p != part:
                yield from close()
                part, vals, ids, sizes = p, [], [], []
            vals.append(np.frombuffer(v, np.int64))
            ids.append(np.frombuffer(i, np.int64))
            sizes.append(np.frombuffer(n, np.int32))
    yield from close()


def _rare_keys(texts: DataFrame, total: int, width: int, num: int, den: int) -> DataFrame:
    """(sid, key): the rarest shingles of each set within its group; sets that have no partner there give no row.

    ``texts`` has (grp, sid, text), ``total`` is their number of shingles.
    """
    parts = max(LEAST_PARTS, -(-total // PART_SIGNATURES))
    schema = "part int, vals binary, ids binary, sizes binary"
    counted = _by_part(texts.select("grp", "sid", "text").mapInArrow(partial(_group_shingle_rows, width=width, parts=parts), schema), parts)
    keys = _by_part(counted.mapInArrow(partial(_key_rows, parts=parts), schema), parts)
    return materialize(keys.mapInArrow(partial(_rarest_rows, num=num, den=den), "sid long, key long"), "jaccard-rare")


def _by_part(rows: DataFrame, parts: int) -> DataFrame:
    """Rows of a part (0 .. parts - 1) together and in order; parts are dealt by number, so that none meet by chance."""
    tasks = min(parts, MAX_TASKS)
    return rows.repartitionById(tasks, (F.col("part").cast("long") * tasks / parts).cast("int")).sortWithinPartitions("part")


def _same_row(docs: DataFrame, keys: DataFrame) -> Column:
    """Join condition of a table with (doc_id, th) and one with (key_id, key_th)."""
    return docs["doc_id"].eqNullSafe(keys["key_id"]) & (docs["th"] == keys["key_th"])


def _components(docs: DataFrame, width: int, num: int, den: int, prefilter: bool) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): every row (doc_id, th, n_shingles, sid) of ``docs`` (doc_id, th, text), and each set's (sid, rep, label)."""
    spark = docs.sparkSession
    drop_shuffles(spark)
    table = materialize(docs.select("doc_id", "th", "text").mapInArrow(partial(_doc_rows, width=width, num=num, den=den, few=prefilter), _DOCS), "jaccard-docs")
    # the row that stands for a set: the least id, rows without id last
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    sets = table.where("sid is not null").groupBy("sid").agg(rep.alias("rep"), F.max("n_shingles").alias("n"), F.max("n_counted").alias("n_counted"), F.max("n_sigs").alias("n_sigs"))
    sets = materialize(sets, "jaccard-sets")
    key = lambda df: df.select("*", F.col("rep.doc_id").alias("key_id"), F.col("rep.th").alias("key_th"))
    named = docs
    if prefilter:
        total = sets.agg(F.sum("n_counted")).first()[0] or 0
        parts = max(LEAST_PARTS, -(-total // PART_SIGNATURES))
        counted = docs.select("text").mapInArrow(partial(_frequency_rows, width=width, parts=parts), "part int, vals binary, ids binary")
        shared = _by_part(counted, parts).mapInArrow(_shared_rows, "sid long, shared long").groupBy("sid").agg(F.sum("shared").alias("shared"))
        own = F.col("n_counted") - F.coalesce("shared", F.lit(0))
        open_sets = materialize(key(sets.join(shared, "sid", "left").where(den * own <= (den - num) * F.col("n"))).select("key_id", "key_th", "n_sigs"), "jaccard-open-sets")
        drop_shuffles(spark)
        total = open_sets.agg(F.sum("n_sigs")).first()[0] or 0
        keys = open_sets.hint("merge")
        named = materialize(docs.join(keys, _same_row(docs, keys), "left_semi"), "jaccard-open")
        drop_shuffles(spark)
    else:
        total = sets.agg(F.sum("n_sigs")).first()[0] or 0
    parts = max(LEAST_PARTS, -(-total // PART_SIGNATURES))
    blobs = named.select("text").mapInArrow(
        partial(_signature_rows, width=width, num=num, den=den, parts=parts, few=prefilter), "part int, sigs binary, ids binary, pairs binary"
    )
    pairs = materialize(_by_part(blobs, parts).mapInArrow(_candidate_rows, "a long, b long").distinct(), "jaccard-pairs")
    drop_shuffles(spark)
    groups = connected_components(pairs)  # candidate groups

    members = key(groups.join(sets, groups.node == sets.sid)).select("sid", F.col("component").alias("grp"), "key_id", "key_th", "n")
    members = materialize(members, "jaccard-members")
    # The text of each member's row (one text per distinct set), fetched once. Members grow with the corpus, so they are never
    # broadcast, whatever a small run allows.
    keys = members.hint("merge")
    texts = materialize(keys.join(named, _same_row(named, keys)).select("sid", "grp", "text"), "jaccard-texts")
    drop_shuffles(spark)
    if named is not docs:
        release(named)
    members = members.select("sid", "grp", "n")
    total = F.sum("n").alias("shingles")
    big = members.groupBy("grp").agg(F.count("*").alias("m"), total).where((F.col("m") > BLOCK_DOCS // CUT_SHARE) | (F.col("shingles") > BLOCK_SHINGLES // CUT_SHARE))
    big = materialize(big, "jaccard-big")
    shingles = big.agg(F.sum("shingles")).first()[0]
    if shingles is None:
        links = _grouped_links(texts.select("grp", "sid", F.col("sid").alias("label"), "text"), width, num, den)
        links = materialize(links, "jaccard-links")
    else:
        rare = _rare_keys(texts.join(big.select("grp"), "grp", "left_semi"), shingles, width, num, den)
        drop_shuffles(spark)
        least = rare.groupBy("key").agg(F.min("sid").alias("a"))
        cut = connected_components(materialize(rare.join(least, "key").where("a <> sid").select("a", F.col("sid").alias("b")).distinct(), "jaccard-pairs"))
        small = members.join(big.select("grp"), "grp", "left_anti").select("sid", "grp", "n")
        members = small.unionByName(cut.join(members, cut.node == members.sid).select("sid", F.col("component").alias("grp"), "n"))
        members = materialize(members, "jaccard-members")
        sizes = members.groupBy("grp").agg(F.count("*").alias("m"), total)
        sizes = sizes.withColumn("blocks", F.greatest(F.ceil(F.col("m") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int"))
        wanted = members.join(sizes.select("grp", "blocks"), "grp").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
        wanted = materialize(wanted.select("sid", "grp", "blocks", "block"), "jaccard-blocks")
        held = materialize(wanted.hint("merge").join(texts.select("sid", "text"), "sid").select("sid", "grp", "blocks", "block", "text"), "jaccard-held")
        release(texts)
        drop_shuffles(spark)
        links = _grouped_links(held.select(F.xxhash64("grp", "block").alias("grp"), "sid", F.col("sid").alias("label"), "text"), width, num, den)
        links = materialize(links, "jaccard-links")
        large = held.where("blocks > 1")
        if not large.isEmpty():
            links = _across_blocks(large, rare, links, width, num, den)
    drop_shuffles(spark)
    labels = connected_components(links)
    known = sets.join(labels, sets.sid == labels.node, "left").select("sid", "rep", F.coalesce("component", "sid").alias("label"))
    return table, known


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, num: int = 85, den: int = 100, prefilter: bool = False) -> DataFrame:
    """Every document with its shingle count and the least document id reachable over links.

    Returns (doc_id, n_shingles, component_id). With ``prefilter`` sets that cannot have a partner
    get no signatures: a linked set has at most (1 - threshold) of its shingles to itself, so one with
    more shingles of its own than that in the counted third of the domain has no link. The result is the
    same; it pays for low thresholds, whose many signatures have few shingles each.
    """
    with arrow_scope(docs.sparkSession) as done:
        table, known = _components(_keyed(docs, id_col, text_col), width, num, den, prefilter)
        known = known.join(known.groupBy("label").agg(F.min("rep.doc_id").alias("component_id")), "label").select("sid", "component_id")
        return done(table.join(known, "sid", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def one_per_component(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The row of least id of each group of near copies, with all its columns.

    Rows without words link with nothing and stay. Copies go whatever their ids are, rows of one id with unlike texts stay.
    Of rows equal in id and text one stays, the least in its other columns.
    """
    with arrow_scope(docs.sparkSession) as done:
        table, known = _components(_keyed(docs, "doc_id", "text"), width, num, den, True)
        best = known.groupBy("label").agg(F.min("rep").alias("rep")).select("rep.doc_id", "rep.th")
        twins = table.groupBy("doc_id", "th").agg(F.count("*").alias("rows"))
        keys = best.withColumnsRenamed({"doc_id": "key_id", "th": "key_th"})
        kept = done(keys.join(twins, _same_row(twins, keys)).select("key_id", "key_th", "rows"), "jaccard-kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"))
    words = F.length(F.btrim(F.col("row.text"), F.lit(SPACES)))
    keys = kept.hint("merge")
    found = rows.where(words > 0).join(keys, _same_row(rows, keys))
    alone = found.where("rows = 1").select("row")
    if not kept.where("rows > 1").isEmpty():
        alone = alone.unionByName(found.where("rows > 1").groupBy("doc_id", "th").agg(F.min("row").alias("row")).select("row"))
    return alone.unionByName(rows.where((words == 0) | words.isNull()).select("row")).select("row.*")


def _across_blocks(large: DataFrame, rare: DataFrame, links: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links between the blocks of groups that need more than one block; ``large`` has their texts, ``rare`` their sets' rarest shingles."""

    def labelled(found: DataFrame) -> DataFrame:
        named = connected_components(found)
        return large.join(named, large.sid == named.node, "left").select(*[large[c] for c in large.columns], F.coalesce("component", "sid").alias("label"))

    # one member for each (block, component), brought together in new blocks
    state = labelled(links)
    heads = state.groupBy("grp", "block", "label").agg(F.min("sid").alias("sid"))
    some = heads.groupBy("grp").agg(F.count("*").alias("heads"))
    cell = F.pmod(F.xxhash64("sid", F.lit(1)), F.ceil(F.col("heads") / BLOCK_DOCS)).cast("int")
    heads = heads.join(some, "grp").withColumn("cell", cell).join(large.select("sid", "text").hint("merge"), "sid")
    more = _grouped_links(heads.select(F.xxhash64("grp", "cell", F.lit("heads")).alias("grp"), "sid", "label", "text"), width, num, den)
    links = materialize(links.unionByName(more), "jaccard-links")
    # Where a group still has two components, every open pair has an end outside the group's largest
    # one, and its ends share one of their rarest shingles: those outsiders visit the blocks that hold one of theirs.
    state = materialize(labelled(links), "jaccard-state")
    sizes = state.groupBy("grp", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    state = state.join(main.where(F.col("all") > F.col("most")).select("grp", "main"), "grp")
    rows = state.select("grp", "block", "sid", (F.col("label") != F.col("main")).alias("outside")).hint("merge")
    least = rows.join(rare, "sid").select("grp", "block", "sid", "outside", F.col("key").alias("shingle"))
    homes = least.select("grp", "shingle", "block").distinct()
    asked = least.where("outside").select("grp", "shingle", "sid", F.col("block").alias("own"))
    visits = materialize(asked.join(homes, ["grp", "shingle"]).where("block <> own").select("grp", "block", "sid").distinct(), "jaccard-visits")
    cells = visits.groupBy("grp", "block").agg(F.ceil(F.count("*") / (BLOCK_DOCS // 2)).cast("int").alias("cells"))
    residents = state.join(cells, ["grp", "block"]).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    coming = visits.join(cells, ["grp", "block"]).withColumn("cell", F.pmod(F.xxhash64("sid", F.lit(2)), F.col("cells")).cast("int"))
    visitors = coming.join(state.select("sid", "label", "text").hint("merge"), "sid")
    columns = ["grp", "block", "cell", "sid", "label", "text"]
    met = residents.select(*columns).unionByName(visitors.select(*columns))
    more = _grouped_links(met.select(F.xxhash64("grp", "block", "cell", F.lit("visit")).alias("grp"), "sid", "label", "text"), width, num, den)
    return materialize(links.unionByName(more), "jaccard-links")
