"""Token counts at every prefix, by dynamic programming over merge ranks.

The vocabulary's pre-tokenizer drops white space and cuts a text into runs of
letters, single digits and runs of other characters; a run is merged on its own.
For a run, ``open[i]`` is the token count of its first ``i`` bytes without the
end-of-word mark, and ``last[i]`` the last token. A token ``t`` that ends at ``i`` is the
last one exactly when it is compatible with ``last[i - len(t)]`` (the two would not
have merged), so ``open[i] = open[i - len(t)] + 1``; the count of the prefix as a
text of its own takes its last token from those with the mark. Runs share their
prefixes in a memo. A text's counts are those of its words one after another.

The counts are stored per code point and answer truncation ("longest prefix within a
budget") and budget ("tokens of this prefix") questions without encoding again.

Defined results: null text is empty and has no tokens; white space counts as the
prefix before it; special strings inside texts are the library's special
tokens; words that are not NFC or hold special strings are walked by characters, with a branch for
the prefixes that end before a mark which joins its letter; words whose count then differs from the library's take their
prefix counts from the library; repeated rows stay; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import string
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.llm.workers import arrow_scope, enter, remember

#: Words, runs and prefixes remembered by a Python worker; a full memo starts afresh.
MEMO_WORDS, MEMO_RUNS, MEMO_PREFIXES, MEMO_PAIRS, MEMO_STEMS, MEMO_ODD = 400_000, 300_000, 300_000, 300_000, 500_000, 300_000
#: Texts are cut at these characters only: white space for every version of Unicode.
_MARKS = string.punctuation


def _split(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_RUN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(name: str):
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the other cores run other tasks
    return Tokenizer.from_file(vocabulary_path(name))


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + extra)
            extra += 1
    return table


@lru_cache(1)
def _joining() -> frozenset[str]:
    """Characters that may join the one before in NFC: the second ones of all canonical pairs, and Hangul vowels and finals."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    second = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
    return frozenset(second | set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)])))


def _segments(text: str) -> Iterator[str]:
    """Cut before every character that neither joins what is before it nor moves past it in NFC."""
    joining, start = _joining(), 0
    for i in range(1, len(text)):
        if not unicodedata.combining(text[i]) and text[i] not in joining:
            yield text[start:i]
            start = i
    if start < len(text):
        yield text[start:]


class _Walk:
    """Token count of a text that grows by folded characters: the finished runs, and the run that is open."""

    def __init__(self, counter: PrefixCounter, done: int):
        self.counter, self.done, self.kind, self.run, self.before = counter, done, "", "", [None]

    def mark(self) -> tuple:
        return self.done, self.kind, self.run, self.before, len(self.before)

    def back(self, mark: tuple) -> None:
        self.done, self.kind, self.run, self.before, n = mark
        del self.before[n:]

    def total(self) -> int:
        if self.kind == "'":
            return self.done + sum(self.counter.run_counts(x)[-1] for x in (self.run[:1], self.run[1:]) if x)
        return self.done + (self.before[-1][2] if self.kind else 0)

    def close(self) -> None:
        self.done, self.kind = self.total(), ""

    def _extend(self, c: str) -> None:
        for x in c.encode():
            self.run += self.counter.byte_chars[x]
            self.before.append(self.counter._state(self.run, len(self.run), self.before))

    def _open(self, kind: str, c: str) -> None:
        self.kind, self.run, self.before = kind, "", [None]
        self._extend(c)

    def add(self, c: str) -> None:
        kind = "S" if c.isspace() else "L" if regex.match(r"\p{L}", c) else "N" if regex.match(r"\p{N}", c) else "O"
        if self.kind == "'":  # a mark that may begin a contraction, with its first letter if that has come
            grown = self.run + c
            if grown in _CONTRACTIONS:
                self.done, self.kind = self.done + self.counter.run_counts(grown)[-1], ""
                return
            if any(x.startswith(grown) for x in _CONTRACTIONS):
                self.run = grown
                return
            letter = self.run[1:]
            if letter or kind != "O":
                self.done += self.counter.run_counts("'")[-1]
                self.kind = ""
                if letter:
                    self._open("L", letter)
            else:
                self._open("O", "'")
        if kind == self.kind and kind != "N":
            self._extend(c)
            return
        self.close()
        if kind == "N":
            self._open("N", c)
        elif c == "'":
            self.kind, self.run = "'", c
        elif kind != "S":
            self._open(kind, c)


class _Words(dict):
    """Counts of words, computed when first asked for."""

    def __init__(self, count: Callable[[str], bytes | tuple[np.ndarray]]):
        super().__init__({"": b"\0"})
        self.count = count

    def __missing__(self, word: str) -> bytes | tuple[np.ndarray]:
        if len(self) > MEMO_WORDS:
            self.clear()
            self[""] = b"\0"
        found = self[word] = self.count(word)
        return found


class PrefixCounter:
    """Exact token counts of all prefixes of words."""

    def __init__(self, name: str):
        spec = json.load(open(vocabulary_path(name), encoding="utf-8"))
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab = model["vocab"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, self.specials)) or r"(?!)")
        self.library = load_tokenizer(name)
        n = max(self.vocab.values()) + 1
        self.left, self.right, self.pair = list(range(n)), list(range(n)), {}
        self.rank = [-1] * n  # -1: not made by a merge
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.pair.setdefault((x, y), r)
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        self.inner = {t: i for t, i in self.vocab.items() if not t.endswith(self.end)}
        self.final = {t.removesuffix(self.end): i for t, i in self.vocab.items() if t.endswith(self.end)}
        self.longest = max(map(len, self.vocab))
        self.byte_chars = _byte_chars()
        self.low = {c: chr(c).lower() for c in range(0x250)}  # per character, as the library folds
        self.states: dict[str, tuple[int, int, int]] = {}
        self.pairs: dict[int, bool] = {}
        self.runs: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}  # runs of the generation before
        self.words = _Words(self.word_counts)

    def compatible(self, x: int, y: int) -> bool:
        """Whether tokens x, y side by side stay two tokens: undo their merges, latest first."""
        limit = len(self.pair)
        while True:
            r = self.pair.get((x, y))
            if r is not None and r < limit:
                return False
            if self.rank[x] > self.rank[y]:
                limit, x = self.rank[x], self.right[x]
            elif self.rank[y] >= 0:
                # a merge in y comes before an equal one further right
                limit, y = self.rank[y] + 1, self.left[y]
            else:
                return True

    def _state(self, run: str, i: int, before: list) -> tuple[int, int, int]:
        """(count without the mark, last token, count with the mark) of run[:i], given those of shorter prefixes."""
        inner, final, pairs = self.inner, self.final, self.pairs
        open_count = last = end_count = 0
        for j in range(max(0, i - self.longest), i):
            t = run[j:i]
            if not open_count and (x := inner.get(t)) is not None:
                if not j:
                    open_count, last = 1, x
                else:
                    key = before[j][1] << 32 | x
                    good = pairs.get(key)
                    if good is None:
                        good = pairs[key] = self.compatible(before[j][1], x)
                    if good:
                        open_count, last = before[j][0] + 1, x
            if not end_count and (x := final.get(t)) is not None:
                if not j:
                    end_count = 1
                else:
                    key = before[j][1] << 32 | x
                    good = pairs.get(key)
                    if good is None:
                        good = pairs[key] = self.compatible(before[j][1], x)
                    if good:
                        end_count = before[j][0] + 1
            if open_count and end_count:
                return open_count, last, end_count
        raise ValueError(f"no token ends {run[:i]!r}")

    def run_counts(self, run: str) -> list[int]:
        """Counts of the prefixes of a run of byte characters, each as a text of its own."""
        states = self.states
        if len(states) > MEMO_PREFIXES:
            states.clear()
        if len(self.pairs) > MEMO_PAIRS:
            self.pairs.clear()
        before: list = [None]
        for i in range(1, len(run) + 1):
            p = run[:i] if i < 64 else ""  # long runs share nothing worth keeping
            found = states.get(p)
            if found is None:
                found = self._state(run, i, before)
                if p:
                    states[p] = found
            before.append(found)
        return [x[2] for x in before[1:]]

    def _walked(self, word: str) -> list[int] | None:
        """Counts of words that are not NFC or hold special strings; None if the library's count differs."""
        out: list[int] = []
        done = at = 0
        for m in [*self.special.finditer(word), None]:
            walk = _Walk(self, done)
            inside = len(word) if m is None else m.end() - 1  # an unfinished special string is plain text
            for part in _segments(word[at:inside]):
                start = walk.mark()
                for k in range(1, len(part) + 1):
                    walk.back(start)
                    for c in "".join(x.lower() for x in unicodedata.normalize("NFC", part[:k])):
                        walk.add(c)
                    out.append(walk.total())
            if m is not None:
                done = (out[m.start() - 1] if m.start() > at else done) + 1
                out.append(done)
                at = m.end()
        same = out[-1] == len(self.library.encode(word, add_special_tokens=False).ids)
        return out if same else None

    def _by_library(self, word: str) -> list[int]:
        """Every prefix encoded."""
        encode = self.library.encode_batch
        out: list[int] = []
        for a in range(0, len(word), 256):
            out += [len(e.ids) for e in encode([word[:i] for i in range(a + 1, min(a + 256, len(word)) + 1)], add_special_tokens=False)]
        return out

    def _letters(self, run: str) -> bytes | None:
        """Counts of a lower-case run of letters below U+0250 as bytes; None where they do not fit."""
        found = self.runs.get(run, 0)
        if found == 0:
            found = self.older.get(run, 0)
            if found == 0:
                found = bytes(self._run_chars(run)) if len(run) < 256 else None
            if len(self.runs) > MEMO_RUNS:
                self.older, self.runs = self.runs, {}
            self.runs[run] = found
        return found

    def _run_chars(self, run: str) -> list[int]:
        """run_counts at the ends of code points."""
        if run.isascii() and run.isalnum():
            return self.run_counts(run)
        every = self.run_counts("".join(self.byte_chars[x] for x in run.encode()))
        if run.isascii():
            return every
        return [every[s - 1] for s in accumulate(len(c.encode()) for c in run)]

    def word_counts(self, word: str) -> bytes | tuple[np.ndarray]:
        """Counts at every prefix of a word, and once more for the character after it; bytes if all are below 256."""
        stem = word[:-1] if word[-1] in ".," else word
        low = stem.lower()
        if stem.isalpha() and (stem.isascii() or len(low) == len(stem) and max(low) < "ɐ" > max(stem)) and (part := self._letters(low)):
            n = part[-1]
            return part + (bytes((n,)) if len(stem) == len(word) else bytes((n + 1, n + 1)))
        counts = self._dp(word) or self._walked(word) or self._by_library(word)
        counts.append(counts[-1])
        # no byte string, so that joining notices it
        return bytes(counts) if max(counts) < 256 else (np.array(counts, np.int32),)

    def _dp(self, word: str) -> list[int] | None:
        plain = max(word) < "ɐ"
        if not plain and (not unicodedata.is_normalized("NFC", word)) or "<|" in word and any(s in word for s in self.specials):
            return None
        low = [self.low[ord(c)] if c < "ɐ" else c.lower() for c in word]
        if any(len(c) != 1 for c in low):
            return None
        folded = "".join(low)
        out: list[int] = []
        done = 0
        for m in _RUN.finditer(folded):
            a, b = m.span()
            out += [done] * (a - len(out))  # white space of other kinds
            run = m.group()
            if run[0] == "'" and b - a > 1 and run[1].isalpha():  # a contraction: its parts count alone
                first = self.run_counts("'")[-1]
                part = [first] + [first + self.run_counts(run[1 : 1 + k])[-1] for k in range(1, b - a)]
                part[-1] = self.run_counts(run)[-1]
            else:
                part = self._run_chars(run)
            out += [done + x for x in part]
            done = out[-1]
        out += [done] * (len(word) - len(out))
        if not plain and done != len(self.library.encode(word, add_special_tokens=False).ids):
            return None
        return out

    def text_counts(self, text: str) -> np.ndarray:
        """Token count of text[:i] for every i from 1 on."""
        words = _split(text)
        try:
            joined = b"".join(map(self.words.__getitem__, words))
        except TypeError:  # counts beyond a byte
            joined, parts = None, [self.words[w] for w in words]
        if joined is None:
            counts = np.concatenate([x[0] if isinstance(x, tuple) else np.frombuffer(x, np.uint8).astype(np.int32) for x in parts])
        else:
            counts = np.frombuffer(joined, np.uint8).astype(np.int32)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        totals = counts[np.cumsum(sizes) - 1]
        counts += np.repeat(np.cumsum(totals, dtype=np.int32) - totals, sizes)
        return counts[:-1]


@lru_cache(1)
def _worker_counter(tokenizer: str) -> PrefixCounter:
    """One per Python worker, so that its memos serve all tasks there."""
    return PrefixCounter(tokenizer)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts of all prefixes as their steps: a byte that tells the width of a step (1 or 4 bytes), then the steps."""
    steps = np.diff(counts, prepend=0)
    kind = np.int8 if not len(steps) or (steps.min() >= -128 and steps.max() <= 127) else np.int32
    return bytes([kind().itemsize]) + steps.astype(kind).tobytes()


def unpack_counts(packed: bytes) -> np.ndarray:
    """The counts that ``pack_counts`` packed."""
    return np.cumsum(np.frombuffer(packed, f"<i{packed[0]}", offset=1), dtype=np.int64)


def _count_rows(batches: Iterable[pa.RecordBatch], tokenizer: str, limit: int, store: str) -> Iterator[pa.RecordBatch]:
    enter("prefix counts")
    remember("prefix counts", _worker_counter.cache_clear)
    counter = _worker_counter(tokenizer)
    for b in batches:
        n_bytes, n_tokens, cut, stored = [], [], [], []
        for text in b.column(1).to_pylist():
            text = text or ""
            counts = counter.text_counts(text)
            n_bytes.append(len(text.encode()))
            n_tokens.append(int(counts[-1]) if len(counts) else 0)
            within = np.flatnonzero(counts <= limit) if n_tokens[-1] > limit else ()
            cut.append(len(text) if n_tokens[-1] <= limit else (int(within[-1]) + 1 if len(within) else 0))
            if store:
                stored.append(counts if store == "array" else pack_counts(counts))
        columns = [b.column(0).cast(pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(cut, pa.int64())]
        names = ["doc_id", "n_bytes", "n_tokens", "cut_chars"]
        if store:
            columns.append(pa.array(stored, pa.list_(pa.int32()) if store == "array" else pa.binary()))
            names.append("prefix_tokens")
        yield pa.RecordBatch.from_arrays(columns, names)


def prefix_token_counts(
    docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, store: str = "array", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, cut_chars (longest prefix of at most ``limit``
    tokens, in code points) and prefix_tokens, the count at every prefix: an array, or with ``store="packed"`` a byte or four
    a code point (``unpack_counts`` reads them); ``store=""`` leaves it out."""
    kept = {"array": ", prefix_tokens array<int>", "packed": ", prefix_tokens binary", "": ""}[store]
    rows = docs.select(F.col(id_col).cast("long"), text_col)
    with arrow_scope(docs.sparkSession) as done:
        counts = rows.mapInArrow(partial(_count_rows, tokenizer=tokenizer, limit=limit, store=store), "doc_id long, n_bytes long, n_tokens long, cut_chars long" + kept)
        return done(counts)


def longest_prefix(prefix_tokens: Column, budget: int) -> Column:
    """Code points of the longest prefix with at most ``budget`` tokens, from stored counts."""
    return F.coalesce(
        F.array_max(F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i + 1).otherwise(0))), F.lit(0)
    )


def tokens_of_prefix(prefix_tokens: Column, chars: Column) -> Column:
    """Tokens of the first ``chars`` code points, from stored counts."""
    return F.when(chars <= 0, 0).otherwise(F.element_at(prefix_tokens, F.least(chars, F.size(prefix_tokens)).cast("int")))


class IdEncoder:
    """Texts to little-endian 32-bit token ids, with bounded memos of words and of their bare stems.

    Stems (lower-case letters below U+0250) are encoded many at a time in one text: each is
    one run, so its ids end at the token with the end-of-word mark.
    """

    def __init__(self, tokenizer: str):
        self.library = load_tokenizer(tokenizer)
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {"": b""}
        self.stems: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {"": b""}
        self.marks: dict[str, bytes] = {}

    def _plain(self, some: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(some, add_special_tokens=False)]

    def _encode_stems(self, some: list[str]) -> None:
        for k in range(0, len(some), 5000):
            part = some[k : k + 5000]
            ids = np.array(self.library.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cut = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cut) != len(part):
                raise RuntimeError("a stem was not one run")
            raw = ids.tobytes()
            self.stems.update(zip(part, map(raw.__getitem__, map(slice, [0, *cut[:-1]], cut)), strict=True))

    def _learn(self, fresh: set[str]) -> None:
        fresh.discard("")
        if len(self.words) + len(fresh) > MEMO_ODD:
            self.words = {"": b""}
        stems, older, derived, other, ask = self.stems, self.older, [], [], set()
        for w in fresh:
            bare = w.rstrip(_MARKS)  # what follows a run of letters is a run of its own
            low = bare.lower()
            if bare.isalpha() and (bare.isascii() or len(low) == len(bare) and max(low) < "ɐ" > max(bare)):
                derived.append((w, low))
                if low not in stems:
                    old = older.get(low)
                    if old is None:
                        ask.add(low)
                    else:
                        stems[low] = old
            elif w:
                other.append(w)
        self._encode_stems(list(ask))
        words, marks = self.words, self.marks
        if len(marks) > MEMO_ODD:
            marks.clear()
        ends = list({w[len(low) :] for w, low in derived}.difference(marks))
        marks.update(zip(ends, self._plain(ends), strict=True))
        for w, low in derived:
            words[w] = stems[low] + marks[w[len(low) :]]
        words.update(zip(other, self._plain(other), strict=True))

    @staticmethod
    def _runs(text: str) -> list[str] | None:
        """The runs of a plain text, or None: Latin-1 letters and digits, spaces, line ends and single . or , only.

        There a mark is always a run of its own, and folding the whole text is folding each word.
        """
        rest = text.replace(" ", "").replace("\n", "").replace(".", "").replace(",", "")
        if rest and not rest.isalnum() or ".." in text or ",," in text or ".," in text or ",." in text:
            return None
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return None
        return text.lower().replace(".", " . ").replace(",", " , ").replace("\n", " ").split(" ")

    def _learn_runs(self, fresh: set[str]) -> None:
        older, stems, ask, other = self.older, self.stems, [], []
        for w in fresh:
            old = older.get(w)
            if old is not None:
                stems[w] = old
            elif w.isalpha():
                ask.append(w)
            else:
                other.append(w)
        self._encode_stems(ask)
        stems.update(zip(other, self._plain(other), strict=True))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for a in range(0, len(texts), 200):
            part = texts[a : a + 200]
            runs = list(map(self._runs, part))
            if len(self.stems) > MEMO_STEMS:
                self.older, self.stems = self.stems, {"": b""}
            self._learn_runs(set().union(*[r for r in runs if r is not None]).difference(self.stems))
            split = {i: _split(part[i]) for i, r in enumerate(runs) if r is None}
            if split:
                fresh = set().union(*split.values())
                missing = fresh.difference(self.words)
                if len(self.words) + len(missing) > MEMO_ODD:
                    missing = fresh
                if missing:
                    self._learn(missing)
            get, get_run = self.words.__getitem__, self.stems.__getitem__
            for i, r in enumerate(runs):
                yield b"".join(map(get, split[i])) if r is None else b"".join(map(get_run, r))


@lru_cache(1)
def worker_encoder(tokenizer: str) -> IdEncoder:
    """One per Python worker, so that its memos serve all tasks there."""
    return IdEncoder(tokenizer)
