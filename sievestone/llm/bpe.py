"""Byte-level BPE: encoding by corpus-level merge replay, and decoding.

Each task gathers the distinct pre-tokens of a chunk of documents and replays the merges
over all of them at once.  An inverted index leads from each merge to the word positions where its
pair stands; merges are taken in rank order from a heap, each is applied to all its positions by
array operations, and only the pairs with the touched neighbours are looked up and
indexed anew.  Words' ids are kept for the chunks that follow.

Within a word the order is that of the library: always the lowest rank, leftmost first.
A merge whose result can stand in a pair of a lower rank than its own is therefore applied
to the first position of each word only, then put back into the heap.
"""

from __future__ import annotations

import base64
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.llm.common import binary_array, gathered, map_rows
from sievestone.session import table

RANKS = "byte_bpe_50k.tiktoken"
#: Chunks of text kept in a task, the longest that is kept, and bytes of words in one replay.
KEPT, LONGEST, REPLAY_BYTES = 300_000, 64, 8_000_000
_NONE = np.iinfo(np.int32).max
#: A space beside other white space; elsewhere a pre-token always begins at a space.
_UNSAFE = re.compile(r" \s|\s ")
#: The same for Arrow, whose \s knows ASCII only.
_UNSAFE_ARROW = r" [\s\p{Z}\x0b\x1c-\x1f\x{85}]|[\s\p{Z}\x0b\x1c-\x1f\x{85}] "
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Replay:
    """The merges of a rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        self.risky = set()
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = r
                    if i > 1 and a > r:
                        self.risky.add(a)
                    if len(token) - i > 1 and b > r:
                        self.risky.add(b)
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.merged = np.append(np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))[order], _NONE).astype(np.int32)
        self.bytes_of = {r: t for t, r in ranks.items()}

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.searchsorted(self.keys, key)
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), self.merged[at], _NONE)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each non-empty word."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        owner = np.repeat(np.arange(len(words)), sizes + 1)
        total = len(owner)
        tok = np.full(total + 1, -1, dtype=np.int64)  # a mark of -1 follows each word
        inside = np.ones(total, dtype=bool)
        inside[np.cumsum(sizes + 1) - 1] = False
        tok[:-1][inside] = self.single[np.frombuffer(b"".join(words), dtype=np.uint8)]
        nxt, prv = np.arange(1, total + 2), np.arange(-1, total)
        rank = np.full(total + 1, _NONE, dtype=np.int32)
        rank[:-1] = self.pair_ranks(tok[:-1], tok[1:])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(places: np.ndarray) -> None:
            found = rank[places]
            places, found = places[found != _NONE], found[found != _NONE]
            if not len(places):
                return
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            for r, part in zip(found[np.append(0, cuts)].tolist(), np.split(places, cuts), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        post(np.arange(total))
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            places = parts[0] if len(parts) == 1 else np.concatenate(parts)
            places = np.unique(places[rank[places] == r])
            if not len(places):
                continue
            if r in self.risky:
                first = np.unique(owner[places], return_index=True)[1]
                if len(first) < len(places):
                    index[r] = [np.delete(places, first)]
                    heapq.heappush(heap, r)
                    places = places[first]
            elif len(places) > 1:
                follows = nxt[places[:-1]] == places[1:]
                if follows.any():  # in a run of overlapping pairs, every second one
                    begin = np.append(True, ~follows)
                    runs = np.flatnonzero(begin)
                    at = np.arange(len(places)) - runs[np.cumsum(begin) - 1]
                    places = places[at % 2 == 0]
            second = nxt[places]
            after = nxt[second]
            tok[places], tok[second] = r, -2
            nxt[places], prv[after] = after, places
            rank[second] = _NONE
            before = prv[places]
            before = before[before >= 0]
            rank[before] = self.pair_ranks(tok[before], tok[nxt[before]])
            rank[places] = self.pair_ranks(tok[places], tok[after])
            post(np.concatenate((before, places)))
        alive = np.flatnonzero(tok[:-1] >= 0)
        counts = np.bincount(owner[alive], minlength=len(words))
        return np.split(tok[alive].astype("<u4"), np.cumsum(counts)[:-1])


class Encoder:
    """Texts to ids, as little-endian 32-bit bytes; keeps what it has encoded."""

    def __init__(self, replay: Replay, pattern: str):
        import regex

        self.replay, self.find = replay, regex.compile(pattern).findall
        self.inner: dict[str, bytes] = {}
        self.outer: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _learn(self, strings: list[str]) -> list[bytes]:
        """The ids of strings that stand alone."""
        split = [[s] if s[1:].isalpha() and s[0] == " " else self.find(s) for s in strings]
        words = self.words
        new = [w for w in set().union(*split) if w not in words]  # a difference of sets would go through all that is known
        ranks, slow, size = self.replay.ranks, [], 0

        def flush() -> None:
            nonlocal slow, size
            if slow:
                for (w, _), ids in zip(slow, self.replay.encode([b for _, b in slow]), strict=True):
                    self.words[w] = ids.tobytes()
            slow, size = [], 0

        for w in new:
            b = w.encode("utf-8")
            if b in ranks:
                self.words[w] = ranks[b].to_bytes(4, "little")
            else:
                slow.append((w, b))
                size += len(b)
                if size > REPLAY_BYTES:
                    flush()
        flush()
        made = [b"".join(map(self.words.__getitem__, x)) for x in split]
        if len(self.words) > KEPT:
            self.words = {}
        return made

    def _with(self, known: dict, strings: set, lead: str) -> dict:
        new = [s for s in strings if s not in known]
        made = dict(zip(new, self._learn([lead + s for s in new]), strict=True)) if new else {}
        keep = made if all(len(s) <= LONGEST for s in new) else {s: x for s, x in made.items() if len(s) <= LONGEST}
        known.update(keep)
        return known if keep is made else {**made, **known}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") if not _UNSAFE.search(t) else _SAFE_SPACE.split(t) for t in texts]
        if len(self.inner) + len(self.outer) > KEPT:
            self.inner, self.outer = {}, {}
        heads = [x.pop(0) for x in split]
        outer = self._with(self.outer, {h for h in heads if h}, "")
        inner = self._with(self.inner, set().union(*split), " ")
        get = inner.__getitem__
        return [(outer[h] if h else b"") + b"".join(map(get, rest)) for h, rest in zip(heads, split, strict=True)]

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """As `encode`, for an Arrow array without nulls; words are found and ids put together without a Python object for each."""
        plain = pc.invert(pc.match_substring_regex(texts, _UNSAFE_ARROW)).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        lengths = np.asarray(pc.list_value_length(split)).astype(np.int64)
        words, begins = split.flatten(), np.zeros(int(lengths.sum()), dtype=bool)
        begins[np.cumsum(lengths) - lengths] = True
        coded = words.filter(pa.array(~begins)).dictionary_encode()
        distinct, heads = coded.dictionary.to_pylist(), words.filter(pa.array(begins)).to_pylist()
        odd = self.encode(texts.filter(pa.array(~plain)).to_pylist())
        if len(self.inner) + len(self.outer) > KEPT:
            self.inner, self.outer = {}, {}
        outer = self._with(self.outer, {h for h in heads if h}, "")
        inner = self._with(self.inner, set(distinct), " ")
        # Each text is its head, or all of an odd text, and then its inner words.
        whole = np.empty(len(texts), dtype=object)
        whole[plain], whole[~plain] = [outer[h] if h else b"" for h in heads], odd
        values = list(map(inner.__getitem__, distinct)) + whole.tolist()
        sizes = np.ones(len(texts), dtype=np.int64)
        sizes[plain] = lengths
        first = np.zeros(int(sizes.sum()), dtype=bool)
        first[np.cumsum(sizes) - sizes] = True
        place = np.empty(len(first), dtype=np.int64)
        place[first], place[~first] = len(distinct) + np.arange(len(texts)), coded.indices.to_numpy()
        counts = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
        ids, ends = gathered(np.frombuffer(b"".join(values), dtype="<u4"), (np.cumsum(counts) - counts)[place], counts[place])
        return binary_array(ids, ends[np.cumsum(sizes) - 1] if len(sizes) else ends)


class Decoder:
    """Ids to bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        self.sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def decode(self, ids: bytes) -> bytes:
        own = np.frombuffer(ids, dtype="<u4")
        return gathered(self.flat, self.starts[own], self.sizes[own])[0].tobytes()

    def decode_all(self, ids: pa.Array) -> pa.Array:
        """As `decode`, for an Arrow array of ids' bytes without nulls."""
        ids = ids.cast(pa.large_binary())
        offsets = np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset : ids.offset + len(ids) + 1]
        own = np.frombuffer(ids.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]].view("<u4") if len(ids) else np.zeros(0, dtype="<u4")
        data, ends = gathered(self.flat, self.starts[own], self.sizes[own])
        return binary_array(data, np.append(0, ends)[(offsets[1:] - offsets[0]) // 4])


@lru_cache(maxsize=2)
def _replay(path: str) -> Replay:
    return Replay(read_ranks(path))


def _encode(path: str, pattern: str):
    def make():
        encoder = Encoder(_replay(path), pattern)
        return lambda texts: {"ids": encoder.encode_all(pc.fill_null(texts, ""))}

    return make


def _decode(path: str):
    def make():
        decoder = Decoder(read_ranks(path))
        return lambda ids: {"decoded": decoder.decode_all(pc.fill_null(ids, b""))}

    return make


def encode(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",), path: str | None = None) -> DataFrame:
    """The columns `keep` and `ids`: each whole text's ids as little-endian unsigned 32-bit integers (null: empty).

    Texts fall into the matches of the public pattern, on which the split at spaces rests.  Special tokens' strings are ordinary
    text.  Repeated rows have a row each, an empty table gives none, and extra columns may have any name.
    """
    import public_tokenizers

    return map_rows(docs, text, "ids binary", _encode(path or ranks_path(), public_tokenizers.PATTERN), list(keep), arrow=True)


def decode(encoded: DataFrame, ids: str = "ids", keep: tuple = ("doc_id", "ids"), path: str | None = None) -> DataFrame:
    """The columns `keep` and `decoded`: the bytes of each row's ids; null ids count as none.

    Repeated rows have a row each, an empty table gives none, and extra columns may have any name.
    """
    return map_rows(encoded, ids, "decoded binary", _decode(path or ranks_path()), list(keep), arrow=True)


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """The number of ids and digests of ids and decoded bytes of every row of `documents`."""
    return decode(encode(table(spark, sf_dir, "documents"))).select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
