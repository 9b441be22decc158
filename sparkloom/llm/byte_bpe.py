"""Byte-level BPE encoding and decoding by merge ranks.

Texts are cut into words by the usual byte-level pattern, worked out on arrays of character kinds; only distinct words are
encoded, by folding ranked merges over their bytes: again and again the adjacent pair of least rank is merged, leftmost
first, until no pair is in the rank map. The fold runs over many words at once, one array row a word. Decoding puts the
binary pieces of the ids one after another.

``fold_column`` is the same fold as a Spark column of higher-order functions with the rank map as a literal. It gives the
same ids, at about ten times the cost a word, so the operator uses the array form (figures are in the README).

A worker keeps the ids of up to ``CACHED`` distinct words between batches; beyond, it starts anew, so memory is bounded and
results do not change. Nothing is shuffled: every text is encoded where it is read.

Words are told apart by 64-bit hashes, and what the ids decode to is compared with the text: if it is not the same, every
word is folded for itself.

Cases: a null or empty text has no ids and decodes to no bytes; one very long word is folded with a heap, and a very long text
goes through in segments cut where the pattern must begin a new word; repeated rows are encoded row by row; a null key is kept;
an empty table gives an empty result; only the key and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow_map, table
from sparkloom.llm.words import hashes

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Words with more bytes are folded one at a time.
WIDE = 64
CACHED = 200_000
SEGMENT = 1 << 20
SAFE_CUT = re.compile(r"(?<=[A-Za-z.,]) (?=[A-Za-z])")
NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def character_kinds() -> np.ndarray:
    """The kind of each code point."""
    import regex

    kinds = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        found = np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)
        kinds[found] = kind
    # the pattern's white space is Unicode's, which the four separators U+001C to U+001F are not part of
    kinds[0x1C:0x20] = OTHER
    return kinds


def word_starts(points: np.ndarray, at: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the words of the texts begin that ``at`` cuts out of the code points."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds[points]
    first = np.zeros(n + 1, bool)
    first[at] = True
    run = first[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    ends = np.append(run[1:], True)  # the last character of a run
    last_of_text = first[1:] | (np.arange(n) == n - 1)
    start = run.copy()
    # the last white space of a run stands alone or leads the next word, unless the text ends there
    start |= space & ends & ~last_of_text
    blank = points == 0x20
    led = np.zeros(n, bool)
    led[1:] = blank[:-1] & ~first[1:-1]
    start &= ~(led & run & ~space)
    quotes = np.flatnonzero((points == 0x27) & start & run)
    for i in quotes.tolist():
        # 's 't 'm 'd 're 've 'll
        end = i + 1
        while end < n and not first[end] and end < i + 3:
            end += 1
        tail = points[i + 1 : end]
        if not len(tail):
            continue
        size = 1 if tail[0] in (0x73, 0x74, 0x6D, 0x64) else 2 if len(tail) == 2 and (tail[0], tail[1]) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)) else 0
        if size:
            start[i + 1] = False
            after = i + 1 + size
            if after < n and not first[after] and kind[after] == LETTER:
                start[after] = True
    return np.flatnonzero(start)


class RankFold:
    """Folds ranked merges over the bytes of words."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pieces = {rank: token for token, rank in ranks.items()}
        top = max(self.pieces) + 1
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing or top > 1 << 24:
            raise ValueError("a rank map without all single bytes, or of too many ranks")
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 24 | b] = rank
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.merged = keys, np.array([pairs[k] for k in keys.tolist()], np.int32)
        self.two = np.full(1 << 16, NONE, np.int32)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.two[token[0] << 8 | token[1]] = rank
        sizes = np.zeros(top, np.int64)
        for rank, token in self.pieces.items():
            sizes[rank] = len(token)
        self.piece_size, self.piece_at = sizes, np.concatenate(([0], np.cumsum(sizes)))[:-1]
        self.piece_bytes = np.frombuffer(b"".join(self.pieces.get(r, b"") for r in range(top)), np.uint8)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where the two don't merge."""
        key = a.astype(np.int64) << 24 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def fold(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the spans one after another, and how many each has."""
        size = stops - starts
        counts = np.zeros(len(size), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for high in (1, 6, 9, 12, 16, 24, 40, WIDE):
            own = np.flatnonzero((size > low) & (size <= high))
            low = high
            for k in range(0, len(own), 1 << 14):
                rows = own[k : k + (1 << 14)]
                ids, n = self._fold_rows(raw, starts[rows], size[rows])
                counts[rows] = n
                parts.append((rows, ids))
        wide = {int(i): self.fold_one(raw[starts[i] : stops[i]].tobytes()) for i in np.flatnonzero(size > WIDE)}
        for i, ids in wide.items():
            counts[i] = len(ids)
        begin = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(int(begin[-1]), np.int32)
        for rows, ids in parts:
            there = np.arange(ids.shape[1]) < counts[rows][:, None]
            out[(begin[rows][:, None] + np.arange(ids.shape[1]))[there]] = ids[there]
        for i, ids in wide.items():
            out[begin[i] : begin[i] + len(ids)] = ids
        return out, counts

    def _fold_rows(self, raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = int(size.max())
        place = np.minimum(starts[:, None] + np.arange(width), len(raw) - 1)
        byte = raw[place].astype(np.int32)
        there = np.arange(width) < size[:, None]
        result = self.single[byte]
        counts = size.copy()
        if width == 1:
            return result, counts
        rank = self.two[byte[:, :-1] << 8 | byte[:, 1:]]
        rank[~there[:, 1:]] = NONE
        live = np.arange(len(size))
        ids, left = result.copy(), size.copy()
        while len(live):
            best = rank.argmin(axis=1)
            least = rank[np.arange(len(live)), best]
            done = least == NONE
            if done.any():
                result[live[done]] = np.pad(ids[done], ((0, 0), (0, width - ids.shape[1])))
                counts[live[done]] = left[done]
                keep = ~done
                live, ids, rank, left, best, least = live[keep], ids[keep], rank[keep], left[keep], best[keep], least[keep]
                if not len(live):
                    break
            row = np.arange(len(live))
            columns = np.arange(ids.shape[1] - 1)
            moved = columns >= best[:, None] + 1
            ids = np.where(moved, ids[:, 1:], ids[:, :-1])
            ids[row, best] = least
            rank = np.where(columns[:-1] >= best[:, None], rank[:, 1:], rank[:, :-1])
            left = left - 1
            if rank.shape[1]:
                a = np.flatnonzero(best > 0)
                if len(a):
                    rank[a, best[a] - 1] = self.lookup(ids[a, best[a] - 1], least[a])
                b = np.flatnonzero(best + 1 < left)
                rank[row[best < rank.shape[1]], best[best < rank.shape[1]]] = NONE
                if len(b):
                    rank[b, best[b]] = self.lookup(least[b], ids[b, best[b] + 1])
            elif len(live):
                result[live] = np.pad(ids, ((0, 0), (0, width - ids.shape[1])))
                counts[live] = left
                break
        return result, counts

    def fold_one(self, word: bytes) -> list[int]:
        """The fold of one word of any length, with a heap of pairs over linked places."""
        if word in self.ranks:
            return [self.ranks[word]]
        n, ranks = len(word), self.ranks
        end = list(range(1, n + 1))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i], after[i] = stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(word[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        found, i = [], 0
        while i < n:
            found.append(ranks[word[i : end[i]]])
            i = after[i]
        return found

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The pieces of ``ids`` one after another."""
        size = self.piece_size[ids]
        stop = np.cumsum(size)
        if not len(ids):
            return np.zeros(0, np.uint8)
        return self.piece_bytes[np.arange(stop[-1]) + np.repeat(self.piece_at[ids] - (stop - size), size)]


class Encoder:
    """Encodes texts; keeps the ids of distinct words between calls."""

    def __init__(self, path: str):
        self.rank_fold = RankFold(read_ranks(path))
        self.kinds = character_kinds()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.begin, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [ids for ids, _ in self.round_trip(texts)]

    def round_trip(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text its ids, and the bytes that they decode to. A long text goes through in segments, one after another."""
        found = [(np.zeros(0, np.int32), np.zeros(0, np.uint8))] * len(texts)
        held: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            for (i, _), (ids, decoded) in zip(held, self._round_trip([part for _, part in held]), strict=True):
                found[i] = (ids, decoded) if not len(found[i][0]) else tuple(np.concatenate(x) for x in zip(found[i], (ids, decoded), strict=True))
            held.clear()

        for i, text in enumerate(texts):
            for part in segments(text):
                if size + len(part) > SEGMENT and held:
                    flush()
                    size = 0
                held.append((i, part))
                size += len(part)
        flush()
        return found

    def _round_trip(self, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        whole = "".join(parts)
        raw = np.frombuffer(whole.encode(), np.uint8)
        points = raw if len(raw) == len(whole) else np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        at = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        starts = word_starts(points, at, self.kinds)
        bounds, ends = np.searchsorted(starts, at), at
        if len(raw) != len(whole):
            width = np.ones(len(points) + 1, np.int64)
            width[:-1] += (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            byte_at = np.cumsum(width) - width
            starts, ends = byte_at[starts], byte_at[at]
        stops = np.append(starts[1:], len(raw))[: len(starts)]
        ids, edge = self._ids(self._index(raw, starts, stops), bounds)
        decoded = self.rank_fold.decode(ids)
        if not np.array_equal(decoded, raw):  # two words of one hash: each is folded for itself
            self._forget()
            ids, count = self.rank_fold.fold(raw, starts, stops)
            edge, decoded = np.concatenate(([0], np.cumsum(count)))[bounds], self.rank_fold.decode(ids)
        return [(ids[edge[k] : edge[k + 1]], decoded[ends[k] : ends[k + 1]]) for k in range(len(parts))]

    def _ids(self, index: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at ``index``, and where they are at the words ``bounds``."""
        count = self.count[index]
        stop = np.cumsum(count)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.begin[index] - (stop - count), count)] if total else np.zeros(0, np.int32)
        return ids, np.concatenate(([0], stop))[bounds]

    def _index(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """For each word the place of its ids."""
        if len(self.known) > CACHED:
            self._forget()
        hashed = hashes(raw, starts, stops)
        unique, first, back = np.unique(hashed, return_index=True, return_inverse=True)
        place = np.array([self.known.get(h, -1) for h in unique.tolist()], np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            ids, count = self.rank_fold.fold(raw, starts[first[new]], stops[first[new]])
            base = len(self.count)
            place[new] = base + np.arange(len(new))
            self.known.update(zip(unique[new].tolist(), range(base, base + len(new)), strict=True))
            self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(count) - count))
            self.count = np.concatenate((self.count, count))
            self.ids = np.concatenate((self.ids, ids))
        return place[back]


def segments(text: str) -> list[str]:
    """``text``, cut every so often where the pattern begins a new word whatever surrounds it."""
    if len(text) <= SEGMENT:
        return [text] if text else []
    found, at = [], 0
    while len(text) - at > SEGMENT and (m := SAFE_CUT.search(text, at + SEGMENT)):
        found.append(text[at : m.start()])
        at = m.start()
    return [*found, text[at:]]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids``: the token ids of each row's whole text."""

    def make():
        encoder = Encoder(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = encoder.encode([x or "" for x in batch.column(0).to_pylist()])
            ends = np.concatenate(([0], np.cumsum([len(x) for x in found])))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
            return pa.RecordBatch.from_arrays([batch.column(1), ids], ["key", "ids"])

        return step

    return arrow_map(docs.select(F.col(text).alias("text"), F.col(key).alias("key")), make, f"key {dict(docs.dtypes)[key]}, ids array<int>").withColumnRenamed("key", key)


def decode(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, decoded``: the bytes of each row's ids; a null list gives null."""

    def run(batches):
        fold = RankFold(read_ranks(path))
        for batch in batches:
            found = [None if x is None else fold.decode(np.array(x, np.int64)).tobytes() for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], ["key", "decoded"])

    chosen = rows.select(F.col(ids).alias("ids"), F.col(key).alias("key"))
    return chosen.mapInArrow(run, f"key {dict(rows.dtypes)[key]}, decoded binary").withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256``, and the ids on demand: encodes, and decodes the ids again."""

    def make():
        encoder = Encoder(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            both, rows = encoder.round_trip([x or "" for x in batch.column(0).to_pylist()]), []
            found = [ids for ids, _ in both]
            for ids, decoded in both:
                rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.tobytes()).hexdigest()))
            n, a, b = zip(*rows, strict=True)
            columns = [batch.column(1), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.concatenate(([0], np.cumsum(n)))
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found]))))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        return step

    schema = f"key {dict(docs.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return arrow_map(docs.select(F.col(text).alias("text"), F.col(key).alias("key")), make, schema).withColumnRenamed("key", key)


def fold_column(word: Column, ranks: dict[bytes, int], buckets: int = 1 << 16) -> Column:
    """The ids of ``word``, a column of single words, by higher-order functions alone.

    Bytes are held as the characters U+0000 to U+00FF. The rank map is one literal, an array of small maps by crc32; the
    fold's state is where the pieces begin, the ranks of adjacent pairs, and the place of the least.
    """
    small: list[dict[str, int]] = [{} for _ in range(buckets)]
    for token, rank in ranks.items():
        name = token.decode("latin-1")
        small[zlib.crc32(name.encode()) % buckets][name] = rank
    literal = F.from_json(F.lit(json.dumps(small)), "array<map<string,int>>")
    none = F.lit(int(NONE))
    raw = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    n = F.length(raw)

    def rank(piece: Column) -> Column:
        return F.coalesce(F.element_at(F.element_at(literal, (F.crc32(piece) % buckets + 1).cast("int")), piece), none)

    def bind(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def least(pairs: Column) -> Column:
        return F.when(F.array_min(pairs) < none, F.array_position(pairs, F.array_min(pairs)).cast("int")).otherwise(0)

    def state(begins: Column, pairs: Column) -> Column:
        return F.struct(begins.alias("begins"), pairs.alias("pairs"), least(pairs).alias("at"))

    def pair(begins: Column, i: Column) -> Column:
        return rank(F.substring(raw, F.element_at(begins, i), F.element_at(begins, i + 2) - F.element_at(begins, i)))

    def step(s: Column, _: Column) -> Column:
        def merged(begins: Column) -> Column:
            pairs = F.transform(F.filter(s.pairs, lambda x, i: i != s.at - 1), lambda x, i: F.when((i == s.at - 1) | (i == s.at - 2), pair(begins, i + 1)).otherwise(x))
            return bind(pairs, lambda p: state(begins, p))

        return F.when(s.at == 0, s).otherwise(bind(F.filter(s.begins, lambda x, i: i != s.at), merged))

    def ids(s: Column) -> Column:
        return F.transform(F.slice(s.begins, 1, F.size(s.begins) - 1), lambda x, i: rank(F.substring(raw, x, F.element_at(s.begins, i + 2) - x)))

    first = F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank(F.substring(raw, i, F.lit(2))))
    start = bind(first, lambda p: state(F.sequence(F.lit(1), n + 1), p))
    return F.when(n == 0, F.array().cast("array<int>")).when(n == 1, F.array(rank(raw))).otherwise(F.aggregate(F.sequence(F.lit(1), n - 1), start, step, ids))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
