"""Best-fit packing of token pieces into sequences, after Martello-Toth dominance reduction.

Lengths are whole numbers from 1 to `capacity`, so an instance of any size is a table of at most
`capacity` counts. The plan is made on that table: patterns (sets of lengths that share a sequence)
with the number of times each is used. The reduction first fixes patterns that provably dominate
what else could hold their largest piece; best fit decreasing packs the rest, all pieces of a length
at a time. In Spark, every piece gets a rank among the pieces of its length, and a join with the
plan's ranges of ranks gives its sequence and its place there.
"""

from __future__ import annotations

import bisect
import functools
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textvec
from .common import give_back, stored, text_slices

CAPACITY, END = 1024, 2
#: A rank is counted inside a salt of about so many pieces.
SALT_ROWS = 4000
#: Distinct pre-tokens whose ids a task remembers.
REMEMBERED = 1 << 19

_PIECES = "doc_id long, piece int, start long, length long, ids binary"


_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point in the tokenizer's pre-token pattern."""
    import regex

    out = np.full(0x110000, _OTHER, np.uint8)
    for lo in range(0, 0x110000, 0x800):  # a piece at a time: all at once take 70 MB of a worker
        if lo == 0xD800:  # surrogates
            continue
        every = "".join(map(chr, range(lo, lo + 0x800)))
        for kind, pattern in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                out[lo + m.start() : lo + m.end()] = kind
    return out


def _contractions(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Letters after each apostrophe that make one token with it: 1 (s, t, m, d), 2 (re, ve, ll) or 0."""
    a = points[np.minimum(at + 1, len(points) - 1)]
    b = points[np.minimum(at + 2, len(points) - 1)]
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    return np.where(np.isin(a, np.frombuffer("stmd".encode("utf-32-le"), "<u4")), 1, np.where(two, 2, 0))


def pretokens(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """First code point of every pre-token; rows start at `edges` (the last edge is the end).

    Pre-tokens are runs of letters, of numbers or of other characters, each with a blank before it;
    white space but for that last blank is one, a last other white space is its own; an apostrophe
    that starts its run without a blank makes one with s, t, m, d, re, ve or ll.
    """
    n = len(points)
    kind = _classes()[points]
    row_start = np.zeros(n + 1, bool)
    row_start[edges] = True
    new = row_start[:-1].copy()
    new[1:] |= kind[1:] != kind[:-1]
    first = np.flatnonzero(new)
    after = np.append(first[1:], n)
    k = kind[first]
    blank = k == _SPACE
    inner = blank & ~row_start[after]  # white space that a run follows
    glued = inner & (points[after - 1] == 32)
    starts = [first[~blank], first[blank & ~(glued & (after - first == 1))]]  # a lone blank starts the token of its run
    taken = np.zeros(n + 1, bool)  # runs that start with the blank before them
    taken[after[glued]] = True
    starts[0] = starts[0][~taken[starts[0]]]
    starts.append(after[inner] - 1)  # the last of the white space: with the run, or alone
    apostrophe = first[(k == _OTHER) & (after - first == 1) & (points[first] == 39)]
    apostrophe = apostrophe[~taken[apostrophe]]
    apostrophe = apostrophe[~row_start[apostrophe + 1]]
    if len(apostrophe):
        tail = _contractions(points, apostrophe)
        tail[(tail == 2) & row_start[np.minimum(apostrophe + 2, n)]] = 0
        apostrophe, tail = apostrophe[tail > 0], tail[tail > 0]
        drop = np.zeros(n + 1, bool)
        drop[apostrophe + 1] = True
        starts[0] = starts[0][~drop[starts[0]]]
        rest = apostrophe + 1 + tail  # letters left of the run, if any
        rest = rest[(rest < n) & ~row_start[np.minimum(rest, n)]]
        starts.append(rest[kind[rest] == _LETTER])
    marked = np.zeros(n, bool)
    for s in starts:
        marked[s] = True
    return np.flatnonzero(marked)


class Encoder:
    """Token ids of texts by the tokenizer file, its pre-tokens each encoded once and remembered.

    Byte-level BPE never merges across pre-tokens, so a text's ids are its pre-tokens' ids in turn.
    Pre-tokens are found for many texts at once and told apart by 64-bit hashes of their bytes.
    Texts that hold the string of a special token are encoded by the tokenizer itself, which gives the
    token's id for it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.newline,) = self._ids("\n")
        self.forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def forget(self) -> None:
        self.hashes, self.size, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        if odd:
            whole = {i: np.array(self._ids(texts[i]), np.uint32) for i in odd}
            ids, sizes = self.encode(["" if i in whole else t for i, t in enumerate(texts)])
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            parts = [whole.get(i, part) for i, part in enumerate(parts)]
            return np.concatenate(parts).astype(np.uint32), np.array([len(x) for x in parts], np.int64)
        raw = "".join(texts)
        edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        return self._plain(raw, edges)

    def _look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids) of pre-tokens: those with ink as lines of one text, others one by one."""
        ink = np.fromiter((not w.isspace() for w in words), bool, len(words))
        lines = [w for w, i in zip(words, ink.tolist()) if i]
        joined = np.array(self._ids("\n".join([*lines, ""])), np.uint32)
        stop = np.flatnonzero(joined == self.newline)
        rest = [self._ids(w) for w, i in zip(words, ink.tolist()) if not i]
        if len(stop) != len(lines):  # a pattern unlike the one assumed
            raise ValueError("the tokenizer doesn't cut at line ends")
        size = np.empty(len(words), np.int64)
        size[ink] = np.diff(stop, prepend=-1) - 1
        size[~ink] = [len(x) for x in rest]
        ids = np.empty(int(size.sum()), np.uint32)
        held = np.repeat(ink, size)
        ids[held] = joined[joined != self.newline]
        ids[~held] = [i for x in rest for i in x]
        return size, ids

    def _plain(self, raw: str, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not raw:
            return np.zeros(0, np.uint32), np.zeros(len(edges) - 1, np.int64)
        points = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), "<u4")
        data = np.frombuffer(raw.encode("utf-8", "surrogatepass"), np.uint8)
        start = pretokens(points, edges)
        if len(data) == len(points):
            byte = start
        else:  # continuation bytes are no code points of their own
            byte = np.flatnonzero((data & 0xC0) != 0x80)[start]
        h = textvec.hash_spans(data, byte, np.append(byte[1:], len(data)))
        unique, first, code = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes) > REMEMBERED:
            self.forget()
        known = np.searchsorted(self.hashes, unique)
        known[known == len(self.hashes)] = 0
        fresh = np.flatnonzero(self.hashes[known] != unique) if len(self.hashes) else np.arange(len(unique))
        if len(fresh):
            end = np.append(start[1:], len(points))
            size, found = self._look_up([raw[a:b] for a, b in zip(start[first[fresh]].tolist(), end[first[fresh]].tolist())])
            hashes = np.concatenate([self.hashes, unique[fresh]])
            sizes = np.concatenate([self.size, size.astype(np.int32)])
            at = np.concatenate([self.at, (len(self.ids) + np.cumsum(size) - size).astype(np.int32)])
            self.ids = np.concatenate([self.ids, found])
            order = np.argsort(hashes, kind="stable")  # two sorted runs are merged
            self.hashes, self.size, self.at = hashes[order], sizes[order], at[order]
            known = np.searchsorted(self.hashes, unique)
        place = known[code]
        total = np.cumsum(np.append(0, self.size[place]))
        step = np.ones(total[-1], np.int32)  # ids of one pre-token follow each other; a jump leads to the next one's
        at, last = self.at[place], self.at[place] + self.size[place] - 1
        step[total[:-1]] = at - np.append(0, last[:-1])
        return self.ids[np.cumsum(step, dtype=np.int32)], np.diff(total[np.searchsorted(start, edges)])


@functools.cache
def _encoder(path: str) -> Encoder:
    """One for each Python worker, which keeps it from task to task."""
    encoder = Encoder(path)
    give_back()  # what reading the file took
    return encoder


def tokenise(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of every document: its ids and the end id, cut only where they exceed a sequence.

    The first piece of a cut document takes what whole sequences leave over. Null texts are empty:
    a single end id. ids holds little-endian unsigned 32-bit numbers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for first, after, _, _ in text_slices(batch.column(1), 1 << 19):
                part = batch.slice(first, after - first)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, sizes = encoder.encode(texts)
                out: list[list] = [[], [], [], [], []]
                lo = 0
                for doc_id, n in zip(part.column(0).to_pylist(), sizes.tolist()):
                    own = np.append(ids[lo : lo + n], np.uint32(end)).astype("<u4")
                    lo += n
                    start, piece = 0, 0
                    while start < len(own):
                        size = (len(own) - 1) % capacity + 1 if piece == 0 else capacity
                        for column, value in zip(out, (doc_id, piece, start, size, own[start : start + size].tobytes())):
                            column.append(value)
                        start, piece = start + size, piece + 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(read, _PIECES)


def reduce_instance(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello-Toth reduction on counts (changed in place): the patterns fixed, with multiplicity.

    For the largest length w: alone, where nothing fits beside it; with its exact complement, which
    no set can beat; with the largest length v that fits, where no two pieces fit beside w, or where
    no three do and no two that fit are longer together than v: they could change places with v.
    Lengths that none of this settles stay for best fit.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    sizes = sorted(s for s, n in counts.items() if n)
    undecided = len(sizes)

    def take(pattern: tuple[int, ...], n: int) -> None:
        fixed.append((pattern, n))
        for s in pattern:
            counts[s] -= n
            if not counts[s] and s in sizes_set:
                sizes_set.discard(s)
                sizes.remove(s)

    sizes_set = set(sizes)
    top = undecided
    while top > 0:
        top = min(top, len(sizes))
        if not top:
            break
        w = sizes[top - 1]
        room = capacity - w
        fits = bisect.bisect_right(sizes, room)
        if not fits:
            take((w,), counts[w])
            top -= 1
            continue
        v = sizes[fits - 1]
        n = counts[w] // 2 if v == w else min(counts[w], counts[v])
        if v == w and not n:  # one piece left of a length that fits only with itself
            v = sizes[fits - 2] if fits > 1 else None
            if v is None:
                take((w,), counts[w])
                top -= 1
                continue
            n = min(counts[w], counts[v])
        low, second, third = ([s for s in sizes[:3] for _ in range(min(3, counts[s]))] + [capacity] * 3)[:3]
        if v == room or low + second > room or (low + second + third > room and _pair_bound(sizes, counts, room, v)):
            take((w, v), n)
            top = min(top, len(sizes))
        else:
            top -= 1
    return fixed


def _pair_bound(sizes: list[int], counts: dict[int, int], room: int, v: int) -> bool:
    """Whether no two pieces that fit in `room` together are longer than v."""
    lo, hi, best = 0, bisect.bisect_right(sizes, room) - 1, 0
    while lo <= hi:
        total = sizes[lo] + sizes[hi]
        if total > room or (lo == hi and counts[sizes[lo]] < 2):
            hi -= 1
        else:
            best = max(best, total)
            lo += 1
    return best <= v


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing; bins with the same content are handled together."""
    bins: dict[int, Counter] = defaultdict(Counter)  # by the room left
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in bins or not bins[room]:
            bisect.insort(rooms, room)
        bins[room][pattern] += n

    for w in sorted((s for s, n in counts.items() if n), reverse=True):
        left = counts[w]
        while left:
            at = bisect.bisect_left(rooms, w)
            if at == len(rooms):
                each = capacity // w
                if whole := left // each:
                    put(capacity - each * w, (w,) * each, whole)
                if rest := left % each:
                    put(capacity - rest * w, (w,) * rest, 1)
                break
            room = rooms[at]
            pattern, have = next(iter(bins[room].items()))
            n = min(have, left)
            bins[room][pattern] -= n
            if not bins[room][pattern]:
                del bins[room][pattern]
            if not bins[room]:
                rooms.pop(at)
            put(room - w, (*pattern, w), n)
            left -= n
    return [(p, n) for group in bins.values() for p, n in group.items()]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used; the lengths used are exactly those counted."""
    left = Counter(counts)
    return reduce_instance(left, capacity) + best_fit(left, capacity)


def _ranges(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, sequence of the first, offset, pieces a sequence).

    A row for each pattern and length in it: best fit makes a few patterns for each of `capacity`
    lengths, and lengths that differ and fit together number sqrt(2 * capacity) at most, so the table
    is bounded whatever the number of pieces.
    """
    used: Counter = Counter()
    out, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for w, each in Counter(pattern).items():
            out.append((w, used[w], used[w] + n * each, sequence, offset, each))
            used[w] += n * each
            offset += w * each
        sequence += n
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows with a `length` from 1 to capacity; other columns stay.

    Rows with other lengths (or null) are errors of the caller and raise. Which of several pieces
    of the same length goes where doesn't matter to the packing.
    """
    spark = pieces.sparkSession
    rows = pieces.count()
    salts = -(-rows // SALT_ROWS)
    pieces = pieces.withColumn("_salt", F.spark_partition_id() * F.lit(7919) + F.monotonically_increasing_id() % 1009)
    pieces = stored(pieces.withColumn("_salt", F.pmod(F.xxhash64("_salt"), F.lit(max(1, salts))).cast("int")), "pieces")
    wrong = pieces.where(f"length is null or length < 1 or length > {capacity}")
    if wrong.limit(1).count():
        raise ValueError(f"a length is not from 1 to {capacity}")
    by_salt = stored(pieces.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_salt.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # capacity rows at most
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(by_salt.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "bases")
    within = Window.partitionBy("length", "_salt").orderBy(*[c for c in ("doc_id", "piece") if c in pieces.columns] or ["_salt"])
    # base grows with the pieces; the ranked rows are already partitioned and sorted by its keys
    ranked = pieces.withColumn("_rank", F.row_number().over(within) - 1).join(base.hint("merge"), ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    schema = "length long, _from long, _to long, _sequence long, _offset long, _each long"
    ranges = spark.createDataFrame(_ranges(plan(counts, capacity)), schema)  # bounded by capacity, see _ranges
    placed = ranked.join(F.broadcast(ranges), ["length"]).where("_rank >= _from and _rank < _to")
    place = F.col("_rank") - F.col("_from")
    placed = placed.withColumns({"sequence_id": F.col("_sequence") + F.floor(place / F.col("_each")), "offset": F.col("_offset") + place % F.col("_each") * F.col("length")})
    return placed.select(*(c for c in pieces.columns if c != "_salt"), "sequence_id", "offset")


def sequences(placed: DataFrame) -> DataFrame:
    """Whole sequences of pieces with ids: sequence_id, ids (binary), the pieces' doc_ids."""
    held = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))  # capacity members at most
    rows = placed.groupBy("sequence_id").agg(held.alias("held"))
    return rows.select("sequence_id", F.expr("aggregate(held, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), F.col("held.doc_id").alias("doc_ids"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Tokenise and pack all documents: a row for each piece, with the check sum of its ids."""
    pieces = tokenise(docs, path, capacity, end).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(stored(pieces, "tokens"), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
