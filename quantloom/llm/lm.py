"""Language-model scores by a weighted backoff automaton.

Documents are read in shelves of about `SHELF` bytes of text. A shelf keeps its documents as numbers of
its own words and asks for the corpus counts of the n-grams that occur in it: sorted 64-bit hashes, cut into
hash ranges of a bounded number of n-grams, one compressed row a shelf and range. A range's task adds up
what all shelves counted in training documents and answers each shelf with its n-grams' counts in its
own order. Nothing gathered from the corpus passes through the driver but two totals.

With its counts a shelf builds the part of the automaton that its texts can reach: a state for each context
that training has seen, an arc for each n-gram with the log-probability of its last word, and a failure arc
from each state to that of its context without its first word, with the weight of backing off:

    p(w | h) = (c(hw) + B p(w | h')) / (c(h) + B),   p(w) = (c(w) + A) / (N + A (V + 1))

(B is `PRIOR`, A `ADD`; h' is h without its first word. Unseen words share one place, V + 1 in all.) A word
without an arc costs c(hw) = 0, that is the failure arc's B / (c(h) + B). One traversal from left to right
carries the state and adds up; texts are cut into stretches that run side by side, each led in by the
n - 1 tokens before it, after which an automaton of n-grams is in the state in which the text's own
traversal would be. Logarithms are added in whole billionths, so sums don't depend on any order
(and are off by half a billionth a step at most).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import stored, text_slices

ORDER = 3
ADD, PRIOR = 0.1, 5.0
#: Bytes of text in a shelf, one document at least.
SHELF = 8 << 20
#: N-grams in a hash range, counted once for each shelf they occur in.
RANGE = 1 << 20
#: Tokens of one stretch of the traversal.
STRETCH = 256
#: Hashes of the end of a text and of the place before its first word; no word is hashed to them on purpose.
END, START = textvec.mix(np.array([0x656E64, 0x7374617274], np.uint64))
UNIT = 1_000_000_000


def _held_out() -> Column:
    """Rows that the model doesn't learn from; a row without doc_id is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers, compressed byte plane by byte plane; the width is the largest number's."""
    v = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    planes = v.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _pack_sorted(values: np.ndarray) -> bytes:
    """Sorted hashes as differences in byte planes; they are random, so only the top plane is compressed."""
    v = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(v[1:].max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(v[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + int(v[0]).to_bytes(8, "little") + planes[:-1].tobytes() + zlib.compress(planes[-1].tobytes(), 1)


def _unpack_sorted(data: bytes, n: int) -> np.ndarray:
    width, plain = data[0], 9 + (data[0] - 1) * (n - 1)
    planes = np.frombuffer(data[9:plain] + zlib.decompress(data[plain:]), np.uint8).reshape(width, n - 1)
    out = np.zeros((n, 8), np.uint8)
    out[0] = np.frombuffer(data[1:9], np.uint8)
    out[1:, :width] = planes.T
    return np.cumsum(out.reshape(-1).view("<u8").astype(np.uint64), dtype=np.uint64)


def _bits(tokens: int) -> int:
    """Width of the hashes of two and more words: of `tokens` n-grams at most one in a million shares another's."""
    return min(64, max(40, tokens.bit_length() + 20))


SHELVES = "shelf string, doc_id array<string>, held_out array<boolean>, length array<long>, words binary, tokens binary, n_tokens long"


def _shelve(size: int):
    """Batches (doc_id, held_out, text) -> shelves: every word (and the end) numbered by falling frequency in the shelf."""

    def shelf(name: str, ids: list, held: list, texts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hashes, row, base = [], [], 0
        for data, offsets in texts:
            start, end, r = textvec.word_spans(data, offsets, textvec.NOT_SPACE)
            hashes.append(textvec.hash_spans(data, start, end, textvec.LOWER))
            row.append(r + base)
            base += len(offsets) - 1
        hashes, row = np.concatenate(hashes), np.concatenate(row)
        count = np.bincount(row, minlength=base)
        at = np.cumsum(count)  # the end of a text comes after its last word
        hashes = np.insert(hashes, at, END)
        words, number, often = np.unique(hashes, return_inverse=True, return_counts=True)
        falling = np.argsort(-often, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[falling] = np.arange(len(words))
        values = [[name], [ids], [held], [(count + 1).tolist()], [words[falling].astype("<u8").tobytes()], [_pack(rank[number].astype(np.uint64))], [len(hashes)]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.string(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()))], names=[c.split()[0] for c in SHELVES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held_bytes = TaskContext.get().partitionId(), 0, 0
        ids, held, texts = [], [], []
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                ids += a[lo:hi]
                held += b[lo:hi]
                texts.append((data.copy(), offsets.copy()))
                held_bytes += len(data)
                if held_bytes >= size:
                    yield shelf(f"{part}-{n}", ids, held, texts)
                    n, held_bytes, ids, held, texts = n + 1, 0, [], [], []
        if ids:
            yield shelf(f"{part}-{n}", ids, held, texts)

    return run


class _Grams:
    """The n-grams of a shelf: for each order the sorted hashes, and of each token the place of the n-gram that ends there.

    The n-gram of the first tokens of a text is shorter: START and what follows it; where there is none of an order, the place is -1.
    """

    def __init__(self, words: np.ndarray, tokens: np.ndarray, length: np.ndarray, order: int, bits: int):
        first = np.cumsum(length) - length
        place = np.arange(len(tokens)) - np.repeat(first, length)
        h = words[tokens]
        before = [h]  # before[j]: the hash of the token j places back, START in front of the text
        for j in range(1, order):
            back = np.empty_like(h)
            back[j:], back[:j] = h[:-j] if len(h) > j else h[:0], START
            back[place < j] = START
            before.append(back)
        self.place = place
        self.hashes, self.at = [], []
        for k in range(1, order + 1):
            g = np.full(len(h), np.uint64(k)) if k > 1 else h
            for j in range(k - 1, -1, -1) if k > 1 else ():
                g = textvec.mix(g * np.uint64(0x9E3779B97F4A7C15) + before[j])
            exists = place >= k - 2
            hashes, at = np.unique(g[exists] >> np.uint64(64 - bits) if k > 1 else g, return_inverse=True)
            whole = np.full(len(h), -1, np.int32)
            whole[exists] = at
            self.hashes.append(hashes)
            self.at.append(whole)


def _read(shelf: dict, order: int, bits: int):
    words = np.frombuffer(shelf["words"], "<u8").astype(np.uint64)
    tokens = _unpack(shelf["tokens"]).astype(np.int32)
    length = np.array(shelf["length"], np.int64)
    return words, tokens, length, _Grams(words, tokens, length, order, bits)


def _ranges(order: int, ranges: int, bits: int):
    """Shelves -> their n-grams' hashes and counts in training documents, a row for each order and hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1).to_pylist()[0]
                _, tokens, length, grams = _read(one, order, bits)
                learned = np.repeat(~np.array(one["held_out"], bool), length)
                out = []
                for k, (hashes, at) in enumerate(zip(grams.hashes, grams.at), 1):
                    n = np.bincount(at[(at >= 0) & learned], minlength=len(hashes))
                    top = hashes >> np.uint64((bits if k > 1 else 64) - 32)
                    bucket = ((top * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
                    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=ranges))
                    for lo, hi in zip(cuts[:-1], cuts[1:]):
                        out.append((k, int(bucket[lo]), one["shelf"], _pack_sorted(hashes[lo:hi]), _pack(n[lo:hi].astype(np.uint64))))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary()))], names=["n", "range", "shelf", "hashes", "counts"])

    return run


def _count(table: pa.Table) -> pa.Table:
    """One hash range: the counts of all shelves added up, and for each shelf those of its own n-grams; the row
    without a shelf has the range's totals."""
    counts = [_unpack(x) for x in table["counts"].to_pylist()]
    hashes = [_unpack_sorted(x, len(n)) for x, n in zip(table["hashes"].to_pylist(), counts)]
    counts = np.concatenate(counts).astype(np.int64)
    sizes = np.cumsum([len(h) for h in hashes])[:-1]
    every, at = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(every)).astype(np.int64)
    answers = [_pack(x.astype(np.uint64)) for x in np.split(total[at], sizes)]
    n, where = table["n"][0].as_py(), table["range"][0].as_py()
    return pa.table({"n": pa.array([n] * (len(hashes) + 1), pa.int32()), "range": pa.array([where] * (len(hashes) + 1), pa.int64()), "shelf": pa.array(table["shelf"].to_pylist() + [None], pa.string()),
        "counts": pa.array(answers + [None], pa.binary()), "total": pa.array([None] * len(hashes) + [int(total.sum())], pa.int64()), "types": pa.array([None] * len(hashes) + [int((total > 0).sum())], pa.int64())})


def _nano(p: np.ndarray) -> np.ndarray:
    return np.rint(np.log10(p) * UNIT).astype(np.int64)


class Automaton:
    """States, arcs and failure arcs over a shelf's own words.

    State 0 is the empty context, `start` that before a text's first word. Any other context whose count is over 0
    is a state; a context's count is its own as an n-gram, for every token but a text's end is followed by one.
    An arc from a context of k - 1 words is an n-gram of k, so arcs have the shelf's n-gram numbers: `arc[k - 1]`
    has the one at each token. `goes` is the state behind an arc, or -1 where training has not seen it.
    """

    def __init__(self, tokens: np.ndarray, grams: _Grams, counts: list[np.ndarray], end: int, total: int, types: int, prior: float):
        order = len(counts)
        last = [np.zeros(len(h), np.int64) for h in grams.hashes]
        for at, place in zip(grams.at, last):  # a token at which each n-gram ends
            there = np.flatnonzero(at >= 0)
            place[at[there]] = there
        self.p1 = (counts[0] + ADD) / (total + ADD * (types + 1))
        texts = int(counts[0][grams.at[0][np.flatnonzero(tokens == end)[0]]])
        self.start = int(texts > 0 and order > 1)
        size, fail, level = [np.array([0, texts][: 1 + self.start])], [np.zeros(1 + self.start, np.int32)], [np.arange(1 + self.start, dtype=np.int8)]
        state, n = [], 1 + self.start
        for k in range(1, order):
            own = np.zeros(len(counts[k - 1]), np.int32)
            seen = np.flatnonzero((counts[k - 1] > 0) & (tokens[last[k - 1]] != end))
            own[seen] = n + np.arange(len(seen))
            n += len(seen)
            size.append(counts[k - 1][seen])
            fail.append(state[-1][grams.at[k - 2][last[k - 1][seen]]] if k > 1 else np.zeros(len(seen), np.int32))
            level.append(np.full(len(seen), k, np.int8))
            state.append(own)
        size = np.concatenate(size)
        self.fail, self.level, self.backoff = np.concatenate(fail), np.concatenate(level), _nano(prior / (size + prior))
        weights, goes, arcs, p, n = [], [], [], self.p1, 0
        for k in range(1, order + 1):
            seen = np.flatnonzero(counts[k - 1] > 0) if k > 1 else np.arange(len(counts[0]))
            ends = last[k - 1][seen]
            if k > 1:
                context = state[k - 2][grams.at[k - 2][ends - 1]]
                context[grams.place[ends] == 0] = self.start
                shorter, p = p[grams.at[k - 2][ends]], np.ones(len(counts[k - 1]))
                p[seen] = (counts[k - 1][seen] + prior * shorter) / (size[context] + prior)
            weights.append(_nano(p))
            to = np.full(len(counts[k - 1]), -1, np.int32)
            kept = min(k, order - 1)  # words of the longest context that the arc can lead to
            to[seen] = state[kept - 1][grams.at[kept - 1][ends]] if kept else 0
            goes.append(to)
            arcs.append(grams.at[k - 1] + np.int32(n))
            n += len(to)
        self.arc, self.weights, self.goes = np.stack(arcs), np.concatenate(weights), np.concatenate(goes)

    def read(self, length: np.ndarray) -> np.ndarray:
        """Log10 probabilities of the texts in billionths: all stretches side by side, from left to right."""
        first = np.cumsum(length) - length
        pieces = -(-length // STRETCH)
        text = np.repeat(np.arange(len(length)), pieces)
        begin = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH
        size = np.minimum(STRETCH, length[text] - begin)
        lead = np.minimum(begin, len(self.arc) - 1)
        falling = np.argsort(-(lead + size), kind="stable")
        text, begin, size, lead = text[falling], begin[falling], size[falling], lead[falling]
        at, steps = first[text] + begin - lead, lead + size
        state = np.where(begin == lead, self.start, 0).astype(np.int32)
        total = np.zeros(len(text), np.int64)
        for t in range(int(steps[0]) if len(steps) else 0):
            lanes = np.arange(np.searchsorted(-steps, -t, "left"))  # stretches of more than t steps
            while len(lanes):
                now = state[lanes]
                arc = self.arc[self.level[now], at[lanes] + t]
                goes, counted = self.goes[arc], lead[lanes] <= t
                found = goes >= 0
                total[lanes] += np.where(counted, np.where(found, self.weights[arc], self.backoff[now]), 0)
                state[lanes] = np.where(found, goes, self.fail[now])
                lanes = lanes[~found]
        out = np.zeros(len(length), np.int64)
        np.add.at(out, text, total)
        return out


SCORES = "doc_id string, held_out boolean, n_tokens long, n_known long, base long, score long"


def _score(order: int, bits: int, total: int, types: int, prior: float):
    """A shelf and the answers to it -> its documents' scores."""

    def run(shelf: pa.Table, answers: pa.Table) -> pa.Table:
        one = shelf.to_pylist()[0]
        words, tokens, length, grams = _read(one, order, bits)
        answers = answers.sort_by([("n", "ascending"), ("range", "ascending")])
        n, blobs = np.array(answers["n"]), answers["counts"].to_pylist()
        none = np.zeros(0, np.uint64)  # short texts have no n-grams of the higher orders
        counts = [np.concatenate([none, *(_unpack(blobs[i]) for i in np.flatnonzero(n == k))]).astype(np.int64) for k in range(1, order + 1)]
        end = int(np.flatnonzero(words == END)[0])
        automaton = Automaton(tokens, grams, counts, end, total, types, prior)
        text = np.repeat(np.arange(len(length)), length)
        base, known = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        np.add.at(base, text, _nano(automaton.p1)[grams.at[0]])
        np.add.at(known, text, (counts[0] > 0)[grams.at[0]].astype(np.int64))
        score = automaton.read(length)
        columns = (one["doc_id"], one["held_out"], length, known, base, score)
        return pa.table({c.split()[0]: pa.array(v, t) for c, v, t in zip(SCORES.split(", "), columns, (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))})

    return run


def language_scores(docs: DataFrame, order: int = ORDER, prior: float = PRIOR, shelf: int = SHELF) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    base_score is the unigram model's, score the automaton's log10 probability of the whole text and its end.
    A null text is empty: one token, its end. Rows are scored each, repeated ones and those without doc_id too;
    the latter are learned from. Texts of any length are read whole; other columns are ignored. Without training rows
    every word is equally (un)likely. Words are compared by 64-bit hashes, longer
    n-grams by hashes whose width grows with the corpus.
    """
    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.col("doc_id").cast("string"), _held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    shelves = stored(rows.mapInArrow(_shelve(shelf), SHELVES), "shelves")
    tokens = shelves.agg(F.sum("n_tokens")).first()[0] or 0
    bits = _bits(tokens)
    asked = shelves.mapInArrow(_ranges(order, max(1, -(-tokens // RANGE)), bits), "n int, range long, shelf string, hashes binary, counts binary")
    answers = stored(asked.groupBy("n", "range").applyInArrow(_count, "n int, range long, shelf string, counts binary, total long, types long"), "answers")
    known = answers.where("shelf is null and n = 1").agg(F.sum("total"), F.sum("types")).first()
    total, types = known[0] or 0, known[1] or 0
    scored = shelves.groupBy("shelf").cogroup(answers.where("shelf is not null").select("shelf", "n", "range", "counts").groupBy("shelf")).applyInArrow(_score(order, bits, total, types, prior), SCORES)
    return scored.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") / float(UNIT)).alias("base_score"), (F.col("score") / float(UNIT)).alias("score"))
