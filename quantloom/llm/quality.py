"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Each line with a word is an observation with indicator features of its form. One pass reads every text and
writes what its lines hold. The model is trained in Spark tasks on the lines of all labelled documents, a
shard at a time, and the shards' weights are averaged a few times; Viterbi decoding runs in tasks over
every line of every text. A text is kept when enough of its words stand in content lines.

Labels are given by document, the field needs them by line (`line_labels`): lines of documents of low
quality are boilerplate, as are, in good ones too, lines that repeat in their document or stand in several
labelled documents; the others are content. So labels change inside sequences.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import stored, text_slices

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
_CLASSES = {"symbols": SYMBOLS, "upper": UPPER, "digit": DIGIT, "bang": np.arange(256) == 33, "pipe": np.arange(256) == 124}
#: Bounds that cut each measure of a line into indicator features.
_BOUNDS = {
    "words": (2, 4, 8, 16, 40, 120),
    "symbols": (0.005, 0.03, 0.08),
    "upper": (0.08, 0.2, 0.5),
    "digit": (0.02, 0.1, 0.4),
    "bang": (0.005, 0.05),
    "pipe": (0.005, 0.05),
    "letters": (2.5, 3.5, 5.0, 7.0, 10.0),
    "same": (0.05, 0.2, 0.5),
    "stop": (0.5,),
    "again": (0.5,),
}
N_FEATURES = 1 + sum(len(b) + 1 for b in _BOUNDS.values())
N_WINDOW = 8
#: So many labelled documents make a line boilerplate.
COMMON = 3
#: Labelled documents and lines of a shard, about; rounds of training and steps in each.
SHARD_ROWS, SHARD_LINES, ROUNDS, STEPS = 3000, 1 << 19, 6, 10
#: At most so many lines can each hold a HOT-th of all lines or more.
HOT = 1000


@dataclass
class Lines:
    """A slice of texts: base counts by row; active features, rows and word counts of its lines."""

    counts: dict[str, np.ndarray]
    features: np.ndarray
    row: np.ndarray
    words: np.ndarray
    hash: np.ndarray | None = None
    again: np.ndarray | None = None


def _sums(mask: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[hi] - total[lo]


def read_lines(data: np.ndarray, offsets: np.ndarray) -> Lines:
    rows = len(offsets) - 1
    start, end, row = textvec.word_spans(data, offsets, textvec.NOT_SPACE)
    n_words = np.bincount(row, minlength=rows)
    words = textvec.hash_spans(data, start, end)
    inside = textvec.NOT_SPACE[data] & ((data & 0xC0) != 0x80)
    counts = {
        "n_words": n_words,
        "word_chars": _sums(inside, offsets[:-1], offsets[1:]),
        "n_symbols": _sums(SYMBOLS[data], offsets[:-1], offsets[1:]),
        "n_repeat_words": _repeats(words, row, rows),
    }
    newline = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], newline + 1]))
    of = np.searchsorted(begin, start, "right") - 1
    held, first, n = np.unique(of, return_index=True, return_counts=True)
    lo = begin[held]
    line_row = row[first] if len(first) else np.zeros(0, np.int64)
    hi = np.minimum(np.append(newline, len(data))[np.searchsorted(newline, lo)], offsets[line_row + 1])
    raw = data.tobytes()
    again = np.zeros(len(lo), np.float64)
    seen: set[bytes] = set()
    last = -1
    for i, (a, b, r) in enumerate(zip(lo.tolist(), hi.tolist(), line_row.tolist())):
        if r != last:
            seen, last = set(), r
        if (line := raw[a:b]) in seen:
            again[i] = 1
        else:
            seen.add(line)
    counts["n_dup_lines"] = np.bincount(line_row, weights=again, minlength=rows).astype(np.int64)
    size = np.maximum(1, hi - lo)
    measure = {"words": n, "again": again} | {k: _sums(m[data], lo, hi) / size for k, m in _CLASSES.items()}
    measure["letters"] = _sums(inside, lo, hi) / np.maximum(1, n)
    pair = np.concatenate([[False], (words[1:] == words[:-1]) & (of[1:] == of[:-1])]) if len(words) else np.zeros(0, bool)
    measure["same"] = (np.add.reduceat(pair.astype(np.int64), first) if len(first) else np.zeros(0)) / np.maximum(1, n)
    measure["stop"] = np.isin(data[end[first + n - 1] - 1], np.frombuffer(b".!?:;", np.uint8)).astype(float) if len(first) else np.zeros(0)
    features = np.zeros((len(lo), 1 + len(_BOUNDS)), np.int32)
    at = 1
    for j, (name, bounds) in enumerate(_BOUNDS.items(), 1):
        features[:, j] = at + np.searchsorted(np.array(bounds), measure[name], "right")
        at += len(bounds) + 1
    place = (np.arange(len(words)) - np.repeat(first, n)).astype(np.uint64) if len(first) else np.zeros(0, np.uint64)
    whole = textvec.mix(np.add.reduceat(textvec.mix(words + place * np.uint64(0x9E3779B97F4A7C15)), first)) if len(first) else np.zeros(0, np.uint64)
    return Lines(counts, features, line_row, n, whole, again > 0)


def line_labels(lines: Lines, quality: np.ndarray, common: int = COMMON) -> np.ndarray:
    """1 (content) or 0 for every line of labelled texts in memory; `common` of them make a line boilerplate."""
    order = np.lexsort((lines.row, lines.hash))
    h, row = lines.hash[order], lines.row[order]
    other = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])) if len(h) else np.zeros(0, bool)
    held, n = np.unique(h[other], return_counts=True)
    return _gold(lines, quality, held[n >= common])


def _gold(lines: Lines, quality: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The labels of lines, given the hashes of those that stand in several documents."""
    return np.where(np.isin(lines.hash, shared) | lines.again, 0, quality[lines.row])


def _repeats(words: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Words in windows of N_WINDOW words that are in their text twice or more."""
    h, first = textvec.runs(words, row, N_WINDOW)
    if not len(h):
        return np.zeros(rows, np.int64)
    key = textvec.mix(h + textvec.mix(row[first].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, first[twice], 1)
    np.add.at(step, first[twice] + N_WINDOW, -1)
    return np.bincount(row, weights=np.cumsum(step[:-1]) > 0, minlength=rows).astype(np.int64)


@dataclass
class Chain:
    """Weights of the field: emission (features x 2), transition (2 x 2); least share of content."""

    emission: np.ndarray
    transition: np.ndarray
    share: float

    def emissions(self, lines: Lines) -> np.ndarray:
        return self.emission[lines.features].sum(1)


def _ranks(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Texts by falling number of lines: their first lines, those numbers, and who is left at step t."""
    rows, first, n = np.unique(row, return_index=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    left = len(n) - np.searchsorted(n[::-1], np.arange(1, n[0] + 1)) if len(n) else np.zeros(0, np.int64)
    return first, n, left


def viterbi(chain: Chain, lines: Lines) -> np.ndarray:
    """The best labels (1: content) of all texts at once, a line at a time."""
    e = chain.emissions(lines)
    first, n, left = _ranks(lines.row)
    label = np.zeros(len(e), np.int8)
    if not len(n):
        return label
    back = np.zeros((len(e), 2), np.int8)
    best = e[first].copy()
    for t in range(1, len(left)):
        k = left[t]
        step = best[:k, :, None] + chain.transition
        back[first[:k] + t] = step.argmax(1)
        best[:k] = step.max(1) + e[first[:k] + t]
    now = best.argmax(1)
    for t in range(len(left) - 1, -1, -1):
        k = left[t]
        at = first[:k] + t
        label[at] = now[:k]
        if t:
            now[:k] = back[at, now[:k]]
    return label


def _gradient(chain: Chain, lines: Lines, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected minus observed counts, by forward and backward sums."""
    e = chain.emissions(lines)
    first, n, left = _ranks(lines.row)
    fwd, bwd = np.zeros_like(e), np.zeros_like(e)
    fwd[first] = e[first]
    for t in range(1, len(left)):
        at = first[: left[t]] + t
        fwd[at] = np.logaddexp.reduce(fwd[at - 1][:, :, None] + chain.transition, axis=1) + e[at]
    for t in range(len(left) - 2, -1, -1):
        at = first[: left[t + 1]] + t
        bwd[at] = np.logaddexp.reduce(chain.transition + (e[at + 1] + bwd[at + 1])[:, None, :], axis=2)
    last = np.repeat(first + n - 1, n)
    norm = np.empty(len(e))
    norm[np.concatenate([np.arange(a, a + m) for a, m in zip(first, n)])] = np.logaddexp.reduce(fwd[last], axis=1)
    p = np.exp(fwd + bwd - norm[:, None])
    d_e = np.zeros_like(chain.emission)
    diff = p.copy()
    diff[np.arange(len(e)), gold] -= 1
    for j in range(lines.features.shape[1]):
        for y in (0, 1):
            d_e[:, y] += np.bincount(lines.features[:, j], weights=diff[:, y], minlength=len(d_e))
    inner = np.flatnonzero(lines.row[1:] == lines.row[:-1])
    pair = np.exp(fwd[inner][:, :, None] + chain.transition + (e[inner + 1] + bwd[inner + 1])[:, None, :] - norm[inner][:, None, None])
    d_t = pair.sum(0)
    np.add.at(d_t, (gold[inner], gold[inner + 1]), -1)
    return d_e, d_t


@dataclass
class Adam:
    """The weights of the field under training with their moments, as one vector each."""

    w: np.ndarray
    m: np.ndarray
    v: np.ndarray
    step: int = 0

    def chain(self, share: float = 0.5) -> Chain:
        return Chain(self.w[:-4].reshape(N_FEATURES, 2), self.w[-4:].reshape(2, 2), share)

    def walk(self, lines: Lines, gold: np.ndarray, steps: int) -> Adam:
        """Some steps on the likelihood of the lines' labels."""
        w, m, v = self.w.copy(), self.m.copy(), self.v.copy()
        for step in range(self.step + 1, self.step + steps + 1):
            g = np.concatenate([x.ravel() for x in _gradient(Adam(w, m, v).chain(), lines, gold)])
            g = g / max(1, len(gold)) + 1e-4 * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return Adam(w, m, v, self.step + steps)


def _start() -> Adam:
    w = np.concatenate([np.zeros(2 * N_FEATURES), [0.5, -0.5, -0.5, 0.5]])
    return Adam(w, np.zeros_like(w), np.zeros_like(w))


def content_share(label: np.ndarray, lines: Lines, rows: int) -> np.ndarray:
    words = np.bincount(lines.row, weights=lines.words, minlength=rows)
    return np.bincount(lines.row, weights=lines.words * label, minlength=rows) / np.maximum(1, words)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_LINES = f"doc_id long, key long, {', '.join(f'{c} long' for c in COUNTS)}, features binary, words binary, again binary, hashes array<long>"
_NAMES = [c.split()[0] for c in _LINES.split(", ")]


def _blobs(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """values cut at the places `at` into one binary a row."""
    return pa.array([values[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column(2)):
            lines = read_lines(data, offsets)
            at = np.searchsorted(lines.row, np.arange(hi - lo + 1))
            blobs = [_blobs(x, at) for x in (lines.features[:, 1:].astype(np.uint8), lines.words.astype(np.int32), lines.again)]
            hashes = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(lines.hash.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), *(pa.array(lines.counts[c], pa.int64()) for c in COUNTS), *blobs, hashes], _NAMES)


def read(docs: DataFrame) -> DataFrame:
    """A row for every row of docs: doc_id, key (a hash of the text), base counts, and what its lines hold."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text")).mapInArrow(_read, _LINES)


def _joined(table: pa.Table | pa.RecordBatch) -> Lines:
    """The lines of some rows of `read`."""
    whole = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    features = whole("features", np.uint8).reshape(-1, len(_BOUNDS))
    n = [len(x) for x in table.column("again").to_pylist()]
    features = np.concatenate([np.zeros((len(features), 1), np.int32), features], axis=1, dtype=np.int32)
    return Lines({}, features, np.repeat(np.arange(len(n)), n), whole("words", np.int32).astype(np.int64), again=whole("again", bool))


_SHARD = "features binary, row binary, words binary, gold binary, good binary"


def _shard(group: pa.Table) -> pa.Table:
    """The labelled documents of a shard as one row."""
    group = group.sort_by([("doc_id", "ascending")])
    lines, quality = _joined(group), group.column("quality").to_numpy().astype(np.int8)
    lines.hash = np.concatenate([np.asarray(x, np.int64) for x in group.column("hashes").to_pylist()])
    shared = group.column("shared").to_pylist()
    gold = np.concatenate([_gold(Lines({}, None, np.zeros(b - a, np.int64), None, lines.hash[a:b], lines.again[a:b]), quality[i : i + 1], np.array(shared[i] or [], np.int64)) for i, (a, b) in enumerate(itertools.pairwise(np.searchsorted(lines.row, np.arange(len(quality) + 1))))])
    columns = (lines.features.astype(np.uint8), lines.row.astype(np.int32), lines.words.astype(np.int32), gold.astype(np.int8), quality == 1)
    return pa.table([pa.array([x.tobytes()], pa.binary()) for x in columns], names=[c.split()[0] for c in _SHARD.split(", ")])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Lines, np.ndarray, np.ndarray]]:
    """Of each shard its lines, their labels, and which documents are good."""
    for batch in batches:
        for x in batch.to_pylist():
            features = np.frombuffer(x["features"], np.uint8).reshape(-1, 1 + len(_BOUNDS)).astype(np.int32)
            row, words = (np.frombuffer(x[c], np.int32).astype(np.int64) for c in ("row", "words"))
            yield Lines({}, features, row, words), np.frombuffer(x["gold"], np.int8), np.frombuffer(x["good"], bool)


def _labelled(lines: DataFrame, labels: DataFrame, rows: int | None) -> DataFrame:
    """The rows of `read` that have a label, with quality; of several texts of a doc_id the one with the largest key."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    known = known if rows is None else known.orderBy(F.xxhash64("doc_id")).limit(rows)
    one = F.max_by(F.struct("features", "words", "again", "hashes"), "key").alias("one")
    return lines.join(known, "doc_id").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"), one).select("doc_id", "quality", "one.*")


def _with_shared(labelled: DataFrame) -> DataFrame:
    """labelled with shared: the hashes of a good document's lines that stand in COMMON documents or more."""
    own = labelled.select("doc_id", "quality", F.explode(F.array_distinct("hashes")).alias("hash"))
    often = stored(own.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON), "often")
    total = labelled.agg(F.sum(F.size("hashes"))).first()[0] or 0
    good = own.where("quality = 1").select("doc_id", "hash")
    hot = F.broadcast(often.where(F.col("n") * HOT >= total).select("hash"))  # HOT rows at most
    rest = good.join(hot, "hash", "left_anti").join(often.where(F.col("n") * HOT < total).select("hash"), "hash")
    found = good.join(hot, "hash").select("doc_id", "hash").union(rest.select("doc_id", "hash"))
    return labelled.join(found.groupBy("doc_id").agg(F.collect_list("hash").alias("shared")), "doc_id", "left")


def _mean(shards: DataFrame, now: Adam) -> Adam:
    """STEPS steps on each shard by itself, then the mean of weights and moments by numbers of lines."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, gold, _ in _shards(batches):
            own = now.walk(lines, gold, STEPS)
            yield pa.RecordBatch.from_arrays([pa.array([len(gold)], pa.int64()), pa.array([np.concatenate([own.w, own.m, own.v]).tobytes()], pa.binary())], ["n", "state"])

    got = sorted((r["n"], r["state"]) for r in shards.mapInArrow(walk, "n long, state binary").collect())  # 2 kB a shard
    total = np.array([n for n, _ in got], np.float64) @ np.array([np.frombuffer(s) for _, s in got])
    return Adam(*np.split(total / max(1, sum(n for n, _ in got)), 3), now.step + STEPS)


def _least_share(shards: DataFrame, chain: Chain) -> float:
    """The share that all but one in 200 of the good texts reach, whatever that leaves of the others; 0.5 at most.

    It is found by counts of the share's digits, twice 4,096 buckets, so no task sorts the shares."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, _, good in _shards(batches):
            own = content_share(viterbi(chain, lines), lines, len(good))
            held = np.bincount(lines.row, minlength=len(good)) > 0
            yield pa.RecordBatch.from_arrays([pa.array(own[held & good])], ["share"])

    found = stored(shards.mapInArrow(share, "share double"), "shares")
    left, low = int(found.count() * 0.005), found.where("share < 0.5")
    digits = (F.floor(F.col("share") * 4096), F.floor(F.col("share") * (1 << 24)))
    for digit in digits:
        for d, n in low.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect():  # 4,096 rows at most
            if left < n:
                low = low.where(digit == d)
                break
            left -= n
        else:
            return 0.5
    return max(1e-6, low.agg(F.min("share")).first()[0])


def fit(docs: DataFrame, labels: DataFrame, rows: int | None = None) -> Chain:
    """Train on the lines of every labelled document, or of `rows` of them in the order of a hash of doc_id."""
    return train(stored(read(docs), "lines"), labels, rows)


def train(lines: DataFrame, labels: DataFrame, rows: int | None = None) -> Chain:
    """The field fitted on all rows of `read` that have a label. Without labels, or with one label only, every line counts as content.

    Labelled documents are dealt by a hash of doc_id into shards of about SHARD_ROWS documents. Each shard takes some steps from the common weights,
    then weights and moments are averaged, ROUNDS times; one shard alone is trained as a whole.
    """
    labelled = stored(_labelled(lines, labels, rows), "labelled")
    n, held, least, most = labelled.agg(F.count("*"), F.sum(F.size("hashes")), F.min("quality"), F.max("quality")).first()
    if not held or least == most:
        emission = np.zeros((N_FEATURES, 2))
        emission[0, 1] = 1
        return Chain(emission, np.zeros((2, 2)), 0.5)
    number = -(-n // SHARD_ROWS) + held // SHARD_LINES
    dealt = _with_shared(labelled).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(number)))
    shards = stored(dealt.groupBy("shard").applyInArrow(_shard, _SHARD), "shards")
    now = _start()
    for _ in range(ROUNDS):
        now = _mean(shards, now)
    return now.chain(_least_share(shards, now.chain()))


def measure(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, base counts, and the share of words in content lines of every row."""
    return judge(read(docs), chain)


def judge(lines: DataFrame, chain: Chain) -> DataFrame:
    """What `measure` says of rows of `read`."""
    shared = lines.sparkSession.sparkContext.broadcast(chain)  # a fixed size

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            part = _joined(batch)
            share = content_share(viterbi(own, part), part, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *COUNTS)), pa.array(share)], ["doc_id", *COUNTS, "content_share"])

    narrow = lines.select("doc_id", *COUNTS, "features", "words", "again")
    return narrow.mapInArrow(decode, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, content_share double")


def quality(docs: DataFrame, labels: DataFrame, rows: int | None = None) -> DataFrame:
    """Base counts of every row, base_failed, kept and the content share.

    base_failed: fewer than 20 words, or over 30 % of them in repeated windows. Null and empty texts
    have no words and fail. Texts of any length are read whole, once. Repeated rows give repeated results; extra columns are ignored.
    """
    lines = stored(read(docs), "lines")
    chain = train(lines, labels, rows)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = judge(lines, chain).withColumn("base_failed", failed)
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("content_share") >= chain.share)).alias("kept"), "content_share")
