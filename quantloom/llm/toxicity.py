"""Convolutional text classifier: hashed word embeddings, filters of several widths, max pooling.

A word's vector is the sum of the embeddings of the whole word and of its prefixes, all hashed, so that inflected forms share
most of it and stems are told from inflected forms. Filters of one, two and three words slide over the
whole text, the largest response of each is kept (max pooling), and a logistic layer scores them. The
network is trained in numpy on the driver, on at most `positives + negatives` labelled rows and
`SAMPLE_BYTES` of their text; it scores every row in Spark tasks, whole texts of any length.

Thresholds are calibrated by language. The language is told from the letters of the text itself;
the lang column is never read. A score of 0.7 is the calibrated threshold of the text's language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .common import bounded, give_back, text_slices

BUCKETS, DIMS, WIDTHS, FILTERS = 1 << 18, 4, (1, 2, 3), 4
#: Bytes of a word's hashed prefixes; the last one is the whole word.
PREFIXES = (4, 5, 6, 7, 8, 1 << 30)
#: Letters that tell a text's language; a text with none of them falls in the first group.
MARKS = {"de": "äöüß", "es": "ñóíáú", "fr": "çèêàâîùé"}
THRESHOLD = 0.7
#: Bound on the text of the labelled sample; a larger sample gives up its last rows.
SAMPLE_BYTES = 64 << 20
#: Bytes of text that a task turns into features at a time: they take some fifty times as much.
SLICE = 1 << 18


@dataclass
class Words:
    """A slice of texts: features (words, prefixes), the words' rows, number of rows, languages."""

    ids: np.ndarray
    row: np.ndarray
    rows: int
    tongue: np.ndarray


def featurise(data: np.ndarray, offsets: np.ndarray) -> Words:
    start, end, row = textvec.word_spans(data, offsets, textvec.ALNUM)
    ids = np.empty((len(start), len(PREFIXES)), np.int32)
    for j, width in enumerate(PREFIXES):
        h = textvec.hash_spans(data, start, np.minimum(end, start + width), textvec.LOWER)
        ids[:, j] = textvec.mix(h + np.uint64(width)) & np.uint64(BUCKETS - 1)
    rows = len(offsets) - 1
    return Words(ids, row.astype(np.int32), rows, _tongue(data, offsets, rows))


def _tongue(data: np.ndarray, offsets: np.ndarray, rows: int) -> np.ndarray:
    """0, or 1 + the place in MARKS of the language whose letters are the most frequent."""
    counts = np.zeros((rows, 1 + len(MARKS)))
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) > 1 else np.zeros(0, np.int64)
    where = np.searchsorted(offsets, lead, "right") - 1
    for j, letters in enumerate(MARKS.values(), 1):
        second = [x.encode()[1] for x in letters if x.encode()[0] == 0xC3]
        counts[:, j] = np.bincount(where[np.isin(data[lead + 1] | 0x20, np.array(second) | 0x20)], minlength=rows)
    return counts.argmax(1)


@dataclass
class Network:
    embed: np.ndarray  # buckets x dims
    kernel: list[np.ndarray]  # by width: width x dims x filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    shift: np.ndarray  # by language
    slope: float = 1.0

    def vectors(self, words: Words) -> np.ndarray:
        x = self.embed[words.ids[:, 0]]
        for j in range(1, words.ids.shape[1]):
            x = x + self.embed[words.ids[:, j]]
        return x

    def responses(self, x: np.ndarray, row: np.ndarray, at: int) -> np.ndarray:
        """Of one width's filters at each word; where a window leaves the row, -inf."""
        width = WIDTHS[at]
        r = np.full((len(x), FILTERS), -np.inf, np.float32)
        if len(x) >= width:
            n = len(x) - width + 1
            total = sum(x[j : j + n] @ self.kernel[at][j] for j in range(width)) + self.bias[at]
            total[row[:n] != row[width - 1 :]] = -np.inf
            r[:n] = total
        return r

    def pooled(self, words: Words, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the largest response of every filter in each text, 0 at least; the words they start at, or -1)."""
        pool = np.zeros((words.rows, len(WIDTHS), FILTERS), np.float32)
        place = np.full(pool.shape, -1, np.int64)
        held, first, count = np.unique(words.row, return_index=True, return_counts=True)
        if not len(held):
            return pool.reshape(words.rows, -1), place.reshape(words.rows, -1)
        of = np.repeat(np.arange(len(held)), count)
        for at in range(len(WIDTHS)):
            r = self.responses(x, words.row, at)
            top = np.maximum.reduceat(r, first, axis=0)
            for f in range(FILTERS):
                hit = np.flatnonzero((r[:, f] == top[of, f]) & (r[:, f] > 0))
                if len(hit):
                    hit = hit[np.append(True, of[hit][1:] != of[hit][:-1])]  # the first of a text's equals
                    rows = held[of[hit]]
                    pool[rows, at, f], place[rows, at, f] = r[hit, f], hit
        return pool.reshape(words.rows, -1), place.reshape(words.rows, -1)

    def logits(self, words: Words) -> np.ndarray:
        return self.pooled(words, self.vectors(words))[0] @ self.out + self.out_bias

    def scores(self, words: Words) -> np.ndarray:
        z = self.slope * (self.logits(words) - self.shift[words.tongue]) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _start(words: Words, label: np.ndarray, rng: np.random.Generator) -> Network:
    """The first dimension starts as each feature's smoothed log-odds, the rest at random."""
    bad, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for j in range(words.ids.shape[1]):  # a column at a time: few copies
        key = words.ids[:, j].astype(np.int64) * words.rows + words.row
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        toxic = label[key % words.rows] == 1
        key //= words.rows
        bad += np.bincount(key[toxic], minlength=BUCKETS)
        good += np.bincount(key[~toxic], minlength=BUCKETS)
    odds = np.log((bad + 0.5) / (label.sum() + 1)) - np.log((good + 0.5) / ((1 - label).sum() + 1))
    odds *= (bad + good) / (bad + good + 20.0)
    embed = rng.normal(0, 0.01, (BUCKETS, DIMS)).astype(np.float32)
    embed[:, 0] = odds / len(PREFIXES)
    kernel = [rng.normal(0, 0.1, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w, k in zip(WIDTHS, kernel):
        k[:, 0, 0] = 1.0 / w
    out = np.full(len(WIDTHS) * FILTERS, 0.05, np.float32)
    out[::FILTERS] = 0.5
    return Network(embed, kernel, np.zeros((len(WIDTHS), FILTERS), np.float32), out, -2.0, np.zeros(1 + len(MARKS)))


def _pick(words: Words, rows: np.ndarray) -> Words:
    """The words of some rows, in ascending order of the rows."""
    rows = np.sort(rows)
    lo, hi = np.searchsorted(words.row, rows), np.searchsorted(words.row, rows, "right")
    ids = np.concatenate([words.ids[a:b] for a, b in zip(lo, hi)]) if len(rows) else words.ids[:0]
    return Words(ids, np.repeat(np.arange(len(rows), dtype=np.int32), hi - lo), len(rows), words.tongue[rows])


def train(words: Words, label: np.ndarray, epochs: int = 6, rate: float = 0.05, seed: int = 7) -> Network:
    """Fit by Adagrad on three quarters of the rows; calibrate on all, weighing the rest alike."""
    rng = np.random.default_rng(seed)
    label = label.astype(np.float32)
    fold = rng.random(words.rows) < 0.75
    if label[fold].min(initial=1) == label[fold].max(initial=0):
        fold[:] = True
    fit = np.flatnonzero(fold)
    net = _start(_pick(words, fit), label[fit].astype(np.int64), rng)
    grown = {"embed": np.full(net.embed.shape, 1e-3, np.float32), "out": np.full(net.out.shape, 1e-3), "bias": np.full(net.bias.shape, 1e-3)}
    sums = [np.full(k.shape, 1e-3, np.float32) for k in net.kernel]
    out_sum = 1e-3
    for _ in range(epochs):
        for lot in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            lot = np.sort(lot)
            part, y = _pick(words, lot), label[lot]
            x = net.vectors(part)
            pool, place = net.pooled(part, x)
            p = 1 / (1 + np.exp(-np.clip(pool @ net.out + net.out_bias, -30, 30)))
            g = (p - y) / len(lot)
            down = (g[:, None] * net.out * (place >= 0)).reshape(len(lot), len(WIDTHS), FILTERS)
            place = place.reshape(down.shape)
            d_out, d_b = pool.T @ g, g.sum()
            d_bias, seen, parts = np.zeros_like(net.bias), [], []
            for at, width in enumerate(WIDTHS):
                d_kernel = np.zeros_like(net.kernel[at])
                for f in range(FILTERS):
                    on = place[:, at, f] >= 0
                    if not on.any():
                        continue
                    t, gd = place[:, at, f][on], down[:, at, f][on]
                    d_bias[at, f] = gd.sum()
                    for j in range(width):
                        d_kernel[j, :, f] = gd @ x[t + j]
                        seen.append(part.ids[t + j].ravel())
                        parts.append(np.repeat(gd[:, None] * net.kernel[at][j][:, f], len(PREFIXES), axis=0))
                sums[at] += d_kernel**2
                net.kernel[at] -= rate * d_kernel / np.sqrt(sums[at])
            if seen:
                ids, inverse = np.unique(np.concatenate(seen), return_inverse=True)
                d_embed = np.zeros((len(ids), DIMS), np.float32)
                np.add.at(d_embed, inverse, np.concatenate(parts))
                grown["embed"][ids] += d_embed**2
                net.embed[ids] -= rate * d_embed / np.sqrt(grown["embed"][ids])
            grown["out"] += d_out**2
            net.out = (net.out - rate * d_out / np.sqrt(grown["out"])).astype(np.float32)
            grown["bias"] += d_bias**2
            net.bias -= (rate * d_bias / np.sqrt(grown["bias"])).astype(np.float32)
            out_sum += d_b**2
            net.out_bias -= rate * d_b / out_sum**0.5
    _calibrate(net, words, label, np.flatnonzero(~fold) if not fold.all() else fit)
    return net


def _cut(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap between sorted logits at which the most rows fall on their side."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    right = np.concatenate([[0], np.cumsum(y == 0)]) + np.concatenate([np.cumsum((y == 1)[::-1])[::-1], [0]])
    gap = np.concatenate([[1e-3], np.diff(z), [1e-3]])
    best = np.flatnonzero(right == right.max())
    at = best[gap[best].argmax()]
    return float(z[0] - 1 if at == 0 else z[-1] + 1 if at == len(z) else (z[at - 1] + z[at]) / 2)


def _calibrate(net: Network, words: Words, label: np.ndarray, rows: np.ndarray, least: int = 25) -> None:
    """A threshold for each language with at least `least` rows of each label, else the common one."""
    rows = np.sort(rows)
    part, y = _pick(words, rows), label[rows]
    z = net.logits(part)
    net.shift[:] = _cut(z, y)
    for tongue in range(1 + len(MARKS)):
        own = part.tongue == tongue
        if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= least:
            net.shift[tongue] = _cut(z[own], y[own])
    net.slope = 1.0


def labelled_sample(docs: DataFrame, labels: DataFrame, positives: int, negatives: int) -> pa.Table:
    """At most so many toxic and other rows, by the order of a hash of doc_id, with whole texts.

    Rows with crc32(doc_id) mod 3 = 1 stay out: they are held out.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(~_held_out()).withColumn("turn", F.xxhash64("doc_id"))
    few = known.where("toxic = 1").orderBy("turn").limit(positives).unionByName(known.where("toxic = 0").orderBy("turn").limit(negatives))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(few.select("doc_id", "toxic")), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))  # one row a label
    return bounded(found, SAMPLE_BYTES).select("doc_id", "toxic", "text").toArrow().sort_by([("doc_id", "ascending")])


def _held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, positives: int = 2000, negatives: int = 3000) -> Network:
    """Train on a bounded sample of labelled rows; without both labels every text scores low."""
    sample = labelled_sample(docs, labels, positives, negatives)
    parts = [featurise(d, o) for _, _, d, o in text_slices(sample.column("text"))]
    label = sample.column("toxic").to_numpy().astype(np.int64)
    del sample
    if not parts or label.min() == label.max():
        rng = np.random.default_rng(0)
        net = _start(Words(np.zeros((0, len(PREFIXES)), np.int32), np.zeros(0, np.int64), 1, np.zeros(1, np.int64)), np.zeros(1, np.int64), rng)
        net.embed[:], net.shift[:] = 0, 5.0
        return net
    base = np.cumsum([0] + [p.rows for p in parts])
    row = np.concatenate([p.row + np.int32(b) for p, b in zip(parts, base)])
    tongue = np.concatenate([p.tongue for p in parts])
    ids = np.empty((len(row), len(PREFIXES)), np.int32)
    at = 0
    while parts:
        part = parts.pop(0).ids
        ids[at : at + len(part)] = part
        at += len(part)
    return train(Words(ids, row, int(base[-1]), tongue), label)


def _scorer(shared, text: int, names: list[str]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            s = [own.scores(featurise(data, offsets)) for _, _, data, offsets in text_slices(batch.column(text), SLICE)]
            score = pa.array(np.concatenate(s) if s else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names)
        give_back()

    return read


def score(docs: DataFrame, net: Network, column: str = "score") -> DataFrame:
    """docs (of any columns, text a string) with the score of every row, null texts as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed size
    names = [*docs.columns, column]
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    return docs.mapInArrow(_scorer(shared, docs.columns.index("text"), names), schema)


def keep_clean(docs: DataFrame, labels: DataFrame, positives: int = 2000, negatives: int = 3000) -> DataFrame:
    """The rows of docs that score below the threshold."""
    kept = score(docs, fit(docs, labels, positives, negatives), "_toxicity").where(F.col("_toxicity") < THRESHOLD)
    return kept.select(docs.columns)


def toxicity(docs: DataFrame, labels: DataFrame, positives: int = 2000, negatives: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    Null or empty texts have a low score; a null doc_id is not held out; repeated rows give
    repeated results; extra columns are ignored. An empty labels table gives low scores throughout.
    """
    net = fit(docs, labels, positives, negatives)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(narrow, net).select(
        "doc_id",
        F.coalesce(_held_out(), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
