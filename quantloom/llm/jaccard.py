"""N-gram Jaccard self-join: rare-first prefixes, length, positional and suffix filters, one check per pair.

A document's set holds its distinct k-word shingles (A-Z lower-cased, words between ASCII white
space); a text with fewer words is one shingle, a text without words (or null) an empty set that
links with nothing. Two documents link when percent * union <= 100 * intersection.

1. One pass reads every text and leaves a row per document (set size, 64-bit set hash) and, per task, how many sets hold a shingle of each of BUCKETS hash buckets. The
   counts are summed in two levels and have a fixed size, so they may be broadcast.
2. Shingles are ordered by (count of their bucket, hash): rare ones first. Two sets that link share
   a shingle among the first n - ceil(t n) + 1 of each. These prefixes are written once, each shingle
   with its place and packed counts of the set's shingles after it, by eight hash ranges; those that
   stand in one prefix only are left behind before wider rows are compared. At the first
   shingle that two sets share in this order all others they share stand after it, so their sizes, the
   two places and the counts bound the overlap: the length, positional and suffix filters.
3. Documents with the same set are one class. Per prefix shingle, the class that has it earliest is
   the leader; every other class is compared with leaders only (a star, not all pairs). Links found
   so far are closed to components. Then classes that are not in their leader's component are
   compared with the classes of other components that share the shingle; pairs inside a component
   can't change it. Of two sets the smaller one holds the first shared shingle in a still shorter
   prefix, n - ceil(2t / (1 + t) n) + 1, and their sizes lie in the same or neighbouring bands of ratio t:
   only such rows meet, so texts of one template that can't link don't. Each pair is verified once,
   on whole sets, which one more pass over the texts writes for the documents in candidate pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import discard, give_back, stored, text_slices
from .components import components

#: Size of the table of shingle counts, and the parts in which it is summed.
BUCKETS, PARTS = 1 << 20, 16
#: Largest filter (16 MB). One keeps shingles of a single prefix from being shuffled, another one texts outside every
#: candidate pair from being read into sets: 64 bits for each document in a pair; where 16 MB leave fewer than 8 bits
#: each, documents are joined by id instead.
FILTER_BITS = 1 << 27
#: Bytes of text that a task turns into sets at a time: they take some sixteen times as much.
SLICE = 1 << 18

_READ = "doc_id long, key long, n long, cls long, part int, task int, counts binary"


def needed(n: int | np.ndarray, percent: int):
    """Least set size that may link with one of size n; also the least overlap for the prefix."""
    return -(-n * percent // 100)


def prefix_length(n: int, percent: int) -> int:
    return n - needed(n, percent) + 1


def _after(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per place in a prefix, the set's shingles after it in each of eight hash ranges, modulo 256, packed."""
    bins = (s >> np.uint64(61)).astype(np.int64)
    upto = np.cumsum(np.eye(8, dtype=np.int64)[bins[first]], axis=0)
    return ((np.bincount(bins, minlength=8) - upto) & 255).astype(np.uint8).view(np.int64).ravel()


def _class(s: np.ndarray) -> int:
    if not len(s):
        return 0
    total = np.array([(textvec.mix(s ^ np.uint64(0x5851F42D4C957F2D))).sum() + np.uint64(len(s))], np.uint64)
    return int(textvec.mix(total).astype(np.int64)[0])


def _first_pass(k: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            n, cls = [], []
            for _, _, data, offsets in text_slices(batch.column(1), SLICE):
                sets = textvec.shingle_sets(data, offsets, k)
                n += map(len, sets)
                cls += map(_class, sets)
                if sets:
                    np.add.at(counts, (np.concatenate(sets) & np.uint64(BUCKETS - 1)).astype(np.int64), np.uint32(1))
            none = [None] * len(n)
            yield _batch(batch.column(0), batch.column(2), n, cls, none, none, none)
        task = TaskContext.get().partitionId()
        for part in range(PARTS):
            own = counts[part * BUCKETS // PARTS : (part + 1) * BUCKETS // PARTS]
            if own.any():
                yield _batch([None], [None], [None], [None], [part], [task], [own.astype(np.uint64).tobytes()])

    return read


def _batch(doc_id, key, n, cls, part, task, counts) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    names = ["doc_id", "key", "n", "cls", "part", "task", "counts"]
    values = (doc_id, key, n, cls, part, task, counts)
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, kinds)], names)


def _add(group: pa.Table) -> pa.Table:
    total = np.zeros(BUCKETS // PARTS, np.uint64)
    for c in group.column("counts"):
        total += np.frombuffer(c.as_buffer(), np.uint64)
    return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _clipped(group: pa.Table) -> pa.Table:
    """The last sum, in half the width: what goes to the driver stays small there."""
    total = np.minimum(np.frombuffer(_add(group).column("counts")[0].as_buffer(), np.uint64), np.uint64(0xFFFFFFFF))
    return pa.table({"part": group.column("part")[:1].cast(pa.int32()), "counts": pa.array([total.astype(np.uint32).tobytes()], pa.binary())})


def _bucket_counts(rows: DataFrame) -> np.ndarray:
    """Sum the tasks' counts: first in groups of about the root of the number of tasks, then all."""
    own = rows.where("part is not null")
    tasks = own.agg(F.max("task")).first()[0] or 0
    some = own.select("part", F.pmod("task", F.lit(int(tasks**0.5) + 1)).alias("lot"), "counts")
    some = some.groupBy("part", "lot").applyInArrow(_add, "part int, counts binary")
    got = some.groupBy("part").applyInArrow(_clipped, "part int, counts binary").toArrow()  # PARTS rows
    total = np.zeros(BUCKETS, np.uint32)
    for part, counts in zip(got.column("part").to_pylist(), got.column("counts")):
        total[part * BUCKETS // PARTS : (part + 1) * BUCKETS // PARTS] = np.frombuffer(counts.as_buffer(), np.uint32)
    return total


def _prefixes(k: int, percent: int, counts):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        seen: set[int] = set()  # classes of this task's rows: copies repeat a prefix
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0), SLICE):
                token, cls, size, place, after = [], [], [], [], []
                for s in textvec.shingle_sets(data, offsets, k):
                    if not len(s) or (own := _class(s)) in seen:
                        continue
                    seen.add(own)
                    p = prefix_length(len(s), percent)
                    rank = table[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]
                    if p < len(s):  # all that may tie with the p-th go into the sort
                        few = np.flatnonzero(rank <= np.partition(rank, p - 1)[p - 1])
                        first = few[np.lexsort((s[few], rank[few]))][:p]
                    else:
                        first = np.lexsort((s, rank))
                    token.append(s[first].astype(np.int64))
                    cls.append(np.full(p, own))
                    size.append(np.full(p, len(s), np.int32))
                    place.append(np.arange(p, dtype=np.int32))
                    after.append(_after(s, first))
                if token:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (token, cls, size, place, after)], ["token", "cls", "n", "pos", "after"])

    return read


def _filters(percent: int) -> str:
    """Length, positional and suffix filters for the rows x and y of a shared prefix shingle: twice the
    overlap they allow is 2 + both numbers of shingles after it, less what the packed counts differ by."""
    apart = "pmod((shiftrightunsigned(x_after, {0}) & 255) - (shiftrightunsigned(y_after, {0}) & 255), 256)"
    gap = " + ".join(f"least({g}, 256 - {g})" for g in (apart.format(8 * i) for i in range(8)))
    length = f"100 * least(x_n, y_n) >= {percent} * greatest(x_n, y_n)"
    place = f"{100 + percent} * least(x_n - x_pos, y_n - y_pos) >= {percent} * (x_n + y_n)"
    suffix = f"{100 + percent} * (x_n - x_pos + y_n - y_pos - ({gap})) >= {2 * percent} * (x_n + y_n)"
    return f"{length} and {place} and {suffix}"


def _short(side: str, percent: int) -> str:
    """Whether a row lies in the shorter prefix, for the smaller of two sets."""
    return f"{100 + percent} * ({side}_n - {side}_pos) >= {2 * percent} * {side}_n"


def _band(side: str, percent: int):
    """Bands of sizes: of two sets within the ratio, the larger one is in the same or the next band."""
    return F.floor(F.log(F.col(f"{side}_n").cast("double")) / float(np.log(100 / percent * 1.001))).cast("int")


def _verify(percent: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, xs, ys = (batch.column(i) for i in range(4))
            keep = np.zeros(len(a), bool)
            for i in range(len(a)):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (xs, ys))
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                same = int((y[at] == x).sum())
                keep[i] = 100 * same >= percent * (len(x) + len(y) - same)
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep))
        give_back()

    return read


def _hash_bits(ids: np.ndarray, size: int) -> np.ndarray:
    return (textvec.mix(ids.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def _sets(k: int, wanted=None):
    """(id, text) -> id, class and set of the documents that the filter lets through, or of all."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if wanted is None else wanted.value
        for batch in batches:
            if bits is not None:
                h = _hash_bits(batch.column(0).to_numpy(), 8 * len(bits))
                batch = batch.filter(pa.array((bits[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1))
            for lo, hi, data, offsets in text_slices(batch.column(1), SLICE):
                sets = textvec.shingle_sets(data, offsets, k)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array([_class(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "cls", "held"])

    return read


def _marked(size: int):
    """ids -> the words of 64 bits, of `size` bits in all, that hold a bit of an id's hash."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(size // 64, np.int64)  # a byte for each bit would take up to 128 MB
        for batch in batches:
            h = _hash_bits(batch.column(0).to_numpy(), size)
            np.bitwise_or.at(words, h >> 6, np.int64(1) << (h & 63))
        held = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(words[held])], ["at", "word"])
        del words, held
        give_back()

    return read


def _filter_bits(ids: DataFrame, size: int) -> np.ndarray:
    """A bit for each id's hash, gathered as size / 64 words at most."""
    got = ids.mapInArrow(_marked(size), "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[got.column("at").to_numpy()] = got.column("word").to_numpy()
    return out.view(np.uint8)


def _let_through(tokens: DataFrame, often: DataFrame) -> DataFrame:
    """The rows whose token may be in `often`: most shingles of a prefix stand in no other and need not be shuffled.
    The filter has 8 bits a token up to 16 MB; beyond that it lets more through, which the join then leaves out."""
    size = min(FILTER_BITS, 1 << max(16, (8 * often.count()).bit_length()))
    wanted = tokens.sparkSession.sparkContext.broadcast(_filter_bits(often, size))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            h = _hash_bits(batch.column(0).to_numpy(), size)
            yield batch.filter(pa.array((bits[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1))
        give_back()

    return tokens.mapInArrow(read, tokens.schema)


def _wanted_sets(ids: DataFrame, narrow: DataFrame, k: int) -> DataFrame:
    """id, cls, held of the documents in candidate pairs: one more pass over the texts, or a join where they are many."""
    wanted = ids.count()
    size = min(FILTER_BITS, 1 << max(16, (64 * wanted).bit_length()))
    schema = "id long, cls long, held binary"
    if 8 * wanted > FILTER_BITS:
        return narrow.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_sets(k), schema)
    return narrow.mapInArrow(_sets(k, narrow.sparkSession.sparkContext.broadcast(_filter_bits(ids, size))), schema)


def links(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links): doc_id, key (a hash of the text), n, cls of every row; cls, id (its smallest
    doc_id) of every class; links between classes (a, b).

    Links inside a component that others imply may be missing; components are exact. Rows whose
    doc_id is null get a set size and take part in no link.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(narrow.withColumn("key", F.xxhash64("text")).mapInArrow(_first_pass(k), _READ), "sets")
    every = rows.where("part is null").select("doc_id", "key", "n", "cls")
    classes = stored(every.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("id")), "classes")
    narrow = narrow.where("doc_id is not null")
    counts = docs.sparkSession.sparkContext.broadcast(_bucket_counts(rows))
    tokens = stored(narrow.select("text").mapInArrow(_prefixes(k, percent, counts), "token long, cls long, n int, pos int, after long"), "prefixes")
    often = stored(tokens.groupBy("token").agg(F.count("*").alias("times")).where("times > 1").select("token"), "repeated")
    held = stored(_let_through(tokens, often).join(often, "token", "left_semi"), "often")
    discard(tokens)
    discard(often)
    first = F.min(F.struct("pos", "n", "cls", "after")).alias("y")
    lead = held.groupBy("token").agg(first, F.max("cls").alias("high"), F.min("cls").alias("low")).where("low <> high")
    lead = stored(lead.select("token", F.col("y.cls").alias("y"), F.col("y.n").alias("y_n"), F.col("y.pos").alias("y_pos"), F.col("y.after").alias("y_after")), "lead")
    shared = held.join(lead, "token").select(*lead.columns, F.col("cls").alias("x"), F.col("n").alias("x_n"), F.col("pos").alias("x_pos"), F.col("after").alias("x_after"))
    shared = stored(shared.distinct(), "shared")
    discard(held)
    star = stored(_candidates(shared.where("x <> y"), classes, percent), "star")
    discard(lead)
    found = _verified(star, narrow, k, percent)
    label = stored(components(found), "label")
    tagged = shared.select("token", "x", "x_n", "x_pos", "x_after", "y")
    for side in "xy":
        tagged = tagged.join(label.select(F.col("node").alias(side), F.col("label").alias(f"{side}_of")), side, "left").withColumn(f"{side}_of", F.coalesce(f"{side}_of", side))
    tagged = stored(tagged.select("token", "x", "x_n", "x_pos", "x_after", "x_of", "y_of"), "tagged")
    discard(shared)
    rest = _candidates(_rest(tagged, percent), classes, percent).join(star.select("a", "b"), ["a", "b"], "left_anti")
    return every, classes, found.union(_verified(stored(rest, "rest"), narrow, k, percent))


def _rest(tagged: DataFrame, percent: int) -> DataFrame:
    """Pairs of rows of a token, one of them outside its leader's component, from different components."""
    minor = tagged.where("x_of <> y_of").drop("y_of")
    other = tagged.select("token", *(F.col(f"x{c}").alias(f"y{c}") for c in ("", "_n", "_pos", "_after", "_of")))
    near = lambda side: F.explode(F.array(_band(side, percent), _band(side, percent) + 1))
    larger = minor.withColumn("band", _band("x", percent)).join(other.where(_short("y", percent)).withColumn("band", near("y")), ["token", "band"]).where("y_n <= x_n")
    smaller = minor.where(_short("x", percent)).withColumn("band", near("x")).join(other.withColumn("band", _band("y", percent)), ["token", "band"]).where("x_n < y_n")
    return larger.unionByName(smaller).where("x_of <> y_of")


def _candidates(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that pass the filters at one of their shared shingles, with their ids."""
    pairs = pairs.where(_filters(percent)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("cls").alias(side), F.col("id").alias(f"{side}_id")), side)
    return pairs.select("a", "b", "a_id", "b_id")


def _verified(pairs: DataFrame, narrow: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose whole sets link."""
    ids = stored(pairs.select(F.col("a_id").alias("id")).union(pairs.select(F.col("b_id").alias("id"))).distinct(), "ids")
    held = stored(_wanted_sets(ids, narrow, k), "held")
    for side, name in (("b", "y"), ("a", "x")):  # pairs and sets are of any number: neither is broadcast, at no size
        sets = held.select(F.col("id").alias(f"{side}_id"), F.col("cls").alias(side), F.col("held").alias(name))
        pairs = pairs.join(sets.hint("merge"), [f"{side}_id", side])
    found = stored(pairs.select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long"), "found")
    discard(held)
    return found


def _rooted(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows as links gives them, cls and root: the smallest doc_id of each class's component)."""
    every, classes, found = links(docs, k, percent)
    label = stored(components(found), "label")
    named = classes.join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    named = stored(named.select("cls", "id", "label"), "named")
    first = stored(named.groupBy("label").agg(F.min("id").alias("root")), "first")
    return every, stored(named.join(first, "label").select("cls", "root"), "root")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id reachable by links.

    Repeated rows give repeated result rows; a doc_id with several texts has a row for each. A row
    with an empty set, or without doc_id, is a component of its own. Texts of any length are read
    whole. Extra columns are ignored.
    """
    every, root = _rooted(docs, k, percent)
    out = every.join(root, "cls", "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


#: Rows without doc_id are ranked after those with one: their stand-in numbers have this bit.
_LATE = 1 << 62


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near duplicates: the one with the smallest doc_id, rows without
    one last. Of repeated rows one stays; of several texts of a doc_id each is judged by itself. Texts
    without words stay all. Columns are as in docs.
    """
    key = F.xxhash64(F.col("text").cast("string"))
    number = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(key, 2).bitwiseOR(F.lit(_LATE)))
    every, root = _rooted(docs.select(number.alias("doc_id"), "text"), k, percent)
    rows = every.where("n > 0").groupBy("doc_id", "key", "cls").agg(F.count("*").alias("times")).join(root, "cls")
    kept = rows.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("k")).select("k.doc_id", "k.key", F.lit(True).alias("stays"))
    rows = rows.join(kept, ["doc_id", "key"], "left").select(F.col("doc_id").alias("_number"), F.col("key").alias("_key"), "stays", "times")
    rows = stored(rows.where("stays is null or times > 1"), "gone")
    named = docs.select(*docs.columns, number.alias("_number"), key.alias("_key"))
    alone = named.join(rows.select("_number", "_key"), ["_number", "_key"], "left_anti")
    again = named.join(rows.where("stays").select("_number", "_key"), ["_number", "_key"], "left_semi").dropDuplicates(["_number", "_key"])
    return alone.unionByName(again).select(docs.columns)
