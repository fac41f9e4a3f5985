"""Divergence of sources by systolic rotation.

Terms are counted by language and source in the tasks that read the texts and added up. A language keeps
the terms of at least `least` of its documents, dealt by hash into shards of about `SHARD` entries a slot.
A source is a group of its language; its counts of a shard's terms are a cell, two compressed arrays. The
groups of a language stand in at most `SLOTS` slots; a slot's cells of one shard are a row, which stays in its
partition for the whole tournament. Each round the slots' compressed cells move on to the next meeting of
a round-robin tournament, meet the cells that are at home there and are evaluated in both directions; the
meetings inside a slot come first, when local heaps also rank the terms of each group of the shard. What a
round yields is sums by pair, one row a shard and pair of groups; they are added up over shards at the end.

A term that both groups lack adds the same to every pair of them, so it is counted and not visited.
All numbers are whole: p = 1 + floor(SCALE (count + 1) / (N + V)), f = floor((p - q)^2 / q).
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textvec
from .common import stored, text_slices

#: Slots of a language's groups: SLOTS - 1 rounds at most.
SLOTS = 8
#: Entries (terms times groups) of one slot in one shard, about.
SHARD = 1 << 17
SCALE = 1_000_000_000
#: Bytes of a term in the class [^\x00-\x40\x5B-\x60\x7B-\x7F].
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs) of each slice of texts; its groups' documents have a null term."""
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column(2), 2 << 20):
            start, end, row = textvec.word_spans(data, offsets, LETTER)
            at = np.concatenate([[0], np.cumsum(end - start)])
            letters = textvec.LOWER[data[LETTER[data]]]
            terms = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(letters)).dictionary_encode()
            groups = list(zip(batch.column(0)[lo:hi].to_pylist(), batch.column(1)[lo:hi].to_pylist()))
            docs = Counter(groups)
            number = {g: i for i, g in enumerate(docs)}
            of = np.array([number[g] for g in groups], np.int64)
            code, kinds = np.asarray(terms.indices).astype(np.int64), max(1, len(terms.dictionary))
            each, n = np.unique(row * kinds + code, return_counts=True)  # a text's terms
            pair, place = np.unique(of[each // kinds] * kinds + each % kinds, return_inverse=True)
            count, found = np.bincount(place, n, len(pair)).astype(np.int64), np.bincount(place, minlength=len(pair))
            owner = pa.array(np.concatenate([pair // kinds, np.arange(len(docs))]))
            lang, source = (pa.array(x, pa.string()).take(owner) for x in zip(*docs))
            word = pa.concat_arrays([terms.dictionary.take(pa.array(pair % kinds)).cast(pa.string()), pa.nulls(len(docs), pa.string())])
            n, found = np.concatenate([count, np.zeros(len(docs), np.int64)]), np.concatenate([found, list(docs.values())])
            yield pa.RecordBatch.from_arrays([lang, source, word, pa.array(n), pa.array(found.astype(np.int64))], names=["lang", "source", "term", "n", "docs"])


def _share(count: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(SCALE (count + 1) / whole) in 64-bit steps: SCALE is 31,250 * 32,000."""
    first = (count + 1) * 32_000
    return 1 + first // whole * 31_250 + first % whole * 31_250 // whole


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _pack(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values, np.int64).tobytes(), 1)


def _unpack(data: bytes | None) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int64) if data else np.zeros(0, np.int64)


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, shard, source, entries (id, n) by id) -> (lang, shard, source, ids, counts) as compressed bytes."""
    for batch in batches:
        entries = batch.column(3)
        ids, counts = (np.asarray(entries.flatten().field(i)) for i in (0, 1))
        cuts = np.cumsum(np.asarray(pc.list_value_length(entries)))[:-1]
        packed = ([_pack(np.diff(x, prepend=0)) for x in np.split(ids, cuts)], [_pack(x) for x in np.split(counts, cuts)]) if len(entries) else ([], [])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x, pa.binary()) for x in packed)], names=["lang", "shard", "source", "ids", "counts"])


class _Slot:
    """A slot's cells of one shard: of each group its terms, their shares, and the share of the terms it lacks."""

    def __init__(self, cells: list[dict], terms: int):
        self.cells = [(c["source"], np.cumsum(_unpack(c["ids"])), _unpack(c["counts"]), c["whole"]) for c in cells]
        self.terms = terms
        self.shares = [(_share(n, w), int(_share(np.zeros(1, np.int64), w)[0])) for _, _, n, w in self.cells]

    def whole(self, i: int) -> np.ndarray:
        """Shares of all the shard's terms."""
        (p, absent), ids = self.shares[i], self.cells[i][1]
        every = np.full(self.terms, absent)
        every[ids] = p
        return every


def _meet(home: _Slot, guest: _Slot) -> Iterator[tuple[str, str, int]]:
    """(source, item, value) of every pair of a group at home and another that visits, in both directions."""
    for j, (visitor, ids_b, _, _) in enumerate(guest.cells):
        every = guest.whole(j)
        q, q0 = guest.shares[j]
        for i, (resident, ids_a, _, _) in enumerate(home.cells):
            if home is guest and i >= j:
                break
            p, p0 = home.shares[i]
            there = every[ids_a]  # the visitor's shares of the resident's terms
            only_b = q[~np.isin(ids_b, ids_a, assume_unique=True)]
            only_p = np.full(len(only_b), p0)
            neither = home.terms - len(ids_a) - len(only_b)
            yield resident, visitor, int(_apart(p, there).sum() + _apart(only_p, only_b).sum()) + neither * ((p0 - q0) ** 2 // q0)
            yield visitor, resident, int(_apart(there, p).sum() + _apart(only_b, only_p).sum()) + neither * ((q0 - p0) ** 2 // p0)


PAIRS = "lang string, source string, item string, value long"


def _tournament(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, terms, cells, guests) -> pairs; without guests the cells meet each other."""
    for batch in batches:
        for row in batch.to_pylist():
            home = _Slot(row["cells"], row["terms"])
            out = list(_meet(home, home if row["guests"] is None else _Slot(row["guests"], row["terms"])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(out), pa.string()), *(pa.array(v, t) for v, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64())))], names=["lang", "source", "item", "value"])


def _heaps(top: int):
    """(lang, cells, words, totals, usual) -> the best terms of each group in this shard, by a heap of at most `top`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                slot, words = _Slot(row["cells"], len(row["words"])), [w.encode() for w in row["words"]]
                usual = _share(np.array(row["totals"], np.int64), row["usual"])
                out = []
                for (source, ids, _, _), (p, _) in zip(slot.cells, slot.shares):
                    more = p > usual[ids]
                    ids, value = ids[more], _apart(p[more], usual[ids][more])
                    if len(value) > top:  # all that tie with the last one stay for the heap
                        high = value >= np.partition(value, -top)[-top]
                        ids, value = ids[high], value[high]
                    best = heapq.nsmallest(top, ((-v, words[i]) for v, i in zip(value.tolist(), ids.tolist())))
                    out += [(row["lang"], source, w.decode(), -v) for v, w in best]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "source", "item", "value"])

    return run


def _opponent(slot: Column, slots: Column, step: int) -> Column:
    """Where a slot goes in a round: the last slot stays and the others turn by one place (circle method)."""
    turn = slots - 1
    other = F.pmod(F.lit(2 * step) - slot, turn)  # slots a and b meet when a + b = 2 step, modulo slots - 1
    return F.when(slot == turn, F.pmod(F.lit(step), turn)).when(other == slot, turn).otherwise(other)


def divergence(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part ("pair" or "term"), item, value, rank.

    Null texts, languages and sources are empty strings. Every (language, source) that occurs is a group, even
    without terms; a language of one source has no pairs, a language without kept terms pairs of value 0.
    Values fall with rank, ties go to the smaller item; the terms stop at rank `top`, the pairs don't. Repeated
    rows count each. Texts of any length are read whole, other columns are ignored, no rows give none.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counted = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counted = stored(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    groups = counted.where("term is null").select("lang", "source")
    counted = counted.where("term is not null")
    kept = stored(counted.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("_docs")).where(F.col("_docs") >= least).drop("_docs"), "kept")
    sizes = groups.groupBy("lang").agg(F.count("*").alias("_groups")).join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("_all")), "lang", "left").fillna(0)
    slots = F.least(F.lit(SLOTS), F.col("_groups") + F.col("_groups") % 2)
    shards = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("_groups") / slots) * F.col("terms") / SHARD))
    langs = stored(sizes.select("lang", "terms", slots.alias("slots"), shards.cast("int").alias("shards"), F.greatest(F.lit(1), F.col("_all") + F.col("terms")).alias("usual")), "langs")
    shard = F.pmod(F.xxhash64("term"), F.col("shards")).cast("int")
    numbered = kept.join(langs, "lang").select("lang", shard.alias("shard"), "term", "total", "usual")
    numbered = stored(numbered.withColumn("id", F.row_number().over(Window.partitionBy("lang", "shard").orderBy("term")).cast("long") - 1), "numbered")
    resident, words = _slots(counted, groups, langs, numbered)
    n_rounds = (langs.agg(F.max("slots")).first()[0] or 1) - 1
    resident = resident.repartition("lang", "shard", "slot").persist(StorageLevel.MEMORY_AND_DISK)  # from a written table
    terms = stored(resident.join(words, ["lang", "shard"]).select("lang", "cells", "words", "totals", "usual").mapInArrow(_heaps(top), PAIRS), "heaps")
    alone = resident.select("lang", "terms", "cells", F.lit(None).cast(resident.schema["cells"].dataType).alias("guests"))
    rounds = [stored(alone.mapInArrow(_tournament, PAIRS), "home")]
    for step in range(n_rounds):
        to = _opponent(F.col("slot"), F.col("slots"), step)
        guests = resident.where(F.col("slots") - 1 > step).where(to > F.col("slot")).select("lang", "shard", to.alias("slot"), F.col("cells").alias("guests"))
        met = resident.select("lang", "shard", "slot", "terms", "cells").join(guests, ["lang", "shard", "slot"]).select("lang", "terms", "cells", "guests")
        rounds.append(stored(met.mapInArrow(_tournament, PAIRS), "round"))
    resident.unpersist()
    pairs = reduce(DataFrame.union, rounds).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    falling = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(terms.withColumn("part", F.lit("term"))).withColumn("rank", F.row_number().over(falling))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def _slots(counted: DataFrame, groups: DataFrame, langs: DataFrame, numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, shard, slot, slots, terms, cells): a row for each shard and slot with a cell for each of its groups, empty
    ones too; and (lang, shard, words, totals, usual) of each shard."""
    words = numbered.groupBy("lang", "shard").agg(F.sort_array(F.collect_list(F.struct("id", "term", "total"))).alias("_t"), F.first("usual").alias("usual"))
    words = stored(words.select("lang", "shard", "_t.term", "_t.total", "usual").toDF("lang", "shard", "words", "totals", "usual"), "words")
    counts = stored(counted.join(numbered.select("lang", "term", "shard", "id"), ["lang", "term"]).select("lang", "shard", "source", "id", "n"), "counts")
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("_own"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    every = groups.join(own, ["lang", "source"], "left").fillna(0).withColumn("_place", place).join(langs, "lang")
    every = every.select("lang", "source", (F.col("_place") % F.col("slots")).alias("slot"), "slots", F.greatest(F.lit(1), F.col("_own") + F.col("terms")).alias("whole"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    cells = counts.groupBy("lang", "shard", "source").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("entries")).mapInArrow(_compress, "lang string, shard int, source string, ids binary, counts binary")
    sizes = words.select("lang", "shard", F.size("words").alias("terms"))
    rows = every.join(cells, ["lang", "shard", "source"], "left").groupBy("lang", "shard", "slot", "slots").agg(F.sort_array(F.collect_list(F.struct("source", "ids", "counts", "whole"))).alias("cells"))
    rows = rows.join(sizes, ["lang", "shard"], "left").fillna(0, ["terms"])
    return stored(rows.select("lang", "shard", "slot", "slots", "terms", "cells"), "cells"), words
