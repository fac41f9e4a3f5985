"""The corpus pipeline: each stage on its own input against a plain version, with edge rows and clashing names."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quantloom.llm import pii, toxicity
from quantloom.llm.common import tokenizer_path

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("base", "spans", "score", "_salt", "label", "size", "target", "copies", "cls", "n", "run", "ids", "length", "piece", "toxic")


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """A copy of the small tables whose documents also hold every edge row and columns with clashing names."""
    top = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"))
    docs = docs.unionByName(spark.createDataFrame(brute.EDGES, SCHEMA))
    docs.withColumns({c: F.lit(c) for c in CLASHING}).write.parquet(f"{top}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{top}/labels.parquet")
    return str(top)


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):
    """[(input, output)] of every stage, each output written and read again."""
    out, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("out") / name)
        stage(spark, docs, folder).write.parquet(path)
        got = spark.read.parquet(path)
        out.append((docs, got))
        docs = got
    return out


def as_rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_stages_are_named_as_dealt():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "packing"]


def test_all_but_the_last_keep_the_columns(steps):
    for before, after in steps[:-1]:
        assert after.columns == before.columns and [f.dataType for f in after.schema] == [f.dataType for f in before.schema]
        assert as_rows(after, *CLASHING).keys() == {CLASHING}


def test_toxicity(spark, folder, steps):
    before, after = steps[0]
    scored = toxicity.toxicity(before, spark.read.parquet(f"{folder}/labels.parquet"))
    bad = {r["doc_id"] for r in scored.where("predicted = 1").collect()}
    want = Counter(x for x in as_rows(before, "doc_id", "text").elements() if x[0] not in bad)
    assert as_rows(after, "doc_id", "text") == want and bad


def test_near_duplicates(steps):
    before, after = steps[1]
    rows = as_rows(before, "doc_id", "text")
    number = {x: i for i, x in enumerate(sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")))}
    root = brute.components([(i, x[1]) for x, i in number.items()], 5, 80)
    want = Counter(x for x in rows.elements() if not brute.shingles(x[1], 5))
    want.update(x for x, i in number.items() if brute.shingles(x[1], 5) and root[i][1] == i)
    assert as_rows(after, "doc_id", "text") == want and sum(want.values()) < sum(rows.values())


def test_pii(steps):
    before, after = steps[2]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert not brute.pii(r["text"]) and (r["text"] is None) == (texts[r["doc_id"]] is None)
        if not brute.pii(texts[r["doc_id"]]) and r["text"] != texts[r["doc_id"]]:
            assert any(f"<{k}>" in r["text"] for k in pii.KINDS)
    assert any(r["text"] and "<email>" in r["text"] for r in after.collect())


def test_mixing(steps):
    before, after = steps[3]
    sizes, taken, most, times = Counter(), Counter(), Counter(), as_rows(after, "doc_id", "text")
    for r in before.collect():
        n = len(brute.WORD.findall(r["text"] or ""))
        sizes[r["source"]] += n
        most[r["source"]] = max(most[r["source"]], n)
    for r in after.collect():
        taken[r["source"]] += len(brute.WORD.findall(r["text"] or ""))
    for s, goal in brute.targets(dict(sizes)).items():
        assert abs(taken[s] - goal) <= max(most[s], 0.02 * goal), s
    repeats = as_rows(before, "doc_id", "text")
    assert all(n <= 2 * repeats[x] for x, n in times.items())


def test_packing(steps):
    import numpy as np
    from tokenizers import Tokenizer

    before, after = steps[4]
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for (doc_id, text), n in as_rows(before, "doc_id", "text").items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())] += n
    assert as_rows(after, "doc_id", "piece", "start", "length", "ids_crc32") == want
    held = defaultdict(list)
    for r in after.collect():
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in held.values():
        ends = [0, *(a + n for a, n in sorted(members))]
        assert [a for a, _ in sorted(members)] == ends[:-1] and ends[-1] <= 1024


def test_run_is_the_stages_in_turn(spark, folder, steps):
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert as_rows(corpus_pipeline.run(spark, folder), *columns) == as_rows(steps[-1][1], *columns)


def test_empty_tables(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name


def test_the_rest_works_without_the_corpus_parts():
    """Nothing outside the corpus parts imports them, but for the guarded registry."""
    from pathlib import Path

    top = Path(__file__).resolve().parents[2]
    for f in [*top.glob("*.py"), *(top / "quantloom").rglob("*.py"), *(top / "tests").glob("*.py")]:
        if "llm" not in f.parts and f.name not in ("corpus_pipeline.py", "__spark_entry__.py"):
            assert "quantloom.llm" not in f.read_text() and "from .llm" not in f.read_text(), f


def test_character_classes_take_little_memory():
    """Each worker makes the table; every code point as a string of its own took 80 MB."""
    import tracemalloc

    from quantloom.llm import packing

    packing._classes.cache_clear()
    tracemalloc.start()
    out = packing._classes()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20 and [int(out[ord(c)]) for c in " aé中7²_\U0001d7d8"] == [0, 1, 1, 1, 2, 2, 3, 2]


def test_tasks_take_little_memory(monkeypatch):
    """What a task of the first two stages holds beside a batch of 4 MB: with slices of 1 MB 23, 17 and 23 MB, with a byte for each bit 151 MB."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from quantloom.llm import jaccard

    monkeypatch.setattr(jaccard, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(3)
    texts = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 9999, 600)) for _ in range(1200)])
    ids = pa.array(np.arange(len(texts)))
    three = pa.RecordBatch.from_arrays([ids, texts, ids], ["doc_id", "text", "key"])
    counts = SimpleNamespace(value=np.zeros(jaccard.BUCKETS, np.uint32))
    none = toxicity._start(toxicity.Words(np.zeros((0, len(toxicity.PREFIXES)), np.int32), np.zeros(0, np.int64), 1, np.zeros(1, np.int64)), np.zeros(1, np.int64), rng)
    passes = {
        "sets": (jaccard._first_pass(5), three, 14),
        "prefixes": (jaccard._prefixes(5, 80, counts), three.select(["text"]), 8),
        "scores": (toxicity._scorer(SimpleNamespace(value=none), 1, ["doc_id", "text", "key", "score"]), three, 12),
        "filter": (jaccard._marked(jaccard.FILTER_BITS), three, 30),
    }
    for name, (read, batch, most) in passes.items():
        tracemalloc.start()
        for _ in read(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert peak < most, (name, peak)


def test_filter_has_each_id_s_bit():
    import numpy as np
    import pyarrow as pa

    from quantloom.llm import jaccard

    ids, size = np.arange(-5000, 5000) * 7919, 1 << 16
    batches = [pa.RecordBatch.from_arrays([pa.array(x)], ["id"]) for x in np.array_split(ids, 3)]
    (got,) = jaccard._marked(size)(iter(batches))
    words = np.zeros(size // 64, np.int64)
    words[got.column("at").to_numpy()] = got.column("word").to_numpy()
    assert np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")).tolist() == sorted(set(jaccard._hash_bits(ids, size).tolist()))
