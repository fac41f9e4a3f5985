"""The Merkle manifest, the divergence audit and language-model scores against plain versions of them."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quantloom.llm import divergence, lm, merkle

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf):
    """The small documents, every edge row, and columns with names that operators use themselves."""
    own = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"))
    every = own.unionByName(spark.createDataFrame(brute.EDGES, SCHEMA))
    return every.withColumns({c: F.lit(1) for c in ("leaf", "root", "path", "part", "rank", "shelf", "score", "term", "_hash", "_at")}).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text", "lang", "source", "n_chars").collect()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """The root over nodes, and each node's path: (sibling is on the left, sibling or None) by level."""
    paths, held = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 2, len(nodes))) for i in range(0, len(nodes), 2)]
        for run in runs:
            for j in run:
                for leaf in held[j]:
                    paths[leaf].append((j % 2 == 1, nodes[j ^ 1] if (j ^ 1) in run else None))
        nodes, held = [h(*(nodes[j] for j in run)) for run in runs], [sum((held[j] for j in run), []) for run in runs]
    return nodes[0], paths


def leaf(r, more=0):
    n = r.n_chars if r.n_chars is None else r.n_chars + more
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, n, r.text)))


def manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.lang].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    inner = {}
    for name in names:
        own = sorted(groups[name], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        inner[name] = (own, *climb([leaf(r) for r in own]))
    root, upper = climb([inner[name][1] for name in names])
    out = []
    for name, above in zip(names, upper):
        own, subroot, paths = inner[name]
        for r, path in zip(own, paths):
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            fold = leaf(r, int(changed))
            for left, other in path + above:
                fold = h(other, fold) if left else h(fold, other or "")
            out.append((r.doc_id, leaf(r), subroot, root, h(*(x or "" for _, x in path + above)), fold, fold == root))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 31, 32, 64])
@pytest.mark.parametrize("subtree", [1, 2, 3, 7])
def test_traversal_emits_the_paths_of_the_whole_tree(n, subtree):
    leaves = [h(str(i)) for i in range(n)]
    root, want = climb(list(leaves))
    height = (n - 1).bit_length()
    assert list(merkle.paths(leaves, height, subtree)) == want and merkle.block_root(leaves, height) == root


def test_traversal_of_a_block_that_is_not_full():
    leaves = [h(str(i)) for i in range(5)]
    got = list(merkle.paths(leaves, 5, 2))
    assert got[4] == [(False, None), (False, None), (True, climb(leaves[:4])[0]), (False, None), (False, None)]


@pytest.mark.parametrize("height", [3, 10])
def test_merkle(docs, rows, monkeypatch, height):
    """Blocks of eight leaves make several rounds, blocks of 1,024 one."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    got = merkle.audit(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == Counter(manifest(rows))


def test_merkle_of_one_row_one_group_and_none(spark, none):
    assert merkle.audit(none).count() == 0
    one = spark.createDataFrame([(7, "x", None, None, None)], SCHEMA)
    r = merkle.audit(one).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == h("")
    same = spark.createDataFrame([(1, "x", "en", "s", 1)] * 5, SCHEMA)
    assert Counter(map(tuple, merkle.audit(same).collect())) == Counter(manifest(same.collect()))


def test_merkle_path_proves_a_row_to_whoever_knows_the_root(docs):
    got = merkle.manifest(docs.limit(50), keep={"size": F.length("text")})
    assert got.columns == ["doc_id", "lang", "leaf", "subroot", "root", "path", "size"]
    for r in got.collect():
        node = r["leaf"]
        for step in r["path"]:
            node = h(step["hash"], node) if step["left"] else h(node, step["hash"] or "")
        assert node == r["root"]


LETTERS, LOWER = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), {i: i + 32 for i in range(65, 91)}


def diverge(rows, least=3, top=200):
    count, found = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        words = LETTERS.findall((r.text or "").translate(LOWER))
        count[r.lang or "", r.source or ""].update(words)
        found[r.lang or ""].update(set(words))
    out = set()
    for lang in {k for k, _ in count}:
        kept = [t for t, n in found[lang].items() if n >= least]
        own = {s: c for (k, s), c in count.items() if k == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[t] for t in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        shares, usual = {s: share(c) for s, c in own.items()}, share(sum(own.values(), Counter()))
        for s, p in shares.items():
            pairs = [(sum((p[t] - q[t]) ** 2 // q[t] for t in kept), o) for o, q in shares.items() if o != s]
            terms = [((p[t] - usual[t]) ** 2 // usual[t], t) for t in kept if own[s][t] and p[t] > usual[t]]
            for part, held, most in (("pair", pairs, None), ("term", terms, top)):
                held.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(held[:most], 1)}
    return out


@pytest.mark.parametrize(("shard", "slots"), [(1 << 17, 8), (2000, 2)])
def test_divergence(docs, rows, monkeypatch, shard, slots):
    """One shard, and many small ones; more groups than slots."""
    monkeypatch.setattr(divergence, "SHARD", shard)
    monkeypatch.setattr(divergence, "SLOTS", slots)
    got = divergence.divergence(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert set(map(tuple, got.collect())) == diverge(rows) and got.count() == len(diverge(rows))


def test_divergence_of_few_terms_ties_and_none(spark, none):
    assert divergence.divergence(none).count() == 0
    rows = [(i, t, "en", s, 0) for i, (t, s) in enumerate([("b a", "x"), ("a b", "y"), ("A b é", "z"), (None, "w"), ("é é", "w")])]
    for held, top in ((rows, 1), (rows[:2], 200), (rows[:1], 1)):
        frame = spark.createDataFrame(held, SCHEMA)
        assert set(map(tuple, divergence.divergence(frame, top=top).collect())) == diverge(frame.collect(), top=top)


def test_every_two_slots_meet_once(spark):
    for slots in (2, 4, 6, 8):
        met = Counter()
        for step in range(slots - 1):
            pairs = spark.range(slots).select(F.col("id"), divergence._opponent(F.col("id"), F.lit(slots), step).alias("other")).collect()
            assert sorted(r["other"] for r in pairs) == list(range(slots))
            met.update((r["id"], r["other"]) for r in pairs if r["id"] < r["other"])
        assert met == Counter({(a, b): 1 for b in range(slots) for a in range(b)})


def model(rows, order, prior):
    """{doc_id: [(n_tokens, n_known, N, base, score)]} by looking every n-gram up."""
    texts = [(r.doc_id, r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10 != 0, [0, *brute.WORD.findall((r.text or "").translate(LOWER)), 1]) for r in rows]
    count = Counter()
    for _, learned, t in texts:
        if learned:
            count.update(tuple(t[j - k : j + 1]) for j in range(len(t)) for k in range(min(order, j + 1)))
    total = sum(n for g, n in count.items() if len(g) == 1 and g != (0,))
    types = sum(len(g) == 1 and g != (0,) for g in count)

    def p(gram):
        if len(gram) == 1:
            return (count[gram] + 0.1) / (total + 0.1 * (types + 1))
        return (count[gram] + prior * p(gram[1:])) / (count[gram[:-1]] + prior)

    out = defaultdict(list)
    for i, _, t in texts:
        grams = [tuple(t[max(0, j - order + 1) : j + 1]) for j in range(1, len(t))]
        out[i].append((len(grams), sum(count[g[-1:]] > 0 for g in grams), total, sum(math.log10(p(g[-1:])) for g in grams), sum(math.log10(p(g)) for g in grams)))
    return out


@pytest.mark.parametrize(("order", "shelf"), [(3, 1 << 23), (3, 20_000), (1, 1 << 23), (4, 100_000)])
def test_language_scores(docs, rows, order, shelf):
    got, want = defaultdict(list), model(rows, order, 5.0)
    for r in lm.language_scores(docs, order=order, shelf=shelf).collect():
        got[r.doc_id].append((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    assert got.keys() == want.keys()
    for i, held in want.items():
        for a, b in zip(sorted(got[i]), sorted(held), strict=True):
            assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-9 * b[0] + 1e-9)  # half a billionth a step, two steps a word


def test_language_scores_without_training_rows_and_without_rows(spark, none):
    assert lm.language_scores(none).count() == 0
    held = spark.range(200).where(F.crc32(F.col("id").cast("string")) % 10 == 0).select(F.col("id").alias("doc_id"), F.lit("a b a").alias("text"))
    for r in lm.language_scores(held).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 4, 0, 0, 0.0, 0.0)


def test_probabilities_add_up():
    """After any context the known words, the end and one word that training has not seen share all the weight."""
    import numpy as np

    words = np.sort(np.unique(np.concatenate([[lm.END], np.arange(1, 5, dtype=np.uint64)])))
    end = int(np.flatnonzero(words == lm.END)[0])
    train = [[0, 1, 2, end], [0, 1, 1, end], [2, 0, 1, 0, end]]  # 3 is never seen
    asked = [[*c, w, *([] if w == end else [end])] for c in ([], [0], [0, 1], [2, 2]) for w in range(5)]
    length = np.array(list(map(len, train + asked)))
    tokens = np.array(sum(train + asked, []), np.int32)
    grams = lm._Grams(words, tokens, length, 3, 64)
    learned = np.repeat(np.arange(len(length)) < len(train), length)
    counts = [np.bincount(at[(at >= 0) & learned], minlength=len(g)) for at, g in zip(grams.at, grams.hashes)]
    automaton = lm.Automaton(tokens, grams, counts, end, int(learned.sum()), 4, 5.0)
    first = np.cumsum(length) - length
    for c in range(4):
        own = range(len(train) + 5 * c, len(train) + 5 * c + 5)
        at = [first[i] + len((([], [0], [0, 1], [2, 2])[c])) for i in own]
        total = 0.0
        for i, place in zip(own, at):
            state, log = automaton.start, 0
            for t in range(first[i], place + 1):
                log = 0
                while automaton.goes[automaton.arc[automaton.level[state], t]] < 0:
                    log, state = log + automaton.backoff[state], automaton.fail[state]
                arc = automaton.arc[automaton.level[state], t]
                log, state = log + automaton.weights[arc], automaton.goes[arc]
            total += 10 ** (log / lm.UNIT)
        assert total == pytest.approx(1, abs=1e-6)


def test_held_out_texts_are_likelier_by_the_automaton(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lm.language_scores(docs).where("held_out").agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
    few = lm.language_scores(docs.where(F.col("doc_id") % 5 == 0)).where("held_out").agg(F.sum("n_tokens"), F.sum("score")).first()
    assert held[2] / held[0] > 0.8 * held[1] / held[0] and held[2] / held[0] > few[1] / few[0]
