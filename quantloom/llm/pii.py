"""Personal data by candidate gradient boosting, in DataFrame functions only.

High-recall patterns propose spans that may overlap; boosted trees score each by its format and its
context; spans above a threshold of their kind are added to the base spans, which always stay. The
trees are SQL expressions. They are fitted by gradient boosting on one half of generated examples
(`examples`); the other half calibrates each kind's threshold to a precision.

Positions are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. A match starts at its run's first character, or where the match before
#: ended (\G): a run that fails from there fails from its other characters too, so none is tried twice
#: and matching takes time linear in the text. Repeats that need no way back are possessive.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that hold for every text with a match of the wide pattern of the kind.
HINT = {"email": r"@|\[at\]|\(at\)", "ip": r"[0-9]\x20?\.\x20?[0-9]", "card": r"[0-9][\x20.-]?[0-9]", "phone": r"[0-9][\x20)./-]{0,2}[0-9]"}
#: The same for the base patterns; a base phone may have any number of marks between digits.
BASE_HINT = HINT | {"phone": r"\+[0-9]"}

#: Wider patterns that propose candidates, in what the base leaves.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:(?:\.|\x20\.\x20|\x20?(?:\[dot\]|\(dot\))\x20?)[A-Za-z0-9-]{2,}+)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\x20?\.\x20?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20.-]{1,3}[0-9]{4}){3}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:00[1-9][0-9]{0,2}[\x20-]?)?\(?[0-9]{2,5}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,5}(?![0-9A-Za-z]|[.-][0-9])",
}
#: Written around matches and over base spans; a text's own are read as the third, which no pattern holds.
_OPEN, _SHUT, _MASK = "\x01", "\x02", "\x03"

CONTACT = r"(?i)(phone|tel|call|mobile|fax|contact|mail|reach|write|card|visa|pay|host|addr|server|ip)[^0-9A-Za-z]{0,3}(is|at|to|me|us|on)?[^0-9A-Za-z]{0,3}$"
NUMBER = r"(?i)(order|id|no|ref|version|section|isbn|serial|part|release|article|v|#)[^0-9A-Za-z]{0,3}$"

FEATURES = ("length", "digits", "groups", "longest", "luhn", "glued_before", "glued_after", "contact", "number", "marked", "letters", "domain", "high_part", "dots", "blanks")


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(items: Column) -> Column:
    """An array cut into about as many arrays as each has items, so that sums over items can be made in
    two levels: appending to an array copies it, and only short ones are copied here."""
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items))).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.size(items) - 1, width), lambda i: F.slice(items, i + 1, width))


def _append(array: Column, item: Column) -> Column:
    return F.concat(array, F.array(item))


def _positions(text: Column, pattern: str, hint: str) -> Column:
    """array<struct<start, m>> of the leftmost non-overlapping matches, found in one pass that marks them."""
    kind = "array<struct<start: int, m: string>>"
    empty = F.expr(f"cast(array() as {kind})")
    marked = F.regexp_replace(F.translate(text, _OPEN + _SHUT, _MASK * 2), pattern, f"{_OPEN}$0{_SHUT}")
    # each match, and its length with what follows it up to the next one
    rows = lambda parts: F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(F.substring_index(p, _SHUT, 1).alias("m"), (F.length(p) - 1).alias("n")))

    def starts(block: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        step = lambda a, x: F.struct((a["at"] + x["n"]).alias("at"), _append(a["out"], F.struct(a["at"].alias("start"), x["m"].alias("m"))).alias("out"))
        return F.aggregate(block, first, step)

    def joined(parts: Column) -> Column:
        def shifted(blocks: Column) -> Column:
            first = F.struct(F.length(parts[0]).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
            offsets = F.aggregate(blocks, first, lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), _append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
            return F.flatten(F.zip_with(blocks, offsets, lambda b, o: F.transform(b["out"], lambda x: F.struct((x["start"] + o).alias("start"), x["m"].alias("m")))))

        return F.when(F.size(parts) > 1, _let(F.transform(_blocks(rows(parts)), starts), shifted)).otherwise(empty)

    return F.when(F.regexp_like(text, F.lit(hint)), _let(F.split(marked, _OPEN, -1), joined)).otherwise(empty)


def replaced(text: Column, spans: Column, by) -> Column:
    """text with everything that spans (of kind, start, end) cover replaced: by(span, length) once for
    each stretch of spans that overlap, told from its first span and the length it adds.

    Spans are taken by start in two levels: each block of them cuts its own piece of the text.
    """
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def piece(block: Column, at: Column) -> Column:
        stop = F.greatest(at, F.array_max(F.transform(block, lambda s: s["end"])))
        own = F.substring(text, at + 1, stop - at)

        def cut(own: Column) -> Column:
            def step(a: Column, s: Column) -> Column:
                between = F.substring(own, a["at"] - at + 1, F.greatest(F.lit(0), s["start"] - a["at"]))
                more = F.greatest(F.lit(0), s["end"] - F.greatest(a["at"], s["start"]))
                return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], between, by(s, more, s["start"] >= a["at"])).alias("out"))

            return F.aggregate(block, F.struct(at.alias("at"), F.lit("").alias("out")), step, lambda a: a["out"])

        return _let(own, cut)

    def whole(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda s: s["end"])))
        first = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        starts = F.aggregate(ends, first, lambda a, e: F.struct(F.greatest(a["at"], e).alias("at"), _append(a["out"], a["at"]).alias("out")))
        parts = lambda a: F.concat(F.array_join(F.zip_with(blocks, a["out"], piece), ""), F.substring(text, a["at"] + 1, F.lit(2**31 - 1)))
        return _let(starts, parts)

    return F.when(F.size(spans) > 0, _let(order, lambda o: _let(_blocks(o), whole))).otherwise(text)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes."""
    turned = F.reverse(F.substring(digits, 1, 19))

    def value(i: Column) -> Column:
        x = F.substring(turned, i, F.lit(1)).try_cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(turned))), F.lit(0), lambda a, i: a + F.coalesce(value(i), F.lit(0)))
    return total % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(bare(p)) < 3) | ((F.length(bare(p)) == 3) & (bare(p) <= "255")))
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), _luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end>>, by kind as listed, then start."""

    def of(k: int, kind: str) -> Column:
        kept = F.filter(_positions(text, BASE[kind], BASE_HINT[kind]), lambda x: _holds(kind, x["m"]))
        return F.transform(kept, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end")))

    return F.concat(*(of(k, kind) for k, kind in enumerate(KINDS)))


def _features(text: Column, start: Column, m: Column) -> dict[str, Column]:
    before = F.substring(text, F.greatest(F.lit(1), start - 23), F.least(start, F.lit(24)))
    after = F.substring(text, start + F.length(m) + 1, F.lit(1))
    runs = F.filter(F.split(m, "[^0-9]+"), lambda x: x != "")
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    digits = _digits(m)
    return {
        "length": F.length(m).cast("double"),
        "digits": F.length(digits).cast("double"),
        "groups": F.size(runs).cast("double"),
        "longest": F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)).cast("double"),
        "luhn": yes(_luhn(digits)),
        "glued_before": yes(F.regexp_like(before, F.lit("[0-9A-Za-z]$"))),
        "glued_after": yes(F.regexp_like(after, F.lit("[0-9A-Za-z]"))),
        "contact": yes(F.regexp_like(before, F.lit(CONTACT))),
        "number": yes(F.regexp_like(before, F.lit(NUMBER))),
        "marked": yes(F.regexp_like(m, F.lit(r"^\(|^00|\[at\]|\(at\)"))),
        "letters": yes(F.regexp_like(m, F.lit("[A-Za-z]"))),
        "domain": yes(F.regexp_like(m, F.lit(r"(?i)(com|org|net|edu|io|de|fr|es|uk)$"))),
        "high_part": F.coalesce(F.array_max(F.transform(runs, lambda x: F.substring(x, 1, 9).try_cast("double"))), F.lit(0.0)),
        "dots": (F.length(m) - F.length(F.replace(m, F.lit("."), F.lit("")))).cast("double"),
        "blanks": (F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit("")))).cast("double"),
    }


def _candidates(text: Column, k: int) -> Column:
    """array<struct<kind, start, end, features...>> of a kind's wide pattern."""

    def row(x: Column) -> Column:
        end = x["start"] + F.length(x["m"])
        return F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), end.alias("end"), *(c.alias(n) for n, c in _features(text, x["start"], x["m"]).items()))

    return F.transform(_positions(text, WIDE[KINDS[k]], HINT[KINDS[k]]), row)


def examples(seed: int = 5, n: int = 2400) -> list[tuple[int, str, str, int]]:
    """Generated (kind, text, span, label): personal data in forms the base misses, and look-alikes.

    Forms and contexts of both labels overlap: half of all spans stand after a word that tells
    nothing, and some look-alikes stand after one that misleads.
    """
    rng = random.Random(seed)
    pick = rng.choice
    word = lambda: "".join(pick("abcdefghilmnoprstuvw") for _ in range(rng.randint(2, 9)))
    number = lambda k: "".join(pick("0123456789") for _ in range(k))
    top = lambda: pick(["com", "org", "net", "edu", "io", "de", "fr", "es", "uk"])
    right = [("write to", "mail", "contact", "reach me at"), ("host", "server", "addr", "ip is"), ("card", "visa", "pay with", "card:"), ("call", "phone", "tel:", "fax", "mobile")]
    wrong = [("price", "version", "see"), ("section", "version", "chapter", "release"), ("order", "ref", "serial", "part no."), ("order", "isbn", "no.", "id", "ref")]

    def luhn(ok: bool, sep: str) -> str:
        body = [int(c) for c in number(15)]
        total = sum(x if j % 2 else (2 * x if x < 5 else 2 * x - 9) for j, x in enumerate(body))
        digits = "".join(map(str, body)) + str((-total + (0 if ok else rng.randint(1, 9))) % 10)
        return sep.join(digits[j : j + 4] for j in range(0, 16, 4))

    def email(label: int) -> str:
        name = pick([word(), f"{word()}.{word()}", f"{word()}{number(2)}", f"{word()}_{word()}"])
        if label:
            return pick([f"{name} [at] {word()} [dot] {top()}", f"{name}[at]{word()}[dot]{top()}", f"{name}(at){word()}.{top()}", f"{name} (at) {word()}.{word()}.{top()}", f"{name} @ {word()}.{top()}", f"{name} @ {word()} . {top()}"])
        return pick([f"{word()} @ {word()}.{word().title()}", f"{number(2)} @ {number(2)}.{number(2)}", f"{word()} (at) {word()}.{word().title()}", f"{word()} @ {word()}.{number(2)}", f"{word()} [at] {word()}.{word()}"])

    def ip(label: int) -> str:
        parts = [str(rng.randint(1, 255)) for _ in range(4)]
        if label:
            return pick([" . ", ". ", " ."]).join(parts)
        return pick([" . ".join([*parts[:3], str(rng.randint(256, 999))]), ". ".join(str(rng.randint(1, 9)) for _ in range(4)), f"{rng.randint(1, 28)}. {rng.randint(1, 12)}. 20. {rng.randint(10, 26)}", " . ".join(str(rng.randint(256, 999)) for _ in range(4))])

    def phone(label: int) -> str:
        if label:
            return pick([f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"{number(3)}.{number(3)}.{number(4)}", f"0049 {number(3)} {number(4)}-{number(4)}", f"0{number(3)} {number(3)} {number(4)}", f"0{number(3)}/{number(4)}-{number(3)}"])
        return pick([f"{number(4)}-{number(3)}-{number(4)}", f"{number(2)} {number(3)} {number(3)}", f"{number(3)} {number(4)} {number(5)}", f"978-{number(3)}-{number(5)}", f"{number(5)}-{number(4)}-{number(4)}"])

    out = []
    for i in range(n):
        kind, label = i % 4, (i // 4) % 2
        span = (email, ip, lambda y: luhn(bool(y), pick([".", " - ", "  ", ". "])), phone)[kind](label)
        told = rng.random()
        before = pick(right[kind] if label or told < 0.05 else wrong[kind]) if told < 0.5 else word()
        out.append((kind, f"{word()} {word()} {before} {span} {word()}.", span, label))
    return out


Tree = tuple[int, float, tuple[int, float, float, float], tuple[int, float, float, float]]


def _split(x: np.ndarray, g: np.ndarray, rows: np.ndarray) -> tuple[int, float, float]:
    """The feature and bound that leave the least squared rest."""
    best = (0, float("inf"), 0.0)
    for j in range(x.shape[1]):
        for bound in np.unique(np.quantile(x[rows, j], np.linspace(0, 1, 17)[:-1])):
            left = rows[x[rows, j] <= bound]
            right = rows[x[rows, j] > bound]
            if len(left) and len(right):
                gain = g[left].sum() ** 2 / len(left) + g[right].sum() ** 2 / len(right)
                if gain > best[2] + 1e-12:
                    best = (j, float(bound), gain)
    return best


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 16, rate: float = 0.5) -> list[Tree]:
    """Depth-two regression trees on the gradient of the logistic loss."""
    z, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)

        def leaf(rows: np.ndarray) -> float:
            return float(rate * g[rows].sum() / (h[rows].sum() + 1.0)) if len(rows) else 0.0

        j, bound, _ = _split(x, g, np.arange(len(y)))
        sides = []
        for rows in (np.flatnonzero(x[:, j] <= bound), np.flatnonzero(x[:, j] > bound)):
            jj, b, gain = _split(x, g, rows) if len(rows) > 1 else (0, float("inf"), 0.0)
            low, high = rows[x[rows, jj] <= b], rows[x[rows, jj] > b]
            z[low] += (a := leaf(low))
            z[high] += (c := leaf(high))
            sides.append((jj, b, a, c))
        trees.append((j, bound, *sides))
    return trees


def _value(trees: list[Tree]) -> str:
    """The trees' sum for a candidate x, as SQL."""
    leaf = lambda j, bound, low, high: f"if(x.{FEATURES[j]} <= {float(bound)!r}D, {low}, {high})"
    legs = ((leaf(jj, b, f"{a!r}D", f"{c!r}D") if np.isfinite(b) else f"{a!r}D") for _, _, *sides in trees for jj, b, a, c in sides)
    each = list(zip(legs, legs))
    return " + ".join(leaf(j, bound, *pair) for (j, bound, *_), pair in zip(trees, each)) or "0D"


def _margins(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    z = np.zeros(len(x))
    for j, bound, *sides in trees:
        legs = [np.where(x[:, jj] <= b, a, c) for jj, b, a, c in sides]
        z += np.where(x[:, j] <= bound, *legs)
    return z


def measured(spark: SparkSession, rows: list[tuple[int, str, str, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per kind the features and labels of the generated rows' candidates, by the expressions used in scoring."""
    frame = spark.createDataFrame([(k, t, y) for k, t, _, y in rows], "k int, text string, label int")
    every = F.concat(*(_candidates(F.col("text"), k) for k in range(len(KINDS))))
    got = frame.withColumn("x", F.explode(every)).where("x.kind = k").select("k", "label", F.xxhash64("text").alias("h"), *(f"x.{f}" for f in FEATURES)).orderBy("h").collect()
    out = []
    for k in range(len(KINDS)):
        own = [r for r in got if r["k"] == k]
        out.append((np.array([[r[f] for f in FEATURES] for r in own]).reshape(len(own), len(FEATURES)), np.array([r["label"] for r in own], float)))
    return out


def calibrated(z: np.ndarray, y: np.ndarray, precision: float = 0.98) -> float:
    """The lowest threshold above which at least that share of the margins is right; infinite if none is."""
    order = np.argsort(-z, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(np.diff(z[order]) < 0, True)  # equal margins fall together
    good = np.flatnonzero((share >= precision) & last)
    if not len(good):
        return float("inf")
    at = good[-1]
    return float(z[order[at]] - 1e-9) if at + 1 == len(z) else float((z[order[at]] + z[order[at + 1]]) / 2)


@functools.cache
def _model(application: str) -> tuple[tuple[list[Tree], float], ...]:
    """Trees and threshold of each kind: fitted on one half of the examples, calibrated on the other."""
    models = []
    for x, y in measured(SparkSession.getActiveSession(), examples()):
        trees = boost(x[::2], y[::2])
        models.append((trees, calibrated(_margins(trees, x[1::2]), y[1::2])))
    return tuple(models)


def chosen(candidates: str, models: tuple) -> Column:
    """array<struct<kind, start, end>> of a column of candidates: those above their kind's threshold."""
    tests = " ".join(f"when {k} then {_value(trees)} > {float(t)!r}D" for k, (trees, t) in enumerate(models) if np.isfinite(t))
    return F.expr(f"transform(filter({candidates}, x -> coalesce(case x.kind {tests} else false end, false)), x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end))") if tests else F.expr("cast(array() as array<struct<kind: int, start: int, end: int>>)")


def find_pii(docs: DataFrame, base: str = "base", spans: str = "spans") -> DataFrame:
    """docs with base (the base spans) and spans (these and the added ones, which overlap no base span).

    Candidates are proposed in the text with its base spans masked. Null texts are empty and have no
    spans. Texts of any length are read whole, in time linear in the text for one span and growing with
    the root of the number of spans. Columns that already have one of the two names are replaced,
    others stay as they are.
    """
    models = _model(docs.sparkSession.sparkContext.applicationId)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn(base, base_spans(text))
    masked = replaced(text, F.col(base), lambda s, more, first: F.repeat(F.lit(_MASK), more))
    out = out.withColumn("_masked", masked)
    out = out.withColumn("_candidates", F.concat(*(_candidates(F.col("_masked"), k) for k in range(len(KINDS)))))
    out = out.withColumn(spans, F.array_sort(F.concat(F.col(base), chosen("_candidates", models))))
    return out.drop("_candidates", "_masked")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of personal data in text replaced by its kind in angle brackets; spans that
    overlap are one, of the kind of the first."""
    found = find_pii(docs, "_pii_base", "_pii_spans")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    whole = replaced(text, F.col("_pii_spans"), lambda s, more, first: F.when(first, F.element_at(names, s["kind"] + 1)).otherwise(F.lit("")))
    return found.withColumn("text", F.when(F.size("_pii_spans") > 0, whole).otherwise(F.col("text"))).select(docs.columns)


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, the base spans' hash sum and all spans as text."""

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = (count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS))
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
