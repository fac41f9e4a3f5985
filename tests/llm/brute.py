"""Plain versions of the operators, for comparison on small inputs."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}

#: Rows that every operator on documents must take: nulls, empty and long texts, ties, repeats.
EDGES = [
    (1001, None, "en", "src1", 0),
    (1002, "", "en", None, 0),
    (1003, "   \n\t", None, "src1", None),
    (1004, "one two", "en", "src2", 7),
    (1004, "one two", "en", "src2", 7),
    (1005, "word " * 30000, "en", "src2", 150000),
    (1006, "x" * 90000, "de", "src3", 90000),
    (None, "a text without an id. It has two sentences.", "en", "src1", 40),
    (1007, "Ärger über \U0001f600 x\x00y <|im_end|> ~1 <|endoftext|>", "de", "", 30),
]


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) >= k:
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return {tuple(w)} if w else set()


def components(rows, k, percent):
    """{doc_id: (size, root)} by comparing every pair; rows without doc_id are left out."""
    sets = {}
    for doc_id, text in rows:
        if doc_id is not None:
            sets[doc_id] = shingles(text, k)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets, key=lambda i: len(sets[i]))
    for a, i in enumerate(ids):
        if not sets[i]:
            continue
        for j in ids[a + 1 :]:
            if percent * len(sets[j]) > 100 * len(sets[i]):
                break
            same = len(sets[i] & sets[j])
            if 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def top_k(rows, k):
    """{(query, rank): (vec_id, score)} over (vec_id, vector)."""
    good = {i: [math.floor(256 * float(x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for q in good:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in itertools.zip_longest(good[q], v, fillvalue=0)), i) for i, v in good.items() if i != q)
            out.update({(q, r): (i, -s) for r, (s, i) in enumerate(scored[:k], 1)})
    return out


def chats(rows):
    """{conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)} over (conv_id, turn, role, text)."""
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii(text):
    out = []
    for kind, pattern in PII.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n, rep = len(words), len(covered)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, n < 20 or 100 * rep > 30 * n)


LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def licenses(text, phrases):
    words = LICENSE_WORD.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def targets(sizes):
    """{source: target} by dealing and redealing what is above twice a source's size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s] + 1e-9]
        if not over:
            out.update({s: left * weight[s] / total for s in open_})
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            open_.discard(s)
        left -= sum(2.0 * sizes[s] for s in over)
    return out


SPACE = " \t\n\x0b\x0c\r"


def sentences(text):
    """The sentences of a text, with the white space after each, by walking over its words."""
    text = text.lstrip(SPACE)
    pieces, start = [], 0
    for m in re.finditer(r"[^ \t-\r]+[ \t-\r]*", text):
        word = m[0].rstrip(SPACE)
        blank = m[0][len(word) :]
        if blank and (word.rstrip("\"'\u201d\u2019\u00bb)]}")[-1:] in (".", "!", "?") or blank.count("\n") > 1) or m.end() == len(text):
            pieces.append(text[start : m.end()])
            start = m.end()
    out = []
    for piece in pieces:
        words = re.findall(r"[^ \t-\r]+[ \t-\r]*", piece)
        if len(words) <= 40 or "\x01" in piece:
            out.append(piece)
            continue
        own = ""
        for w in words:
            own += w
            if hashlib.md5(w.rstrip(SPACE).encode()).hexdigest()[0] in "0123":
                out.append(own)
                own = ""
        out += [own] if own else []
    return out


def without_repeats(rows):
    """{doc_id: (sentences gone, words gone, rest)}: for every pair of documents the longest runs of sentences that
    both have are compared place by place; those of two sentences (not all equal) and 30 words go from the later one."""
    texts = {i: sentences(t) for i, t in rows if i is not None and t is not None}
    whole = dict(rows)
    norm = {i: [tuple(WORD.findall(x)) for x in s] for i, s in texts.items()}
    places = defaultdict(list)
    for i in sorted(norm):
        for j, s in enumerate(norm[i]):
            places[s].append((i, j))
    out = {}
    for i, s in norm.items():
        gone = set()
        for j in range(len(s)):
            for k, m in places[s[j]]:
                if k >= i:
                    break
                if j and m and s[j - 1] == norm[k][m - 1]:
                    continue  # not where the shared run begins
                n = 0
                while j + n < len(s) and m + n < len(norm[k]) and s[j + n] == norm[k][m + n]:
                    n += 1
                run = s[j : j + n]
                if n > 1 and len(set(run)) > 1 and sum(map(len, run)) >= 30:
                    gone.update(_told(run, j))
        if gone:
            lead = whole[i][: len(whole[i]) - len(whole[i].lstrip(SPACE))]
            out[i] = (len(gone), sum(len(s[j]) for j in gone), lead + "".join(x for j, x in enumerate(texts[i]) if j not in gone))
    return out


def _told(run, start):
    """Places of a shared run's sentences that lie in a part of it of 30 words whose sentences are not all equal."""
    own = set()
    for a in range(len(run)):
        for b in range(a + 2, len(run) + 1):
            if sum(map(len, run[a:b])) >= 30:
                if len(set(run[a:b])) > 1 and (sum(map(len, run[a + 1 : b])) < 30 or sum(map(len, run[a : b - 1])) < 30 or b - a == 2):
                    own.update(range(start + a, start + b))
                if sum(map(len, run[a + 1 : b])) >= 30 and b - a > 2:
                    break
    return own


def expected_copies(held, goals):
    """{(source, size): copies} from {(source, size): documents}: level times weight, found by halving."""
    out = {}
    for source, goal in goals.items():
        own = {n: k for (s, n), k in held.items() if s == source}
        times = lambda c: {n: min(2.0, c * max(1, 32 - (n.bit_length() - 1))) for n in own}  # noqa: B023, E731
        lo, hi = 0.0, 2.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(x * n * own[n] for n, x in times(mid).items()) < goal else (lo, mid)
        out.update({(source, n): x for n, x in times(hi).items()})
    return out
