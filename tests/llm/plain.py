"""Brute-force versions of the training-data operators, and texts to try them on."""

from __future__ import annotations

import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
COLUMNS = "doc_id long, text string, sig string, n long, bucket string, slice int, mark string, _gone string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def random_texts(seed=5, count=60, vocabulary=40):
    """Short texts with copies, near copies, shared passages and odd characters."""
    draw = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)] + ["é", "Ünder", "中文", "x.y,", "a b", "👍"]
    passage = [draw.choice(vocab) + str(i) for i in range(30)]
    texts = []
    for _ in range(count):
        kind = draw.random()
        if texts and kind < 0.25:
            text = words(draw.choice(texts))
            for _ in range(draw.randint(0, 2)):
                if text:
                    text[draw.randrange(len(text))] = draw.choice(vocab)
        elif kind < 0.45:
            own = [draw.choice(vocab) for _ in range(draw.randint(0, 40))]
            cut = draw.randint(0, len(own))
            text = own[:cut] + passage + own[cut:]
        else:
            text = [draw.choice(vocab) for _ in range(draw.randint(0, 80))]
        texts.append("".join(w + draw.choice([" ", " ", "\n", "  ", "\t"]) for w in text))
    return texts


def edge_texts():
    return [None, "", " \n\t ", "one", "one", "a b c d", "a b c d e", "a b c d e f " * 9, "A B c D", "same line\nsame line\n" * 12,
            "z" * 50_000, " ".join(str(i) for i in range(8000)), "é" * 300]


def frame(spark, texts, first=0):
    """Rows with ids from ``first``, a null id, one repeated row and extra columns with clashing names."""
    rows = [(first + i, t, "s", 7, None, 1, "m", "g", len(t or "")) for i, t in enumerate(texts)]
    rows.append((None, "a row without an id that nothing else says at all", "s", 7, None, 1, "m", "g", 0))
    rows.append(rows[3])
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


# --- repetition ---

def quality(text):
    own = words(text)
    lines = [line for line in (text or "").split("\n") if words(line)]
    grams = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
    seen = Counter(grams)
    inside = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)}
    return (len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))


def ngram_share(text, n):
    own = words(text)
    grams = [tuple(own[i : i + n]) for i in range(len(own) - n + 1)]
    seen = Counter(grams)
    inside = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + n)}
    return sum(len(own[j]) for j in inside) / max(1, sum(map(len, own)))


# --- spans ---

def digest(spans):
    return sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def secrets(text):
    rules = (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 0, 20), ("hex", r"[0-9a-f]+", 0, 0, 24),
    )
    found = [(k, *m.span()) for k, p, f, g, n in rules for m in re.finditer(p, text or "", f) if len(m.group(g)) >= n]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def luhn(digits):
    turned = [int(d) for d in reversed(digits)]
    return (sum(turned[::2]) + sum(sum(divmod(2 * d, 10)) for d in turned[1::2])) % 10 == 0


def personal(text):
    text = text or ""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for kind, pattern, least, most in (("card", r"[0-9]([\x20-]?[0-9])+", 12, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if least <= len(digits) <= most and (kind != "card" or luhn(digits)):
                found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))


# --- shingles ---

def shingles(text, lower=True):
    own = words((text or "").translate(LOWER) if lower else text)
    width = min(5, len(own))
    return Counter(tuple(own[i : i + width]) for i in range(len(own) - width + 1)) if own else Counter()


def components(rows):
    """(id, text) rows: shingles and component of each, ids unique."""
    sets = {i: frozenset(shingles(t)) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def leaks(text, item):
    """Greatest weighted similarity of a window as long as the item."""
    own, size = words((text or "").translate(LOWER)), len(words((item or "").translate(LOWER)))
    want, best = shingles(item), 0.0
    if not size or not own or (size >= 5 and not (shingles(text) & want)):  # shorter items have shorter shingles
        return 0.0
    for i in range(max(1, len(own) - size + 1)):
        got = shingles(" ".join(own[i : i + size]))
        best = max(best, sum((got & want).values()) / sum((got | want).values()))
    return best


# --- repeated windows ---

def strip(rows, window=20):
    """(id, text) rows in order of id: words, removed words, digest of the rest."""
    seen, out = {}, {}
    places = [(i, words(t)) for i, t in sorted(rows)]
    for i, own in places:
        for start in range(len(own) - window + 1):
            seen.setdefault(tuple(own[start : start + window]), (i, start))
    for i, own in places:
        gone = set()
        for start in range(len(own) - window + 1):
            if seen[tuple(own[start : start + window])] != (i, start):
                gone.update(range(start, start + window))
        kept = " ".join(w for j, w in enumerate(own) if j not in gone)
        out[i] = (len(own), len(gone), sha256(kept.encode()).hexdigest())
    return out


# --- periodic runs ---

def runs(own, shortest=12):
    """(start, length, smallest period) of every run, lag by lag."""
    found = {}
    for lag in range(1, len(own) // 2 + 1):
        at = 0
        while at + lag < len(own):
            end = at
            while end + lag < len(own) and own[end] == own[end + lag]:
                end += 1
            if end > at and end + lag - at >= max(shortest, 2 * lag):
                found.setdefault((at, end + lag), lag)
            at = end + 1
    return sorted(((a, b - a, lag) for (a, b), lag in found.items()), key=lambda r: (r[0], r[2]))


def planted(doc, own):
    h = crc32(str(doc).encode()) if doc is not None else 1
    g, n = h // 10, len(own)
    if h % 10 or not n:
        return own
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]


def run_row(doc, text):
    """All columns of operator 12."""
    own = planted(doc, words(text))
    found = runs(own)
    gone = {i for start, length, lag in found for i in range(start + lag, start + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    rest = " ".join(w for i, w in enumerate(own) if i not in gone)
    milli = 1000 * best[1] // best[2] if found else None
    return (len(found), *best, milli, sha256(lines.encode()).hexdigest(), sha256(rest.encode()).hexdigest())


# --- alignment ---

def alignment(texts, encode_a, encode_b):
    """Per text the columns of operator 11; the encoders give (id, bytes) of every token."""
    held = []
    for text in texts:
        whole = b" " + (text or "").encode()
        a, b = (encode_a(text), encode_b(text)) if text else ([], [])
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            held.append(([], [], []))
            continue
        ends = []
        for side in (a, b):
            at, own = 0, {}
            for i, (_, x) in enumerate(side):
                at += len(x)
                own[at] = i + 1
            ends.append(own)
        groups, i, j = [], 0, 0
        for cut in sorted(ends[0].keys() & ends[1].keys()):
            groups.append(([t for t, _ in a[i : ends[0][cut]]], [t for t, _ in b[j : ends[1][cut]]]))
            i, j = ends[0][cut], ends[1][cut]
        held.append((a, b, groups))
    counts = Counter()
    for _, _, groups in held:
        counts.update({(x, y) for own_a, own_b in groups for x in own_a for y in own_b})
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for a, b, groups in held:
        links = [(x, y) for own_a, own_b in groups for x in own_a for y in own_b]
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[k] == most[k[0]] for k in links),
                    sum(counts[k] for k in links), sha256(told.encode()).hexdigest() if a else ""))
    return out
