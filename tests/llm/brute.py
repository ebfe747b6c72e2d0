"""Plain versions of the operators, one text at a time, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered(text):
    return SPACED.findall((text or "").translate(LOWER))


def secrets(rows):
    """[(key, spans)] with spans as (start, rank, end, kind); rows may repeat."""
    from webloom.llm.secrets import BANDS, BITS, ENCODINGS, GRID, KINDS, RATE
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    patterns = {"access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    least = {"access": 20, "hex": 24}
    found, runs = [], []
    for n, (key, text) in enumerate(rows):
        text, spans = text or "", []
        spans += [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
        for rank, kind in enumerate(KINDS[1:], 1):
            spans += [(m.start(), rank, m.end(), kind) for m in patterns[kind].finditer(text) if len(m[0]) >= least[kind]]
        found.append((key, spans))
        for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}", text):
            body = m[0].rstrip("=")
            fit = next(((e, a) for e, p, a in ENCODINGS if re.search(p, body)), None)
            if fit and len(body) >= 20:
                p = battery([fit[1].index(c) for c in body], len(fit[1]))
                runs.append((n, m.start(), m.end(), fit[0], len(body) * math.log2(len(fit[1])),
                             sum(len(body) >= b for b in BANDS), math.ceil(math.log10(p) * GRID)))
    for band in {r[5] for r in runs}:
        points = sorted(r[6] for r in runs if r[5] == band)
        passed = [x for x in set(points) if 10 ** (x / GRID) * len(points) <= RATE * sum(y <= x for y in points)]
        bar = max(passed, default=None)
        for n, start, end, encoding, bits, b, point in runs:
            if b == band and bits >= BITS and (bar is None or point > bar):
                found[n][1].append((start, len(KINDS), end, f"random_{encoding}"))
    return [(key, sorted(spans)) for key, spans in found]


def battery(values, k):
    def clip(p):
        return max(1e-15, min(1 - 1e-15, p))

    def tail(z):
        return math.erfc(z / math.sqrt(2)) / 2

    n, count = len(values), Counter(values)
    x, mean, variance = sum(c * c for c in count.values()) * k / n - n, k - 1, 2 * (k - 1) * (n - 1) / n
    s = variance / (9 * mean * mean)
    ps = [clip(tail(((max(0.0, x) / mean) ** (1 / 3) - (1 - s)) / math.sqrt(s)))]
    side = [2 * v >= k for v in values]
    a = sum(side)
    product = 2 * a * (n - a)
    variance = product * (product - n) / (n * n * (n - 1))
    runs = 1 + sum(p != q for p, q in zip(side, side[1:]))
    ps.append(clip(2 * tail(abs((runs - (product / n + 1)) / math.sqrt(variance)))) if variance > 0 else 1e-15)
    total, squares = sum(values), sum(v * v for v in values)
    spread = n * squares - total * total
    if spread > 0:
        r = (n * sum(p * q for p, q in zip(values, values[1:] + values[:1])) - total * total) / spread
        ps.append(clip(2 * tail(abs((r + 1 / (n - 1)) / math.sqrt(n * n / ((n - 1) ** 2 * (n - 2)))))))
    else:
        ps.append(1e-15)
    return clip(0.5 - math.atan(sum(math.tan((0.5 - p) * math.pi) for p in ps) / 3) / math.pi)


def word_rules(text):
    text = text or ""
    words = SPACED.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    seen, doubled = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            doubled += line in seen
            seen.add(line)
    repeated = len({j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)})
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), doubled, repeated


def sound(text):
    """The verdict of the compression bands, with its base rules."""
    import zstandard

    from webloom.llm.compression import BANDS, CHUNK, LEVEL
    n, _, _, _, repeated = word_rules(text)
    raw = (text or "").encode()
    if n < 50 or 100 * repeated > 50 * n:
        return False

    def within(part):
        low, high = next((b[1], b[2]) for b in reversed(BANDS) if len(part) >= b[0])
        return low <= len(zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False).compress(part)) / len(part) <= high

    chunks = [raw[i:i + CHUNK] for i in range(0, len(raw), CHUNK)] if len(raw) > CHUNK else []
    return within(raw) and sum(len(c) for c in chunks if not within(c)) <= 0.5 * len(raw)


def language(rows, strength, folds=7, fold=2):
    texts = [(k, k is not None and zlib.crc32(str(k).encode()) % folds == fold, lowered(t) + [None]) for k, t in rows]
    single, pair = Counter(), Counter()
    for _, held, tokens in texts:
        if not held:
            single.update(tokens)
            pair.update(zip([0] + tokens, tokens))
    total, vocabulary, out = sum(single.values()), len(single), []
    for key, held, tokens in texts:
        base = score = 0.0
        for v, w in zip([0] + tokens, tokens):
            p = (single[w] + 1) / (total + vocabulary + 1)
            before = single[None] if v == 0 else single[v]
            base += math.log10(p)
            score += math.log10((pair[v, w] + strength * p) / (before + strength))
        out.append((key, held, len(tokens), sum(single[w] > 0 for w in tokens), total, base, score))
    return out


def repeats(rows, length=50):
    """{key: (n_bytes, n_removed, n_spans, sha256)} for distinct keys."""
    first, out = {}, {}
    rows = sorted((k, (t or "").encode()) for k, t in rows)
    for key, raw in rows:
        for i in range(len(raw) - length + 1):
            first.setdefault(raw[i:i + length], key)
    for key, raw in rows:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i:i + length]] < key:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[key] = len(raw), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest()
    return out


def shingles(text):
    words = lowered(text)
    return frozenset(tuple(words[i:i + 4]) for i in range(len(words) - 3)) if len(words) >= 4 else frozenset([tuple(words)] if words else [])


def groups(rows, percent=85):
    """{key: (n_shingles, component)} for distinct keys."""
    sets = {k: shingles(t) for k, t in rows}
    lists, name = defaultdict(list), {k: k for k in sets}

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for key, own in sets.items():
        for s in own:
            lists[s].append(key)
    for a, b in {(a, b) for keys in lists.values() for a in keys for b in keys if a < b}:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            name[y] = x
    return {k: (len(sets[k]), root(k)) for k in sets}


def planted(key, text):
    """Words of a text after the contract of the periodic run query."""
    words = SPACED.findall(text or "")
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def periodic(words, least=24, times=3):
    """Runs as (start, length, period), by scanning every lag; and the words that stay."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j + 1
    runs = sorted((s, m, q) for (s, m), q in found.items())
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return runs, [w for i, w in enumerate(words) if i not in gone]


TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranking(docs, items, top=10):
    """{(item key, text): [(key, score)]}, every document scored for every item."""
    counted = [(k, Counter(w.translate(LOWER) for w in TERM.findall(t or ""))) for k, t in docs]
    counted = [(k, c, sum(c.values())) for k, c in counted if c]
    n, total = len(counted), sum(c[2] for c in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = {}
    for item, text in set(items):
        asked = Counter(w.translate(LOWER) for w in TERM.findall(text or ""))
        scores = []
        for key, c, size in counted:
            m = 25 + 75 * size * n // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, r in asked.items() if c[t])
            scores.append((-s, key is None, key if key is not None else 0, key))
        out[item, text] = [(e[3], -e[0]) for e in sorted(scores)[:top] if e[0] < 0]
    return out


def unrepeated(rows, width=35):
    """[(key, words, removed words, kept text)], by counting all windows."""
    split = [(k, SPACED.findall(t or "")) for k, t in rows]
    count = Counter(tuple(w[i:i + width]) for _, w in split for i in range(len(w) - width + 1))
    out = []
    for key, words in split:
        gone = set()
        for i in range(len(words) - width + 1):
            if count[tuple(words[i:i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((key, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out
