"""Plain, slow versions of the operators, for tests."""

import bisect
import collections
import hashlib
import math
import re
import zlib

import numpy as np

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(
    "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def secrets(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(1)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
    return sorted(out)


TOKEN, PAD = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}"), re.compile("=+$")


def token_p(token, alphabets, ordinary, veto, lean):
    """(encoding, length, p) of a token candidate, one character after the other."""
    body = PAD.sub("", token)
    n = len(body)
    name = next((e for e, abc in alphabets.items() if set(body) <= set(abc)), None)
    if re.fullmatch("[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", body) or name is None:
        return ("uuid" if name else None), n, 1.0
    abc = alphabets[name]
    k, (share, usual) = len(abc), ordinary[name]
    kind = lambda c: "u" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "o"
    if len({kind(c) for c in abc}) == 1:
        kind = lambda c: 2 * abc.index(c) >= k
    many = collections.Counter(map(kind, abc))
    rate = 1 - sum((v / k) ** 2 for v in many.values())
    turns = sum(kind(a) != kind(b) for a, b in zip(body, body[1:], strict=False))
    chi = k * sum(v * v for v in collections.Counter(body).values()) / n - n
    far = k * share - 1
    z_chi = (chi - (k - 1 + n * far)) / math.sqrt(2 * (k - 1 + 2 * n * far))
    v = [float(abc.index(c)) for c in body]
    mean = sum(v) / n
    spread = sum((x - mean) ** 2 for x in v)
    serial = abs(sum((a - mean) * (b - mean) for a, b in zip(v, v[1:], strict=False)) / spread) if spread > 1e-9 else 1.0
    sigma = math.sqrt((n - 1) * rate * (1 - rate))
    if max((chi - (k - 1)) / math.sqrt(2 * (k - 1)), abs(turns - rate * (n - 1)) / sigma, serial * math.sqrt(n)) > veto or normal(z_chi) > lean:
        return name, n, 1.0
    if usual is None:
        return name, n, normal(z_chi)
    z_runs = (turns - usual * (n - 1)) / math.sqrt((n - 1) * usual * (1 - usual))
    return name, n, normal((z_chi - z_runs) / math.sqrt(2))


def normal(z):
    if z < -3:
        return math.exp(-z * z / 2) / (-z * 2.5066282746310002) * (1 - 1 / z**2 + 3 / z**4)
    return 1 / (1 + math.exp(-max(min(z * 1.5976 + z**3 * 0.07056, 500.0), -500.0)))


def random_spans(texts, alphabets, ordinary, veto, lean, rate=0.05, grid=100, decades=15):
    """For each text its spans (start, end) that the step-up rule passes, by strata of encoding and half octave of length."""
    strata, found = collections.defaultdict(list), []
    for nth, t in enumerate(texts):
        for m in TOKEN.finditer(t or ""):
            name, n, p = token_p(m.group(), alphabets, ordinary, veto, lean)
            cell = grid * decades + 1 - math.floor(-math.log10(max(p, 10.0**-decades)) * grid)
            key = (name, min(math.floor(math.log2(n) * 2), 30))
            strata[key].append(cell)
            found.append((nth, m.start(), m.end(), key, cell))
    cut = {}
    for key, cells in strata.items():
        cells.sort()
        cut[key] = max((c for c in cells if 10.0 ** ((c - grid * decades - 1) / grid) <= bisect.bisect_right(cells, c) / len(cells) * rate), default=0)
    out = [[] for _ in texts]
    for nth, a, b, key, cell in found:
        if cell <= cut[key]:
            out[nth].append((a, b))
    return out


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(digits[::-1])) % 10 == 0


def personal(text):
    t = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(v) <= 255 for v in m.group().split("."))]
    out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]


def terms(text):
    """(start, end, lowered) of runs of letters and digits, and of anything beyond ASCII."""
    return [(m.start(), m.end(), m.group().translate(LOW)) for m in re.finditer(r"[^\x00-/:-@\[-`{-\x7f]+", text or "")]


def entities(text):
    out = set()
    for k, a, b in personal(text):
        value = text[a:b]
        out.add((k, re.sub("[^0-9]", "", value) if k >= 2 else value.lower()))
    return out


def disclosing(texts, alpha=1.25):
    """For each text its spans (start, end, sure) of terms that tell an entity of it."""
    n = len(texts)
    held = [{t for _, _, t in terms(x) if len(t) >= 3 and not t.isdigit()} for x in texts]
    owned = [entities(x or "") for x in texts]
    n_t, n_c, n_ct = collections.Counter(), collections.Counter(), collections.Counter()
    for h, o in zip(held, owned, strict=True):
        n_t.update(h)
        n_c.update(o)
        n_ct.update((c, t) for c in o for t in h)
    out = []
    for x, o in zip(texts, owned, strict=True):
        told = {}
        for c in o:
            content = math.log2(n / n_c[c])
            for _, _, t in terms(x):
                if n_ct[c, t] and content > 0 and math.log2(n * n_ct[c, t] / (n_c[c] * n_t[t])) >= content / alpha - 1e-12:
                    told[t] = told.get(t, False) or n_ct[c, t] == n_t[t]
        base = [(a, b) for _, a, b in personal(x)]
        out.append([(a, b, told[t]) for a, b, t in terms(x) if t in told and not any(c < b and a < d for c, d in base)])
    return out


def line_dedup(docs):
    """{(doc_id, text): (n_lines, n_dropped, sha)}"""
    key, hold = (lambda x: x.strip(WS).translate(LOW)), collections.defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n") if i is not None else ():
            if len(key(x)) >= 10:
                hold[key(x)].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or not (len(hold[key(x)]) > 1 and min(hold[key(x)]) != i)]
        out[i, t] = (len(lines), len(lines) - len(keep), sha("\n".join(keep)))
    return out


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_duplicates(docs, percent=85):
    """{doc_id: (set size, component)} for distinct doc_ids."""
    sets = {i: shingles(t) for i, t in docs if i is not None}
    lists, shared = collections.defaultdict(list), collections.Counter()
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    for held in lists.values():
        for a in range(len(held)):
            for b in range(a):
                shared[held[b], held[a]] += 1
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in shared.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def best_fit(sizes, capacity=1024):
    left = []
    for s in sorted(sizes, reverse=True):
        j = bisect.bisect_left(left, s)
        bisect.insort(left, (left.pop(j) if j < len(left) else capacity) - s)
    return len(left)


def repeats(docs, width=100):
    """{doc_id: (n_bytes, n_removed, n_spans, sha)} for distinct doc_ids; documents in order of doc_id."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        data, cover = (t or "").encode(), bytearray(len((t or "").encode()))
        for k in range(len(data) - width + 1):
            w = data[k : k + width]
            if w in seen:
                cover[k : k + width] = b"\1" * width
            seen.add(w)
        kept = bytes(x for x, c in zip(data, cover, strict=True) if not c)
        out[i] = (len(data), sum(cover), len(bytes(cover).replace(b"\0", b" ").split()), sha(kept))
    return out


def top_products(rows, query, k, scale=1024):
    """rows: [(id, vector)]; the k best of equal length, without the query's id."""
    whole = lambda v: [int(np.floor(scale * x)) for x in v]
    q = whole(query[1])
    scored = [(-sum(a * b for a, b in zip(q, whole(v), strict=True)), i) for i, v in rows if i != query[0] and len(v) == len(q)]
    return [(i, -s) for s, i in sorted(scored)[:k]]


def crc_fifth(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
