"""Plain Python statements of what the operators return, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def lines(docs):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    held = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            held[key(line)].add(d)
    out = {}
    for d, t in docs:
        every = (t or "").split("\n")
        stay = [x for x in every if len(key(x)) < 10 or d == min(held[key(x)])]
        out[d] = (len(every), len(every) - len(stay), sha("\n".join(stay)))
    return out


def quality(text):
    text = text or ""
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    count, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            cover.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def substrings(docs, width=50):
    words = {d: WORD.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][i:i + width]), d)
    out = {}
    for d, w in words.items():
        drop = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i:i + width])] < d:
                drop.update(range(i, i + width))
        out[d] = (len(w), len(drop), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))
    return out


def suffixes(docs, width=400):
    data = {d: (t or "").encode() for d, t in docs}
    count = Counter(b[i:i + width] for b in data.values() for i in range(len(b) - width + 1))
    out = {}
    for d, b in data.items():
        drop = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if count[b[i:i + width]] > 1:
                drop[i:i + width] = b"\1" * width
        out[d] = (len(b), sum(drop), len(re.findall(b"\1+", bytes(drop))), sha(bytes(x for x, y in zip(b, drop) if not y)))
    return out


def components(docs):
    sets = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (i := len(sets[a] & sets[b])) and 100 * i >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def pii(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            n = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 13 <= len(n) <= 19 and luhn(n), "phone": 9 <= len(n) <= 15}
            if ok[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def secrets(text):
    """Base spans by the contract's words, without flags or shortcuts."""
    letter = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    names = "|".join([*map(letter, ("password", "passwd", "secret", "token")), letter("api") + "_?" + letter("key")])
    found = []
    for kind, pattern, least, group in (
        ("assign", rf"""(?:{names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1), ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0),
    ):
        found += [(m.start(), len(found), kind, m.end()) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    order = {"assign": 0, "access": 1, "hex": 2}
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found, key=lambda x: (x[0], order[x[2]])))


def kept(rows, features, spreads, shrink, bound):
    """{key: kept} from {key: (lang, source, measures)} by exact quantiles; features as the operator's."""
    import math

    def quantile(values, r):
        values = sorted(values)
        return values[max(0, math.ceil(r * len(values)) - 1)]

    def median(values):
        values = sorted(values)
        n = len(values)
        return (values[(n - 1) // 2] + values[n // 2]) / 2

    ratio = lambda m, f: m[features[f][0]] / max(m[features[f][1]], 1)
    failed = {k: m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"] for k, (_, _, m) in rows.items()}
    out = {k: not failed[k] for k in rows}
    for f, (_, per, unit) in features.items():
        groups = defaultdict(list)
        for k, (lang, source, m) in rows.items():
            if not failed[k]:
                groups[lang, source].append(ratio(m, f))
        own = {g: (quantile(v, 0.5), (quantile(v, 0.9) - quantile(v, 0.5)) / 1.2816, (quantile(v, 0.5) - quantile(v, 0.1)) / 1.2816) for g, v in groups.items()}
        langs = {lang: [own[g] for g in own if g[0] == lang] for lang, _ in own}
        of = {lang: tuple(median([x[i] for x in v]) for i in range(3)) for lang, v in langs.items()}
        corpus = tuple(median([x[i] for x in of.values()]) for i in range(3))
        of = {lang: tuple((len(langs[lang]) * x + 2 * c) / (len(langs[lang]) + 2) for x, c in zip(of[lang], corpus)) for lang in of}
        for k, (lang, source, m) in rows.items():
            if failed[k]:
                continue
            n, (c0, up0, dn0) = len(groups[lang, source]), of[lang]
            c, up, dn = ((n * x + shrink * y) / (n + shrink) for x, y in zip(own[lang, source], of[lang]))
            c, up, dn = max(min(c, c0 + bound * up0), c0 - bound * dn0), min(up, bound * up0), min(dn, bound * dn0)
            per_text = max(m[per], 1)
            noise = c / 2 / math.sqrt(per_text) if unit is None else math.sqrt((c + unit / per_text) * unit / per_text)
            x = ratio(m, f)
            if x > c + spreads * (up + noise) or (unit is None and x < c - spreads * (dn + noise)):
                out[k] = False
    return out


def templates(rows, strength, damp, apart):
    """{(host, path): purity} from [(host, path, ruling or None)] by a recursive tree."""
    import math

    fold = lambda path: tuple(s for s in re.sub("[0-9]+", "#", path).split("/") if s)
    table = defaultdict(lambda: [0, 0, 0])
    for host, path, ruling in rows:
        t = table[host, fold(path)]
        t[0] += 1
        t[1] += ruling == "block"
        t[2] += ruling == "allow"
    b, a = (sum(t[i] for t in table.values()) for i in (1, 2))
    base = min((b + 1) / (b + a + 2), 0.5)
    out = {}

    def critical(k):
        k = max(k, 1)
        return k * (1 - 2 / (9 * k) + apart * math.sqrt(2 / (9 * k))) ** 3

    def unlike(counts):
        """Names whose counts {name: {cell: n}} differ from the others'."""
        cells, total = Counter(), 0
        for v in counts.values():
            cells.update(v)
        total, found = sum(cells.values()), set()
        for name, v in counts.items():
            own = sum(v.values())
            if own in (0, total):
                continue
            g = 0.0
            for cell, n in cells.items():
                for o, e in ((v.get(cell, 0), own * n / total), (n - v.get(cell, 0), (total - own) * n / total)):
                    g += 2 * o * math.log(o / e) if o else 0
            if g > critical(len(cells) - 1):
                found.add(name)
        return found

    def grow(members, depth, prior):
        """members: [(shape, n, blocked, allowed)] of one node."""
        b, a = sum(m[2] for m in members), sum(m[3] for m in members)
        purity = (b + strength * (damp * prior + (1 - damp) * base)) / (b + a + strength)
        done = [m for m in members if len(m[0]) < depth]
        rest = [m for m in members if len(m[0]) >= depth]
        found = {m[0]: purity for m in done}
        if len(members) == 1 and rest:
            p = (b + strength * (damp * purity + (1 - damp) * base)) / (b + a + strength)
            return {rest[0][0]: p}
        child = Counter()
        for m in rest:
            child[m[0][depth - 1]] += m[1]
        single, every = sum(n == 1 for n in child.values()), sum(child.values())
        variable = {s for s in child if "#" in s or 2 * single >= every}
        shapes, labels = defaultdict(Counter), defaultdict(Counter)
        for shape, n, x, y in rest:
            s = shape[depth - 1]
            if s not in variable:
                after = shape[depth] if len(shape) > depth else ""
                shapes[s][after if "#" in after or not after else "a"] += n
                labels[s].update({k: v for k, v in (("b", x), ("a", y)) if v})
        alone = unlike(shapes) | unlike({s: v for s, v in labels.items() if v})
        branch = defaultdict(list)
        for m in rest:
            s = m[0][depth - 1]
            branch["*" if s in variable else s if s in alone else "{}"].append(m)
        for some in branch.values():
            found |= grow(some, depth + 1, purity)
        return found

    for host in {h for h, _ in table}:
        found = grow([(s, *t) for (h, s), t in table.items() if h == host], 1, base)
        out |= {(host, s): p for s, p in found.items()}
    return {(host, path): out[host, fold(path)] for host, path, _ in rows}


def measures(text):
    text = text or ""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    more = {"n_lines": sum(WORD.search(x) is not None for x in text.split("\n")), "n_capitals": len(re.findall("[A-Z]", text)), "n_marks": len(re.findall("[!?]", text))}
    return dict(zip(names, quality(text))) | more


def without_lines(docs):
    """{doc: text} after line dedup."""
    key = lambda line: line.strip(SPACE).translate(LOWER)
    held = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            held[key(line)].add(d)
    return {d: "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or d == min(held[key(x)])) for d, t in docs}


def classes(docs, size, percent):
    """{doc: smallest doc of its class} by shingles of so many words."""
    sets = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    least = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and (i := len(sets[a] & sets[b])) and 100 * i >= percent * len(sets[a] | sets[b])]
    while True:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            return least


def contaminations(docs, items, masks, span, percent, run, least):
    """{(doc, item): words that agree} of the pairs that count."""
    import string

    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower().translate(str.maketrans("", "", string.punctuation))) if w]
    out = {}
    for d, t in docs:
        dw = words(t)
        for i, u in items:
            iw = words(u)
            if 0 < len(iw) < span:
                if any(dw[p:p + len(iw)] == iw for p in range(len(dw) - len(iw) + 1)):
                    out[d, i] = len(iw)
                continue
            shifts = {
                p - q for m in masks for p in range(len(dw) - span + 1) for q in range(len(iw) - span + 1)
                if all(dw[p + k] == iw[q + k] for k in range(span) if m[k] == "1")
            }
            agree = [[0 <= s + j < len(dw) and dw[s + j] == iw[j] for j in range(len(iw))] for s in shifts]
            most = max(map(sum, agree), default=0)
            if agree and (100 * most >= percent * len(iw) or any(sum(a[j:j + run]) >= least for a in agree for j in range(len(iw) - run + 1))):
                out[d, i] = most
    return out
