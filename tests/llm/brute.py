"""Plain single-machine versions of the contracts, for small tables."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def op1(docs):
    sets = {}
    for i, t in docs:
        w = words(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    held = {}
    for i, s in sets.items():
        for x in s:
            held.setdefault(x, []).append(i)
    common = Counter()
    for ids in held.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                common[a, b] += 1
    u = Sets()
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            u.join(a, b)
    return sorted((i, len(sets[i]), u.find(i), u.find(i) == i) for i in sets)


def op2(pages):
    first = {}
    for i, html in pages:
        first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, html in pages:
        raw = (html or "").encode()
        lead = first[html or ""]
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if lead == i else "revisit", None if lead == i else lead))
    return sorted(out)


def op3(docs, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    out = []
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return sorted(out)


def op6(docs, size=13):
    low = {}
    cut = {i: words(t) for i, t in docs}
    for i, w in cut.items():
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            low[x] = min(i, low.get(x, i))
    out = []
    for i, w in cut.items():
        gone = set()
        for k in range(len(w) - size + 1):
            if low[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def op7(vectors, cosine=0.9):
    good = {i: np.array(v, float) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids, u, n = list(good), Sets(), Counter()
    for a in range(len(ids)):
        x = good[ids[a]]
        for b in range(a + 1, len(ids)):
            y = good[ids[b]]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                u.join(ids[a], ids[b])
                n[ids[a]] += 1
                n[ids[b]] += 1
    return sorted((i, n[i], u.find(i), u.find(i) == i) for i, _ in vectors)


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m[0])) <= 15),
}
SECRETS = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def base(docs, kinds, by_kind):
    out = []
    for i, text in docs:
        found = [(k, kind, m.start(), m.end()) for k, (kind, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text or "") if ok(m)]
        found.sort(key=lambda s: (s[0], s[2]) if by_kind else (s[2], s[0]))
        said = ",".join(f"{s[1]}:{s[2]}:{s[3]}" for s in found)
        out.append((i, *(sum(s[1] == kind for s in found) for kind in kinds), hashlib.sha256(said.encode()).hexdigest(), said))
    return sorted(out)


def op9(docs):
    out = []
    for i, text in docs:
        text = text or ""
        w = words(text)
        seen, dup, lines = set(), 0, 0
        for line in text.split("\n"):
            if words(line):
                lines += 1
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        chars, symbols = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text))
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        bad = failed or 4 * symbols > len(w) or 2 * dup > lines or 2 * chars < 3 * len(w) or chars > 40 * len(w)
        worded = [x for x in map(words, text.split("\n")) if x]
        bullets, dots = sum(x[0][0] in "-*" for x in worded), sum(x[-1].endswith("...") for x in worded)
        bad = bad or 10 * len(re.findall("[0-9]", text)) > 3 * chars or (len(worded) >= 5 and (10 * bullets > 9 * len(worded) or 10 * dots > 3 * len(worded)))
        bad = bad or (len(w) >= 20 and 10 * max(Counter(w).values()) > 4 * len(w))
        out.append((i, len(w), chars, symbols, dup, len(hit), failed, not bad))
    return sorted(out)


def op5(docs):
    """docs: (id, text, source), ids unique."""
    size, total = {}, 0
    for _, text, source in docs:
        size[source] = size.get(source, 0) + len(words(text))
    total = sum(size.values())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full: set = set()
    while True:
        left = 1.5 * total - sum(2 * size[s] for s in full)
        level = left / max(1, sum(w for s, w in weight.items() if s not in full))
        over = {s for s in order if s not in full and weight[s] * level >= 2 * size[s]}
        if not over:
            break
        full |= over
    target = {s: 2.0 * size[s] if s in full else weight[s] * level for s in order}
    key = lambda i: int(hashlib.md5(f"{i}:mix".encode()).hexdigest()[:15], 16)
    times = {}
    for s in order:
        whole = int(target[s] // size[s]) if size[s] else 0
        room, upto = target[s] - whole * size[s], 0
        for i, n in sorted(((i, len(words(t))) for i, t, src in docs if src == s), key=lambda x: key(x[0])):
            inside = upto + n <= room or (upto <= room and n - (room - upto) < room - upto)
            times[i] = whole + (n > 0 and inside and upto <= room)
            upto += n
    return sorted((i, len(words(t)), size[s], target[s], times[i] * len(words(t))) for i, t, s in docs)


def mixed(s):
    return bool(re.search("[0-9]", s) and re.search("[A-Z]", s) and re.search("[a-z]", s) and s[0] != "/")


def op10_spans(docs, kinds, weak, mixed, scope):
    """All spans by pairs of parts: weak (kind, pattern), mixed(secret)."""
    out = []
    for i, text in docs:
        text = text or ""
        base = [(m.start(), m.end(), kind) for kind, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m)]
        parts = [(m.start(), m.end(), kind) for kind, p in weak for m in re.finditer(p, text) if kind != "weak_secret" or mixed(m[0])]
        parts = [w for w in parts if not any(b[0] < w[1] and b[1] > w[0] for b in base)]
        named = [w for w in parts if w[2] == "weak_id"]
        parts = [w for w in parts if w[2] != "weak_secret" or not any(n[0] <= w[0] and n[1] >= w[1] for n in named)]
        near = lambda a, b: 0 <= b[0] - a[1] <= scope or 0 <= a[0] - b[1] <= scope
        ids = [p for p in base + parts if p[2] in ("access", "weak_id")]
        keys = [p for p in base + parts if p[2] in ("assign", "hex", "weak_secret")]
        found = [p for p in parts if p[2] == "weak_secret" and any(near(p, q) for q in ids) or p[2] == "weak_id" and any(near(p, q) for q in keys)]
        sure = [p for p in keys if any(near(p, q) for q in ids)]
        found += [p for p in parts if p[2] == "endpoint" and any(near(p, q) for q in sure)]
        place = [*kinds, *(k for k, _ in weak)]
        out.append((i, ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(base + found, key=lambda s: (s[0], place.index(s[2]))))))
    return sorted(out)


def op8_spans(docs, kinds, rounds, sure_at, seeds_at):
    """All spans by the bootstrap over plain dictionaries."""
    tokens, base, counts = [], {}, Counter()
    for i, text in docs:
        text = text or ""
        base[i] = [(k, m.start(), m.end(), kind) for k, (kind, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text) if ok(m)]
        every = [(m.start(), m.end(), m[0]) for m in WORD.finditer(text)]
        counts.update(w.lower() for _, _, w in every)
        for n, (a, b, w) in enumerate(every):
            hit = sorted(s for s in base[i] if s[1] < b and s[2] > a)
            value = re.sub(r"[^0-9A-Za-z)]+\Z", "", re.sub(r"^[^0-9A-Za-z@+(]+", "", w))
            if (re.search("[0-9@]", w)) and (hit or len(digits(value)) >= 4 or "@" in value):
                # The word on the right may be a token itself; a gap without a word has none.
                last, then = every[n - 1] if n else None, every[n + 1] if n + 1 < len(every) else None
                plain = lambda t: t[2].lower() if t and not re.search("[0-9@]", t[2]) else ""
                tokens.append((i, a, b, {"l": plain(last), "r": plain(then)}, value, hit[0][3] if hit else None))
    graph, kind_of = Counter(), {}
    for _, _, _, sides, value, kind in tokens:
        for side, word in sides.items():
            if len(word) > 1:
                graph[side, word, value] += 1
                if kind:
                    kind_of[value] = max(kind, kind_of.get(value, ""))
    best = lambda options: max(options) if options else None
    seeds = {v: (1.0, k) for v, k in kind_of.items()}
    scored, rules = dict(seeds), {}
    for _ in range(rounds):
        met: dict = {}
        for (side, word, value), n in graph.items():
            if value in scored:
                met.setdefault((side, word), []).append((round(n * scored[value][0], 9), scored[value][1]))
        rules = {}
        for (side, word), found in met.items():
            share = round(sum(w for w, _ in found) / counts[word], 9) if counts[word] else 0
            if len(found) >= seeds_at and share >= sure_at:
                rules[side, word] = (share, max(found)[1])
        new: dict = {}
        for side, word, value in graph:
            if (side, word) in rules:
                share, kind = rules[side, word]
                new.setdefault(value, []).append((share, kind))
        scored = dict(seeds)
        for value, found in new.items():
            options = [(min(1.0, max(found)[0]), max(found)[1])] + ([seeds[value]] if value in seeds else [])
            scored[value] = best(options)
    learned: dict = {}
    for i, a, b, sides, _, kind in tokens:
        found = [rules[s, w] for s, w in sides.items() if (s, w) in rules]
        if kind is None and found:
            learned.setdefault(i, []).append((list(kinds).index(max(found)[1]), a, b, max(found)[1]))
    return sorted((i, ",".join(f"{s[3]}:{s[1]}:{s[2]}" for s in sorted(base[i] + learned.get(i, []), key=lambda s: (s[0], s[1], s[2])))) for i, _ in docs)


def op11(docs, path):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i, t in docs:
        ids = library.encode(t or "", add_bos=False, add_eos=True)
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), True))
    return out


def op12(docs):
    """With the output itself, before its digests."""
    out = []
    for i, t in docs:
        t = t or ""
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
        h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        n = len(units)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
            out.append((i, n, "plain", None, None, t, t))
        elif h4 % 100 < 80:
            out.append((i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t))
        else:
            out.append((i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t))
    return out


def op13(docs, labels):
    """docs: (id, text, source); labels: (id, quality, toxic). Every order applied to every part's documents, one by one."""
    from itertools import permutations

    told = {}
    for i, q, x in labels:
        old = told.get(i, (False, False))
        told[i] = (old[0] or q == 1, old[1] or x == 1)
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = {}
    for i, t, s in docs:
        t = t or ""
        w = words(t)
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t])
        parts.setdefault(s or "", []).append((fails, *told.get(i, (False, False))))
    out = []
    for part, rows in parts.items():
        steps = []
        for order in permutations(range(5)):
            left = rows
            for step, k in enumerate(order, 1):
                gone = [r for r in left if r[0][k]]
                left = [r for r in left if not r[0][k]]
                failing = [r for r in rows if r[0][k]]
                steps.append((k, (part, "".join("ABCDE"[j] for j in order), step, len(left), len(gone), len(failing) - len(gone), sum(sum(r[0]) == 1 for r in failing), sum(r[1] for r in gone), sum(r[2] for r in gone))))
        share = Counter()
        for k, r in steps:
            share[k] += r[4]
        out += [(*r, share[k]) for k, r in steps]
    return sorted(out)
