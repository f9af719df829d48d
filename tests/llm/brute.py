"""Plain versions of the training-data queries, for comparison on small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def tokenizer(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def op1(docs):
    t, out, start = tokenizer("byte_bpe_50k.json"), [], 0
    for d, text in sorted(docs, key=lambda r: r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def op2(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(i)
    both = Counter()
    for h in holders.values():
        for a in range(len(h)):
            for b in range(a + 1, len(h)):
                both[h[a], h[b]] += 1
    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a][1]) + len(sets[b][1]) - n):
            parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets)]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def op5(docs):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(x := re.sub("[^0-9]", "", m)) <= 19 and luhn(x)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    out = []
    for d, t in docs:
        spans = sorted((m.start(), i, k, m.end()) for i, (k, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, t or "") if ok(m[0]))
        out.append((d, *[sum(s[2] == k for s in spans) for k in kinds], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans))))
    return out


def op6(docs, n=200):
    texts = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(t[i : i + n] for _, t in texts for i in range(len(t) - n + 1))
    out = []
    for d, t in texts:
        cover = np.zeros(len(t) + 1, dtype=int)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                cover[i : i + n] = 1
        runs = int((np.diff(np.concatenate([[0], cover])) == 1).sum())
        out.append((d, len(t), int(cover.sum()), runs, sha(bytes(b for b, c in zip(t, cover, strict=False) if not c))))
    return out


def op7(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


class _Article(HTMLParser):
    """Blocks of the article element, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.dropped, self.parts, self.blocks = 0, 0, [], []

    def flush(self):
        if text := " ".join("".join(self.parts).split()):
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.dropped += tag in ("nav", "aside", "footer", "form", "script", "style")
        if tag not in ("b", "i", "em", "strong", "a", "span", "code"):
            self.flush()

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "em", "strong", "a", "span", "code"):
            self.flush()
        self.inside -= tag == "article"
        self.dropped -= tag in ("nav", "aside", "footer", "form", "script", "style")

    def handle_data(self, data):
        if self.inside and not self.dropped:
            self.parts.append(data)


def op8(page):
    p = _Article()
    p.feed(page or "")
    p.close()
    p.flush()
    return " ".join(p.blocks)
