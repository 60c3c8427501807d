"""Plain versions of the operators, to compare results with."""

import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from patternlake.llm import licenses


def groups(nodes, linked):
    """Smallest member of each node's component."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def fingerprint(text, width=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def simhash(docs, tau=4):
    """{doc_id: (fingerprint, component)}"""
    fp = {i: fingerprint(t) for i, t in docs}
    ids = sorted(fp)
    root = groups(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= tau])
    return {i: (f"{fp[i]:016x}", root[i]) for i in ids}


def spans(docs, least=2, words=12):
    """{doc_id: text left}"""
    gone, parts = spans_gone(docs, least, words, True)
    return {i: "".join(s + g for k, (s, g) in enumerate(p) if k not in gone[i]) for i, p in parts.items()}


def spans_gone(docs, least=2, words=12, with_parts=False):
    """{doc_id: numbers of the sentences that go}"""
    cut = re.compile(r"(?<=[.!?])\s+|\n+")
    first, runs, parts = {}, [], {}
    for i, text in sorted(docs):
        at, out = 0, []
        for m in cut.finditer(text or ""):
            out.append((text[at : m.start()], m.group()))
            at = m.end()
        if at < len(text or ""):
            out.append((text[at:], ""))
        parts[i] = out
        full = [(k, " ".join(s.lower().split())) for k, (s, _) in enumerate(out) if s.split()]
        for a in range(len(full)):
            for b in range(a + least, len(full) + 1):
                if sum(len(s.split()) for _, s in full[a:b]) >= words:
                    key = tuple(s for _, s in full[a:b])
                    runs.append((key, i, full[a][0], full[b - 1][0] + 1))
                    first.setdefault(key, (i, full[a][0]))
                    break
    gone = defaultdict(set)
    for key, i, a, b in runs:
        if first[key] != (i, a):
            gone[i].update(range(a, b))
    return (gone, parts) if with_parts else gone


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[-1], row[k + 1]))
        row = new
    return row[-1]


def plain_words(text):
    """Lower-case words without marks at either end."""
    found = (re.sub(r"^(?:\W|_)+|(?:\W|_)+$", "", c) for c in (text or "").lower().split())
    return [w for w in found if w]


def leaks(docs, bench, near=0.8, loose=0.6, answer=0.8):
    """{(doc_id, item_id)}: every passage (64 words from every 32nd, and as many more around it as the item has) against every item."""
    items = []
    for i, t in bench:
        if x := plain_words(t):
            last = [w for s in re.split(r"(?<=[.!?])\s+|\n+", t) if len(w := plain_words(s)) >= 3]
            items.append((i, x, Counter(x), last[-1] if last else x))
    found = set()
    for d, text in docs:
        w = plain_words(text)
        for at in range(0, len(w), 32):
            for i, x, times, told in items:
                region = w[max(0, at - len(x)) : at + 64 + len(x)]
                if (d, i) in found or (times & Counter(region)).total() < loose * len(x):  # no common subsequence is longer
                    continue
                share = lcs(x, region) / len(x)
                if share >= near or (share >= loose and lcs(told, region) / max(1, len(told)) >= answer):
                    found.add((d, i))
    return found


def vectors(rows, threshold=0.98):
    """{vec_id: (n_links, component)}"""

    def usable(e, label):
        return label is not None and e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(x != 0 for x in e)

    good = [(i, np.array(e, float), label) for i, e, label in rows if usable(e, label)]
    pairs = [(a, b) for k, (a, x, p) in enumerate(good) for b, y, q in good[k + 1 :] if p == q and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold]
    n = defaultdict(int)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    root = groups([i for i, _, _ in rows], pairs)
    return {i: (n[i], root[i]) for i, _, _ in rows}


def licensing(text):
    """(n_words, n_base, first, last, labels) of the base phrases."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(k, label) for p, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    at = [k for k, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in hits}))


def _regions(markup):
    """A template as nested lists: words, ("any", n), ("optional", [...])."""
    stack = [[]]
    for t in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup):
        if t == "[[":
            stack.append([])
        elif t == "]]":
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif t[:2] == "{{":
            stack[-1].append(("any", int(t[2:-2])))
        else:
            stack[-1] += re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    return stack[0]


def _ends(parts, words, starts):
    """All places where ``parts`` may end that begin at one of ``starts``."""
    for x in parts:
        if isinstance(x, str):
            starts = {k + 1 for k in starts if k < len(words) and words[k] == x}
        elif x[0] == "any":
            starts = {k + j for k in starts for j in range(x[1] + 1) if k + j <= len(words)}
        else:
            starts = starts | _ends(x[1], words, starts)
        if not starts:
            return starts
    return starts


def license_labels(text, templates):
    """(labels, score, matches): every template at every word."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    labels, covered, n = set(), set(), 0
    for p, label in licenses.BASE.items():
        for k in range(len(words)):
            if words[k : k + len(p.split())] == p.split():
                labels.add(label)
                covered |= set(range(k, k + len(p.split())))
    for label, markup in templates:
        parts = _regions(markup)
        for k in range(len(words)):
            if words[k] == parts[0] or not isinstance(parts[0], str):
                if ends := _ends(parts, words, {k}):
                    labels.add(label)
                    covered |= set(range(k, max(ends)))
                    n += 1
    return ",".join(sorted(labels)), len(covered) / len(words) if words else 0.0, n


def language(text, samples):
    """(lang, score) by greedy parsing of the letters into longest pieces that stand in a sample."""

    def letters(t):
        t = "".join(c if c.isalpha() else " " for c in (t or "").lower())
        return re.sub(" +", " ", t).lstrip(" ")

    x = letters(text)
    if not x.strip():
        return "und", 0.0
    cost = {}
    for lang, sample in samples.items():
        s, n = letters(sample), 0
        for k in range(0, len(x), 1024):
            part, at = x[k : k + 1024], 0
            while at < len(part):
                size = 1
                while at + size < len(part) and part[at : at + size + 1] in s:
                    size += 1
                at, n = at + size, n + 1
        cost[lang] = n * np.log2(max(2, len(s)))
    best = min(sorted(cost), key=lambda k: cost[k])
    rest = [c for k, c in cost.items() if k != best]
    return best, (min(rest) - cost[best]) / min(rest) if rest else 1.0


def passages(docs, passage=51, words=12):
    """{doc_id: words that go}: of the runs of half a passage that any passage holds the one with the least hash, where it is not the first; and repeated texts of one sentence."""
    mask, width = (1 << 64) - 1, (passage + 1) // 2
    first, gone = {}, defaultdict(set)

    def mixed(numbers, base):
        h = sum(x * pow(base, k, 1 << 64) for k, x in enumerate(numbers)) & mask
        h = ((h ^ h >> 31) * 0xD6E8FEB86659FD93) & mask
        return h ^ h >> 29

    for i, text in sorted(docs):
        w = (text or "").lower().split()
        numbers = [xxhash.xxh3_64_intdigest(x.encode()) for x in w]
        runs = [mixed(numbers[k : k + width], 0x9E3779B97F4A7C15) for k in range(len(w) - width + 1)]
        at = {min(range(k, k + passage - width + 1), key=lambda j: (runs[j], j)) for k in range(len(w) - passage + 1)}
        spans = [((tuple(w[k : k + width])), k, k + width) for k in sorted(at)]
        if len(w) >= words and not re.search(r"(?<=[.!?])\s+|\n+", text.strip()):
            spans.append((("whole", *w), 0, len(w)))
        for key, a, e in spans:
            if first.setdefault(key, (i, a)) != (i, a):
                gone[i].update(range(a, e))
    return gone


def dedup(docs, passage=51):
    """{doc_id: text left} by sentence runs and passages together."""
    sentences, words = spans_gone(docs, with_parts=True), passages(docs, passage)
    out = {}
    for i, text in docs:
        gone, parts = sentences[0][i], sentences[1][i]
        keep = [k not in gone for k, (s, g) in enumerate(parts) for _ in s + g]
        if text and len(gone) < len(parts):
            begins = [m.start() for m in re.finditer(r"\S+", text)] + [len(text)]
            for k in words[i]:
                keep[begins[k] : begins[k + 1]] = [False] * (begins[k + 1] - begins[k])
        out[i] = "".join(c for c, k in zip(text or "", keep) if k)
    return out
