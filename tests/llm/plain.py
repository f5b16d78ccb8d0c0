"""What the operators should give, in plain Python over small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import public_tokenizers
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    found = words((text or "").translate(LOWER))
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[i:i + 5]) for i in range(len(found) - 4)}


def groups(nodes, links):
    """The smallest node of each node's group."""
    of = {n: n for n in nodes}

    def top(n):
        while of[n] != n:
            n = of[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        of[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def jaccard_components(texts: dict):
    sets = {d: shingles(t) for d, t in texts.items()}
    ids = sorted(d for d in sets if sets[d])
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
             if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {d: len(s) for d, s in sets.items()}, groups(texts, links)


def rule_counts(text):
    found, seen, repeated = words(text), set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    windows = [tuple(found[i:i + 3]) for i in range(len(found) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    n = len(found)
    return (n, sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def without_repeated_lines(texts: dict) -> dict:
    """Texts and numbers of removed lines."""
    first, found = {}, {}
    for d in sorted(texts):
        lines = (texts[d] or "").split("\n")
        solid = [(i, line.strip(" \t\x0b\x0c\r")) for i, line in enumerate(lines) if words(line)]
        removed = set()
        for k in range(max(len(solid) - 2, 1) if solid else 0):
            window = tuple(line for _, line in solid[k:k + 3])
            if first.setdefault(window, (d, k)) != (d, k):
                removed |= {i for i, _ in solid[k:k + 3]}
        found[d] = ("\n".join(x for i, x in enumerate(lines) if i not in removed), len(solid), len(removed))
    return found


def mix(rows):
    """rows: (doc_id, text, source). (doc_id, size, source_size, target, taken) of each."""
    sizes = [len(words(t)) for _, t, _ in rows]
    names = sorted({s for *_, s in rows if s is not None}, key=lambda s: s.encode()) + [None] * any(s is None for *_, s in rows)
    total = {s: sum(n for n, r in zip(sizes, rows) if r[2] == s) for s in names}
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, left, free = {}, Fraction(sum(sizes)), set(names)
    while free:
        unit = left / sum(weight[s] for s in free)
        above = {s for s in free if unit * weight[s] > 3 * total[s]}
        for s in above or free:
            target[s] = Fraction(3 * total[s]) if above else unit * weight[s]
        left -= sum(target[s] for s in above)
        free = free - above if above else set()
    def draw(i):
        d, text, _ = rows[i]
        inner = hashlib.md5((text or "").encode()).hexdigest()
        return hashlib.md5(f":{'' if d is None else d}:{inner}".encode()).hexdigest(), sizes[i]

    before, queue, order = defaultdict(int), [], sorted(range(len(rows)), key=draw)
    for i in order:
        s = rows[i][2]
        key = "n" if s is None else "s" + s
        queue += [((r * total[s] + before[s] + sizes[i]) / float(target[s]), key.encode(), before[s], r, i) for r in range(3) if sizes[i]]
        before[s] += sizes[i]
    parts, left = defaultdict(lambda: [0, 0, 0]), sum(sizes)
    for _, _, _, r, i in sorted(queue):
        parts[i][r] = min(sizes[i], left)
        left -= parts[i][r]
    return [(rows[i][0], sizes[i], total[rows[i][2]], float(target[rows[i][2]]), sum(parts[i]), parts[i]) for i in order]


def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check_packing(pieces, ids: list, length: int):
    """``pieces``: rows of pack(); ``ids``: for each document its id and token ids, its end among them."""
    total = sum(len(x) for _, x in ids)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    wanted = defaultdict(list)
    for d, x in ids:
        wanted[d].append(x)
    for d, lists in wanted.items():
        for x in {tuple(x): x for x in lists}.values():
            own = sorted((p for p in by_doc[d]), key=lambda p: p.start)
            if len(lists) == 1:
                assert [p.start for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
                assert sum(p.length for p in own) == len(x)
                for p in own:
                    packed = b"".join(i.to_bytes(4, "little") for i in x[p.start:p.start + p.length])
                    assert p.ids_crc32 == zlib.crc32(packed)
                    assert p.doc_tokens == len(x)
        assert sum(p.length for p in by_doc[d]) == sum(map(len, lists))
    assert sum(p.length for p in pieces) == total
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        n = sum(p.length for p in own)
        assert n <= length and n & (n - 1) == 0
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def license_marks(text, phrases, templates, threshold):
    """Words, places and labels of a text, every block compared with every template."""
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, base, best, labels = [], set(), 0.0, set()
    for phrase, label in phrases:
        p = phrase.split()
        at = [i for i in range(len(found) - len(p) + 1) if found[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    for notice, label in templates:
        words, size = set(notice.split()), len(notice.split())
        least = max(1, -(-Fraction(str(threshold)) * len(words) // 1))
        for first in range(0, len(found), size):
            common = len(words & set(found[first:first + 2 * size]))
            if common >= least:
                best, labels = max(best, common / len(words)), labels | {label}
    return (len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | labels)), 1.0 if base else best)


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _lift(leaves):
    """Levels of a tree, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([_sha("".join(row[i:i + 8])) for i in range(0, len(row), 8)])
    return levels


def _way(levels, at, node):
    """Siblings up to the root, and the root that follows from ``node``."""
    proof = ""
    for row in levels[:-1]:
        run, mine = row[at - at % 8:at - at % 8 + 8], at % 8
        left, right = "".join(run[:mine]), "".join(run[mine + 1:])
        proof, node, at = proof + left + right, _sha(left + node + right), at // 8
    return proof, node


def merkle_rows(rows):
    """``rows`` of (doc_id, source, lang, n_chars, text) to the rows of the manifest query."""
    def leaf(fields):
        return _sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))

    trees = defaultdict(list)
    for r in rows:
        d, text = r[0], r[4]
        tampered = d is not None and zlib.crc32(str(d).encode()) % 3 == 0 and text is not None
        trees[r[2]].append((d is not None, d or 0, leaf(r), leaf((*r[:4], text.translate(LOWER))) if tampered else leaf(r), d))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {lang: _lift([t[2] for t in sorted(trees[lang], key=lambda t: t[:3])]) for lang in langs}
    top = _lift([built[lang][-1][0] for lang in langs])
    found = []
    for place, lang in enumerate(langs):
        for at, (_, _, own, seen, d) in enumerate(sorted(trees[lang], key=lambda t: t[:3])):
            low, node = _way(built[lang], at, seen)
            high, node = _way(top, place, node)
            root = top[-1][0]
            found.append((d, own, built[lang][-1][0], root, _sha(low + high), node, node == root))
    return sorted(found, key=repr)


def gram_buckets(text):
    """Buckets of all 2- and 3-grams of a text, one by one."""
    letters = [ch if ch.isalpha() else " " for ch in f" {(text or '').lower()} "]
    if not any(ch != " " for ch in letters):
        return []
    kept = [ch for i, ch in enumerate(letters) if ch != " " or i == 0 or letters[i - 1] != " "]
    out = []
    for size in (2, 3):
        for i in range(len(kept) - size + 1):
            key = size
            for ch in kept[i:i + size]:
                key = (key + ord(ch)) * 0x9E3779B97F4A7C15 % (1 << 64)
            out.append(key >> 50)
    return out


def naive_bayes(rows):
    """``rows`` of (doc_id, text, lang) to (doc_id, held out, language, probability), by sums over n-grams."""
    from math import exp, log

    held = [d is not None and zlib.crc32(str(d).encode()) % 4 == 2 for d, _, _ in rows]
    grams = [gram_buckets(t) for _, t, _ in rows]
    counts, docs = defaultdict(Counter), Counter()
    for (d, text, lang), out, found in zip(rows, held, grams, strict=True):
        if d is not None and not out and lang is not None and text is not None:
            counts[lang].update(found)
            docs[lang] += 1
    langs, got = sorted(docs), []
    size = {k: sum(counts[k].values()) + 0.5 * (1 << 14) for k in langs}
    for (d, _, _), out, found in zip(rows, held, grams, strict=True):
        if not found or not langs:
            got.append((d, out, "und", 0.0))
            continue
        total = {k: log((docs[k] + 1) / (sum(docs.values()) + len(langs))) for k in langs}
        for k in langs:
            total[k] += sum(n * log((counts[k][b] + 0.5) / size[k]) for b, n in Counter(found).items())
        best = max(langs, key=lambda k: total[k])
        got.append((d, out, best, 1 / sum(exp(total[k] - total[best]) for k in langs)))
    return got


def quality_features(text):
    """Weights of trigrams of bytes, and shares of style, one by one; None for a text that is too short."""
    data = (text or "").encode()
    if len(data) < 3:
        return None
    mask, counts = (1 << 32) - 1, Counter()
    for i in range(len(data) - 2):
        key = (data[i] * 0x9E3779B1 + data[i + 1] * 0x85EBCA6B + data[i + 2] * 0xC2B2AE35) & mask
        counts[((key ^ (key >> 15)) * 0x2C1B3C6D & mask) >> 21] += 1
    total = sum(counts.values())
    found = [(counts[b] / total) ** 0.5 for b in range(2048)]
    tokens = text.split()
    pairs = list(zip(tokens, tokens[1:], strict=False))
    shares = [5 * sum(ch in "#*$%&|<>{}[]\\^~_=@" for ch in text) / len(text), 10 * text.count("|") / len(text),
              10 * text.count("!") / len(text), sum(t.isupper() for t in tokens) / max(len(tokens), 1),
              5 * sum(ch in "0123456789" for ch in text) / len(text),
              1 - min(1, len(set(tokens)) / max(3 * len(tokens) ** 0.6, 1)), 1 - len(set(pairs)) / len(pairs) if pairs else 0]
    return found + [min(1.0, x) for x in shares]


def neighbour_votes(rows, labels: dict, nearest: int = 25):
    """``rows`` of (doc_id, text) to (doc_id, held out, score) by all cosines in the space of the labelled rows' variance.

    For samples of fewer documents than the space has directions, where every direction of variance is kept.
    """
    import numpy as np

    held = [d is not None and zlib.crc32(str(d).encode()) % 3 == 1 for d, _ in rows]
    found = [quality_features(t) for _, t in rows]
    sample = [(f or [0.0] * 2055, labels[d]) for (d, t), out, f in zip(rows, held, found, strict=True)
              if d in labels and not out and t is not None]
    x = np.array([f for f, _ in sample])
    weights = np.clip(np.log(2 / ((x > 0).mean(0) + 1e-3)), 0.2, 4)
    weights[2048:] = 0.5 * weights[:2048].mean()
    mean = (x * weights).mean(0)
    _, spread, right = np.linalg.svd(x * weights - mean, full_matrices=False)
    right = right[spread > 1e-4 * spread[0]]

    def place(f):
        if f is None or not any(f):
            return np.zeros(len(right))
        v = right @ (np.array(f) * weights - mean)
        return v / np.linalg.norm(v)

    known = [(place(f), label) for f, label in sample]
    got = []
    for (d, _), out, f in zip(rows, held, found, strict=True):
        own = place(f)
        cosines = sorted(((float(own @ v), label) for v, label in known), reverse=True)
        least = cosines[min(nearest, len(cosines)) - 1][0] - 1e-6
        voting = [(max(c, 0) ** 4, label) for c, label in cosines if c >= least]
        total = sum(w for w, _ in voting)
        got.append((d, out, sum(w * k for w, k in voting) / total if total else sum(k for _, k in known) / len(known)))
    return got
