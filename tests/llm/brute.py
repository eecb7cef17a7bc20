"""The operators said again, row by row in plain Python, for comparison on small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def any_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def decontaminated(documents, items, window=10):
    """documents: texts; items: (id, text). Per text: n_words, n_hit, n_items, digest, hit."""
    spans = defaultdict(set)
    for item, text in items:
        words = plain_words(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            spans[tuple(words[k : k + size])].add(str(item))
    sizes = {len(s) for s in spans}
    out = []
    for text in documents:
        words, hit, found = plain_words(text), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                ids = spans.get(tuple(words[k : k + size]))
                if ids:
                    hit |= set(range(k, k + size))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((len(words), len(hit), len(found), digest, bool(hit)))
    return out


def rule_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = any_words(text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if any_words(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


def shingles(text, size=5):
    words = plain_words(text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)])


def near_duplicates(texts, top=4, bottom=5):
    """Per text: the texts (by place) it is linked to, and the least place of its class."""
    sets = [shingles(t) for t in texts]
    links = [set() for _ in texts]
    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and common * (top + bottom) >= top * (len(sets[a]) + len(sets[b])):
                links[a].add(b)
                links[b].add(a)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, others in enumerate(links):
        for b in others:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return links, [find(x) for x in range(len(texts))]


def token_crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def language_model(texts, training, head_share, gram_share, discount):
    """Per text: n_tokens, n_known, base score, score; `training`: which texts are learnt from."""
    end = "\0end"
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [end] for t in texts]
    count = Counter()
    for own, learnt in zip(tokens, training):
        if learnt:
            count.update(own)
    total, distinct = sum(count.values()), len(count)
    head = {w for w, n in count.items() if n >= max(2, math.ceil(head_share * total))}
    least = max(2, math.ceil(gram_share * total))
    two, three = Counter(), Counter()
    for own, learnt in zip(tokens, training):
        if learnt:
            row = ["\0begin", *own]
            held = [w == "\0begin" or w in head for w in row]
            for k in range(1, len(row)):
                if held[k - 1] and held[k]:
                    two[row[k - 1], row[k]] += 1
                    if k > 1 and held[k - 2]:
                        three[row[k - 2], row[k - 1], row[k]] += 1
    two = {k: n for k, n in two.items() if n >= least}
    three = {k: n for k, n in three.items() if n >= least}
    one = dict(count) | {"\0begin": sum(training)}
    left_one, left_two = Counter(), Counter()
    for (a, _), n in two.items():
        left_one[a] += (n - discount) / one[a]
    for (a, b, _), n in three.items():
        left_two[a, b] += (n - discount) / two[a, b]
    out = []
    for own in tokens:
        row, base, score = ["\0begin", *own], 0.0, 0.0
        for k in range(1, len(row)):
            p = (count[row[k]] + 1) / (total + distinct + 1)
            base += math.log10(p)
            n = two.get((row[k - 1], row[k]))
            p = ((n - discount) / one[row[k - 1]] if n else 0) + (1 - left_one[row[k - 1]]) * p
            if k > 1:
                n = three.get((row[k - 2], row[k - 1], row[k]))
                p = ((n - discount) / two[row[k - 2], row[k - 1]] if n else 0) + (1 - left_two[row[k - 2], row[k - 1]]) * p
            score += math.log10(p)
        out.append((len(own), sum(count[w] > 0 for w in own), base, score))
    return total, out
