"""Plain answers to small inputs, one document at a time, to compare the operators with."""
from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def exact(rows):
    """rows: (id, text). Per row (id, keep_id, size of group, sha)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(AZ)].append(i)
    return [(i, max((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in ((i, (t or "").translate(AZ)) for i, t in rows)]


def statistics(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def phrases(text):
    """(n_words, n_base, first, last, labels) of the license phrases."""
    words = LICENSE_WORD.findall((text or "").translate(AZ))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def fingerprint(text):
    words = WORD.findall((text or "").translate(AZ))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs):
    """pairs: (id, fingerprint). Smallest id reachable, per row, links being two or fewer bits."""
    prints = sorted({f for _, f in pairs})
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    low = {}
    for i, f in pairs:
        if i is not None:
            low[find(f)] = min(low.get(find(f), i), i)
    return [low.get(find(f)) for _, f in pairs]


def repeats(texts, length=400):
    """Per text: (bytes, removed, spans, sha of the rest)."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def targets(sizes, weights=(5, 2, 1), most=3):
    """sizes: source -> words. Target per source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / max(sum(weight[s] for s in free), 1)
        over = [s for s in free if weight[s] * level > most * sizes[s]]
        if not over:
            return {**capped, **{s: weight[s] * level for s in free}}
        capped |= {s: most * sizes[s] for s in over}


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def collocations(rows, least=10, inside=50, top=2000):
    """rows: (lang, text). (lang, rank, phrase, a, l, r, n, score), sorted."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        f[lang], n[lang] = f[lang], n[lang]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= inside * count[q]}
        scored = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    return rest[:end].translate(AZ), path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
