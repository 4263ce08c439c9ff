"""Plain Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash


def components(nodes, links):
    """Smallest node that each reaches."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b), near[b].add(a)
    out = {}
    for n in sorted(nodes):
        if n in out:
            continue
        out[n], todo = n, [n]
        while todo:
            for m in near[todo.pop()]:
                if m not in out:
                    out[m] = n
                    todo.append(m)
    return out


def token_rows(rows, path, end):
    """doc_id -> (start, n_tokens, crc) of (doc_id, text) rows with different ids."""
    from tokenizers import Tokenizer

    library, at, out = Tokenizer.from_file(path), 0, {}
    for key, text in sorted(rows):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end]
        out[key] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def simhash(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def simhash_rows(rows, radius=3):
    """doc_id -> (fingerprint, component)."""
    prints = {k: simhash(t) for k, t in rows}
    keys = list(prints)
    values = np.array([prints[k] for k in keys], np.uint64)
    links = [(keys[i], keys[j]) for i in range(len(keys)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius).tolist()]
    part = components(keys, links)
    return {k: (f"{prints[k]:016x}", part[k]) for k in keys}


def vector_rows(rows, threshold=0.98):
    """vec_id -> (n_links, component) of (vec_id, vector, label) rows."""

    def usable(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    own = [(k, np.array(v, float), lab) for k, v, lab in rows if lab is not None and usable(v)]
    links, count = [], defaultdict(int)
    by = defaultdict(list)
    for k, v, lab in own:
        by[lab, len(v)].append((k, v))
    for members in by.values():
        m = np.stack([v for _, v in members])
        norm = np.sqrt((m * m).sum(axis=1))
        c = (m @ m.T) / norm[:, None] / norm
        for i, j in zip(*np.nonzero(c >= threshold)):
            if i != j:
                links.append((members[i][0], members[j][0]))
                count[members[i][0]] += 1
    part = components([k for k, _, _ in rows], links)
    return {k: (count[k], part[k]) for k, _, _ in rows}


def removed_rows(rows, length=50):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256 of the rest)."""
    first = {}
    texts = {k: (t or "").encode() for k, t in rows}
    for k in sorted(texts):
        for i in range(len(texts[k]) - length + 1):
            first.setdefault(texts[k][i : i + length], k)
    out = {}
    for k, data in texts.items():
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < k:
                gone[i : i + length] = True
        spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(data) else 0
        rest = bytes(b for b, g in zip(data, gone) if not g)
        out[k] = (len(data), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())
    return out


def revisit_rows(rows, least=1000):
    """page_id -> (bytes, sha1, type, refers_to) of (page_id, html) rows with different ids."""
    top = {}
    for k, page in rows:
        top[page or ""] = max(k, top.get(page or "", k))
    out = {}
    for k, page in rows:
        data = (page or "").encode()
        again = len(data) >= least and top[page or ""] != k
        out[k] = (len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top[page or ""] if again else None)
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets of sources in order: the excess over ``most`` times a size is shared again by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    total = share * sum(sizes)
    got = [total * x / sum(w) for x in w]
    full = set()
    for _ in range(10_000):
        excess = 0.0
        for i, s in enumerate(sizes):
            if i not in full and got[i] > most * s:
                excess += got[i] - most * s
                got[i] = float(most * s)
                full.add(i)
        rest = [i for i in range(len(sizes)) if i not in full]
        if excess == 0 or not rest:
            break
        for i in rest:
            got[i] += excess * w[i] / sum(w[j] for j in rest)
    return got


def gear_cuts(data, gear, memory, reach):
    """Ends of the chunks of one text, position by position (no longest chunk)."""
    h = []
    for i in range(len(data)):
        h.append(sum(int(gear[data[i - j]]) << j for j in range(min(memory, i + 1))) & (1 << 64) - 1)
    cuts = [i + 1 for i in range(memory + reach, len(data) - reach) if all(h[i] > h[i + d] for d in range(-reach, reach + 1) if d)]
    return [*cuts, len(data)] if data else []


def phrases(sample, text):
    """Greedy longest matches of a text in a sample; a character that the sample lacks is a phrase."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at += size
        n += 1
    return n
