"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re

import xxhash


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if len(words) >= 5:
        return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    return frozenset([tuple(words)] if words else [])


def near_duplicates(rows):
    """[(doc_id, n_shingles, component_id)] of rows (doc_id, text)."""
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    return [(doc_id, len(sets[k]), least.get(find(k))) for k, (doc_id, _) in enumerate(rows)]


def suffix_dedup(rows, length=100):
    """{(doc_id, text): (n_bytes, n_removed, n_spans, sha256)} of rows with distinct ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        removed = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if data[k : k + length] in seen:
                removed[k : k + length] = b"\1" * length
            else:
                seen.add(data[k : k + length])
        kept = bytes(c for c, r in zip(data, removed, strict=True) if not r)
        spans = sum(1 for k in range(len(data)) if removed[k] and (k == 0 or not removed[k - 1]))
        out[(doc_id, text)] = (len(data), sum(removed), spans, hashlib.sha256(kept).hexdigest())
    return out


def contamination(rows, items, size=13, share=20):
    """[(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)]."""

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))

    windows = {}
    for item, text in items:
        own = words(text)
        n = min(size, len(own))
        for k in range(len(own) - n + 1 if n and item is not None else 0):
            windows.setdefault(tuple(own[k : k + n]), set()).add(str(item))
    out = []
    for doc_id, text in rows:
        own, hit, found = words(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(own) - n + 1):
                if names := windows.get(tuple(own[k : k + n])):
                    found |= names
                    hit |= set(range(k, k + n))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(found), digest, bool(hit) and share * len(hit) >= len(own)))
    return out


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def simhash_components(rows, radius=3):
    """[(doc_id, fingerprint, component_id)] of rows (doc_id, text)."""
    marks = [simhash(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, x in enumerate(marks):
        for b in range(a):
            if (x ^ marks[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    return [(doc_id, f"{marks[k]:016x}", least.get(find(k))) for k, (doc_id, _) in enumerate(rows)]


def fill_middle(rows):
    """[(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)] of rows (doc_id, text)."""
    out = []
    for doc_id, text in rows:
        text = text or ""
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        whole = hashlib.sha256(text.encode()).hexdigest()
        if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            out.append((doc_id, len(units), "plain", None, None, whole, whole))
            continue
        spm = h4 % 100 < 20
        made = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
        out.append((doc_id, len(units), "spm" if spm else "psm", len(prefix), len(middle), hashlib.sha256(made.encode()).hexdigest(), whole))
    return out
