"""Plain versions of the operators, slow and simple, for small fixtures."""

import hashlib
from collections import defaultdict
from itertools import combinations

import regex
import xxhash


def components(nodes, links):
    """Smallest node reachable of each node."""
    to = {n: n for n in nodes}

    def root(n):
        while to[n] != n:
            n = to[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        to[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# ------------------------------------------------------------ exact dedup


def exact(docs):
    """docs: (id, text). {id: (keep_id, group_size, kept, sha256)}"""
    low = {i: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for i, t in docs}
    groups = defaultdict(list)
    for i, t in low.items():
        groups[t].append(i)
    return {i: (max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in low.items()}


# ---------------------------------------------------------------- simhash


def simhash(text, width=4):
    words = [w for w in regex.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < width else [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(docs, radius=4):
    """{id: (fingerprint, component)}"""
    fp = {i: simhash(t) for i, t in docs}
    part = components(fp, [(a, b) for a, b in combinations(sorted(fp), 2) if (fp[a] ^ fp[b]).bit_count() <= radius])
    return {i: (f"{fp[i]:016x}", part[i]) for i in fp}


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def near_copies(docs, least=0.8):
    """{id: component} by the Jaccard similarity of 5-word shingles."""
    sets = {i: shingles(t) for i, t in docs}
    alike = lambda a, b: len(a & b) >= least * len(a | b)
    return components(sets, [(a, b) for a, b in combinations(sets, 2) if alike(sets[a], sets[b])])


# ------------------------------------------------------------------ lines


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def cleaned_lines(docs):
    """docs: (id, text) in order of id. {id: (text, removed)}: a line goes if it or one within one edit came before."""
    seen, variants, out = set(), defaultdict(set), {}
    for i, text in docs:
        stay, gone = [], 0
        for line in text.split("\n") if text is not None else []:
            bare = line.strip(" \t\r\f\v")
            if not bare:
                stay.append(line)
                continue
            # lines within one edit have a form in common when one character or none is left out
            forms = {bare, *(bare[:k] + bare[k + 1 :] for k in range(len(bare)))}
            known = bare in seen or any(within_one(bare, o) for f in forms for o in variants[f])
            if bare not in seen:
                seen.add(bare)
                for f in forms:
                    variants[f].add(bare)
            if known:
                gone += 1
            else:
                stay.append(line)
        out[i] = ("\n".join(stay) if gone else text, gone)
    return out


# ------------------------------------------------------------------ spans


def without_spans(docs, least=36, long=24):
    """{id: (text, pieces removed)}: sentences, long ones cut further before words of a hash that is a multiple of four."""
    cut = regex.compile(r"(?<=[.!?])\s+|\n\s*|\s+(?=\p{Lu})")
    parts, runs = {}, []
    for n, (i, text) in enumerate(docs):
        text = text or ""
        ends = [m.end() for m in cut.finditer(text)]
        ends += [len(text)] if not ends or ends[-1] < len(text) else []
        pieces = []  # (text, words, whether a sentence ends here)
        for a, b in zip([0, *ends], ends, strict=False):
            at = [m.start() for m in regex.finditer(r"\S+", text[a:b])]
            words = text[a:b].split()
            marks = [k for k in range(1, len(words)) if xxhash.xxh64_intdigest(words[k].lower()) % 4 == 0] if len(words) > long else []
            for k, stop in zip([0, *marks], [*marks, len(words)], strict=True):
                begin, end = (at[k] if k else 0), (at[stop] if stop < len(words) else b - a)
                pieces.append([text[a:b][begin:end], [w.lower() for w in words[k:stop]], stop == len(words)])
        parts[i] = []
        for p in pieces:  # white space belongs to what is before it, or to the first words
            if parts[i] and (not p[1] or not parts[i][-1][1]):
                parts[i][-1] = [parts[i][-1][0] + p[0], parts[i][-1][1] + p[1], p[2] or parts[i][-1][2]]
            else:
                parts[i].append(p)
        words = [p[1] for p in parts[i]]
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                size = sum(map(len, words[a:b]))
                if size >= least:
                    ahead = sum(map(len, words[a : b - 1])) < least
                    behind = parts[i][b - 1][2] and sum(map(len, words[a + 1 : b])) < least
                    if ahead or behind:
                        runs.append((" ".join(w for p in words[a:b] for w in p), n, i, a, b))
    first = {}
    for key, n, _, a, _ in sorted(runs, key=lambda r: r[1:4]):
        first.setdefault(key, (n, a))
    gone = defaultdict(set)
    for key, n, i, a, b in runs:
        if first[key] != (n, a):
            gone[i].update(range(a, b))
    return {i: ("".join(p[0] for k, p in enumerate(parts[i]) if k not in gone[i]) if gone[i] else text, len(gone[i])) for i, text in docs}


# ------------------------------------------------------------------ leaks

UNITS = set("km m cm mm kg g mg lb lbs l ml mile miles meter meters metre metres feet foot inch inches hour hours minute minutes second seconds day days week weeks month months year years dollar dollars euro euros pound pounds cent cents usd eur percent degree degrees".split())


def template(text):
    """[(template token, raw token in lower case)]"""
    out, text = [], text or ""
    for m in regex.finditer(r"[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{M}]+", text):
        raw, before = m.group(), text[: m.start()]
        gap = regex.search(r"( *)$", before).group(1)
        left = before[: len(before) - len(gap)]
        number_left = bool(out) and out[-1][0] == "0" and regex.search(r"[0-9]$", left)
        if raw[0].isdigit():
            token = "0"
        elif number_left and len(gap) <= 1 and raw.lower() in UNITS:
            token = "1"
        elif regex.match(r"\p{Lu}", raw) and ((number_left and len(gap) <= 2) or (1 <= len(gap) <= 3 and regex.search(r"[\p{L}\p{M}0-9,;:]$", left))):
            token = "2"
        else:
            token = raw.lower()
        out.append((token, raw.lower()))
    return out


def leaks(docs, items, width=8, fewest=5, least=0.3):
    """{(doc_id, item_id): (coverage, reparameterised)}"""
    found, read = {}, [(doc, template(text)) for doc, text in docs]
    for item, item_text in items:
        q = template(item_text)
        if len(q) < fewest:
            continue
        w = min(width, len(q))
        slots = {"0", "1", "2"}
        own = {p: tuple(t for t, _ in q[p : p + w]) for p in range(len(q) - w + 1)}
        own = {p: x for p, x in own.items() if 2 * sum(t in slots for t in x) <= w}
        at = defaultdict(list)
        for p, x in own.items():
            at[x].append(p)
        has_slots = any(t in slots for t, _ in q)
        for doc, d in read:
            shifts = defaultdict(set)
            for p, x in enumerate(zip(*([t for t, _ in d[k:]] for k in range(w)), strict=False)):
                for o in at.get(x, ()):
                    shifts[p - o].add(o)
            covered, changed = set(), []
            for shift, places in shifts.items():
                under = {k for p in places for k in range(p, p + w) if q[k][0] in slots}
                pairs = {(q[k][0], q[k][1], d[k + shift][1]) for k in under}
                if has_slots and len(pairs) != len({x[:2] for x in pairs}):
                    continue
                covered |= places
                changed.append(any(a != b for _, a, b in pairs))
            if covered and len(covered) / len(own) >= least:
                found[doc, item] = (len(covered) / len(own), min(changed))
    return found
