"""Plain versions of the operators over lists of rows."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    size = min(size, len(words))
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if words else frozenset()


def near(rows, size):
    """(doc_id, text) -> doc_id: component, by all pairs."""
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def repeats(rows, window):
    """(doc_id, text) -> kept words of each row."""
    least = {}
    for i, t in rows:
        words = WORD.findall(t or "")
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if i is not None:
                least[key] = min(i, least.get(key, i))
    out = []
    for i, t in rows:
        words = WORD.findall(t or "")
        gone = {
            k + j
            for k in range(len(words) - window + 1)
            for j in range(window)
            if i is not None and least[tuple(words[k : k + window])] < i
        }
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def lines(rows, min_chars=20, min_documents=3):
    """(doc_id, text) -> (doc_id, lines, dropped, kept)."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                docs[key(line)].add(i)
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(docs.get(key(x), ())) < min_documents or i == max(docs[key(x)])]
        out.append((i, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return out


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(text, items, window=13):
    """text, [(id, text)] -> words, hit words, ids."""
    words, hit, found = words_of(text), set(), set()
    for name, item in items:
        own = words_of(item)
        width = min(window, len(own))
        if not own:
            continue
        for k in range(len(own) - width + 1):
            for at in range(len(words) - width + 1):
                if words[at : at + width] == own[k : k + width]:
                    hit |= set(range(at, at + width))
                    found.add(str(name))
    return len(words), len(hit), sorted(found)


def longest_match(text, items, window=13):
    """(length, place, item, place in the item) of the longest match that holds a window, of equals the first; None without."""
    words, best = words_of(text), []
    for item, item_text in items:
        theirs = words_of(item_text)
        least = min(window, len(theirs))
        for i in range(len(words)):
            for j in range(len(theirs)):
                n = 0
                while i + n < len(words) and j + n < len(theirs) and words[i + n] == theirs[j + n]:
                    n += 1
                if theirs and n >= least:
                    best.append((-n, i, item is None, str(item), j))
    if not best:
        return None
    n, i, nameless, item, j = min(best)
    return -n, i, None if nameless else item, j
