"""Plain-Python versions of the operators, for small inputs."""

import collections
import hashlib
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORDS.findall(text or "")


def substring_dedup(texts, window):
    """[(n_words, n_removed, sha256 of the kept words)]"""
    split = [words(t) for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def contamination(texts, items, window=10):
    """[(n_words, n_hit, n_items, items_sha256, contaminated)] for items [(id, text)]."""
    fold = lambda t: FOLDED.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = fold(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for text in texts:
        w, hit, ids = fold(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    ids |= found
        out.append((len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return out


def exact_groups(rows):
    """{row number: (keep_id, group_size, kept)} for rows [(id, text)]."""
    groups = collections.defaultdict(list)
    for n, (key, text) in enumerate(rows):
        groups["".join(words(text))].append((-len(text or ""), key is None, key or 0, n))
    out = {}
    for members in groups.values():
        best = min(members)
        for member in members:
            out[member[3]] = (rows[best[3]][0], len(members), member[3] == best[3])
    return out


def distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, line[0] = line[0], i
        for j, y in enumerate(b, 1):
            last, line[j] = line[j], min(last + (x != y), line[j] + 1, line[j - 1] + 1)
    return line[-1]


def near_classes(texts, similarity):
    """Class number per text: connected components of edit similarity, over all pairs of different texts."""
    split = [words(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    first = {}
    for i, t in enumerate(texts):
        parent[root(i)] = root(first.setdefault(t or "", i))
    unique = sorted(first.values())
    for n, i in enumerate(unique):
        for j in unique[:n]:
            a, b = split[i], split[j]
            longer = max(len(a), len(b))
            if a and b and root(i) != root(j) and longer - (sum((collections.Counter(a) & collections.Counter(b)).values())) <= (1 - similarity) * longer + 1e-9:
                if 1 - distance(a, b) / longer >= similarity - 1e-12:
                    parent[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def templates(rows, leading, min_docs, constant):
    """[kept text] for rows [(id, text)]."""
    parse = lambda line: ["<*>" if re.search("[0-9]", w) else w for w in words(line)]
    leaves, lines = collections.defaultdict(set), collections.defaultdict(set)
    for key, text in rows:
        for line in (text or "").split("\n"):
            if t := parse(line):
                leaves[(len(t), *t[:leading])].add(key)
                lines[((len(t), *t[:leading]), line)].add(key)
    lines = {k: v for k, v in lines.items() if len(leaves[k[0]]) >= min_docs}
    support = collections.Counter()
    for (leaf, line), keys in lines.items():
        for place, token in enumerate(parse(line)):
            support[leaf, place, token] += len(keys) if token != "<*>" else 0
    formed, docs = {}, collections.defaultdict(set)
    for (leaf, line), keys in lines.items():
        t = [x if support[leaf, i, x] >= min_docs else "<*>" for i, x in enumerate(parse(line))]
        if sum(x != "<*>" for x in t) >= constant * len(t):
            formed[leaf, line] = tuple(t)
            docs[leaf, tuple(t)] |= keys
    gone = {line for (leaf, line), t in formed.items() if len(docs[leaf, t]) >= min_docs}
    return [None if text is None else "\n".join(x for x in text.split("\n") if x not in gone) for _, text in rows]
