"""Plain versions of what the operators compute, for small inputs."""

import hashlib
import random
import re


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", lower(text))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def links(rows, percent=75):
    """{doc_id: (number of other sets, number of other documents that link)} of (doc_id, text) rows with distinct ids."""
    sets = {d: frozenset(shingle_set(t)) for d, t in rows}
    out = {}
    for d, a in sets.items():
        linked = [b for e, b in sets.items() if e != d and a and b and 100 * len(a & b) >= percent * len(a | b)]
        out[d] = len(set(linked) - {a}), len(linked)
    return out


def components(rows, percent=75):
    """{doc_id: smallest id reachable} of (doc_id, text) rows with distinct ids."""
    sets = {d: shingle_set(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def cut_lines(rows, least=50):
    """{doc_id: text} without lines of any run of `least` words or more that also stands earlier; distinct ids."""
    docs = {}
    for d, t in sorted(rows):
        lines = [re.findall("[^\x20\x09-\x0d]+", x) for x in t.split("\n")]
        docs[d] = [(k, tuple(x)) for k, x in enumerate(lines) if x]
    first, gone = set(), {d: set() for d in docs}
    for d, lines in docs.items():
        for i in range(len(lines)):
            n = 0
            for j in range(i, len(lines)):
                n += len(lines[j][1])
                if n < least:
                    continue
                key = tuple(x for _, x in lines[i : j + 1])
                if key in first:
                    gone[d] |= set(range(lines[i][0], lines[j][0] + 1))
                first.add(key)
    return {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in rows}


def sha(text):
    return hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", text or "").encode()).hexdigest()


def random_documents(seed, n=120, words=40):
    """Texts with copies, near copies, shared passages, odd blanks, empties."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "ß", "naïve", "字", "Ab", "aB"]
    line = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passages = ["\n".join(line(r.randint(3, 30)) for _ in range(r.randint(1, 6))) for _ in range(4)]
    out = []
    for i in range(n):
        pick = r.random()
        if pick < 0.15 and out:
            text = r.choice(out)[1]
        elif pick < 0.35 and out:
            w = (r.choice(out)[1] or "").split(" ")
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            text = " ".join(w)
        elif pick < 0.55:
            text = "\n".join([line(r.randint(0, 20)), r.choice(passages), line(r.randint(0, 60)), r.choice(passages)])
        elif pick < 0.6:
            text = r.choice(["", " \t\n", "\x0b", "one", "one two three", "One TWO three", "\n\n"])
        else:
            text = r.choice([" ", "\t", "\n", " "]).join(r.choice(vocabulary) for _ in range(r.randint(1, 2 * words)))
        out.append((i * 3, text))
    return out
