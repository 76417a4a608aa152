"""What the operators must return, worked out plainly in Python."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def encoded(tokenizer_path, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path)
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


def rule_counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(covered)}


def fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints, radius):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array(prints, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= radius).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(ids))]


def secret_spans(text):
    text = text or ""
    found = []
    rules = [
        ("assign", re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
    ]
    for rank, (kind, pattern, group, least) in enumerate(rules):
        found += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found)


def secret_row(text):
    spans = secret_spans(text)
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
    n = Counter(s[2] for s in spans)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(joined.encode()).hexdigest(), joined


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves):
    """(root, for each leaf its siblings before and after in each run up to the root)."""
    level, place, steps = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, i in enumerate(place):
            low = i // 8 * 8
            steps[k].append((level[low:i], level[i + 1 : low + 8]))
        level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
        place = [i // 8 for i in place]
    return level[0], steps


LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def license_places(text):
    words = LICENSE_WORD.findall((text or "").translate(LOWER))
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    found = [(i, label) for phrase, label in phrases.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def damaged(rows):
    """(conv_id, turn, role, text) in the order in which they are taken, by conversation; those without rows too."""
    show = lambda x: " " if x is None else str(x)
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        k = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        kept += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def repaired(turns):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) by trying all edits from the end."""
    faults, seen = [], set()
    for _, role, text in turns:
        inner = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else "")
        seen.add((role, text))
    expected = {"": "u", "s": "u", "u": "a", "a": "u"}
    grown = {"": (0, ""), "s": (4, "II"), "u": (2, "I"), "a": (0, "")}
    for (_, role, _), fault in zip(turns[::-1], faults[::-1], strict=True):
        late, options = int(fault == "truncated"), {}
        for state, want in expected.items():
            some = [(grown[state][0] + 3, "D" + grown[state][1])]
            if fault not in ("blank", "duplicate"):
                if role[:1] == want or role[:1] == "s" and state == "":
                    some.append((grown[role[:1]][0] + late, "K" + grown[role[:1]][1]))
                some.append((grown[want][0] + 2 + late, "R" + grown[want][1]))
            options[state] = some
        for _ in range(3):
            for state, want in expected.items():
                cost, audit = min(options[want])
                options[state].append((cost + 2, "I" + audit))
        grown = {state: min(some) for state, some in options.items()}
    cost, audit = grown[""]
    left, state, at = [], "", 0
    for letter in audit:
        if letter in "IR":
            left.append(({"u": "user", "a": "assistant"}[expected[state]], turns[at][2] if letter == "R" else ""))
            state = expected[state]
        elif letter == "K":
            left.append(turns[at][1:])
            state = turns[at][1][0]
        at += letter != "I"
    known = [t for t, *_ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
    n = Counter(faults)
    return gaps, n["blank"], n["duplicate"], n["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, h("\n".join(f"{r}:{t}" for r, t in left))
