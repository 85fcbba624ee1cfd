"""The operators' contracts in plain Python, over lists of (id, text)."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import accumulate

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def licenses(docs):
    out = {}
    for i, text in docs:
        words, found = ALNUM.findall((text or "").translate(LOWER)), []
        for label, phrase in PHRASES:
            own = phrase.split()
            found += [(k, label) for k in range(len(words)) if words[k : k + len(own)] == own]
        places = [k for k, _ in found]
        labels = ",".join(sorted({label for _, label in found}))
        out[i] = (len(words), len(found), min(places, default=None), max(places, default=None), labels)
    return out


def contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        if words and item is not None:
            for k in range(max(1, len(words) - 12)):
                windows[tuple(words[k : k + 13])].add(str(item))
    out = {}
    for i, text in docs:
        words = ALNUM.findall((text or "").translate(LOWER))
        hit, own = [False] * len(words), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if items := windows.get(tuple(words[k : k + n])):
                    hit[k : k + n] = [True] * n
                    own |= items
        n_hit = sum(hit)
        out[i] = (len(words), n_hit, len(own), sha(",".join(sorted(own))), n_hit > 0 and 20 * n_hit >= len(words))
    return out


def secrets(docs):
    out = {}
    for i, text in docs:
        text = text or ""
        kinds = [
            [m for m in ASSIGN.finditer(text) if len(m[1]) >= 6],
            [m for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
            [m for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24],
        ]
        spans = sorted((m.start(), k, m.end()) for k, found in enumerate(kinds) for m in found)
        shown = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        out[i] = (*map(len, kinds), sha(shown))
    return out


def similar(docs, least=85):
    """Sizes and components from links between all pairs that share a shingle."""
    sets = {}
    for i, text in docs:
        words = [w.translate(LOWER) for w in SPACED.findall(text or "")]
        grams = {tuple(words[k : k + 4]) for k in range(len(words) - 3)}
        sets[i] = grams or ({tuple(words)} if words else set())
    having, parent = defaultdict(list), {i: i for i in sets}
    for i, grams in sets.items():
        for g in grams:
            having[g].append(i)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, grams in sets.items():
        shared = Counter(j for g in grams for j in having[g] if j > i)
        for j, n in shared.items():
            if 100 * n >= least * (len(grams) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def quality(docs):
    out = {}
    for i, text in docs:
        text = text or ""
        words = SPACED.findall(text)
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        again = [False] * len(words)
        for k in range(len(words) - 7):
            if windows[tuple(words[k : k + 8])] > 1:
                again[k : k + 8] = [True] * 8
        n, r = len(words), sum(again)
        symbols = sum(c in "#*$%&|<>" for c in text)
        out[i] = (n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n)
    return out


def repeated(docs):
    first, words = {}, {}
    for i, text in sorted(docs):
        words[i] = SPACED.findall(text or "")
        for k in range(len(words[i]) - 19):
            first.setdefault(tuple(words[i][k : k + 20]), (i, k))
    out = {}
    for i, own in words.items():
        gone = [False] * len(own)
        for k in range(len(own) - 19):
            if first[tuple(own[k : k + 20])] != (i, k):
                gone[k : k + 20] = [True] * 20
        kept = " ".join(w for w, g in zip(own, gone) if not g)
        out[i] = (len(own), sum(gone), sha(kept))
    return out


def alignment(docs, folder="/opt/tokenizers"):
    """Groups by the byte ends that both tokenizers share, links and their counts, pair by pair."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(f"{folder}/byte_bpe_50k.json")
    a_model.encode_special_tokens = True
    with open(f"{folder}/byte_bpe_50k.json") as file:
        names = {i: t for t, i in json.load(file)["model"]["vocab"].items()}
    extra = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
    letters = {chr(b): b for b in range(256) if b not in extra} | {chr(256 + k): b for k, b in enumerate(extra)}
    b_model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")

    def b_bytes(i):
        return bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()

    groups = []
    for _, text in docs:
        own = []
        if text:
            a = a_model.encode(" " + text, add_special_tokens=False).ids
            b = b_model.encode(text)
            cut_a = [bytes(letters[c] for c in names[i]) for i in a]
            cut_b = [b_bytes(i) for i in b]
            if b"".join(cut_a) == b"".join(cut_b) == b" " + text.encode():
                x, at, open_b = 0, 0, []
                ends_a = {end: k for k, end in enumerate(accumulate(map(len, cut_a)))}
                for k, t in enumerate(cut_b):
                    at += len(t)
                    open_b.append(b[k])
                    if at in ends_a:
                        y = ends_a[at] + 1
                        own.append((a[x:y], open_b))
                        x, open_b = y, []
        groups.append(own)
    links = [Counter((i, j) for p, q in own for i in p for j in q) for own in groups]
    count = Counter(pair for own in links for pair in own)
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    out = {}
    for (doc, _), own, linked in zip(docs, groups, links):
        shown = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in own)
        best = sum(n for (i, j), n in linked.items() if count[i, j] == most[i])
        total = sum(n * count[pair] for pair, n in linked.items())
        n_a, n_b = sum(len(p) for p, _ in own), sum(len(q) for _, q in own)
        out[doc] = (n_a, n_b, len(own), sum(linked.values()), best, total, sha(shown) if own else "")
    return out
