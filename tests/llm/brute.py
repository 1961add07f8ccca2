"""Plain-Python versions of what SQL can't express, one document or pair at a time."""

from __future__ import annotations

import base64
import functools
import hashlib
import math
import re
import struct
from collections import defaultdict

import public_tokenizers
import tiktoken

SPACE = r"[\x20\x09-\x0D]+"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# --- n-gram Jaccard join


def shingles(text: str | None, size: int = 5) -> set[tuple[str, ...]]:
    words = WORDS.findall(lower(text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def near_components(docs: list[tuple]) -> list[tuple]:
    """(id, text) -> sorted (id, n_shingles, component_id); each pair is compared."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    low: dict = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            low[top(k)] = min(i, low.get(top(k), i))
    return sorted(((i, len(sets[k]), low.get(top(k))) for k, (i, _) in enumerate(docs)), key=str)


# --- benchmark decontamination

UNITS = set("mm cm m km kg g mg t l ml s h min ms inch inches foot feet mile miles yard yards pound pounds ounce ounces gram grams kilogram kilograms meter meters metre metres kilometer kilometers kilometre kilometres liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees watt watts volt volts".split())
TOKEN = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def forms(text: str | None) -> list[list[tuple[str, str | None]]]:
    """The literal form and the template: (token, value of the slot or None)."""
    raw = TOKEN.findall(text or "")
    literal = [(lower(w), None) for w in raw]
    template: list[tuple[str, str | None]] = []
    number = lambda w: "0" <= w[0] <= "9"
    unit = lambda w: lower(w) in UNITS and not number(w)
    name = lambda w: ("A" <= w[0] <= "Z" or "À" <= w[0] <= "Þ") and not unit(w)
    for k, w in enumerate(raw):
        after_number = k >= 1 and number(raw[k - 1])
        if (number(w) or unit(w)) and after_number:
            continue
        kind = "#" if number(w) else "U" if unit(w) else "N" if name(w) else None
        template.append((f"<{kind}>", kind + w) if kind else (lower(w), None))
    return [literal, template]


def windows(form: int, tokens: list, size: int, least_literal: int) -> dict[int, tuple]:
    out = {}
    for i in range(len(tokens) - size + 1):
        part = tokens[i : i + size]
        literals = sum(v is None for _, v in part)
        if form == 0 or min(least_literal, size - 1) <= literals < size:
            out[i] = tuple(t for t, _ in part)
    return out


def contaminated(docs: list[tuple], items: list[tuple], size: int = 8, least_literal: int = 4, least_words: int = 5, coverage: float = 0.5, words_covered: float = 0.7, run: int = 13) -> set[tuple]:
    found = set()
    theirs = [(i, [(f, t) for f, t in enumerate(forms(text))]) for i, text in items]
    index = defaultdict(list)
    wholes = {}
    for k, (_, fs) in enumerate(theirs):
        for f, tokens in fs:
            s = size if len(tokens) >= size else len(tokens)
            own = windows(f, tokens, s, least_literal) if s >= least_words else {}
            wholes[k, f] = len(own)
            for at, w in own.items():
                index[f, s, w].append((k, at))
    sizes = sorted({s for _, s, _ in index})
    for d, text in docs:
        both = forms(text)
        aligned = defaultdict(dict)
        for f, tokens in enumerate(both):
            for s in sizes:
                for pos, w in windows(f, tokens, s, least_literal).items():
                    for k, at in index.get((f, s, w), ()):
                        item = theirs[k][1][f][1]
                        pairs = [(item[at + j][1], tokens[pos + j][1]) for j in range(s) if item[at + j][1] is not None]
                        aligned[k, f, pos - at][at] = pairs
        ats, straight = defaultdict(set), set()
        for (k, f, _), hits in aligned.items():
            pairs = {p for ps in hits.values() for p in ps}
            if not any(p[0] == q[0] and p[1] != q[1] or p[0] != q[0] and p[1] == q[1] and p[0][0] == "N" for p in pairs for q in pairs):
                ats[k, f] |= set(hits)
                if f == 0 and any(all(x + j in hits for j in range(run - size + 1)) for x in hits):
                    straight.add((k, f))
        for (k, f), v in ats.items():
            n = len(theirs[k][1][f][1])
            covered = len({x + j for x in v for j in range(size) if x + j < n})
            if len(v) >= coverage * wholes[k, f] or covered >= words_covered * n or (k, f) in straight:
                found.add((d, theirs[k][0]))
    return found


# --- secret scan

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
LETTERS = (8.17, 1.49, 2.78, 4.25, 12.70, 2.23, 2.02, 6.09, 6.97, 0.15, 0.77, 4.03, 2.41, 6.75, 7.51, 1.93, 0.10, 5.99, 6.33, 9.06, 2.76, 0.98, 2.36, 0.15, 1.97, 0.07)


def base_secrets(text: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def battery(codes: list[int], a: int) -> float:
    n, free = len(codes), a - 1
    chi = max(a / n * sum(codes.count(c) ** 2 for c in set(codes)) - n, 0)
    z = ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    uniform = 0.5 if z <= 0 else tail(z)
    up = [c >= a / 2 for c in codes]
    high = sum(up)
    low = n - high
    runs = 1 + sum(x != y for x, y in zip(up, up[1:]))
    expected = 2 * high * low / n + 1
    by_runs = 2 * tail(abs(runs - expected) / math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9))) if high and low else 0
    m = [c - sum(codes) / n for c in codes]
    serial = sum(x * y for x, y in zip(m, m[1:])) / max(sum(x * x for x in m), 1e-9) * math.sqrt(n)
    return min(1, 3 * min(uniform, by_runs, 2 * tail(abs(serial))))


def mixes(run: str) -> bool:
    digits, small = any(c.isdigit() for c in run), any(c.islower() for c in run)
    return digits and any(c.isalpha() for c in run) or small and any(c.isupper() for c in run[1:])


def secrets(text: str | None, least: int = 10, alpha: float = 0.001, q: float = 0.001) -> list[tuple[int, int, int]]:
    """Sorted (start, rank of the kind, end)."""
    text = text or ""
    base = base_secrets(text)
    inside = {k for a, _, e in base for k in range(a, e)}
    bare = "".join("\ue001" if k in inside else c for k, c in enumerate(text))
    runs = [m for m in re.finditer(r"[A-Za-z0-9+/_=-]+", bare) if len(m[0].rstrip("=")) >= least and (len(m[0]) >= 16 or mixes(m[0]))]
    tested = []
    for m in runs:
        body = m[0].rstrip("=")
        size = 16 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", body) else 32 if re.fullmatch("[A-Z2-7]+", body) else 64
        if size == 16:
            codes = [int(c, 16) for c in body]
        elif size == 32:
            codes = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ234567".index(c) for c in body]
        else:
            codes = [62 if c in "+-" else 63 if c in "/_=" else "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789".index(c) for c in body]
        kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in body]
        natural = 0.0
        for k, c in enumerate(body):
            natural += math.log((0.1, LETTERS[(ord(c) | 32) - 97] / 100 if c.isalpha() else 0, LETTERS[(ord(c) | 32) - 97] / 100 if c.isalpha() else 0, 0.2)[kinds[k]])
            natural += math.log(0.25 if not k else 0.9 if kinds[k] == kinds[k - 1] else 0.1 / 3)
        ratio = -len(body) * math.log(size) - natural
        average = sum(len(r[0]) for r in runs) / len(runs)
        if battery(codes, size) >= alpha:
            tested.append((math.exp(-max(ratio, 0)) * average / len(m[0]), m))
    ps = sorted(p for p, _ in tested)
    cut = max((p for k, p in enumerate(ps) if p <= q * (k + 1) / len(runs)), default=-1)
    return sorted(base + [(m.start(), 3, m.end()) for p, m in tested if p <= cut])


def secret_row(text: str | None) -> tuple:
    """What op6 says of a text."""
    spans = secrets(text)
    shown = lambda ranks: ",".join(f"{('assign', 'access', 'hex', 'random')[r]}:{s}:{e}" for s, r, e in spans if r in ranks)
    return (*(sum(r == k for _, r, _ in spans) for k in range(3)), hashlib.sha256(shown((0, 1, 2)).encode()).hexdigest(), shown((0, 1, 2, 3)))


def covered(text: str | None) -> str | None:
    if not text:
        return text
    out, at = "", 0
    for s, _, e in secrets(text):
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


# --- byte-level BPE


@functools.lru_cache
def encoding() -> tiktoken.Encoding:
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokens(text: str | None) -> tuple[list[int], str, str]:
    """ids, their digest and that of the text's bytes."""
    ids = encoding().encode_ordinary(text or "")
    return ids, hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
