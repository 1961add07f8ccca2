"""Personal data: fixed patterns, then a skip-chain conditional random field.

Base kinds, leftmost and without overlap within a kind: ``email``, ``ip`` (parts at most 255), ``card`` (16 to 19
digits that pass the Luhn test), ``phone`` (``+`` and 8 to 15 digits). Base spans are always reported.

Method: a document's tokens (runs without white space) with a digit, an ``@`` or a spelled-out one such as ``[at]``,
and the neighbours of the latter, are labelled as one of the kinds or none. What speaks for a label is a token's shape,
the words before it in four languages, and the base spans it lies in. Tokens next to each other share a potential, and
so do repeated or similar ones however far apart (equal digits, or equal letters and digits): each is linked to the
first of its like, so evidence at any of them reaches all by two links. Sum-product messages are passed over this loopy
graph until they stay the same, for ``ROUNDS`` rounds at most, and tokens whose best label has a marginal of at least
``LEAST_MARGINAL`` give spans: joined with neighbours of the same label, trimmed of punctuation, without those that
overlap a base span or have too few or too many digits for a value of the kind. No pattern has a say in what the field
finds. Other tokens have no label, which is part of the model, so chains end there.

The weights are fitted when first used, by pseudo-likelihood on ``TRAINING_TEXTS`` generated texts with known
spans, a fixed bound; the corpus isn't needed for it.

Positions are code points, end exclusive. Edge cases: null text counts as empty and has no spans; whole texts are
searched; repeated rows and a null id pass through; other columns pass through unchanged unless named like an
output.
"""

from __future__ import annotations

import bisect
import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import LONG_TEXTS, releasing, ship_package, table, written

KINDS = ("email", "ip", "card", "phone")
TRAINING_TEXTS, ROUNDS, LEAST_MARGINAL = 4000, 60, 0.8

LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"{LOCAL}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
HINT = re.compile("[0-9@]")
#: Each pattern, and where it can start but inside a run: the start of a run decides for its later characters.
PATTERNS = [(re.compile(EMAIL), re.compile(f"(?<!{LOCAL}){EMAIL}")), (re.compile(IP), re.compile(f"(?<![0-9]){IP}")), (re.compile(CARD), None), (re.compile(PHONE), None)]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def holds(kind: int, found: str) -> bool:
    if kind == 1:
        return all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in found.split(".")))
    if kind >= 2:
        digits = "".join(c for c in found if "0" <= c <= "9")
        return 16 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 8 <= len(digits) <= 15
    return True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind, then start."""
    out: list[tuple[int, int, int]] = []
    wanted = ("@" in text, True, True, "+" in text)
    if not HINT.search(text):
        return out
    for kind, (plain, bounded) in enumerate(PATTERNS):
        at = 0
        while wanted[kind] and at < len(text):
            m = (plain.match(text, at) or bounded.search(text, at)) if bounded else plain.search(text, at)
            if not m:
                break
            if holds(kind, m[0]):
                out.append((kind, m.start(), m.end()))
            at = m.end()
    return out


TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
GLUED = re.compile(r"[A-Za-z0-9][\[({]at[\])}][A-Za-z0-9]")
CUES = (
    "mail email e-mail contact write kontakt schreiben courriel contacter écrire correo escribir", "ip host server address ping adresse rechner serveur servidor dirección",
    "card visa credit debit payment pan karte kreditkarte zahlung carte crédit paiement tarjeta crédito pago", "phone tel call mobile fax number ring telefon anrufen handy nummer mobil téléphone appeler appelez portable numéro teléfono llame llamar móvil número",
)
#: An @ or a dot spelled out.
SPELLED = re.compile(r"^[\[({<](?:at|AT|arroba|dot|DOT|punkt|point|punto)[\])}>]$")
CUE_OF = {w: k for k, words in enumerate(CUES) for w in words.split()}
STRIP = ".,;:!?\"'()[]{}<>"
SHAPES = (
    r"@", r"@[^@]+\.[A-Za-z]", r"^\+", r"^\(?\d{2,4}\)?$", r"^\d+$", r"^\d{13,19}$", r"^\d{4}$", r"^\d{4}([ -]\d{4}){3}", r"^(\d{4}\.){3}\d{4}$", r"^\d{1,3}(\.\d{1,3}){3}(:\d+)?$", r"^\d{1,3}(\.\d{1,3}){3}/\d+$",
    r"^\(?\d{3}\)?[-. ]?\d{3}[-. ]\d{4}$", r"^\d{2}$", r"^0\d+$", r"^\d{3}$", r"^\d{6,12}$", r"^\d{2}([.-]\d{2}){3,4}$", r"^\d{3,5}[/-]\d{5,9}$", r"^0\d{1,4}[.-]\d", r"[A-Za-z]\(at\)[A-Za-z]|[A-Za-z]\[at\][A-Za-z]", r"^\d{3}[-.]\d{4}$", r"^\d{4}-\d{2}-\d{2}", r"^\d{1,2}[/.]\d{1,2}[/.]\d{2,4}$", r"^[$€£]", r"%$", r"[A-Za-z]", r"^v?\d+\.\d+(\.\d+)?$", r"^\d{1,3}(,\d{3})+", r"-", r"\(", r"\.", r":",
)
SHAPE_OF = [re.compile(s) for s in SHAPES]
CUED = 4  # tokens before one that are looked at
N_FEATURES = 1 + len(SHAPES) + 8 + CUED * len(CUES) + 4 + len(KINDS) + 1
N_LABELS = len(KINDS) + 1


class Graph:
    """A text's labelled tokens: spans, features, links to the token before (chain) and to the same or a similar one (skip)."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        all_tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        spelled = {k for k, (a, b) in enumerate(all_tokens) if text[a] in "[({<" and SPELLED.match(text[a:b])} if any(c in text for c in "[({<") else set()
        near = {k + d for k in spelled for d in (-1, 0, 1) if 0 <= k + d < len(all_tokens)}
        self.at = [k for k, (a, b) in enumerate(all_tokens) if k in near or HINT.search(text, a, b) or "at" in text[a:b] and GLUED.search(text, a, b)]
        marked = sorted((s, e, kind) for kind, s, e in base)
        starts = [s for s, _, _ in marked]
        self.spans = [all_tokens[k] for k in self.at]
        n = len(self.at)
        x = np.zeros((n, N_FEATURES), np.float32)
        chain, skip, first = [], [], {}
        for i, k in enumerate(self.at):
            a, b = all_tokens[k]
            core = text[a:b].strip(STRIP.replace("(", "").replace(")", ""))
            digits = sum("0" <= c <= "9" for c in core)
            row = x[i]
            row[0] = 1
            for s, shape in enumerate(SHAPE_OF):
                row[1 + s] = shape.search(core) is not None
            at = 1 + len(SHAPES)
            row[at + min(7, digits // 3)] = 1
            for side in range(CUED):
                if k - side > 0:
                    word = text[slice(*all_tokens[k - side - 1])].strip(STRIP + "=").lower()
                    if word in CUE_OF:
                        row[at + 8 + side * len(CUES) + CUE_OF[word]] = 1
            at += 8 + CUED * len(CUES)
            row[at : at + 4] = k in spelled, k + 1 in spelled, k - 1 in spelled, k - 1 in spelled and "." in core
            for j in range(max(0, bisect.bisect_left(starts, b) - 6), bisect.bisect_left(starts, b)):
                if marked[j][1] > a:
                    row[at + 4 + marked[j][2]] = 1
            row[-1] = digits == len(core) and digits >= 13 and luhn(core)
            if i and self.at[i - 1] == k - 1:
                chain.append((i - 1, i))
            plain = "".join(c for c in core if "0" <= c <= "9")
            key = plain if len(plain) >= 7 and "@" not in core else core.lower()
            if key in first:
                skip.append((first[key], i))
            else:
                first[key] = i
        self.x, self.chain, self.skip = x, np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2)

    def links(self, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From, to and log-potential of each directed link."""
        source = np.concatenate([self.chain[:, 0], self.chain[:, 1], self.skip[:, 0], self.skip[:, 1]])
        target = np.concatenate([self.chain[:, 1], self.chain[:, 0], self.skip[:, 1], self.skip[:, 0]])
        forward, same = np.broadcast_to(weights.chain, (len(self.chain), N_LABELS, N_LABELS)), np.broadcast_to(weights.skip, (len(self.skip), N_LABELS, N_LABELS))
        return source, target, np.concatenate([forward, forward.transpose(0, 2, 1), same, same.transpose(0, 2, 1)])


class Weights:
    """Unary, chain and skip weights; chain[a, b] is for a label a before b."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, (skip + skip.T) / 2


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def marginals(graph: Graph, weights: Weights, rounds: int = ROUNDS) -> np.ndarray:
    """Label chances of each token by sum-product messages, damped by half, until they stay the same or for so many rounds."""
    unary = graph.x @ weights.unary
    source, target, potential = graph.links(weights)
    m = len(source)
    if not m:
        return softmax(unary)
    half_chain, half_skip = len(graph.chain), len(graph.skip)
    back = np.concatenate([np.arange(half_chain) + half_chain, np.arange(half_chain), 2 * half_chain + half_skip + np.arange(half_skip), 2 * half_chain + np.arange(half_skip)])
    message = np.zeros((m, N_LABELS))
    for _ in range(rounds):
        belief = unary.astype(float).copy()
        np.add.at(belief, target, message)
        out = (belief[source] - message[back])[:, :, None] + potential
        top = out.max(1)
        new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        still = np.abs(new - message).max() < 1e-3
        message = (message + new) / 2
        if still:
            break
    belief = unary.astype(float).copy()
    np.add.at(belief, target, message)
    return softmax(belief)


def training_text(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated text with (kind, start, end) of its personal data."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("aeioubcdfghlmnprstvwz") for _ in range(rng.randint(2, 9)))
    parts: list[tuple[str, int]] = []
    said: list[tuple[str, int]] = []

    def card() -> str:
        n = rng.choice((16, 16, 16, 15, 18, 19))
        body = d(n - 1)
        digits = next(body + str(k) for k in range(10) if luhn(body + str(k)))
        return rng.choice((digits, digits, *(sign.join(digits[k : k + 4] for k in range(0, n, 4)) for sign in ". ")))

    def phone() -> str:
        a, b, c = d(3), d(3), d(4)
        pairs = [d(2) for _ in range(4)]
        return rng.choice((
            f"+1 ({a}) {b}-{c}", f"+{d(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{d(11)}", f"0{d(1)} {' '.join(pairs)}", f"0{d(1)}.{'.'.join(pairs)}", f"0{d(1)}{''.join(pairs)}",
            f"0{d(2)} {d(7)}", f"0{d(3)}/{d(6)}", f"{b}-{c}", f"{d(4)}-{c}", f"+{d(2)} {d(2)} {d(4)}-{c}", f"{a} {b} {d(3)}", f"{a} {d(2)} {d(2)} {d(2)}", f"00{d(2)} {d(3)} {d(7)}",
        ))

    def entity() -> tuple[str, int]:
        kind = rng.randrange(4)
        octets = [str(rng.randint(0, 255)) for _ in range(4)]
        sign, dot = rng.choice((("[at]", "[dot]"), ("(at)", "(dot)"), ("{at}", "{dot}")))
        return (
            lambda: rng.choice((f"{word()}.{d(2)}@{word()}.example.com", f"{word()}@{word()}.org", f"{word()}{d(3)}@{word()}", f"mailto:{word()}@{word()}.net", f"{word()} {sign} {word()}.org", f"{word()}{sign}{word()}.com", f"{word()} {sign} {word()} {dot} com")),
            lambda: ".".join(octets) + rng.choice(("", "", ":" + d(4), "/24")),
            card,
            phone,
        )[kind](), kind

    def other() -> str:
        return rng.choice((
            f"{rng.randint(1900, 2030)}", f"{rng.randint(1, 99)}", f"{d(4)}-{d(2)}-{d(2)}", f"{rng.randint(1, 31)}/{rng.randint(1, 12)}/{d(4)}", f"${d(3)}.{d(2)}", f"{d(2)}%", f"v{d(1)}.{d(1)}.{d(2)}", f"{d(1)},{d(3)},{d(3)}",
            f"{word()}{d(3)}", d(rng.randint(5, 12)), d(16), f"{d(3)}.{d(2)}", f"@{word()}", f"{d(2)}:{d(2)}", f"{word()}-{d(4)}", f"{d(8)}-{d(4)}-{d(4)}", f"{d(3)}-{d(10)}", f"({d(4)})", f"{word()}={d(8)}", f"{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(1)}", "".join(rng.choice("0123456789abcdef") for _ in range(32)), f"{d(3)}:{d(4)}", f"{d(2)} {d(2)}", f"{d(3)} {d(3)}", f"{rng.randint(1, 31)} {word()} {d(4)}", f"[{d(2)}]", f"({word()})", f"{d(1)}-{d(2)}", f"{d(3)}-{d(4)}", f"{d(4)}-{d(4)}", f"{d(4)}-{d(5)}", f"{d(4)}-{d(3)}", f"{d(2)} {d(2)} {d(2)}", f"{d(4)} {d(4)}", "[at]", "(at)", f"{word()} {d(3)} {d(2)}", d(10), f"0{d(5)}", f"{d(3)} {d(3)} {d(3)}",
        ))

    for _ in range(rng.randint(1, 8)):
        parts += [(word(), -1) for _ in range(rng.randint(0, 4))]
        roll = rng.random()
        if roll < 0.4:
            e = entity()
            said.append(e)
            # a value that other numbers look like is told by a word before it
            if rng.random() < (0.3 if e[1] != 3 or e[0][0] in "+(" or len(e[0]) > 13 else 0.9):
                parts.append((rng.choice(CUES[e[1]].split()) + rng.choice(("", ":")), -1))
                parts += [(word(), -1) for _ in range(rng.choice((0, 0, 0, 1, 2, 3)))]
            parts.append(e)
        elif roll < 0.6 and said:
            value, kind = rng.choice(said)
            tail = value.split()[-1]
            parts += [(tail if kind == 3 and sum("0" <= c <= "9" for c in tail) >= 7 else value, kind)] * rng.choice((1, 1, 1, 2, 6))
        else:
            parts.append((other(), -1))
    text, spans = "", []
    for s, kind in parts:
        text += " " if text else ""
        if kind >= 0:
            spans.append((kind, len(text), len(text) + len(s)))
        text += s + rng.choice(("", "", "", ",", "."))
    return text, spans


@functools.lru_cache(maxsize=1)
def trained(texts: int = TRAINING_TEXTS, seed: int = 11, steps: int = 300) -> Weights:
    """Pseudo-likelihood: each label given its neighbours' labels, by gradient steps."""
    rng = random.Random(seed)
    xs, ys, sums = [], [], [[], [], []]  # features, labels, counts of neighbours' labels before, after and by skip links
    for _ in range(texts):
        text, spans = training_text(rng)
        graph = Graph(text, base_spans(text))
        n = len(graph.at)
        y = np.zeros(n, np.int64)
        for i, (a, b) in enumerate(graph.spans):
            y[i] = next((k + 1 for k, s, e in spans if a < e and s < b), 0)
        one = np.eye(N_LABELS)[y]
        near = [np.zeros((n, N_LABELS)) for _ in range(3)]
        np.add.at(near[0], graph.chain[:, 1], one[graph.chain[:, 0]])
        np.add.at(near[1], graph.chain[:, 0], one[graph.chain[:, 1]])
        np.add.at(near[2], graph.skip[:, 1], one[graph.skip[:, 0]])
        np.add.at(near[2], graph.skip[:, 0], one[graph.skip[:, 1]])
        xs.append(graph.x)
        ys.append(one)
        for s, v in zip(sums, near):
            s.append(v)
    x, y = np.concatenate(xs), np.concatenate(ys)
    before, after, skip = (np.concatenate(s) for s in sums)
    w, c, s = np.zeros((N_FEATURES, N_LABELS)), np.zeros((N_LABELS, N_LABELS)), np.zeros((N_LABELS, N_LABELS))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, c, s)]
    for t in range(1, steps + 1):
        error = (y - softmax(x @ w + before @ c + after @ c.T + skip @ s)) / len(y)
        slopes = [x.T @ error - 1e-5 * w, before.T @ error + error.T @ after - 1e-5 * c, skip.T @ error - 1e-5 * s]
        slopes[2] = (slopes[2] + slopes[2].T) / 2
        for p, g, m in zip((w, c, s), slopes, state):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            p += 0.1 * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-9)
    return Weights(w, c, s)


#: Digits that a value of each kind has, at least and at most.
DIGITS = ((0, 99), (4, 17), (13, 19), (6, 15))


def model_spans(text: str, base: list[tuple[int, int, int]], weights: Weights) -> list[tuple[int, int, int]]:
    graph = Graph(text, base)
    chance = marginals(graph, weights)
    best = chance.argmax(1)
    best[chance.max(1) < LEAST_MARGINAL] = 0
    taken = np.array([(s, e) for _, s, e in base], np.int64).reshape(-1, 2)
    taken = taken[taken[:, 0].argsort()]
    reach = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
    out, i, n = [], 0, len(best)
    while i < n:
        j = i + 1
        while j < n and best[j] == best[i] and graph.at[j] == graph.at[j - 1] + 1:
            j += 1
        if best[i]:
            a, b = graph.spans[i][0], graph.spans[j - 1][1]
            while a < b and text[a] in STRIP.replace("(", ""):
                a += 1
            while a < b and text[b - 1] in STRIP:
                b -= 1
            under = np.searchsorted(taken[:, 0], b) if len(taken) else 0
            least, most = DIGITS[best[i] - 1]
            if a < b and not (under and reach[under - 1] > a) and least <= sum("0" <= c <= "9" for c in text[a:b]) <= most:
                out.append((int(best[i]) - 1, a, b))
        i = j
    return out


def find(text: str, weights: Weights) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and the method's."""
    base = base_spans(text)
    return base, model_spans(text, base, weights) if HINT.search(text) or any(x in text for x in ("at]", "at)", "at}")) else []


def spans_of(df: DataFrame, text: Column) -> Column:
    """array<struct<kind, start, end, base>> by kind, then start."""
    shared = ship_package(df.sparkSession).sparkContext.broadcast(trained())

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                base, more = find(t or "", shared.value)
                rows = sorted([(*s, True) for s in base] + [(*s, False) for s in more])
                out.append([{"kind": KINDS[k], "start": a, "end": b, "base": z} for k, a, b, z in rows])
            yield pd.Series(out, dtype=object)

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,base:boolean>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from releasing(found)(batches)

    return run(text)


def mark(documents: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    return documents.withColumn(out, spans_of(documents, F.col(text)))


def span_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans are stored first: while they are, tasks get texts in batches of few bytes, so a worker's memory doesn't grow with the table or its texts."""
    found = written(mark(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii"), "pii", more=LONG_TEXTS)
    base = F.filter("pii", lambda s: s["base"])
    n = lambda kind: F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, KINDS), F.sha2(span_string(base).cast("binary"), 256).alias("base_sha256"), span_string(F.col("pii")).alias("spans"))
