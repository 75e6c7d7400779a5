"""Personal data by a semi-Markov conditional random field.

Exact base patterns (e-mail, IP, card, phone) are always reported. Around marks of personal data (digits, `@`, "at") a
text has islands of tokens; on each a semi-Markov CRF scores whole candidate segments of up to MAX_TOKENS tokens by
features of the span (digits, separators, shape, checksum, cue words before it) and of the types of neighbours, and a
dynamic program over ends, lengths and types chooses boundaries and types jointly. Its spans are added where they
don't overlap base spans.

The weights are trained here, by gradient ascent on the exact conditional likelihood of generated examples (a fixed
seed, N_EXAMPLES of them): written-out and badly formed personal data, and look-alikes that are none. No row of the
input is used. Everything else covers all of each text.

Nulls and empty texts have no spans. Islands are cut at MAX_ISLAND tokens with an overlap of MAX_TOKENS, and of two
spans found twice one is kept, so that long texts take time linear in their length. Repeated rows give equal rows;
other columns are not looked at.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
MAX_TOKENS = 12
MAX_ISLAND = 60
MARGIN = 4
N_EXAMPLES = 400
SEED = 7
EPOCHS = 6

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain, found from each `@` so that long runs cost nothing."""
    out = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SET:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns by kind as listed, then start."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if any(c in text for c in "0123456789"):
        for m in _IP.finditer(text):
            if all(int(x[-4:]) <= 255 and (len(x) <= 4 or not x[:-4].strip("0")) for x in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


# ---- the field

_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_MARK = re.compile(r"[0-9]+|@|[(\[]\s?at\s?[)\]]|(?<![^\s(\[])at [A-Za-z0-9-]+(?:\.[A-Za-z]{2}| dot [A-Za-z]{2})", re.I)
_CUES = {"email": {"mail", "email", "contact", "write"}, "ip": {"ip", "address", "host", "server"}, "card": {"card", "visa", "credit", "mastercard", "pay"},
         "phone": {"phone", "tel", "call", "mobile", "fax", "cell", "telephone"}}
_N_FEATURES = 23


def span_features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> np.ndarray:
    """Features of tokens i:j as one candidate segment."""
    start, end = tokens[i][0], tokens[j - 1][1]
    s = text[start:end]
    digits = [c for c in s if "0" <= c <= "9"]
    n = len(digits)
    groups = re.findall(r"[0-9]+", s)
    letters = sum(c.isalpha() for c in s)
    before = {text[a:b].lower() for a, b in tokens[max(0, i - 3):i]}
    f = np.zeros(_N_FEATURES)
    f[0] = 1.0
    f[1] = "@" in s or bool(re.search(r"(?:^|[\s(\[])at(?:$|[\s)\]])", s, re.I))
    f[2] = s.count(".") / 3 if s.count(".") <= 3 else -1
    f[3] = bool(re.search(r"\bdot\b", s, re.I))
    f[4] = len(groups) == 4 and letters == 0
    f[5] = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    f[6] = 16 <= n <= 19
    f[7] = 16 <= n <= 19 and luhn("".join(digits))
    f[8] = 8 <= n <= 15
    f[9] = n < 7
    f[10] = n > 19
    f[11] = letters > 0
    f[12] = letters > 0 and n > 0
    f[13] = s[0].isalnum() or s[0] in "+("
    f[14] = s[-1].isalnum()
    f[15] = s[0] in "+("
    f[16] = bool(re.search(r"[A-Za-z](?:\.|\s*\(?\[?\s*dot\s*\]?\)?\s*)[A-Za-z]{2,}$", s, re.I))
    f[17] = sum(c.isspace() for c in s) > 3 or "\n" in s
    f[18] = any(c in s for c in ",;:!?%$#=/\"|")
    f[19] = len(groups) >= 2 and len(groups) <= 6 and letters == 0 and all(2 <= len(g) <= 5 for g in groups)
    f[20] = bool(before & (_CUES["phone"] | _CUES["card"] | _CUES["ip"] | _CUES["email"]))
    f[21] = (j - i) / MAX_TOKENS
    f[22] = bool(re.match(r"[@.]|(?:at|dot)\b", s, re.I))
    return f


def cue_features(text: str, tokens: list[tuple[int, int]], i: int) -> np.ndarray:
    before = {text[a:b].lower() for a, b in tokens[max(0, i - 3):i]}
    return np.array([bool(before & _CUES[k]) for k in KINDS], dtype=float)


#: Weights: for each kind a row over span features and one cue weight; transitions from none or a kind to none or a kind.
K = len(KINDS)


def _candidate(s: str) -> bool:
    """Segments that can be personal data at all: an `@` or a spelt-out one, or seven digits, or four groups of digits."""
    return "@" in s or sum(c.isdigit() for c in s) >= 7 or len(re.findall(r"[0-9]+", s)) >= 4 or bool(re.search(r"(?:^|[\s(\[])at(?:$|[\s)\]])", s, re.I))


def lattice(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, np.ndarray]]:
    """Candidate segments (first token, end token, features and cues)."""
    out = []
    for i in range(len(tokens)):
        cues = None
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            start, end = tokens[i][0], tokens[j - 1][1]
            if start and text[start].isalnum() and text[start - 1].isalnum():
                break  # inside a word
            s = text[start:end]
            if "\n" in s:
                break
            if s[-1].isalnum() and text[end:end + 1].isalnum() or not _candidate(s):
                continue
            if cues is None:
                cues = cue_features(text, tokens, i)
            out.append((i, j, np.concatenate([span_features(text, tokens, i, j), cues])))
    return out


def segment_scores(weights: dict, segments: list) -> np.ndarray:
    """Score of each segment as each kind."""
    if not segments:
        return np.zeros((0, K))
    x = np.array([f for _, _, f in segments])
    return x[:, :_N_FEATURES] @ weights["span"].T + x[:, _N_FEATURES:] * weights["cue"]


def best_path(n: int, segments: list, scores: np.ndarray, transition: np.ndarray) -> list[tuple[int, int, int]]:
    """Best segmentation of n tokens into single tokens of no kind (score 0) and segments: (first, end, kind)."""
    best = np.full((n + 1, K + 1), -np.inf)
    best[0, 0] = 0.0
    back: dict[tuple[int, int], tuple[int, int]] = {}
    ending: dict[int, list[int]] = {}
    for c, (_, j, _) in enumerate(segments):
        ending.setdefault(j, []).append(c)
    for j in range(1, n + 1):
        options = best[j - 1] + transition[:, 0]
        p = int(options.argmax())
        best[j, 0] = options[p]
        back[j, 0] = (j - 1, p)
        for c in ending.get(j, ()):
            i = segments[c][0]
            for k in range(K):
                options = best[i] + transition[:, k + 1]
                p = int(options.argmax())
                if (value := options[p] + scores[c, k]) > best[j, k + 1]:
                    best[j, k + 1] = value
                    back[j, k + 1] = (i, p)
    out, j, k = [], n, int(best[n].argmax())
    while j:
        i, p = back[j, k]
        if k:
            out.append((i, j, k - 1))
        j, k = i, p
    return out[::-1]


def _forward_backward(n: int, segments: list, scores: np.ndarray, transition: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log partition sum, expected use of (segment, kind), expected use of transitions."""
    starting: dict[int, list[int]] = {}
    ending: dict[int, list[int]] = {}
    for c, (i, j, _) in enumerate(segments):
        starting.setdefault(i, []).append(c)
        ending.setdefault(j, []).append(c)
    lse = np.logaddexp.reduce
    alpha, beta = np.full((n + 1, K + 1), -np.inf), np.full((n + 1, K + 1), -np.inf)
    alpha[0, 0], beta[n] = 0.0, 0.0
    for j in range(1, n + 1):
        alpha[j, 0] = lse(alpha[j - 1] + transition[:, 0])
        for c in ending.get(j, ()):
            value = lse(alpha[segments[c][0]][:, None] + transition[:, 1:], axis=0) + scores[c]
            alpha[j, 1:] = np.logaddexp(alpha[j, 1:], value)
    z = lse(alpha[n])
    for i in range(n - 1, -1, -1):
        beta[i] = transition[:, 0] + beta[i + 1, 0]
        for c in starting.get(i, ()):
            beta[i] = np.logaddexp(beta[i], lse(transition[:, 1:] + scores[c] + beta[segments[c][1], 1:], axis=1))
    used, moves = np.zeros((len(segments), K)), np.zeros((K + 1, K + 1))
    for j in range(1, n + 1):
        moves[:, 0] += np.exp(alpha[j - 1] + transition[:, 0] + beta[j, 0] - z)
    for c, (i, j, _) in enumerate(segments):
        both = np.exp(alpha[i][:, None] + transition[:, 1:] + scores[c] + beta[j, 1:] - z)
        used[c] = both.sum(axis=0)
        moves[:, 1:] += both
    return float(z), used, moves


def examples(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Generated texts with their spans."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ta", "en", "ri", "o", "mes", "la", "th", "is", "de", "un"]) for _ in range(rng.randint(1, 3)))
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = number(15)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def bad_card() -> str:
        d = card()
        d = d[:-1] + next(c for c in "0918273645" if not luhn(d[:-1] + c))
        sep = rng.choice([" ", "-", "", ""])
        return sep.join(d[i:i + 4] for i in range(0, 16, 4))

    def entity() -> tuple[str, str]:
        kind = rng.choice(KINDS)
        if kind == "email":
            host = f"{word()}.{rng.choice(['com', 'net', 'org', 'de'])}"
            spelt = rng.choice(["{0}@{1}", "{0} @ {1}", "{0} at {1}", "{0} (at) {1}", "{0}[at]{1}", "{0} at {2}"])
            return kind, spelt.format(word() + rng.choice(["", "." + word(), number(2)]), host, host.replace(".", " dot "))
        if kind == "ip":
            parts = [str(rng.randint(1, 255)) for _ in range(4)]
            return kind, rng.choice([".", ".", " . ", "[.]"]).join(parts)
        if kind == "card":
            d = card()
            sep = rng.choice([" ", "-", ".", "", "/"])
            return kind, sep.join(d[i:i + 4] for i in range(0, 16, 4))
        a, b, c = number(3), number(3), number(4)
        return kind, rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{number(2)} {a} {b}{c}", f"00{number(2)} {a} {b} {c}", f"{a}.{b}.{c}"])

    def noise() -> str:
        return rng.choice([
            lambda: f"{rng.randint(1900, 2030)}", lambda: f"{rng.randint(1, 12)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", lambda: f"{number(2)}:{number(2)}:{number(2)}",
            lambda: f"{rng.randint(1900, 2030)}-{number(2)}-{number(2)} {number(2)}:{number(2)}", lambda: f"${number(3)},{number(3)}.{number(2)}", lambda: f"{number(6)}",
            lambda: f"{word()} at {word()}", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(32)), lambda: f"@{word()}", lambda: f"{number(3)} {word()} {number(4)}",
            lambda: number(24), bad_card, bad_card, lambda: f"{number(1)} {number(1)} {number(1)} {number(2)}", lambda: f"{number(7)}/{number(2)}", lambda: f"at {number(4)} {word()}",
            lambda: " | ".join(number(rng.randint(1, 4)) for _ in range(5)), lambda: ", ".join(number(2) for _ in range(6)), lambda: f"{word()} at {word()}. {word().title()}",
        ])()

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(1, 4))) + " "
            if rng.random() < 0.55:
                kind, value = entity()
                if rng.random() < 0.5:
                    text += rng.choice(sorted(_CUES[kind])) + rng.choice([" ", ": "])
                spans.append((len(text), len(text) + len(value), kind))
                text += value + rng.choice([" ", ". ", ", "])
            else:
                text += noise() + rng.choice([" ", ". ", ", "])
        out.append((text, spans))
    return out


@functools.lru_cache(maxsize=4)
def train(n: int = N_EXAMPLES, seed: int = SEED, epochs: int = EPOCHS) -> dict:
    """Weights by batch gradient ascent (Adam) on the conditional log-likelihood with a small quadratic penalty."""
    data = []
    for text, spans in examples(n, seed):
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        segments = lattice(text, tokens) if _candidate(text) else []
        gold = {(s, e): KINDS.index(k) for s, e, k in spans}
        chosen = {c: gold[tokens[i][0], tokens[j - 1][1]] for c, (i, j, _) in enumerate(segments) if (tokens[i][0], tokens[j - 1][1]) in gold}
        if segments:
            data.append((len(tokens), segments, chosen))
    weights = {"span": np.zeros((K, _N_FEATURES)), "cue": np.zeros(K), "transition": np.zeros((K + 1, K + 1))}
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    rng = random.Random(seed)
    step = 0
    for _ in range(epochs):
        rng.shuffle(data)
        for at in range(0, len(data), 50):
            grad = {k: -0.002 * v for k, v in weights.items()}
            for size, segments, chosen in data[at:at + 50]:
                scores = segment_scores(weights, segments)
                _, used, moves = _forward_backward(size, segments, scores, weights["transition"])
                goal = np.zeros_like(used)
                for c, k in chosen.items():
                    goal[c, k] = 1.0
                true_moves = np.zeros_like(moves)
                last, place = 0, 0
                for c in sorted(chosen, key=lambda c: segments[c][0]):
                    i, j, _ = segments[c]
                    for _ in range(i - place):
                        true_moves[last, 0] += 1
                        last = 0
                    true_moves[last, chosen[c] + 1] += 1
                    last, place = chosen[c] + 1, j
                for _ in range(size - place):
                    true_moves[last, 0] += 1
                    last = 0
                x = np.array([f for _, _, f in segments])
                grad["span"] += (goal - used).T @ x[:, :_N_FEATURES] / 50
                grad["cue"] += ((goal - used) * x[:, _N_FEATURES:]).sum(axis=0) / 50
                grad["transition"] += (true_moves - moves) / 50
            step += 1
            for k in weights:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.99 * second[k] + 0.01 * grad[k] ** 2
                weights[k] += 0.25 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return weights


def field_spans(text: str, weights: dict) -> list[tuple[str, int, int]]:
    """Spans that the field chooses, in text order."""
    marks = [m.span() for m in _MARK.finditer(text)]
    out: list[tuple[str, int, int]] = []
    k = 0
    while k < len(marks):
        first, end = marks[k]
        while k + 1 < len(marks) and marks[k + 1][0] - end <= 24:
            k += 1
            end = marks[k][1]
        k += 1
        lo, hi = max(0, first - 64), min(len(text), end + 64)
        tokens = [m.span() for m in _TOKEN.finditer(text, lo, hi)]
        inner = [i for i, (a, b) in enumerate(tokens) if b > first and a < end]
        tokens = tokens[max(0, inner[0] - MARGIN):inner[-1] + 1 + MARGIN]
        at = 0
        while at < len(tokens):
            part = tokens[at:at + MAX_ISLAND]
            segments = lattice(text, part) if _candidate(text[part[0][0]:part[-1][1]]) else []
            if segments:
                path = best_path(len(part), segments, segment_scores(weights, segments), weights["transition"])
                out += [(KINDS[kind], part[i][0], part[j - 1][1]) for i, j, kind in path]
            if at + MAX_ISLAND >= len(tokens):
                break
            at += MAX_ISLAND - MAX_TOKENS
    found, free = [], 0
    for kind, s, e in sorted(set(out), key=lambda x: (x[1], -x[2], x[0])):
        if s >= free:
            found.append((kind, s, e))
            free = e
    return found


def all_spans(text: str | None, weights: dict) -> tuple[list, list]:
    """Base spans, and all spans: base ones and the field's where they overlap none. By kind as listed, then start."""
    if not text:
        return [], []
    base = base_spans(text)
    if not _MARK.search(text):
        return base, base
    taken = sorted((s, e) for _, s, e in base)
    more, k = [], 0
    for kind, s, e in field_spans(text, weights):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if not any(a < e and s < b for a, b in taken[max(0, k - 4):k + 4]):
            more.append((kind, s, e))
    return base, sorted([*base, *more], key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


SPANS = "array<struct<kind:string,start:long,end:long>>"
RESULT = f"doc_id long, base {SPANS}, spans {SPANS}"


def find_spans(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """doc_id with base spans and all spans (code points, end exclusive)."""
    weights = train() if weights is None else weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        put = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
        for batch in batches:
            both = [all_spans(t if isinstance(t, str) else None, weights) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "base": [put(b) for b, _ in both], "spans": [put(a) for _, a in both]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, RESULT)


def redact(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """All rows and columns of docs; in the text each span is replaced by its kind in brackets.

    Where spans overlap, their union is replaced by the kind that starts first. A null text stays null.
    """
    weights = train() if weights is None else weights

    @F.pandas_udf("string")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text):
            if not isinstance(text, str):
                return None
            _, spans = all_spans(text, weights)
            if not spans:
                return text
            out, at = [], 0
            for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
                if s >= at:
                    out += [text[at:s], f"[{kind}]"]
                at = max(at, e)
            return "".join([*out, text[at:]])

        for series in texts:
            yield series.map(one)

    return docs.withColumn("text", clean(F.col("text")))
