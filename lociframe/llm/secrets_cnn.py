"""Secrets by a convolutional network over the characters of candidates and of their surroundings.

The base patterns (assign, access, hex) are always reported. Beside them a text has candidates: values after a name
that speaks of passwords, keys or tokens, passwords inside URLs, blocks of private keys, and bare runs of 12 or more
characters that mix digits, letters or cases. The network reads each whole candidate, whatever its length, with
BEFORE characters before and AFTER behind it: characters become vectors, marked as before, inside or after; a
convolution of WIDTH characters is pooled by maximum over each of the three parts and by mean over the inside, and a
small hidden layer gives a logit. Candidates over their form's threshold that overlap neither a base span nor a
likelier candidate are added.

Training is numpy on labelled findings; by default generated ones with a fixed seed, FINDINGS of them, of which a
quarter are held out. On these the logits are calibrated (Platt's line, by Newton steps), and each form's threshold is
the largest probability up to one half that still finds RECALL of its secrets. No row of the input is used. Texts are searched whole.

A null or an empty text has no spans. Repeated rows give equal rows, an empty table none; other columns are not
looked at. Base spans of different kinds may overlap each other; added ones overlap none.
"""

from __future__ import annotations

import bisect
import functools
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ["assign", "access", "hex"]
FORMS = ["block", "login", "value", "bare"]
KINDS = BASE_KINDS + FORMS
BEFORE, AFTER, WIDTH = 28, 12, 5
CODES, DIMS, FILTERS, HIDDEN = 128, 8, 24, 24
CHANNELS = DIMS + 3
FINDINGS = 10_000
RECALL = 0.99
EPOCHS = 8
SEED = 11
FLAT = 1 << 16

# ---- base patterns

_SIGN = re.compile(r"[:=]")
_WORD_END = re.compile(r"(?:password|passwd|secret|token|api_?key)\Z", re.I | re.A)
_VALUE = re.compile(r"\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")


def names_before(text: str, sign: int) -> int:
    """Place behind the name before a `:` or `=`: spaces and then one quote are passed."""
    end = sign
    while end and text[end - 1] == " ":
        end -= 1
    return end - 1 if end and text[end - 1] in "\"'" else end


def assignments(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the assign pattern, found from each sign back to its word and on to its value."""
    out, free = [], 0
    for m in _SIGN.finditer(text):
        end = names_before(text, m.start())
        word = _WORD_END.search(text, max(free, end - 8), end) if text[max(0, end - 1):end] in tuple("DdTtNnYy") else None
        value = _VALUE.match(text, m.end()) if word else None
        if value:
            free = value.end()
            if len(value[1]) >= 8:
                out.append((word.start(), free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns by start, then kind."""
    out = [("assign", *s) for s in assignments(text)]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], BASE_KINDS.index(s[0]), s[2]))


# ---- candidates

_NAME = re.compile(r"[\w.-]*\Z")
_CUE = re.compile(r"pass|pwd|pwrd|secret|token|cred|auth|key|signature|salt|private|access", re.I | re.A)
_ASSIGNED = re.compile(r"[>=]?\s{0,2}(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\s\"'`<>,;]+))")
_SAID = re.compile(r"(?:[Bb]earer|[Bb]asic|(?:[Pp]ass(?:word|wd|phrase|code)|[Ss]ecret|[Tt]oken|[Kk]ey) (?:is|was)):?\x20+[\"'`]?([^\s\"'`<>,;]+)")
_LOGIN = re.compile(r"://[^\s:/@\"']+:([^\s/@\"']+)@")
_BLOCK = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY[A-Z ]*)-----")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_.~-])[A-Za-z0-9+/_.~-]{12,}={0,2}")
_MIXED = re.compile(r"[0-9]|[a-z][A-Z]|[A-Z]{2}[a-z]")


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the form) of every candidate, each span once, as the first of its forms."""
    found: dict[tuple[int, int], int] = {}

    def add(start: int, end: int, form: str) -> None:
        while end > start and text[end - 1] in ".,:)]}":
            end -= 1
        if end - start >= 6:
            found.setdefault((start, end), FORMS.index(form))

    if "-----BEGIN " in text:
        free = 0
        for m in _BLOCK.finditer(text):
            if m.start() >= free:
                close = text.find(f"-----END {m[1]}-----", m.end())
                free = close + len(m[1]) + 14 if close >= 0 else m.end()
                found.setdefault((m.start(), free), FORMS.index("block"))
    if "://" in text:
        for m in _LOGIN.finditer(text):
            add(*m.span(1), "login")
    for m in _SIGN.finditer(text):
        end = names_before(text, m.start())
        name = _NAME.search(text, max(0, end - 32), end)
        if name and _CUE.search(name[0]) and (value := _ASSIGNED.match(text, m.end())):
            add(*value.span(value.lastindex), "value")
    for m in _SAID.finditer(text):
        add(*m.span(1), "value")
    for m in _RUN.finditer(text):
        run = m[0].rstrip("._~/-")
        lead = len(run) - len(run.lstrip("./~-"))
        if len(run) - lead >= 12 and _MIXED.search(run, lead) and any(c.isalpha() for c in run):
            add(m.start() + lead, m.start() + len(run), "bare")
    return [(s, e, f) for (s, e), f in found.items()]


# ---- the network

_CODE = np.arange(CODES)
_CODE[0] = 1  # 0 is the filling between windows


@dataclass
class Windows:
    """Characters of all windows with fillings between them: codes, part of each character, limits of the parts, forms."""

    codes: list[np.ndarray] = field(default_factory=list)
    limits: list[tuple[int, int, int, int]] = field(default_factory=list)
    forms: list[int] = field(default_factory=list)
    size: int = 0

    def add(self, text: str, start: int, end: int, form: int) -> None:
        lo, hi = max(0, start - BEFORE), min(len(text), end + AFTER)
        raw = np.frombuffer(text[lo:hi].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.concatenate([[0, 0, 0], _CODE[np.where(raw < CODES, raw, 1)], [0]])
        first = self.size + 2
        self.limits.append((first, first + 1 + start - lo, first + 1 + end - lo, first + 2 + hi - lo))
        self.codes.append(codes)
        self.forms.append(form)
        self.size += len(codes)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        codes = np.concatenate([*self.codes, [0, 0]])
        limits = np.array(self.limits)
        part = np.zeros((len(codes), 3))
        starts = np.zeros(len(codes) + 1, int)
        starts[limits[:, 0]] += 1
        inner = np.zeros(len(codes) + 1, int)
        inner[limits[:, 1]] += 1
        inner[limits[:, 2]] -= 1
        whole = starts.copy()
        np.add.at(whole, limits[:, 3], -1)
        inside, window = np.cumsum(inner)[:-1] > 0, np.cumsum(whole)[:-1] > 0
        behind = np.cumsum(np.bincount(limits[:, 2], minlength=len(codes) + 1) - np.bincount(limits[:, 3], minlength=len(codes) + 1))[:-1] > 0
        part[:, 1], part[:, 2] = inside, behind
        part[:, 0] = window & ~inside & ~behind
        return codes, part, limits, np.array(self.forms)


def new_weights(seed: int, dtype=np.float32) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    inputs = 4 * FILTERS + 1 + len(FORMS)
    shapes = {"chars": ((CODES, DIMS), 0.5), "filters": ((WIDTH * CHANNELS, FILTERS), (WIDTH * CHANNELS) ** -0.5), "shift": ((FILTERS,), 0.0),
              "hidden": ((inputs, HIDDEN), inputs**-0.5), "hidden_shift": ((HIDDEN,), 0.0), "out": ((HIDDEN,), HIDDEN**-0.5), "out_shift": ((1,), 0.0)}
    return {name: (rng.standard_normal(shape) * scale).astype(dtype) for name, (shape, scale) in shapes.items()}


def _unfold(codes: np.ndarray, part: np.ndarray, w: dict) -> np.ndarray:
    """WIDTH neighbouring vectors of each character but the outermost two on both sides."""
    x = np.concatenate([w["chars"][codes], part.astype(w["chars"].dtype)], axis=1)
    return np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=0).transpose(0, 2, 1).reshape(len(codes) - WIDTH + 1, -1)


def forward(w: dict, codes: np.ndarray, part: np.ndarray, limits: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, dict]:
    """Logit of each window, and what the backward pass needs. Long inputs are folded in pieces of FLAT characters."""
    dtype = w["chars"].dtype
    h = np.zeros((len(codes), FILTERS), dtype)
    for lo in range(0, len(codes) - WIDTH + 1, FLAT):
        hi = min(len(codes), lo + FLAT + WIDTH - 1)
        h[lo + 2:hi - 2] = np.maximum(_unfold(codes[lo:hi], part[lo:hi], w) @ w["filters"] + w["shift"], 0)
    n = len(limits)
    most = np.maximum.reduceat(h, limits.ravel(), axis=0).reshape(n, 4, FILTERS)
    length = (limits[:, 2] - limits[:, 1])[:, None]
    mean = np.add.reduceat(h, limits.ravel(), axis=0).reshape(n, 4, FILTERS)[:, 1] / length.astype(dtype)
    features = np.concatenate([most[:, 0], most[:, 1], mean, most[:, 2], np.log(length).astype(dtype) / 4, np.eye(len(FORMS), dtype=dtype)[forms]], axis=1)
    hidden = np.tanh(features @ w["hidden"] + w["hidden_shift"])
    return hidden @ w["out"] + w["out_shift"][0], {"h": h, "most": most, "features": features, "hidden": hidden, "length": length}


def gradients(w: dict, labels: np.ndarray, codes: np.ndarray, part: np.ndarray, limits: np.ndarray, forms: np.ndarray) -> tuple[float, dict]:
    """Mean logistic loss and its gradient."""
    logit, kept = forward(w, codes, part, limits, forms)
    n, f = len(labels), FILTERS
    loss = float(np.mean(np.logaddexp(0, logit) - labels * logit))
    d = ((sigmoid(logit) - labels) / n).astype(w["chars"].dtype)
    grad = {"out": kept["hidden"].T @ d, "out_shift": np.array([d.sum()])}
    back = np.outer(d, w["out"]) * (1 - kept["hidden"] ** 2)
    grad["hidden"], grad["hidden_shift"] = kept["features"].T @ back, back.sum(axis=0)
    back = back @ w["hidden"].T
    h, dh = kept["h"], np.zeros_like(kept["h"])
    sizes = np.diff(np.concatenate([limits.ravel(), [len(codes)]]))
    row = np.repeat(np.arange(4 * n), sizes)  # part of each character from the first window on
    start = limits[0, 0]
    pooled = np.zeros((n, 4, f), dh.dtype)
    pooled[:, 0], pooled[:, 1], pooled[:, 2] = back[:, :f], back[:, f:2 * f], back[:, 3 * f:4 * f]
    top = (h[start:] == kept["most"].reshape(-1, f)[row]) & (h[start:] > 0)
    ties = np.maximum(np.add.reduceat(top, limits.ravel() - start, axis=0, dtype=dh.dtype), 1)
    dh[start:] = top * (pooled.reshape(-1, f) / ties)[row]
    mean = np.zeros((n, 4, f), dh.dtype)
    mean[:, 1] = back[:, 2 * f:3 * f] / kept["length"]
    dh[start:] += mean.reshape(-1, f)[row] * (h[start:] > 0)
    dh = dh[2:-2]
    columns = _unfold(codes, part, w)
    grad["filters"], grad["shift"] = columns.T @ dh, dh.sum(axis=0)
    dx = np.zeros((len(codes), DIMS), dh.dtype)
    spread = (dh @ w["filters"].T).reshape(-1, WIDTH, CHANNELS)
    for k in range(WIDTH):
        dx[k:k + len(spread)] += spread[:, k, :DIMS]
    grad["chars"] = np.zeros_like(w["chars"])
    np.add.at(grad["chars"], codes, dx)
    return loss, grad


# ---- labelled findings

_HEXES, _ALNUM = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def findings(n: int, seed: int) -> list[tuple[str, int, int, int, int]]:
    """Generated (text, start, end, form, label): candidates of made-up texts, 1 where the text was given a secret there."""
    rng = random.Random(seed)
    pick = rng.choice
    chars = lambda alphabet, lo, hi=None: "".join(pick(alphabet) for _ in range(rng.randint(lo, hi or lo)))
    word = lambda: "".join(pick(["ta", "en", "ri", "o", "mes", "la", "th", "is", "de", "un", "ber", "quo", "é"]) for _ in range(rng.randint(1, 5)))
    syllable = lambda: pick("bcdfghklmnprstvw") + pick("aeiou") + pick(["", "", "n", "r", "s", "t", "ng", "l"])
    plain = lambda: pick([lambda: word().replace("é", "e"), lambda: "".join(syllable() for _ in range(rng.randint(1, 4)))])()
    base64 = lambda lo, hi: chars(_ALNUM + "+/", lo, hi) + pick(["", "=", "=="])
    uuid = lambda: "-".join(chars(_HEXES, k) for k in (8, 4, 4, 4, 12))
    name = lambda: pick(["", "", "DB_", "my_", "client_", "app.", "AWS_", "x-"]) + pick(
        ["password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "private_key", "credentials", "secretKey", "key"])

    def case(s: str) -> str:
        return pick([s, s, s.upper(), s.title()])

    def password() -> str:
        return pick([lambda: plain().title() + chars("0123456789", 2, 4) + pick("!?#$%&*@"), lambda: chars(_ALNUM + "!#$%&*@?^", 8, 20), lambda: plain() + pick("_-.!") + plain() + chars("0123456789", 1, 4),
                     lambda: plain() + chars("0123456789", 2, 5), lambda: plain().replace("e", "3").replace("o", "0").title() + pick("!@#$") + chars(_ALNUM, 3, 6)])()

    def key() -> str:
        return pick([lambda: "ghp_" + chars(_ALNUM, 36), lambda: "sk-" + chars(_ALNUM, 32, 48), lambda: "xoxb-" + chars("0123456789", 11) + "-" + chars(_ALNUM, 24), lambda: "AIza" + chars(_ALNUM + "_-", 35),
                     lambda: ".".join(["eyJ" + chars(_ALNUM, 17, 33), "eyJ" + chars(_ALNUM, 30, 80), chars(_ALNUM + "_-", 43)]), lambda: chars(_ALNUM, 20, 48), lambda: base64(24, 64), lambda: "sk_live_" + chars(_ALNUM, 24),
                     lambda: "glpat-" + chars(_ALNUM, 20), lambda: "SG." + chars(_ALNUM, 22) + "." + chars(_ALNUM, 43), lambda: chars(_ALNUM + "_-", 24, 40)])()

    def secret() -> tuple[str, str, str]:
        quote = pick(['"', "'", ""])
        sign = pick([" = ", "=", ": ", ":", " := ", " => "])
        return pick([
            lambda: (case(name()) + sign + quote, pick([password, key, key])(), quote), lambda: (case(name()) + sign + quote, pick([chars(_HEXES, 16, 31), uuid(), base64(16, 40)]), quote),
            lambda: ("", key(), ""), lambda: (pick(["key ", "use ", "with ", "("]), key(), pick(["", ".", ")"])), lambda: (pick(["Authorization: Bearer ", "bearer ", "Authorization: Basic "]), pick([key, lambda: base64(20, 40)])(), ""),
            lambda: (f"{pick(['https', 'postgres', 'mysql', 'ftp', 'amqp'])}://{plain()}:", pick([password().replace("@", "!").replace("/", "x"), chars(_ALNUM, 10, 30)]), f"@{plain()}.{pick(['com', 'net', 'local'])}/{plain()}"),
            lambda: (pick(["password is ", "passphrase is ", "the token is ", "Password was "]), pick([password, key])(), ""),
            lambda: ("", (lambda k: f"-----BEGIN {k}PRIVATE KEY-----\n" + "\n".join(chars(_ALNUM + "+/", 64) for _ in range(rng.randint(2, 6))) + f"\n-----END {k}PRIVATE KEY-----")(pick(["", "RSA ", "EC "])), ""),
        ])()

    def harmless() -> tuple[str, str, str]:
        return pick([
            lambda: ("", f"{plain()}.{plain()}{chars('0123456789', 1, 3)}.example.{pick(['com', 'org', 'net'])}", ""), lambda: (f"{plain()}{chars('0123456789', 1, 2)}@", f"mail{chars('0123456789', 1, 2)}.{plain()}.com", ""),
            lambda: (pick(["", "mail ", "<"]), plain() + plain() + pick([".", "_", ""]) + plain() + chars("0123456789", 1, 3), f"@mail{chars('0123456789', 1)}.{plain()}.com"),
            lambda: ("https://", f"www.{plain()}.org/{plain()}/{plain()}-{plain()}-{chars('0123456789', 1, 5)}.html", ""),
            lambda: (pick(["", "see ", "http://"]), pick(["www.", "", "cdn."]) + plain() + pick(["", "-", "."]) + plain() + chars("0123456789", 0, 3) + pick([".com", ".org", ".net"]) + pick(["", "/"]) + pick([plain(), plain() + "-" + plain() + chars("0123456789", 0, 2), plain() + pick(["?", "/"]) + "p" + chars("0123456789", 1, 4)]) + pick(["", ".html", "/"]), ""), lambda: ("/", f"usr/{plain()}/{plain()}{chars('0123456789', 1, 2)}/{plain()}.{pick(['py', 'txt', 'so'])}", ""),
            lambda: ("", "".join(plain().title() for _ in range(rng.randint(2, 5))), ""), lambda: ("", "_".join(plain() for _ in range(rng.randint(2, 4))) + chars("0123456789", 1, 3), ""),
            lambda: ("", f"{rng.randint(1950, 2030)}-{chars('01', 2)}-{chars('012', 2)}T{chars('01', 2)}:{chars('0123', 2)}:{chars('0123', 2)}Z", ""), lambda: (pick(["id ", "uuid: ", "request ", "node "]), uuid(), ""),
            lambda: (pick(["commit ", "sha1 ", "md5: ", "sha256: ", "etag ", "checksum: ", "revision "]), chars(_HEXES, 16, 31), ""), lambda: (pick(["data:image/png;base64,", "integrity sha512-"]), "iVBORw0KGgo" + base64(60, 200), ""),
            lambda: (case(name()) + pick([" = ", ": ", "="]), pick(["os.environ['" + plain().upper() + "']", "get" + plain().title() + "()", "required", "optional", "string", "config." + plain() + "." + plain(), "null,", "settings." + plain(),
                                                                     "self." + plain() + "_" + plain(), "${" + plain().upper() + "_" + plain().upper() + "}", "{{ " + plain() + " }}", "random_string(16)"]), ""),
            lambda: (case(name()) + pick([" = ", ": ", "="]) + '"', pick(["your_" + plain() + "_here", "your-key-here", "********", "xxxxxxxxxxxx", "<insert>" + plain(), "changeme_please", "example", "placeholder", "XXXX-XXXX-XXXX", "..........", "TODO_fill_in"]), '"'),
            lambda: (pick(["keyboard: ", "monkey: ", "author: ", "keynote: ", "authors = ", "passage: ", "keywords: "]), " ".join([plain().title() + plain(), plain()]), ""), lambda: ("", f"{plain()}-{plain()}-{plain()}-{rng.randint(1, 99)}", ""),
            lambda: ("", f"{pick(['ISBN', 'DOI', 'No.'])}{chars('0123456789', 3)}-{chars('0123456789', 5)}-{chars('0123456789', 4)}", ""), lambda: ("v", f"{rng.randint(0, 20)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}-{plain()}{rng.randint(1, 9)}", ""),
            lambda: ("", word().title() + word() + word() + "GmbH" + word(), ""), lambda: ("", pick("aAxX0zn=") * rng.randint(12, 30) + "1a", ""), lambda: (pick(["password is ", "token is ", "key is ", "secret was "]), pick(["required", "missing", "invalid", "needed", "stored", "hashed", "forgotten"]), ""),
            lambda: (pick(["basic ", "bearer ", "Basic "]), plain() + plain(), ""), lambda: ("https://", f"{plain()}.com:8080/{plain()}@{plain()}", ""),
        ])()

    out: list[tuple[str, int, int, int, int]] = []
    while len(out) < n:
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(pick([word, plain])() for _ in range(rng.randint(0, 8))) + pick([" ", " ", "\n", ". "])
            good = rng.random() < 0.5
            before, value, after = secret() if good else harmless()
            if good:
                spans.append((len(text) + len(before), len(text) + len(before) + len(value)))
            text += before + value + after + pick([" ", ". ", "\n", ", "])
        for s, e, form in candidates(text):
            # a part of a secret, or one with a sign more, is no clean example of either class
            if any(a == s and abs(b - e) <= 2 for a, b in spans):
                out.append((text, s, e, form, 1))
            elif not any(a < e and s < b for a, b in spans):
                out.append((text, s, e, form, 0))
    return out[:n]


# ---- training, calibration, thresholds


def windows_of(rows: Sequence[tuple[str, int, int, int, int]]) -> Windows:
    out = Windows()
    for text, s, e, form, _ in rows:
        out.add(text, s, e, form)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def platt(logits: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logits that fit the labels best, with Platt's smoothed targets.

    Newton steps, halved until the loss falls.
    """
    good = labels.sum()
    goal = np.where(labels == 1, (good + 1) / (good + 2), 1 / (len(labels) - good + 2))
    loss = lambda c: (np.logaddexp(0, c[0] * logits + c[1]) - goal * (c[0] * logits + c[1])).sum()
    x, now = np.column_stack([logits, np.ones_like(logits)]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ now)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-6 * np.eye(2), x.T @ (p - goal))
        size = 1.0
        while size > 1e-6 and loss(now - size * step) > loss(now):
            size /= 2
        now = now - size * step
        if size <= 1e-6 or np.abs(size * step).max() < 1e-9:
            break
    return float(now[0]), float(now[1])


def recall_threshold(scores: np.ndarray, labels: np.ndarray, recall: float) -> float:
    """The largest score up to 0.5 that this share of the positives reaches; 0.5 without positives."""
    good = np.sort(scores[labels == 1])[::-1]
    return min(0.5, float(good[int(np.ceil(recall * len(good))) - 1])) if len(good) else 0.5


def fit(rows: Sequence[tuple[str, int, int, int, int]], seed: int = SEED, epochs: int = EPOCHS, recall: float = RECALL) -> dict:
    """Weights, calibration line and thresholds from labelled findings; every fourth is held out for the last two."""
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    held, used = rows[::4], [r for i, r in enumerate(rows) if i % 4]
    w = new_weights(seed)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step, batches = 0, [used[i:i + 48] for i in range(0, len(used), 48)]
    ready = [(np.array([r[4] for r in b], np.float32), windows_of(b).arrays()) for b in batches]
    for epoch in range(epochs):
        for i in rng.permutation(len(ready)):
            labels, arrays = ready[i]
            _, grad = gradients(w, labels, *arrays)
            step += 1
            rate = 0.006 * (1 - epoch / epochs)
            for k in w:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.99 * second[k] + 0.01 * grad[k] ** 2
                w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(w[k].dtype)
    labels, forms = np.array([r[4] for r in held]), np.array([r[3] for r in held])
    logits = forward(w, *windows_of(held).arrays())[0].astype(float)
    a, b = platt(logits, labels)
    p = sigmoid(a * logits + b)
    limits = [recall_threshold(p[forms == f], labels[forms == f], recall) for f in range(len(FORMS))]
    return {"weights": w, "slope": a, "shift": b, "thresholds": limits}


@functools.lru_cache(maxsize=2)
def train(n: int = FINDINGS, seed: int = SEED) -> dict:
    return fit(findings(n, seed), seed)


# ---- search


def probabilities(model: dict, windows: Windows) -> np.ndarray:
    logits = forward(model["weights"], *windows.arrays())[0].astype(float)
    return sigmoid(model["slope"] * logits + model["shift"])


def score_candidates(model: dict, texts: Sequence[str | None]) -> list[list[tuple[int, int, int, float]]]:
    """(start, end, form, probability) of the candidates of each text. Windows are scored FLAT characters at a time."""
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    windows, owners = Windows(), []

    def flush() -> None:
        if owners:
            for (row, s, e, form), p in zip(owners, probabilities(model, windows).tolist()):
                out[row].append((s, e, form, p))

    for row, text in enumerate(texts):
        for s, e, form in candidates(text) if text else ():
            windows.add(text, s, e, form)
            owners.append((row, s, e, form))
            if windows.size >= FLAT:
                flush()
                windows, owners = Windows(), []
    flush()
    return out


def chosen(base: list[tuple[str, int, int]], scored: list[tuple[int, int, int, float]], thresholds: list[float]) -> list[tuple[str, int, int, float | None]]:
    """Base spans and the accepted candidates, by start, then kind; the likelier of two that overlap, then the longer."""
    taken: list[tuple[int, int]] = []
    for _, s, e in sorted(base, key=lambda x: x[1]):  # as disjoint stretches
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    starts = [s for s, _ in taken]
    out: list[tuple[str, int, int, float | None]] = [(k, s, e, None) for k, s, e in base]
    for s, e, form, p in sorted(scored, key=lambda x: (-x[3], x[0] - x[1], x[0])):
        at = bisect.bisect_left(starts, e)
        if p >= thresholds[form] and not (at and taken[at - 1][1] > s):
            starts.insert(at, s)
            taken.insert(at, (s, e))
            out.append((FORMS[form], s, e, p))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPAN = "kind:string,start:long,end:long"
RESULT = f"doc_id long, base array<struct<{SPAN}>>, spans array<struct<{SPAN},probability:double>>"


def find_secrets(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id with base spans and all spans (code points, end exclusive); added spans carry their probability."""
    model = train() if model is None else model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            base = [base_spans(t) if t else [] for t in texts]
            spans = [chosen(b, s, model["thresholds"]) for b, s in zip(base, score_candidates(model, texts))]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "base": [[{"kind": k, "start": s, "end": e} for k, s, e in b] for b in base],
                                "spans": [[{"kind": k, "start": s, "end": e, "probability": p} for k, s, e, p in x] for x in spans]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, RESULT)
