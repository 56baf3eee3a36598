"""Personal data by base patterns and a gradient-boosted judge of further candidates.

Base spans, leftmost and non-overlapping per kind, are always kept: email, ip, card (Luhn), phone. High-recall
generators then propose further spans of other kinds, which may overlap one another and base spans: spelt-out addresses,
national phone numbers, identity numbers, bank accounts, hardware addresses, keys and tokens. Features of a candidate's
format, of the words around it and of how much of it base spans hold already go to boosted regression trees, and a
candidate whose probability reaches its kind's threshold is a span.

Trees and thresholds are trained here, on TRAIN_ROWS labelled candidates that `labelled` writes from templates with a
fixed seed; thresholds are the least that keep precision at PRECISION on the half held out from the trees, lowered where
recall would fall under RECALL, and one half at least.

Defined results: null text is the empty text and has no spans; texts of any length are searched whole, and each
pattern takes linear time; ties of start go by kind; repeated rows get equal results; extra columns stay out of the
spans, and with the rows that `redact` masks, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import by_batch, claim, small_batches, texts

BASE = ("email", "ip", "card", "phone")
ADDED = ("address", "national", "identity", "account", "hardware", "secret")
#: Labelled candidates that the trees and thresholds are fitted on.
TRAIN_ROWS = 12_000
#: Thresholds keep this precision where that leaves this recall; else recall comes first.
PRECISION, RECALL = 0.995, 0.95

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the four base kinds."""
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _DIGITS.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


# The generators are wide on purpose: what they propose is judged by the trees. A group, where there is one, is the span.
_PROPOSE = {
    "address": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}+ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{2,}+(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]{2,}+)+"),
    "national": re.compile(r"(?<![\d+.-])(?:\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}|\(0\d{1,4}\) ?\d{2,4}[ -]?\d{3,6}|0\d{1,4}[ /-]\d{3,4}[ -]?\d{3,6})(?![\d.-]*\d)"),
    "identity": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!-?\d)"),
    "account": re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "hardware": re.compile(r"\b(?:[0-9A-Fa-f]{2}(?:(?::[0-9A-Fa-f]{2}){5}|(?:-[0-9A-Fa-f]{2}){5})|[0-9A-Fa-f]{4}(?:\.[0-9A-Fa-f]{4}){2})\b(?![:-][0-9A-Fa-f])"),
    "secret": re.compile(r"""(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+|(?i:passwor[dt]|passwd|passphrase|pwd|secret|token|key)["']?(?: is |[ ]?[:=][ ]?)["']?([^\s"']{6,})"""),
}
#: Every generator's match holds a match of this.
_GATE = re.compile(r"[\d:\[(][\d:A-Za-z]|[A-Za-z0-9_+/-]{20}| at |\d[/.-]\d|(?i:pass|pwd|secret|token|key)")
# Words that stand before or after the kinds' values.
CUES = {
    "address": {"mail", "email", "contact", "write", "reach", "send", "courriel", "correo"},
    "national": {"call", "phone", "tel", "telephone", "mobile", "fax", "contact", "cell", "reach", "ring", "telefon", "téléphone", "teléfono"},
    "identity": {"ssn", "social", "security", "taxpayer", "tax", "insurance", "identity", "identification"},
    "account": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "hardware": {"mac", "device", "adapter", "interface", "ethernet", "hardware", "nic", "wlan"},
    "secret": {"token", "key", "secret", "password", "passwort", "passwd", "passphrase", "pwd", "api", "credential", "bearer"},
}
_ALL_CUES = {w: k for k, ws in CUES.items() for w in ws}


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def union(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what spans sorted by start cover."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b, _ in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def covered(start: int, end: int, starts: list[int], ends: list[int]) -> float:
    """The share of [start, end) inside such a union."""
    total, i = 0, bisect_right(ends, start)
    while i < len(starts) and starts[i] < end:
        total += min(end, ends[i]) - max(start, starts[i])
        i += 1
    return total / (end - start)


def describe(text: str, start: int, end: int, kind: str, held: float) -> list[float]:
    """Format and context of a candidate of which base spans hold the share `held`."""
    body = text[start:end]
    n = len(body)
    digits = sum(map(str.isdigit, body))
    upper = sum(map(str.isupper, body))
    lower = sum(map(str.islower, body))
    count: dict[str, int] = {}
    for c in body:
        count[c] = count.get(c, 0) + 1
    entropy = -sum(v / n * math.log2(v / n) for v in count.values())
    before = re.findall(r"[^\W\d_]+", text[max(0, start - 40) : start].lower())[-4:]
    after = re.findall(r"[^\W\d_]+", text[end : end + 24].lower())[:2]
    cue = sum(w in CUES[kind] for w in before)
    other = sum(_ALL_CUES.get(w, kind) != kind for w in before)
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(body, body[1:]))
    left = text[max(0, start - 3) : start]
    check = kind == "account" and iban_valid(body)
    hexadecimal = all(c in "0123456789abcdefABCDEF" for c in body)
    return [
        float(ADDED.index(kind)), n, digits / n, upper / n, lower / n, entropy, cue, other, sum(w in CUES[kind] for w in after),
        changes / n, float("=" in left or ":" in left), float('"' in left or "'" in left), float(check), float(hexadecimal),
        float(body.count("-") + body.count("/") + body.count("_")), max(count.values()) / n, held,
    ]


def candidates(text: str) -> list[tuple[int, int, str]]:
    if not _GATE.search(text):
        return []
    return [(*m.span(m.lastindex or 0), k) for k, p in _PROPOSE.items() for m in p.finditer(text)]


def labelled(rows: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of candidates in sentences written from templates: half personal, half look-alikes."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiou" if i % 2 else "bdlmnrst") for i in range(r.randint(2, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    pick = lambda s, n: "".join(r.choice(s) for _ in range(n))
    num = lambda n: pick("0123456789", n)
    near = {"national": ["number", "me", "us"], "identity": ["number", "no", "id"], "account": ["number", "no"], "hardware": ["address"], "secret": ["value"], "address": ["me", "us"]}

    def cue(k: str) -> str:
        """One or two cues, in any case, perhaps with a word that goes with them, and what joins them to the value."""
        said = " ".join(r.sample(sorted(CUES[k]), r.choice([1, 1, 2])) + ([r.choice(near[k])] if r.random() < 0.4 else []))
        said = r.choice([said, said, said.upper(), said.capitalize()])
        return r.choice(["", "", "my ", "the ", "our "]) + said + r.choice([" ", ": ", " is ", "=", " = ", ' = "', ": '", " at ", " on "])

    hexa, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def account(ok: bool) -> str:
        tail = num(18)
        check = 98 - int("".join(str(int(c, 36)) for c in tail + "DE00")) % 97
        return f"DE{check if ok else (check + r.randint(1, 50)) % 97:02d}{tail}"

    def make(kind: str, own: bool) -> str:
        if kind == "address":
            names = r.choice([word, lambda: f"{word()}.{word()}", lambda: f"{word()}{r.choice('._-')}{num(2)}", lambda: f"{word()[:1]}.{word()}_{word()}"])
            at, dot = r.choice([(" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" (at) ", "[dot]")])
            ends = ["com", "org", "net", "edu", "io", "de", "fr", "es", "co", "info"]
            tail = r.choice([[], [], [], [word()], ["co", "uk"]])
            return f"{names()}{at}{dot.join([word() if own else r.choice(['the', 'a', word()]), *tail[:1], r.choice(ends) if own else word(), *tail[1:]])}" if own else f"{word()} at {word()} dot {word()}"
        if kind == "national":
            form = r.randint(0, 3)
            if form < 2:
                return f"{'(' if (b := r.random() < 0.5) else ''}{num(3)}{')' if b else ''}{r.choice(' -.')}{num(3)}{r.choice('-. ')}{num(4)}"
            if form == 2:
                return f"(0{num(r.randint(1, 4))}){r.choice(['', ' '])}{num(r.randint(3, 4))}{r.choice([' ', '-', ''])}{num(r.randint(3, 5))}"
            return f"0{num(r.randint(1, 4))}{r.choice(' /-')}{num(r.randint(3, 4))}{r.choice(['', ' ', '-'])}{num(r.randint(3, 5))}"
        if kind == "identity":
            return f"{num(3)}-{num(2)}-{num(4)}"
        if kind == "account":
            return account(own)
        if kind == "hardware":
            digits = r.choice([hexa, hexa.upper()])
            form = r.choice("::-.")
            return ".".join(pick(digits, 4) for _ in range(3)) if form == "." else form.join(pick(digits, 2) for _ in range(6))
        if r.random() < 0.4:  # a short one behind its name
            name = r.choice(["password", "Password", "passwd", "pwd", "PASSWORD", "secret", "token", "api_key", "passphrase", "Passwort"])
            made = f"{word()}{r.choice('!#$%&*_-.')}{num(r.randint(1, 4))}{r.choice(['', word().title()])}" if r.random() < 0.6 else f"{word().title()}{num(r.randint(2, 5))}{r.choice('!?#*')}"
            plain = r.choice([word() + word(), word() + word() + ",", "required", word() + word() + "."])
            return f"{name}{r.choice([': ', '=', ' = ', ' is ', ':'])}{made + 'x' * max(0, 6 - len(made)) if own else plain}"
        if own:
            return r.choice([lambda: pick(hexa, r.choice([32, 40, 64])), lambda: "sk-" + pick(base, r.randint(24, 48)), lambda: pick(base, r.randint(24, 60)), lambda: "AKIA" + pick(base.upper(), 16)])()
        return r.choice([lambda: some(4).replace(" ", "-"), lambda: word() * r.randint(3, 6) + word() * 3, lambda: r.choice("-=_") * r.randint(20, 60), lambda: "/".join(word() for _ in range(6)), lambda: num(r.randint(20, 40)), lambda: some(5).replace(" ", "").title()])()

    xs, ys = [], []
    while len(xs) < rows:
        kind, own = r.choice(ADDED), r.random() < 0.5
        lead = cue(kind) if own and r.random() < (0.97 if kind in ("national", "identity", "hardware") else 0.7) else ""
        if not own and kind in ("national", "identity", "hardware"):
            lead = r.choice(["no. ", "part ", "case ", "lot ", "version ", "page ", "order number ", "ref: ", "id = ", ""])
        text = f"{some(r.randint(1, 6))} {lead}{make(kind, own)}{r.choice(['', '.', ',', chr(34)])} {some(r.randint(1, 5))}"
        if (inside := r.random() < 0.1):  # what base spans hold needs no second span
            kind, own = r.choice(["secret", "national"]), False
            text = f"{some(r.randint(1, 6))} " + (f"{pick(base, r.randint(20, 40))}@{word()}.org" if kind == "secret" else f"+{r.randint(1, 99)} {num(3)} {num(3)}-{num(4)}") + f" {some(3)}"
        base_union = union(sorted(base_spans(text)))
        for a, b, k in candidates(text):
            if k == kind:
                held = covered(a, b, *base_union)
                if not inside or held > 0:
                    xs.append(describe(text, a, b, k, held))
                    ys.append(float(own))
    return np.array(xs[:rows]), np.array(ys[:rows])


@dataclass
class Trees:
    """Boosted trees of depth 3 in level order: feature, cut and the eight leaves of each."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(3):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - 7]
        return 1 / (1 + np.exp(-out))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.3) -> Trees:
    """Newton boosting of the logistic loss, cuts taken at 31 quantiles of each feature."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.03, 0.97, 31))) for j in range(x.shape[1])]
    start = math.log(y.mean() / (1 - y.mean()))
    score = np.full(len(y), start)
    feature, cut, leaf = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        f, c = np.zeros(7, np.int64), np.full(7, np.inf)
        node = np.zeros(len(y), np.int64)
        for depth in range(3):
            for k in range(2**depth - 1, 2 ** (depth + 1) - 1):
                own = node == k
                if not own.any():
                    continue
                gs, hs = g[own].sum(), h[own].sum()
                best = gs * gs / (hs + 1) + 1e-9
                for j, cj in enumerate(cuts):
                    right = x[own, j][:, None] > cj
                    gr, hr = g[own] @ right, h[own] @ right
                    gain = gr**2 / (hr + 1) + (gs - gr) ** 2 / (hs - hr + 1)
                    i = int(gain.argmax())
                    if gain[i] > best:
                        best, f[k], c[k] = gain[i], j, cj[i]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > c[node])
        v = np.zeros(8)
        for k in range(8):
            own = node == k + 7
            v[k] = rate * g[own].sum() / (h[own].sum() + 1)
        score += v[node - 7]
        feature.append(f)
        cut.append(c)
        leaf.append(v)
    return Trees(np.array(feature), np.array(cut), np.array(leaf), start)


@lru_cache(maxsize=1)
def model(rows: int = TRAIN_ROWS) -> tuple[Trees, dict[str, float]]:
    """Trees fitted on one half, and each kind's threshold calibrated on the other half."""
    x, y = labelled(rows)
    half = np.arange(rows) % 2 == 0
    trees = boost(x[half], y[half])
    p, truth, kinds = trees.score(x[~half]), y[~half], x[~half][:, 0].astype(int)
    limits = {}
    for i, kind in enumerate(ADDED):
        own = np.flatnonzero(kinds == i)
        order = own[np.argsort(-p[own])]
        right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= PRECISION)
        precise = float(p[order[good[-1]]]) if len(good) else 2.0
        limits[kind] = max(0.5, min(precise, float(np.quantile(p[own][truth[own] == 1], 1 - RECALL))))
    return trees, limits


def find(batch: list[str], trees: Trees, limits: dict[str, float]) -> tuple[list[list], list[list]]:
    """Base spans and added spans of each text, sorted by start and kind."""
    base, owner, spans, rows = [], [], [], []
    for i, text in enumerate(batch):
        own = sorted(base_spans(text), key=lambda s: (s[0], BASE.index(s[2])))
        base.append(own)
        starts, ends = union(own)
        for a, b, k in candidates(text):
            owner.append(i)
            spans.append((a, b, k))
            rows.append(describe(text, a, b, k, covered(a, b, starts, ends)))
    added: list[list] = [[] for _ in batch]
    if rows:
        p = trees.score(np.array(rows))
        for i, s, q in zip(owner, spans, p.tolist()):
            if q >= limits[s[2]]:
                added[i].append(s)
    return base, added


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for a, b, k in spans])


def _all(base: list, added: list) -> list:
    order = {k: i for i, k in enumerate(BASE + ADDED)}
    return sorted(base + added, key=lambda s: (s[0], order[s[2]], s[1]))


def spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, counts of the base kinds, base_sha256 and spans."""
    trees, limits = model()
    small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        claim("pii")
        base, added = find(texts(batch.column(1)), trees, limits)
        counts = [pa.array([sum(s[2] == k for s in own) for own in base], pa.int64()) for k in BASE]
        digest = [hashlib.sha256(_join(own).encode()).hexdigest() for own in base]
        listed = [_join(_all(b, a)) for b, a in zip(base, added)]
        return pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digest, pa.string()), pa.array(listed, pa.string())], names=names)

    names = ["key", *[f"n_{k}" for k in BASE], "base_sha256", "spans"]
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    schema = f"key {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return rows.mapInArrow(by_batch(run, 1), schema).withColumnRenamed("key", key)


def mask(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for a, b, k in found:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each text masked. Null text stays null."""
    trees, limits = model()
    small_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def masked(column: pa.Array) -> pa.Array:
        claim("pii")
        raw = column.to_pylist()
        base, added = find([t or "" for t in raw], trees, limits)
        return pa.array([None if t is None else mask(t, _all(b, a)) for t, b, a in zip(raw, base, added)], pa.string())

    return docs.withColumn(text, masked(docs[text].cast("string")))
