"""Secret scan: fixed patterns, and a character network over further candidates with their context.

Base kinds (assign, access, hex) follow fixed rules and always stay.  Every other candidate - a run of 16 or more token
characters with a letter and a digit - is judged by a small convolutional network in numpy that sees the characters of the
candidate and around it; a long candidate is seen in overlapping pieces, and its likeliest piece counts.  It is trained on a bounded sample of the corpus (base findings against candidates whose form
shows that they are something else) and on generated tokens of public formats, then calibrated; the threshold finds
``RECALL`` of the validation secrets of every generated format at least.  Scanning is a function of one text: no shuffle.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from itertools import islice
from random import Random

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from motionlake.session import settle

from .common import appended, appending, by_text, field, utf8

BASE = ("assign", "access", "hex")
LEARNED = "learned"
KINDS = (*BASE, LEARNED)
#: Labelled findings read from the corpus, of either label; generated ones, of either label.
SAMPLE = 1500
GENERATED = 1500
RECALL = 0.98
#: Generated secrets of each format, and as many look-alikes, that set the threshold.
JUDGED = 250
#: Characters the network sees: before a piece of a candidate, of it, and after it.
BEFORE, WITHIN, AFTER = 24, 48, 8
#: Pieces of a longer candidate begin so many characters apart.
STEP = 16
SEED = 11

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# shorter runs would be dropped anyway
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By start, then kind as listed."""
    spans = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CANDIDATE.finditer(text) if _DIGIT.search(m[0]) and _LETTER.search(m[0])]


# ---- characters

_ALPHABET = string.ascii_letters + string.digits + "+/_=-.:\"' \n"
_CODES = np.ones(128, np.int16)  # 0 pads, 1 is any other character
_CODES[[ord(c) for c in _ALPHABET]] = np.arange(2, len(_ALPHABET) + 2)
LENGTH = BEFORE + WITHIN + AFTER


def pieces(start: int, end: int) -> Iterator[tuple[int, int]]:
    """Overlapping pieces of a candidate, all of it covered; the last ends where it ends."""
    last = max(start, end - WITHIN)
    for at in range(start, last, STEP):
        yield at, at + WITHIN
    yield last, end


def window(text: str, start: int, end: int) -> str:
    """What the network sees: the end of what stands before, the piece, the beginning of what follows."""
    inside = text[start : min(end, start + WITHIN)]
    return text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + inside.ljust(WITHIN, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")


def encode(windows: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(windows), LENGTH)
    codes = _CODES[np.minimum(points, 127)].astype(np.int64)
    codes[points >= 127] = 1
    codes[points == 0] = 0
    return codes


# ---- network

DIM, WIDTH, FILTERS = 8, 5, 32


class Network:
    """Character embedding, one convolution with ReLU, maximum and mean over positions, one logistic unit."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.3, (len(_ALPHABET) + 2, DIM)),
            "conv": r.normal(0, (2 / (WIDTH * DIM)) ** 0.5, (WIDTH * DIM, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": r.normal(0, 0.1, 2 * FILTERS),
            "out_bias": np.zeros(1),
        }

    def forward(self, codes: np.ndarray) -> tuple:
        embedded = self.p["embed"][codes]
        steps = codes.shape[1] - WIDTH + 1
        patches = np.concatenate([embedded[:, i : i + steps] for i in range(WIDTH)], axis=2)
        active = np.maximum(patches @ self.p["conv"] + self.p["bias"], 0)
        at = active.argmax(1)
        pooled = np.concatenate([active.max(1), active.mean(1)], axis=1)
        return patches, active, at, pooled, pooled @ self.p["out"] + self.p["out_bias"][0]

    def logits(self, codes: np.ndarray, batch: int = 512) -> np.ndarray:
        parts = [self.forward(codes[i : i + batch])[-1] for i in range(0, len(codes), batch)]
        return np.concatenate(parts) if parts else np.empty(0)

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        patches, active, at, pooled, logit = self.forward(codes)
        n, steps, _ = active.shape
        d = (1 / (1 + np.exp(-logit)) - labels) / n
        g = {"out": pooled.T @ d, "out_bias": np.array([d.sum()])}
        d_pool = d[:, None] * self.p["out"]
        d_active = np.repeat(d_pool[:, None, FILTERS:] / steps, steps, axis=1)
        np.add.at(d_active, (np.arange(n)[:, None], at, np.arange(FILTERS)), d_pool[:, :FILTERS])
        d_active *= active > 0
        g["conv"], g["bias"] = np.tensordot(patches, d_active, ((0, 1), (0, 1))), d_active.sum((0, 1))
        d_patches = d_active @ self.p["conv"].T
        g["embed"] = np.zeros_like(self.p["embed"])
        for i in range(WIDTH):
            np.add.at(g["embed"], codes[:, i : i + steps], d_patches[:, :, i * DIM : (i + 1) * DIM])
        return g

    def fit(self, codes: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = SEED) -> Network:
        """Adam on the logistic loss."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(codes))
            for i in range(0, len(order), batch):
                step += 1
                for k, g in self.gradients(codes[order[i : i + batch]], labels[order[i : i + batch]]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def calibrate(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through validation logits (Newton's method, lightly regularised)."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        w = p * (1 - p)
        g = np.array([((p - labels) * logits).sum() + 1e-2 * (a - 1), (p - labels).sum() + 1e-2 * b])
        h = np.array([[(w * logits * logits).sum() + 1e-2, (w * logits).sum()], [(w * logits).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = float(np.clip(a - step[0], 0.05, 5)), float(np.clip(b - step[1], -10, 10))
    return a, b


def threshold(probabilities: np.ndarray, labels: np.ndarray, kinds: np.ndarray, recall: float = RECALL) -> float:
    """Even odds, or the highest threshold that finds ``recall`` of the secrets of each kind if that is lower or more precise."""
    if not (labels == 1).any():
        return 0.5
    found = [np.sort(probabilities[(labels == 1) & (kinds == k)]) for k in np.unique(kinds[labels == 1])]
    highest = min(float(x[int(np.floor(len(x) * (1 - recall)))]) for x in found)
    false = lambda t: int((probabilities[labels == 0] >= t).sum())
    return min(highest, 0.5) if false(0.5) == 0 else highest


# ---- labelled findings


def _token(r: Random, alphabet: str, n: int) -> str:
    return "".join(r.choices(alphabet, k=n))


#: Formats of generated secrets.
FORMATS = 8


def candidates_made(n: int, seed: int = SEED) -> Iterator[tuple[str, int, int, int, int]]:
    """``n`` tokens in public formats, which take turns, and ``n`` look-alikes that are no secrets: the text, where the
    candidate begins, where the token in it begins, where both end, and the label."""
    r = Random(seed)
    alnum, hexes, base64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    word = lambda: _token(r, "etaoinshrdlucmfw", r.randint(3, 9))
    spoken = lambda: "".join(r.choice("bcdfghjklmnprstvwyz") + r.choice("aeiou") + r.choice(("", "", "n", "r", "s", "t")) for _ in range(r.randint(1, 5)))
    secret = [
        lambda: "ghp_" + _token(r, alnum, 36),
        lambda: "sk_live_" + _token(r, alnum, 24),
        lambda: "xoxb-" + _token(r, string.digits, 12) + "-" + _token(r, alnum, 24),
        lambda: "glpat-" + _token(r, alnum + "_-", 20),
        lambda: "AIza" + _token(r, alnum + "_-", 35),
        lambda: "eyJ" + _token(r, alnum + "_-", r.randint(30, 60)),
        lambda: _token(r, base64, r.choice((32, 40, 43, 64))) + "=" * r.randint(0, 2),
        lambda: _token(r, alnum, r.randint(20, 40)),
    ]
    plain = [
        lambda: f"{word()}-{word()}-{r.randint(1, 999)}-{word()}",
        lambda: f"{word()}_{word()}_{r.randint(0, 99)}_{word()}",
        lambda: f"{word()}/{word()}/{word()}{r.randint(1, 20)}/{word()}",
        lambda: "-".join(_token(r, hexes, k) for k in (8, 4, 4, 4, 12)),
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{r.randint(0, 23):02d}-{word()}",
        lambda: "".join(word().capitalize() for _ in range(r.randint(2, 4))) + str(r.randint(2, 9999)),
        lambda: f"{word()}{word()}{word()}{word()}{r.randint(0, 99)}",
        lambda: f"ISBN-{r.randint(100, 999)}-{r.randint(0, 9)}-{r.randint(100, 999)}-{r.randint(10000, 99999)}",
    ]
    for label, makers in ((1, secret), (0, plain)):
        for i in range(n):
            body = makers[i % len(makers)]()
            # one in four stands at the end of a longer candidate
            lead = ""
            if i // len(makers) % 4 == 3:
                joint = r.choice(("/", "_", "-"))
                lead = joint.join(spoken() for _ in range(r.randint(3, 12))) + r.choice(("=", joint))
                lead = lead.upper() if r.random() < 0.5 else lead
            before = " ".join(word() for _ in range(4)) + r.choice((" ", " key ", " = ", ': "', " "))
            start = len(before)
            yield before + lead + body + f" {word()} {word()}", start, start + len(lead), start + len(lead) + len(body), label


def generated(n: int, seed: int = SEED) -> list[tuple[str, int]]:
    """Windows of ``candidates_made``: of a secret the piece that has most of the token, and as harmless all pieces before
    the token; of a look-alike every piece."""
    out = []
    for text, start, body, end, label in candidates_made(n, seed):
        found = list(pieces(start, end))
        if label:
            out.append((window(text, *max(found, key=lambda p: min(p[1], end) - max(p[0], body))), 1))
        out += [(window(text, *p), 0) for p in found if not label or p[1] <= body]
    return out


_FORMAT = re.compile(
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"  # UUID
    r"|ISBN[-=]?[0-9Xx-]+"
    r"|[0-9]{4}([-/_])[0-9]{2}\1[0-9]{2}(?:[T_-][0-9]{2}(?:-?[0-9]{2}){0,2}(?:Z|[+-][0-9]{2,4})?)?"  # date, or date and time
)
_JOINT = re.compile("[-_/+=]+")
#: Words in one case or in camel case, then a number.
_PART = re.compile(r"(?:[a-z]+(?:[A-Z][a-z]+)*|(?:[A-Z][a-z]+)+|[A-Z]+)?[0-9]*")
_WORD_OF_PART = re.compile("[A-Z]?[a-z]+|[A-Z]+")
#: A word as it is spelled: no four consonants and no three vowels in a row.
_SPELLED = re.compile(r"(?=.*[aeiouy])(?!.*[^aeiouy]{4})(?!.*[aeiou]{3})[a-z]{3,}", re.IGNORECASE)


def plain(token: str) -> bool:
    """Whether a candidate's form shows that it is no secret: a UUID, ISBN, date, or spelled words and numbers, joined.

    One short part (``v`` of ``v1``) is let pass.  One run of letters of one case with digits is no evidence: keys are
    written so too.  Drawn characters change between cases, digits and signs too often to look like several words.
    """
    if _FORMAT.fullmatch(token):
        return True
    parts = _JOINT.split(token)
    if not all(map(_PART.fullmatch, parts)):
        return False
    words = [w for p in parts for w in _WORD_OF_PART.findall(p)]
    spelled = sum(_SPELLED.fullmatch(w) is not None for w in words)
    short = sum(len(w) < 3 for w in words)
    return spelled > 1 and short < 2 and spelled + short == len(words) and sum(map(len, words)) * 2 >= len(token)


def _labelled(text: str | None):
    """Windows of base findings (1), and of candidates that touch none and are plainly something else (0)."""
    base = base_spans(text or "")
    found = [(start, end, 1) for _, start, end in base]
    for start, end in candidates(text or ""):
        if all(end <= a or b <= start for _, a, b in base) and plain(text[start:end]):
            found.append((start, end, 0))
    for start, end, label in found:
        # of a long finding the beginning is known to show it, of other candidates every piece is harmless
        for piece in islice(pieces(start, end), 1 if label else None):
            seen = window(text, *piece)
            yield label, xxhash.xxh3_64_intdigest(utf8(seen)) >> 1, seen


def corpus_sample(docs: DataFrame, text: str = "text", size: int = SAMPLE) -> list[tuple[str, int]]:
    """At most ``size`` windows of either label, those with the smallest hashes.

    The texts are read once; of the windows written, each task keeps ``size`` of a label and so does the merge.
    """
    out = StructType([StructField("label", IntegerType()), StructField("hash", LongType()), StructField("seen", StringType())])
    rows = settle(docs.select(field(docs, text, "text")).mapInArrow(by_text(_labelled, out), out))
    # below a union the parts are merged in a task, not in the driver
    return sorted((r["seen"], r["label"]) for r in first_windows(rows, 0, size).union(first_windows(rows, 1, size)).collect())


def first_windows(rows: DataFrame, label: int, size: int) -> DataFrame:
    return rows.where(F.col("label") == label).orderBy("hash", "seen").limit(size)


def train(docs: DataFrame, text: str = "text") -> dict:
    """Network weights, calibration and threshold.  A corpus without findings leaves the generated ones."""
    findings = corpus_sample(docs, text) + generated(GENERATED)
    labels = np.array([label for _, label in findings], float)
    codes = encode([seen for seen, _ in findings])
    validation = np.array([xxhash.xxh3_64_intdigest(utf8(seen), seed=1) % 5 == 0 for seen, _ in findings])
    net = Network().fit(codes[~validation], labels[~validation])
    logits = net.logits(codes[validation])
    a, b = calibrate(logits, labels[validation])
    # base findings are never asked about, so only formats that the scan judges set the threshold
    model = {"weights": net.p, "slope": a, "offset": b, "threshold": 0.0}
    judged = list(candidates_made(JUDGED * FORMATS, seed=SEED + 1))
    probabilities = np.array([p for text, start, _, end, _ in judged for p in Scanner(model).chances(text, [(start, end)])])
    labels, kinds = np.array([label for *_, label in judged]), np.arange(len(judged)) % FORMATS
    return model | {"threshold": threshold(probabilities, labels, kinds)}


# ---- scan

SPAN = StructType([
    StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType()),
])


class Scanner:
    def __init__(self, model: dict):
        self.model, self.net = model, Network()
        self.net.p = model["weights"]

    def chances(self, text: str, spots: list[tuple[int, int]]) -> np.ndarray:
        """The highest probability over each candidate's pieces; so many pieces at a time are held."""
        most = np.full(len(spots), -np.inf)
        seen = ((i, window(text, *p)) for i, spot in enumerate(spots) for p in pieces(*spot))
        while part := list(islice(seen, 512)):
            np.maximum.at(most, [i for i, _ in part], self.net.logits(encode([w for _, w in part])))
        return 1 / (1 + np.exp(-np.clip(self.model["slope"] * most + self.model["offset"], -30, 30)))

    def __call__(self, text: str | None) -> list[tuple[str, int, int, float]]:
        if not text:
            return []
        base = base_spans(text)
        found = [(*s, 1.0) for s in base]
        spots = [s for s in candidates(text) if all(s[1] <= a or b <= s[0] for _, a, b in base)]
        for (start, end), p in zip(spots, self.chances(text, spots).tolist(), strict=True):
            if p >= self.model["threshold"]:
                found.append((LEARNED, start, end, p))
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def find(docs: DataFrame, id: str = "doc_id", text: str = "text", model: dict | None = None) -> DataFrame:
    """One row per document row: ``doc_id, found`` (spans in code points, end exclusive, by start and kind).

    Null and empty text have no span; ids may be null or repeated; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, text) if model is None else model)
    rows = docs.select(field(docs, id, "doc_id"), field(docs, text, "text"))
    adds = StructType([StructField("found", ArrayType(SPAN))])

    def run(batches):
        scan = Scanner(sent.value)

        def work(text: str | None) -> tuple:
            return ([dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in scan(text)],)

        yield from appending(work, ["text"], adds)(batches)

    return rows.mapInArrow(run, appended(rows, adds)).drop("text")
