"""PII: candidate gradient boosting.

Generators with high recall propose overlapping spans: the four base kinds as
their rules give them, and looser shapes (addresses with other separators,
telephone numbers without a plus sign, keys, bank accounts, ...). Boosted trees
score each loose span by its format and its context; a threshold, calibrated on
held-out candidates for a wanted precision, selects. Base spans always stay.

Training: contexts are cut from a bounded sample of the documents (TRAIN_TEXTS
rows, the smallest hashes of doc_id in a share of them, TRAIN_CHARS characters each). Into copies of
them go made personal data (label 1) and look-alikes such as versions, dates,
prices and digests (label 0). Fitting is one small numpy job on the driver,
bounded by TRAIN_TEXTS; counting, searching and redacting see every row whole.

Defined cases: null texts count as empty; positions are code points; of spans
that overlap, each is listed, and redaction covers their union; repeated rows
are each searched; an empty table trains on no contexts but the made ones.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import free, own_columns

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "ssn", "iban")

#: Bounds of the labelled sample.
TRAIN_TEXTS = 1500
TRAIN_CHARS = 400
PRECISION = 0.99
CONTEXT = 24

# --- Base kinds. Matches are leftmost and don't overlap; failing ones are dropped without another try.
# Possessive runs and a look behind say the same as the plain patterns, in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", re.A)
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
EMAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_RIGHT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ to the left as far as the class and the last match allow."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        if at >= free and (m := EMAIL_RIGHT.match(text, at + 1)):
            s = at
            while s > free and text[s - 1] in EMAIL_LEFT:
                s -= 1
            if s < at:
                out.append((s, m.end()))
                free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", s, e) for s, e in emails(text)]
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in ips(text)]
        out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(d := re.sub(r"[\x20-]", "", m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def ips(text: str):
    """Parts are compared by length first, so that runs of digits of any length are fine."""
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield m


# --- Candidates of the method, with high recall.
SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]{0,60}[0-9])[A-Za-z0-9_+/-]{20,}+={0,2}")
#: Letters alone: a long run of both cases that changes between them again and again.
LETTERS = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z_+/-]{20,}+(?![0-9])={0,2}")
LEAST_CASES = 4
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z.+])(?:\(0?[0-9]{2,4}\)[ -]?|0?[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])")
EMAIL_SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}){1,4}", re.I)
LOOSE = (("secret", SECRET), ("ssn", SSN), ("iban", IBAN), ("phone", LOCAL_PHONE), ("email", EMAIL_SPELT))


AT = re.compile(r"[(\[]at[)\]]", re.I)


def cases(s: str) -> int:
    """Changes between upper and lower case."""
    return sum(a.isupper() != b.isupper() for a, b in zip(s, s[1:], strict=False))


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Loose spans; they may overlap each other and the base spans."""
    out = [("secret", m.start(), m.end()) for m in LETTERS.finditer(text) if cases(m[0]) >= LEAST_CASES]
    spelt = AT.search(text) is not None
    if spelt or DIGIT.search(text):
        out += [(kind, m.start(), m.end()) for kind, p in LOOSE if kind != "email" or spelt for m in p.finditer(text)]
    return out


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


CUES = (("secret", re.compile(r"token|secret|passw|passphrase|api|key|auth|bearer|credential", re.I)),
        ("ssn", re.compile(r"ssn|social|security|insurance", re.I)),
        ("iban", re.compile(r"iban|account|bank|konto|cuenta|compte", re.I)),
        ("phone", re.compile(r"phone|tel|call|mobile|fax|cell|ruf|appel", re.I)),
        ("email", re.compile(r"mail|contact|write|@", re.I)))
COUNTER_CUES = re.compile(r"version|isbn|order|invoice|no\.|nr|id\b|serial|part|sha|commit|checksum|md5|page|price|date|year|\$|€", re.I)


def features(text: str, kind: str, s: int, e: int) -> list[float]:
    """Format of the span and its context."""
    span = text[s:e]
    n = len(span)
    left, right = text[max(0, s - CONTEXT):s], text[e:e + 8]
    digits = sum("0" <= c <= "9" for c in span)
    upper, lower = sum("A" <= c <= "Z" for c in span), sum("a" <= c <= "z" for c in span)
    hexes = sum(c in "0123456789abcdefABCDEF" for c in span)
    counts = {}
    for c in span:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values())
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:], strict=False))
    own_cue = dict(CUES)[kind].search(left)
    return [
        float(KINDS.index(kind)), n, digits / n, upper / n, lower / n, hexes / n, entropy, changes / n,
        float(own_cue is not None), float(COUNTER_CUES.search(left) is not None),
        float("=" in left[-6:] or ":" in left[-6:]), float(any(q in left[-3:] for q in "\"'`")),
        float(any(q in right[:1] for q in "\"'`")) if right else 0.0,
        float(kind == "iban" and iban_ok(span)), float(digits), float(len(set(span)) / n),
        float(span[:3] in ("000", "666") or span[:1] == "9") if kind == "ssn" else 0.0,
        float(sum(c in " .-()/" for c in span)), cases(span) / n, sum(c in "aeiouAEIOU" for c in span) / n,
    ]


# --- Boosted trees: logistic loss, histogram splits.
class Boosted:
    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, least: int = 8, bins: int = 24):
        self.rounds, self.depth, self.rate, self.least, self.bins = rounds, depth, rate, least, bins
        self.trees: list[list[tuple[int, float, float]]] = []
        self.start, self.threshold = 0.0, 0.5

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = math.log(p / (1 - p))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(x.shape[1])]
        raw = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(x, y - p, p * (1 - p), cuts)
            self.trees.append(tree)
            raw += self._tree(tree, x)
        return self

    def _grow(self, x, g, h, cuts) -> list[tuple[int, float, float]]:
        """Nodes in heap order: (feature or -1, cut, value)."""
        nodes: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
        rows = {0: np.arange(len(g))}
        for k in range(len(nodes)):
            r = rows.get(k)
            if r is None:
                continue
            gs, hs = g[r].sum(), h[r].sum()
            nodes[k] = (-1, 0.0, self.rate * gs / (hs + 1.0))
            if 2 * k + 2 >= len(nodes) or len(r) < 2 * self.least:
                continue
            best = (1e-6, -1, 0.0)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                at = np.searchsorted(c, x[r, j], side="left")  # x <= c[at]: left of the cut
                gl, hl = np.cumsum(np.bincount(at, g[r], len(c) + 1))[:-1], np.cumsum(np.bincount(at, h[r], len(c) + 1))[:-1]
                n = np.cumsum(np.bincount(at, minlength=len(c) + 1))[:-1]
                gain = gl ** 2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs ** 2 / (hs + 1)
                gain[(n < self.least) | (len(r) - n < self.least)] = -1
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), j, float(c[i]))
            if best[1] >= 0:
                nodes[k] = (best[1], best[2], 0.0)
                to_left = x[r, best[1]] <= best[2]
                rows[2 * k + 1], rows[2 * k + 2] = r[to_left], r[~to_left]
        return nodes

    @staticmethod
    def _tree(tree, x: np.ndarray) -> np.ndarray:
        f, c, v = (np.array(a) for a in zip(*tree, strict=True))
        at = np.zeros(len(x), int)
        while (go := f[at] >= 0).any():
            r = np.flatnonzero(go)
            k = at[r]
            at[r] = 2 * k + 1 + (x[r, f[k]] > c[k])
        return v[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.start + sum(self._tree(t, x) for t in self.trees))))

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> Boosted:
        """The lowest threshold from which on the held-out candidates have the wanted precision; none if there is none."""
        s = self.score(x)
        order = np.argsort(-s, kind="stable")
        good = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        last = np.r_[s[order][1:] != s[order][:-1], True]  # equal scores go together
        ok = np.flatnonzero((good >= precision) & last)
        self.threshold = float(s[order][ok[-1]]) if len(ok) else 1.1
        return self


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _iban(r: random.Random) -> str:
    body = _digits(r, 18)
    check = 98 - int(body + "131400") % 97  # DE
    s = f"DE{check:02d}{body}"
    return s if r.random() < 0.5 else " ".join(s[i:i + 4] for i in range(0, len(s), 4))


def made_personal(r: random.Random) -> tuple[str, str]:
    """(kind, text with the span between \\x01 and \\x02)."""
    kind = r.choice(("secret", "secret", "ssn", "iban", "phone", "email"))
    if kind == "secret":
        n = r.choice((24, 32, 40, 40, 48, 64))
        letters = r.choice(("0123456789abcdef", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
        v = r.choice(("", "", "sk-", "ghp_", "AKIA")) + "1" + "".join(r.choice(letters) for _ in range(n - 1))
        if r.random() < 0.25:
            v = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(n))
        lead = r.choice(('token = "', "api_key: ", 'secret="', "password: ", "Authorization: Bearer ", "access_token=", "key = '", ""))
        return kind, f"{lead}\x01{v}\x02{lead[-1] if lead[-1:] in ('"', "'") else ''}"
    if kind == "ssn":
        return kind, r.choice(("SSN ", "social security number ", "ssn: ", "")) + f"\x01{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}\x02"
    if kind == "iban":
        return kind, r.choice(("IBAN ", "account ", "bank: ", "")) + f"\x01{_iban(r)}\x02"
    if kind == "phone":
        v = r.choice(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "0{} {} {}")).format(_digits(r, 3), _digits(r, 3), _digits(r, 4))
        return kind, r.choice(("tel ", "phone: ", "call ", "mobile ", "fax ")) + f"\x01{v}\x02"
    at, dot = r.choice(((" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), (" [AT] ", " [DOT] "), (" (At) ", " (Dot) ")))
    name, host = (f"user{_digits(r, 2)}", f"example{_digits(r, 1)}") if r.random() < 0.5 else (r.choice(("john", "mary.jones", "info", "office")), r.choice(("example", "mail-host", "company")))
    v = f"{name}{at}{host}{dot}{r.choice(('com', 'org', 'de'))}"
    return kind, r.choice(("mail ", "contact ", "write to ", "")) + f"\x01{v.upper() if at.strip() == '[AT]' else v}\x02"


def made_name(r: random.Random) -> str:
    """A long name in mixed case, as programs have them."""
    parts = ("get", "User", "Account", "Settings", "Controller", "Abstract", "Proxy", "Factory", "Manager", "Request", "Handler", "Default", "Value", "Window", "Title", "Number", "Index")
    return r.choice(("", "", "src/main/", "com/")) + r.choice(("", "/", "_")).join(r.choice(parts) for _ in range(r.randint(4, 7)))


def made_look_alike(r: random.Random) -> str:
    if r.random() < 0.15:
        return r.choice(("", "class ", "see ", "call ", "key ")) + made_name(r)
    h = "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 64))))
    return r.choice((
        f"sha1 {h}", f"commit {h}", f"md5 checksum {h}", f"https://example.com/articles/{_digits(r, 4)}/some-long-title-of-a-page-{_digits(r, 2)}",
        f"order no. {_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}", f"part {_digits(r, 3)}.{_digits(r, 3)}.{_digits(r, 4)}",
        f"isbn 978-{_digits(r, 3)}-{_digits(r, 4)}", f"invoice id {_digits(r, 4)}-{_digits(r, 3)}-{_digits(r, 4)}", f"serial 9{_digits(r, 2)}-{_digits(r, 2)}-{_digits(r, 4)}",
        f"page {_digits(r, 3)} {_digits(r, 3)} {_digits(r, 3)}", f"price $ {_digits(r, 2)} {_digits(r, 3)} {_digits(r, 3)}",
        f"a_very_long_identifier_name_{_digits(r, 3)}", f"NO{_digits(r, 2)} ABCD 1234 EFGH {_digits(r, 4)}", f"looked (at) house (dot) number {_digits(r, 2)}", "pointed [at] the", "stood (at) home, waiting",
        f"{r.randint(1, 255)}.{r.randint(1, 255)}.{r.randint(100, 255)}.{r.randint(100, 255)}", f"version 2.0.{_digits(r, 3)} 20{_digits(r, 2)}-0{_digits(r, 1)}-1{_digits(r, 1)}"))


def examples(contexts: list[str], seed: int = 7, n: int = 4 * TRAIN_TEXTS) -> tuple[np.ndarray, np.ndarray]:
    """Labelled candidates of ``n`` made texts."""
    r = random.Random(seed)
    xs, ys = [], []
    for _ in range(n):
        c = r.choice(contexts)
        cut = r.randrange(len(c) + 1)
        real = r.random() < 0.5
        insert = made_personal(r)[1] if real else made_look_alike(r)
        text = f"{c[:cut].rstrip()} {insert} {c[cut:].lstrip()}"
        s, e = text.find("\x01"), text.find("\x02") - 1
        text = text.replace("\x01", "").replace("\x02", "")
        lo, hi = cut - 1, cut + len(insert) + 2
        for kind, a, b in candidates(text):
            if real and (a, b) == (s, e):
                xs.append(features(text, kind, a, b))
                ys.append(1.0)
            elif not real and a < hi and b > lo:
                xs.append(features(text, kind, a, b))
                ys.append(0.0)
    return np.array(xs, float).reshape(len(xs), -1), np.array(ys, float)


def train(docs: DataFrame, texts: int = TRAIN_TEXTS, seed: int = 7) -> Boosted:
    """Fits on candidates in the sampled contexts and calibrates on a third that the trees don't see."""
    own = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("i"), F.substring(F.col("text").cast("string"), 1, TRAIN_CHARS).alias("t"))
    # a share of the hashes that leaves some times what is wanted, so that tasks send little however many they are
    share = min(1.0, 8 * texts / max(1, docs.count()))
    some = own.withColumn("h", F.xxhash64("i")).where(F.abs(F.col("h") % 1_000_000) < math.ceil(share * 1_000_000))
    rows = some.where("t IS NOT NULL").orderBy("h", "t").limit(texts).collect()
    contexts = [re.sub(r"(?i)[0-9@+]|[(\[]at[)\]]|\x01|\x02", "", r["t"]) for r in rows] or ["a plain text without any personal data"]
    x, y = examples(contexts, seed, 4 * texts)
    held = np.arange(len(y)) % 3 == 0
    return Boosted().fit(x[~held], y[~held]).calibrate(x[held], y[held])


def method_spans(text: str, model: Boosted, base=()) -> list[tuple[str, int, int]]:
    """Selected candidates. Those that a base span holds add nothing and aren't scored."""
    starts = sorted((s, e) for _, s, e in base)
    reach = list(accumulate((e for _, e in starts), max))  # the farthest end of the base spans so far
    held = lambda c: (k := bisect_right(starts, (c[1], math.inf))) > 0 and reach[k - 1] >= c[2]
    found = [c for c in candidates(text) if not held(c)]
    if not found:
        return []
    scores = model.score(np.array([features(text, *c) for c in found], float))
    return [c for c, s in zip(found, scores.tolist(), strict=True) if s >= model.threshold]


def ordered(spans) -> list[tuple[str, int, int]]:
    return sorted(set(spans), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans) -> str:
    """Each stretch of overlapping spans becomes the name of its first kind in brackets."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, model: Boosted, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns of ``keep`` (doc_id by default), then __base (spans joined), __spans and __redacted
    (the text); names that are taken get further underscores. No shuffle."""
    keep = ["doc_id"] if keep is None else keep
    added = [free(c, docs.columns) for c in ("__base", "__spans", "__redacted")]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred nodes

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in it:
            base, spans, texts = [], [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                own = ordered(base_spans(t or ""))
                every = ordered([*own, *method_spans(t or "", model, own)])
                base.append(joined(own))
                spans.append(joined(every))
                texts.append(t if not every else redact(t, every))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, pa.string()) for c in (base, spans, texts))], [*keep, *added])

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    own = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(free("__text", keep)))
    return own.mapInArrow(run, f"{types}, " + ", ".join(f"{c} string" for c in added))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_sha256 and spans of every document."""
    own = own_columns(docs, "doc_id", "text")
    found = find(own, train(own))
    parts = F.split("__base", ",")
    count = lambda k: F.size(F.filter(parts, lambda x: x.startswith(k + ":"))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(F.col("__base").cast("binary"), 256).alias("base_sha256"), F.col("__spans").alias("spans"))
