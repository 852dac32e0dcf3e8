"""URL filters: a bit-parallel wildcard automaton.

Globs are packed one after another into the bits of several 64-bit words
(Shift-And). One step per byte moves every pattern of every url of a batch at
once, as numpy operations over the batch.

In a glob ``*`` stands for any bytes without ``/`` and ``**`` for any bytes.

The given rules see ``host + path`` as they stand. The method's globs see a canonical
form: escapes decoded (twice, as some are escaped again), lower case, without
user, port and trailing dots; a path without empty and dot segments; the host's
words between ``-`` (``-www-free-bets-net-``), the path's segments between ``/``. So a
glob names a whole word of a host or a whole segment of a path, not letters within.

Defined cases: a null url, or one without ``://``, has an empty host and path,
no rule, and the verdict of the default. Empty tables give empty results.
Repeated rows are each judged. Bytes outside ASCII are matched as UTF-8.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import own_columns

#: (verdict, host and its subdomains, path prefix): fixed values.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Words of hosts that name a kind of site, asked for only where no rule fits.
HOST_WORDS = {
    "gambling": ("casino", "casinos", "poker", "slots", "roulette", "jackpot", "betting", "bets"),
    "pharmacy": ("pills", "viagra", "cialis", "pharmacy"),
    "adult": ("porn", "porno", "xxx", "adult", "sex", "escort"),
    "advertising": ("ads", "adserver", "adtrack", "popunder"),
    "spam": ("spam", "malware", "phishing", "warez"),
}
#: Segments of paths that hold no text of their own, and ends of files.
PATH_SEGMENTS = ("wp-login.php", "cgi-bin", "print", "search", "casino", "viagra", "porn", "xxx")
FILE_ENDS = ("exe", "zip", "iso")
BLOCK_GLOBS = (*(f"*-{w}-*/**" for words in HOST_WORDS.values() for w in words), *(f"**/{s}/**" for s in PATH_SEGMENTS), *(f"**.{e}/" for e in FILE_ENDS))

SCHEMA = "page_id long, host string, path string, rule string, verdict string"


@dataclass(frozen=True)
class Rule:
    glob: str
    verdict: str
    name: str | None  # None: a glob of the method
    length: int


def host_rules(rules: Iterable[Sequence[str]] = RULES) -> list[Rule]:
    """Two globs a rule: the host itself, and its subdomains."""
    return [Rule(prefix + host + path + "**", verdict, host + path, len(host + path))
            for verdict, host, path in rules for prefix in ("", "*.")]


def method_rules(globs: Iterable[str] = BLOCK_GLOBS) -> list[Rule]:
    return [Rule(g, "block", None, 0) for g in globs]


class ShiftAnd:
    """All globs at once. Bit p of the state: the pattern is matched up to its element p."""

    def __init__(self, globs: Sequence[str]):
        chars: list[int] = []  # the byte that moves a bit on
        start, last, stay, stay_seg = [], [], [], []
        for g in globs:
            body: list[tuple[int | None, int]] = []  # (byte, kind of the star behind it)
            lead = 0
            for part in re.findall(rb"\*\*|\*|[^*]", g.encode(), re.S):
                if part in (b"*", b"**"):
                    kind = len(part)
                    if body:
                        body[-1] = (body[-1][0], max(kind, body[-1][1]))
                    else:
                        lead = max(lead, kind)
                else:
                    body.append((part[0], 0))
            # Element 0 is the empty prefix; it holds the star in front.
            start.append(len(chars))
            for byte, kind in [(None, lead), *body]:
                (stay if kind == 2 else stay_seg if kind == 1 else []).append(len(chars))
                chars.append(-1 if byte is None else byte)
            last.append(len(chars) - 1)
        self.words = max(1, -(-len(chars) // 64))
        self.accept = last
        self.move = np.zeros((256, self.words), np.uint64)
        self.hold = np.zeros((256, self.words), np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        for p, byte in enumerate(chars):
            if byte >= 0:
                self.move[byte, p >> 6] |= np.uint64(1 << (p & 63))
        for p in start:
            self.first[p >> 6] |= np.uint64(1 << (p & 63))
        for where, skip in ((stay, ()), (stay_seg, b"/")):
            for p in where:
                bit = np.uint64(1 << (p & 63))
                self.hold[:, p >> 6] |= bit
                for c in skip:
                    self.hold[c, p >> 6] &= ~bit

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """A row of booleans, one for each glob, for each text."""
        n = len(texts)
        size = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-size, kind="stable")
        size = size[order]
        flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        begin = np.concatenate(([0], np.cumsum(size)))[:-1]
        state = np.repeat(self.first[None, :], n, axis=0)
        live = n
        for j in range(int(size[0]) if n else 0):
            live = int(np.searchsorted(-size[:live], -j, side="left"))  # urls longer than j
            c = flat[begin[:live] + j]
            s = state[:live]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)  # from one word to the next
            state[:live] = (moved & self.move[c]) | (s & self.hold[c])
        out = np.zeros((n, len(self.accept)), bool)
        for k, p in enumerate(self.accept):
            out[order, k] = (state[:, p >> 6] >> np.uint64(p & 63)) & np.uint64(1) != 0
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path, as they stand."""
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]


def unescaped(s: str) -> str:
    for _ in range(2):
        s = unquote(s, errors="replace")
    return s.lower()


def canonical(host: str, path: str) -> str:
    """``-words-of-the-host-/segments/of/the/path/``; empty if both are."""
    if not host and not path:
        return ""
    host = re.sub(r":[0-9]*\Z", "", unescaped(host).rpartition("@")[2])
    segments: list[str] = []
    for s in unescaped(path).replace("\\", "/").split("/"):
        if s == "..":
            del segments[-1:]
        elif s not in ("", "."):
            segments.append(s)
    return "-" + re.sub(r"[^a-z0-9\x80-\U0010FFFF]+", "-", host).strip("-") + "-/" + "".join(f"{s}/" for s in segments)


def judge(rules: Sequence[Rule], urls: Sequence[str | None], default: str = "allow", automaton: ShiftAnd | None = None):
    """(host, path, rule or None, verdict) of each url: the longest fitting rule, of equal ones a
    block; else a block if a glob of the method fits its canonical form; else the default."""
    automaton = automaton or ShiftAnd([r.glob for r in rules])
    parts = [split_url(u) for u in urls]
    raw = np.array([r.name is not None for r in rules], bool)
    hits = automaton.match([(h + p).encode("utf-8", "surrogatepass") for h, p in parts]) & raw
    if not raw.all():
        hits |= automaton.match([canonical(h, p).encode("utf-8", "surrogatepass") for h, p in parts]) & ~raw
    rank = sorted(range(len(rules)), key=lambda k: (-rules[k].length, rules[k].verdict != "block"))
    hits = np.concatenate([hits[:, rank], np.ones((len(urls), 1), bool)], axis=1)
    for (host, path), k in zip(parts, hits.argmax(axis=1).tolist(), strict=True):
        r = rules[rank[k]] if k < len(rank) else Rule("", default, None, 0)
        yield host, path, r.name, r.verdict


def filter_urls(pages: DataFrame, rules: Sequence[Rule] | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``. No shuffle."""
    rules = list(rules) if rules is not None else [*host_rules(), *method_rules()]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd([r.glob for r in rules])
        for b in it:
            rows = list(judge(rules, b.column("url").to_pylist(), default, automaton))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), *[pa.array(c, pa.string()) for c in cols]],
                                             ["page_id", "host", "path", "rule", "verdict"])

    own = own_columns(pages, "page_id", "url")
    return own.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(batches, SCHEMA)


ORACLE = r"""
WITH u AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS rawhost,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
h AS (SELECT page_id, translate(rawhost, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path,
             regexp_replace(regexp_replace(lower(url_decode(url_decode(rawhost))), '(?s)^.*@', ''), ':[0-9]*$', '') AS plain_host,
             regexp_replace(replace(lower(url_decode(url_decode(path))), '\', '/') || '/', '/(\./|/)+', '/', 'g') AS p0 FROM u),
p1 AS (SELECT *, regexp_replace(p0, '/([^/.][^/]*|\.[^/.][^/]*)/\.\./', '/', 'g') AS a FROM h),
p2 AS (SELECT *, regexp_replace(a, '/([^/.][^/]*|\.[^/.][^/]*)/\.\./', '/', 'g') AS b FROM p1),
c AS (SELECT page_id, host, path, '-' || trim(regexp_replace(plain_host, '[^a-z0-9\x{80}-\x{10FFFF}]+', '-', 'g'), '-') || '-' AS words, regexp_replace(b, '^(/\.\.)+', '') AS segments FROM p2),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, verdict DESC) AS k
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT c.page_id, c.host, c.path, m.rule,
       coalesce(m.verdict, CASE WHEN regexp_matches(words, '-(casinos?|poker|slots|roulette|jackpot|betting|bets|pills|viagra|cialis|pharmacy|porno?|xxx|adult|sex|escort|ads|adserver|adtrack|popunder|spam|malware|phishing|warez)-')
           OR regexp_matches(segments, '/(wp-login\.php|cgi-bin|print|search|casino|viagra|porn|xxx)/') OR regexp_matches(segments, '\.(exe|zip|iso)/$')
         THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN m ON m.page_id = c.page_id AND m.k = 1
"""
