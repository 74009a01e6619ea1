"""URL filters: a bit-parallel wildcard automaton.

Glob patterns (``*`` any run, ``?`` any one character, all else itself) are packed one after the other into
64-bit words, a bit a character. One Shift-And step per character advances all patterns at once, over all
urls of a batch; a bit whose pattern goes on with ``*`` keeps itself set. A pattern matches a whole
canonical url, host/path or host/path?query: without user part, default port and fragment, ASCII letters in lower
case, escapes of unreserved characters decoded, dot segments resolved. Patterns that allow win over patterns that
block; no match is allowed.

Before the patterns, explicit (host, path) rules: a rule fits its host and all subdomains if the url's path
starts with its path, and the longest rule wins. Null urls and urls without ``://`` have an empty host and
path, which fit no rule, and the canonical url ``/``. Repeated rows are judged alike; an empty table gives no rows;
extra columns are ignored. No shuffle, and whole urls of any length.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import ship

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Patterns over host/path: spam trades in the host, trackers, adverts, sessions and binaries in the path.
BLOCK = [
    "*casino*/*", "*free-bets*/*", "*cheap-pills*/*", "*viagra*/*", "*poker*/*", "*payday*/*", "*xxx*/*", "*porn*/*", "*replica-*/*", "*essay-writ*/*", "ads.*/*", "*.ads.*/*", "ad.doubleclick.*/*",
    "*/ads/*", "*/banner/*", "*/click/*", "*/tracker/*", "*/cgi-bin/*", "*/wp-login.php", "*.exe", "*.zip", "*.apk", "*.iso", "*/login", "*/signup", "*/cart/*", "*/checkout/*",
]
ALLOW = ["*.gov/*", "*.edu/*", "*/robots.txt"]


class Automaton:
    """Shift-And over packed glob patterns."""

    def __init__(self, patterns: list[str]):
        chars: list[str] = []  # the characters of all patterns
        loop: list[int] = []  # bits that a following * keeps
        first: list[int] = []  # first bits
        free: list[int] = []  # first bits of patterns with a leading *
        self.ends: list[int] = []
        self.all_match = [i for i, p in enumerate(patterns) if p and not p.strip("*")]
        self.empty = [i for i, p in enumerate(patterns) if not p]
        for p in patterns:
            start, lead = len(chars), False
            for c in p:
                if c != "*":
                    chars.append(c)
                elif len(chars) > start:
                    loop.append(len(chars) - 1)
                else:
                    lead = True
            if len(chars) > start:
                first.append(start)
                free += [start] * lead
            self.ends.append(len(chars) - 1 if len(chars) > start else -1)
        self.words = max(1, -(-len(chars) // 64))
        self.first, self.free, self.loop = (self._mask(x) for x in (first, free, loop))
        self.heads = self.first
        alphabet = sorted(set(chars) - {"?"})
        self.codes = np.array([ord(c) for c in alphabet], np.uint32)
        any_ = [i for i, c in enumerate(chars) if c == "?"]
        # row 0: a character that no pattern names
        self.table = np.stack([self._mask(any_), *[self._mask([i for i, c in enumerate(chars) if c in (a, "?")]) for a in alphabet]])

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1) << np.uint64(b % 64)
        return out

    def matches(self, texts: list[str], room: int = 1 << 22) -> np.ndarray:
        """texts x patterns: whether each pattern matches each whole text. Texts go by length, in bounded batches."""
        hit = np.zeros((len(texts), len(self.ends)), bool)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        at = 0
        while at < len(order):
            n = at + 1
            while n < len(order) and (n + 1 - at) * (len(texts[order[n]]) + 1) <= room:
                n += 1
            self._run([texts[i] for i in order[at:n]], np.array(order[at:n]), hit)
            at = n
        hit[:, self.all_match] = True
        hit[np.ix_([i for i, t in enumerate(texts) if not t], self.empty)] = True
        return hit

    def _run(self, texts: list[str], rows: np.ndarray, hit: np.ndarray) -> None:
        lengths = np.array([len(t) for t in texts])
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.searchsorted(self.codes, flat) if len(self.codes) else np.zeros(len(flat), np.int64)
        kind = np.where(self.codes[np.minimum(kind, len(self.codes) - 1)] == flat, kind + 1, 0) if len(self.codes) else kind
        starts = np.cumsum(lengths) - lengths
        state = np.zeros((len(texts), self.words), np.uint64)
        done = np.zeros_like(state)
        one, top = np.uint64(1), np.uint64(63)
        live = np.searchsorted(lengths, 1)  # texts are in order of length: rows from here on have this character
        done[:live] = 0
        for i in range(int(lengths.max(initial=0))):
            s = state[live:]
            shifted = s << one
            shifted[:, 1:] |= s[:, :-1] >> top  # carry into the next word
            shifted &= ~self.heads  # no carry from one pattern into the next
            shifted |= self.first if i == 0 else self.free
            s = (shifted & self.table[kind[starts[live:] + i]]) | (s & self.loop)
            state[live:] = s
            ended = int(np.searchsorted(lengths, i + 1, side="right"))
            done[live:ended] = state[live:ended]
            live = ended
        for p, end in enumerate(self.ends):
            if end >= 0:
                hit[rows, p] = (done[:, end // 64] >> np.uint64(end % 64)) & one == 1


#: Characters whose escapes mean the same as themselves, by the lower-cased two digits of the escape.
UNRESERVED = {f"{ord(c):02x}": c.lower() for c in string.ascii_letters + string.digits + "-._~"}
#: The port that each scheme has by itself.
PORTS = {"http": "80", "https": "443"}
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def _decoded(text: str) -> str:
    head, *parts = text.split("%")
    return head + "".join(UNRESERVED[p[:2]] + p[2:] if p[:2] in UNRESERVED else f"%{p}" for p in parts)


def canonical(url: str | None) -> tuple[str, str]:
    """The url as host/path, and with its query, if it has one, as host/path?query; / for what is no url."""
    scheme, mark, rest = (url or "").translate(_LOWER).partition("://")
    if not mark:
        return "/", "/"
    rest = rest.partition("#")[0]
    cut = re.search(r"[/?]|\Z", rest).start()
    host, rest = rest[:cut].rpartition("@")[2], rest[cut:]
    name, colon, port = host.rpartition(":")
    if colon and port in ("", PORTS.get(scheme)):
        host = name
    path, asked, query = rest.partition("?")
    path = _decoded(path) if "%" in path else path
    if "/." in path:
        kept: list[str] = []
        parts = path.split("/")[1:]
        for part in parts:
            if part == "..":
                del kept[-1:]
            elif part != ".":
                kept.append(part)
        path = "/" + "/".join([*kept, ""] if parts[-1] in (".", "..") else kept)
    whole = host + (path or "/")
    return whole, f"{whole}?{_decoded(query)}" if asked and query else whole


def _judge(block: list[str], allow: list[str]):
    machine = Automaton([*allow, *block])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [canonical(u) for u in batch.column(0).to_pylist()]
            hit = machine.matches([f[0] for f in forms])
            asked = [i for i, f in enumerate(forms) if f[0] != f[1]]
            hit[asked] |= machine.matches([forms[i][1] for i in asked])
            good, bad = hit[:, : len(allow)], hit[:, len(allow) :]
            which = np.where(bad.any(axis=1) & ~good.any(axis=1), bad.argmax(axis=1) if bad.shape[1] else 0, -1)
            names = [block[i] if i >= 0 else None for i in which]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string())], [*batch.schema.names[1:], "pattern"])

    return run


def _rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule, as a struct (rule, verdict)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge_urls(urls: DataFrame, rules=RULES, block=BLOCK, allow=ALLOW) -> DataFrame:
    """page_id, host, path, rule, verdict and the pattern that blocked, if one did."""
    ship(urls.sparkSession)
    url = F.coalesce(F.col("url"), F.lit(""))
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*+)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)
    df = urls.select(F.col("url").alias("_u"), "page_id", host.alias("host"), path.alias("path"))
    df = df.mapInArrow(_judge(block, allow), "page_id long, host string, path string, pattern string")
    df = df.withColumn("_r", _rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_r.verdict"), F.when(F.col("pattern").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return df.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "pattern")
