"""Secret scans: keyword automaton, anchored patterns near its hits, then checksums embedded in tokens.

One Aho-Corasick pass over the text, folded to lower case, finds keywords; a pattern is tried only at a hit. Runs of
hexadecimal digits have no keyword of their own: the text is folded to two letters (digit or not), in which sixteen
digits are one keyword. Kinds of the method beside the base ones: ``github`` and ``npm`` tokens, kept only if the CRC-32
in their last six characters fits, and ``pem`` private-key blocks.

Spans are in code points, the end exclusive. Base spans are the leftmost non-overlapping matches of their kind, and a
match that fails its length check still takes its characters.

Edge cases: null and empty texts have no spans and the digest of an empty string; repeated rows are scanned each; an
empty table gives an empty result. Other columns of the input are kept by ``redact`` and not looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The kinds in their order, the patterns of the contract and the alphabet of the token checksums.
KINDS = ("assign", "access", "hex", "github", "npm", "pem")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
    "-----begin ": "pem",
}
PATTERNS = {
    "assign": re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
    "github": re.compile(r"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])"),
    "npm": re.compile(r"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])"),
    "pem": re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----[A-Za-z0-9+/=:,\s-]*?-----END \1-----"),
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Folds bytes to hexadecimal digits (h) and others.
DIGITS = bytes(104 if chr(b) in "0123456789abcdef" else 46 for b in range(256))
HEX = 16
FOUND = T.StructType([
    *[T.StructField(f"n_{k}", T.LongType()) for k in ("assign", "access", "hex")],
    T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
])


def checksum_fits(body: str) -> bool:
    """The last six characters are the base-62 CRC-32 of those before."""
    value, tail = zlib.crc32(body[:-6].encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        tail = BASE62[digit] + tail
    return tail == body[-6:]


CHECKS = {
    "assign": lambda m: len(m[1]) >= 12,
    "access": lambda m: len(m[0]) >= 18,
    "hex": lambda m: len(m[0]) >= HEX,
    "github": lambda m: checksum_fits(m[1]),
    "npm": lambda m: checksum_fits(m[1]),
    "pem": lambda m: True,
}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        out.add_word(word, (len(word), kind))
    out.make_automaton()
    return out


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, kind's place in KINDS, end, kind) of all spans of a whole text, sorted."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    hits = [(end - size + 1, kind) for end, (size, kind) in automaton().iter(raw.lower().decode("utf-8", "surrogatepass"))]
    folded, run, byte, point = raw.translate(DIGITS), b"h" * HEX, 0, 0
    while (at := folded.find(run, byte)) >= 0:
        point += len(raw[byte:at].decode("utf-8", "surrogatepass"))
        hits.append((point, "hex"))
        stop = folded.find(b".", at)
        stop = len(folded) if stop < 0 else stop
        byte, point = stop, point + stop - at
    spans, taken = [], dict.fromkeys(KINDS, 0)
    for start, kind in sorted(hits):
        if start >= taken[kind] and (m := PATTERNS[kind].match(text, start)):
            taken[kind] = m.end()
            if CHECKS[kind](m):
                spans.append((start, KINDS.index(kind), m.end(), kind))
    return sorted(spans)


def listed(spans: list[tuple]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


@F.pandas_udf(FOUND)
def found(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        spans = find(text)
        base = [s for s in spans if s[1] < 3]
        counts = [sum(s[1] == k for s in base) for k in range(3)]
        rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
    return pd.DataFrame(rows, columns=FOUND.names)


def scan(documents: DataFrame) -> DataFrame:
    """``doc_id``, the numbers of base spans, ``base_sha256`` and ``spans`` of every document."""
    return documents.select("doc_id", found("text").alias("f")).select("doc_id", "f.*")


def redact(documents: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The documents with every span replaced; overlapping spans are replaced as one."""

    @F.pandas_udf(T.StringType())
    def redacted(texts: pd.Series) -> pd.Series:
        return pd.Series([_masked(t, mask) for t in texts])

    return documents.withColumn("text", redacted("text"))


def _masked(text: str | None, mask: str) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for start, _, end, _ in find(text):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])
