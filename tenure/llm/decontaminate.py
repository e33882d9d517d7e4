"""Benchmark decontamination with a broadcast set of normalised n-grams.

Benchmark items become windows of ``width`` normalised words (an item of fewer words is one window). Their vocabulary
and the windows, as polynomial hashes over word numbers, are broadcast. A document is scanned once: words are looked up
in the vocabulary, runs of known words are hashed window by window, and a window whose hash is in the set is verified
word by word against the items before it counts. Documents are never shuffled.

The broadcast has a checked size: items are cut into blocks of at most ``block_words`` words, each block is a query set
that is run against all documents, and the hits of the blocks are united per document. All blocks but the last write down
what they hit, by the SHA-256 of the text: no text is written, and copies of a text are one row.

Edge cases: null and empty texts have no words, no hits and are not contaminated; items without words are no windows;
an item with a null id still hits words but is not listed; repeated items and rows are each counted or returned; an
empty benchmark hits nothing. Other columns of the input are kept by ``remove``, whatever their names, and not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_small, materialize

#: A-Z to lower case; digits, a-z and all bytes of non-ASCII characters stay; the rest separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BASE = 0x9E3779B97F4A7C15
SCAN = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.LongType())), T.StructField("spans", T.ArrayType(T.IntegerType())),
])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Windows:
    """The different windows of a block of benchmark items, in flat arrays: about 60 bytes a word beside the vocabulary.

    A window that many items share is held, and verified, once, with the list of its items.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        texts = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)] for _, text in items]
        self.flat = np.array([i for ids in texts for i in ids], dtype=np.uint32)
        lengths = np.array([len(ids) for ids in texts], dtype=np.int64)
        begins = np.concatenate([[0], lengths.cumsum()])
        owner = np.repeat(np.arange(len(texts)), lengths)
        names = np.array([item for item, _ in items], dtype=object)
        #: By size: hashes in order, a place of each window, and the items of window n from ends[n] to ends[n + 1].
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted(set(np.minimum(lengths, width).tolist()) - {0}):
            of_size = np.minimum(lengths, width)[owner] == size
            starts = np.flatnonzero(of_size & (np.arange(len(owner)) + size <= begins[owner + 1]))
            found = self.hashes(self.flat, starts, size)
            order = found.argsort(kind="stable")
            found, starts = found[order], starts[order]
            first = np.concatenate([[True], found[1:] != found[:-1]])
            of = np.flatnonzero(first)[first.cumsum() - 1]  # the first window of the same hash
            step = 1 << 16  # windows that are compared at once
            for low in range(0, len(starts), step):
                a, b = starts[low : low + step, None] + np.arange(size), starts[of[low : low + step], None] + np.arange(size)
                first[low : low + step] |= (self.flat[a] != self.flat[b]).any(axis=1)  # another window of that hash stands alone
            ends = np.append(np.flatnonzero(first), len(starts))
            self.by_size[size] = found[ends[:-1]], starts[ends[:-1]], ends, names[owner[starts]]

    @staticmethod
    def hashes(ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Polynomial hash of the windows that begin at ``starts``."""
        h = np.zeros(len(starts), dtype=np.uint64)
        for k in range(size):
            h = h * np.uint64(BASE) + ids[starts + k]
        return h ^ (h >> np.uint64(32))

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words are hit, and the items found."""
        hit, items, seen = np.zeros(len(words) + 1, dtype=np.int32), set(), set()
        ids = np.fromiter(map(self.vocabulary.get, words, iter(int, 1)), dtype=np.uint64, count=len(words))
        known = np.concatenate([[0], (ids > 0).cumsum()])
        for size, (hashes, places, ends, owners) in self.by_size.items():
            starts = np.flatnonzero(known[size:] - known[:-size] == size) if len(words) >= size else ()
            if not len(starts):
                continue
            found = self.hashes(ids, starts, size)
            first, last = np.searchsorted(hashes, found), np.searchsorted(hashes, found, side="right")
            for n in np.flatnonzero(first < last):
                i = starts[n]
                for at in range(first[n], last[n]):
                    if (self.flat[places[at] : places[at] + size] == ids[i : i + size]).all():
                        hit[i] += 1
                        hit[i + size] -= 1
                        if (size, at) not in seen:
                            seen.add((size, at))
                            items.update(owners[ends[at] : ends[at + 1]])
        return hit.cumsum()[:-1] > 0, items


def blocks_of(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple]]:
    """Items in blocks of bounded size, streamed to the driver a partition at a time."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        n = 1 + len(words_of(r["text"]))  # an item without words takes room too
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    yield block


def spans_of(hit: np.ndarray) -> list[int]:
    """Starts and ends of the runs of hit words, flat."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge).tolist()


def scanned(documents: DataFrame, benchmark: DataFrame, width: int, block_words: int) -> DataFrame:
    """``row`` (a document with its columns) and ``scan``: words, hit words, sorted items and spans of hit words."""
    context, none = documents.sparkSession.sparkContext, F.lit(None)
    rows = documents.select(F.struct(*documents.columns).alias("row"), "text")
    rows = rows.withColumns({"items": none.cast(SCAN["items"].dataType), "spans": none.cast(SCAN["spans"].dataType)})
    blocks, earlier = blocks_of(benchmark, block_words), []
    block = next(blocks)
    for following in blocks:
        earlier.append(_hits(documents, context.broadcast(Windows(block, width))))
        block = following
    if earlier:
        every = reduce(DataFrame.unionByName, earlier).groupBy("digest")  # a row a block and text
        known = every.agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
        rows = join_small(rows.select("row", "text", _digest()), materialize(known), ["digest"])
    return rows.select("row", scan_of(context.broadcast(Windows(block, width)))("text", "items", "spans").alias("scan"))


def _digest():
    return F.sha2(F.col("text").cast("binary"), 256).alias("digest")


def _hits(documents: DataFrame, shared) -> DataFrame:
    """``digest``, ``items`` and ``spans`` of each different text that a block hits, written down."""
    none = F.lit(None)
    scan = scan_of(shared).asNondeterministic()  # run once, not for the filter and again for the columns
    found = documents.where("text is not null").select(
        _digest(), scan("text", none.cast(SCAN["items"].dataType), none.cast(SCAN["spans"].dataType)).alias("scan")
    )
    return materialize(found.where("scan.n_hit > 0").select("digest", "scan.items", "scan.spans").dropDuplicates(["digest"]))


def scan_of(shared):
    """The UDF that scans texts for the broadcast windows and unites the hits with the items and spans of blocks before."""

    @F.pandas_udf(SCAN)
    def scan(texts: pd.Series, known: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, before, flat in zip(texts, known, spans, strict=True):
            words = words_of(text)
            hit, items = shared.value.scan(words)
            items |= set(before if before is not None else ())
            flat = flat if flat is not None else ()
            for a, b in zip(flat[::2], flat[1::2], strict=True):
                hit[a:b] = True
            rows.append((len(words), int(hit.sum()), sorted(i for i in items if i is not None), spans_of(hit)))
        return pd.DataFrame(rows, columns=SCAN.names)

    return scan


def contaminated(n_hit, n_words):
    """The contract's rule: some word is hit, and at least a twentieth of the words are."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(documents: DataFrame, benchmark: DataFrame, *, width: int = 13, block_words: int = 1_000_000) -> DataFrame:
    """Per document: ``n_words``, ``n_hit``, ``n_items``, ``items`` (ids), ``spans`` and ``contaminated``."""
    out = scanned(documents.select("doc_id", "text"), benchmark, width, block_words).select("row.doc_id", "scan.*")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans",
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def items_digest(items: str = "items"):
    """SHA-256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ",").cast("binary"), 256)


def remove(
    documents: DataFrame, benchmark: DataFrame, *, spans: bool = False, width: int = 13, block_words: int = 1_000_000
) -> DataFrame:
    """Without contaminated documents; or, with ``spans``, with the hit words cut out of every text that has some.

    Cutting replaces each run of hit words, and what separates them, by one space; all other characters stay.
    """
    found = scanned(documents, benchmark, width, block_words)
    if not spans:
        return found.where(~contaminated(F.col("scan.n_hit"), F.col("scan.n_words"))).select("row.*")

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series, flat: pd.Series) -> pd.Series:
        return pd.Series([cut_spans(t, s) for t, s in zip(texts, flat, strict=True)])

    text = F.when(F.size("scan.spans") > 0, cut("row.text", "scan.spans")).otherwise(F.col("row.text"))
    return found.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in documents.columns])


def cut_spans(text: str | None, flat) -> str | None:
    """``text`` without the words of the flat list of (start, end) word numbers."""
    if text is None or not len(flat):
        return text
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.frombuffer(raw.translate(FOLD), dtype=np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    starts, ends, out, at = edge[::2], edge[1::2], [], 0
    for a, b in zip(flat[::2], flat[1::2], strict=True):
        out += [raw[at : starts[a]], b" "]
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def digest(items: list[int]) -> str:
    """The same digest in Python, for tests."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
