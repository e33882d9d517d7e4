"""Removal of repeated byte strings by prefix doubling over sampled positions.

A byte is removed if a string of ``SPAN`` bytes that covers it also starts earlier. Ranking every position would sort
each byte of the corpus some seven times; instead positions are sampled by content, so that equal strings have equal
samples, and ranks are formed for these:

1. *Names.* Within a task strings get names by doubling: 8 bytes are a number, a name of 16, 32 and then ``GRAM`` bytes
   is the name of a pair of names at growing offsets. A string of SPAN bytes is represented by its anchor, the GRAM bytes
   in it of the least name (the first of equal ones). The starts that share an anchor are a run; the bytes of its
   strings are its extent. A batch keeps the first of equal extents and marks the others, so a string that a third of all
   documents hold leaves a task once a batch.
2. *First sort.* Spark sorts (name of the anchor, name of the extent, position). An anchor whose name is unique leaves:
   nothing that covers it repeats. Of equal extents all but the first are repeats. Different extents of one name go on.
3. *Doubling.* The strings of a run have GRAM bytes about the anchor in common. A quarter of the run has more bytes in
   common, the old ones and the block beside them, and its rank is renewed from the pair (rank, block): from 50 to 88, 97
   and 100 bytes, so that what is lacking shrinks to a quarter a round. Each round sorts (new rank, content, position) and
   drops what is unique or settled, until runs are single starts, whose strings have SPAN bytes and are compared as they are.
4. *Cut.* Documents are sorted beside their marks and read in a stream.

Sorts are by ranges of (rank, content), so neither a common rank nor a long document lands in one task: a rank that lies
on both sides of a range's edge is taken for shared there and settled by the next round. What is settled leaves at
once, rounds are written to the shared folder, and nothing is collected.

Names have 64 bits. A coincidence of two names can only keep a position a round longer, but for equal extents, which are
told by the names of their anchor and of their whole extent together (128 bits). The last rounds compare bytes.

Edge cases: null and empty texts have no bytes and nothing is removed; so have texts below SPAN bytes. Matches lie within
a text. Rows of one doc_id, repeated rows among them, come in the table's order, null ids first; so a second equal row of
at least SPAN bytes is removed whole. Texts of any length are read in pieces. An empty table gives no row. Other columns
of the input are not looked at. ``documents`` has to give the same rows in the same partitions whenever it is read, as
a scan of files does; write other frames down first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPAN, GRAM = 100, 50
#: Starts that share an anchor lie at offsets 0 to RUN - 1 before it.
RUN = SPAN - GRAM + 1
#: Parts of a run in the next round.
WAYS = 4
#: Bytes whose anchors are formed at once (arrays fit a core's cache), bytes that a batch compares, and the bits of a place.
PIECE, BATCH, PLACE = 1 << 17, 8 << 20, np.uint64(20)
#: Rows that a task hands on at once.
ROWS = 1 << 14
A, B = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
S28, S32 = np.uint64(28), np.uint64(32)

RUNS = "name long, tag long, ord long, row long, start long, n long, hi int"
ITEMS = "name long, tag long, ord long, row long, start long, n long, hi int, low int, high int, body binary"
KEY = ["name", "tag", "ord", "row", "start"]


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of two names side by side."""
    x = a * A
    x ^= x >> S32
    x += b
    x *= B
    x ^= x >> S28
    x *= A
    x ^= x >> S32
    return x


def grams(text: np.ndarray) -> np.ndarray:
    """Names of all strings of GRAM bytes, by doubling from eight; the last pair overlaps."""
    if len(text) < GRAM:
        return np.empty(0, np.uint64)
    x, n = np.ndarray(len(text) - 7, "<u8", text, strides=(1,)).astype(np.uint64), 8
    while n < GRAM:
        step = min(n, GRAM - n)
        x, n = pair(x[:-step], x[step:]), n + step
    return x


def anchors(names: np.ndarray) -> np.ndarray:
    """For each start the place of the least name among the next RUN, the first of equal ones."""
    x, n = (names & ~((np.uint64(1) << PLACE) - np.uint64(1))) | np.arange(len(names), dtype=np.uint64), 1
    while n < RUN:
        step = min(n, RUN - n)
        x, n = np.minimum(x[:-step], x[step:]), n + step
    return (x & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text's number, first start, starts, offset of the first start to its anchor, anchor's name, extent's name) of the runs."""
    pieces = [(i, at, t[at : at + PIECE + SPAN - 1]) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - SPAN + 1), PIECE) if len(t) >= SPAN]
    found = [[np.empty(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)]]
    many: list = []
    size = 0
    for k, piece in enumerate(pieces):
        many.append(piece)
        size += len(piece[2])
        if size < PIECE and k + 1 < len(pieces):
            continue
        text = np.frombuffer(b"".join(p[2] for p in many), np.uint8)
        length = np.array([len(p[2]) for p in many])
        base = np.cumsum(length) - length
        names = grams(text)
        least = anchors(names)
        inside = np.ones(len(least), bool)
        for b in base[1:]:
            inside[b - SPAN + 1 : b] = False  # strings across two pieces
        start = np.flatnonzero(inside)
        a = least[start]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        n = np.diff(np.concatenate([first, [len(a)]]))
        s, a = start[first], a[first]
        whole = lambda at: pair(names[at], names[at + SPAN - GRAM])  # noqa: B023, E731
        extent = pair(pair(whole(s), whole(s + n - 1)), (n << 8 | (a - s)).astype(np.uint64))
        at = np.searchsorted(base, s, "right") - 1
        found.append([np.array([p[0] for p in many])[at], np.array([p[1] for p in many])[at] + s - base[at], n, a - s, names[a], extent])
        many, size = [], 0
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def joined(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals in order of row and start, those that touch made one."""
    if not len(row):
        return row, start, end
    # ends grow with starts within a row here, as all intervals are unions of strings of SPAN bytes
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > end[:-1])])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(row) - 1]])
    return row[new], start[new], end[last]


def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of documents (row, ord, body); of equal extents within a batch the first, and marks for the others."""

    def formed(docs: list[tuple]) -> Iterator[pa.RecordBatch]:
        docs.sort(key=lambda d: d[:2])
        doc, start, n, hi, name, tag = runs([d[2] for d in docs])
        order = np.lexsort((tag, name))  # keeps positions of equal extents in order
        equal = np.concatenate([[False], (name[order][1:] == name[order][:-1]) & (tag[order][1:] == tag[order][:-1])])
        seen = np.zeros(len(name), bool)
        seen[order] = equal[: len(order)]
        d, s, e = joined(doc[seen], start[seen], (start + n + SPAN - 1)[seen])
        ords, rows = np.array([x[0] for x in docs], np.int64), np.array([x[1] for x in docs], np.int64)
        keep = ~seen
        mark = np.zeros(len(d), np.int64)
        far = pair(rows[d].astype(np.uint64), s.astype(np.uint64)).view(np.int64)  # deals the marks out
        out = pa.RecordBatch.from_pydict(
            {
                "name": np.concatenate([name[keep].view(np.int64), far]),
                "tag": pa.array(np.concatenate([tag[keep].view(np.int64), mark]), mask=np.arange(keep.sum() + len(d)) >= keep.sum()),
                "ord": np.concatenate([ords[doc[keep]], mark]),
                "row": np.concatenate([rows[doc[keep]], rows[d]]),
                "start": np.concatenate([start[keep], s]),
                "n": np.concatenate([n[keep], e - s]),
                "hi": np.concatenate([hi[keep], mark]).astype(np.int32),
            }
        )
        yield from (out.slice(i, ROWS) for i in range(0, len(out), ROWS))

    docs: list[tuple] = []
    size = 0
    for batch in batches:
        for d in zip(*(batch.column(c).to_pylist() for c in ("ord", "row", "body")), strict=True):
            docs.append(d)
            size += len(d[2])
            if size >= BATCH:
                yield from formed(docs)
                docs, size = [], 0
    if docs:
        yield from formed(docs)


def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by KEY: marks (tag null) pass; of equal contents all but the first become marks; of the first ones those go
    on whose rank another content shares, or whose neighbour lies in another range.

    A mark has no name. What goes on keeps its columns. Runs of one start are settled by being first.
    """
    held: pa.Table | None = None  # the last first one, which has to see its successor
    held_shared = True
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        is_mark = rows["tag"].is_null().to_numpy(zero_copy_only=False)
        if is_mark.any():
            yield from _marks(rows.filter(pa.array(is_mark)))
            rows = rows.filter(pa.array(~is_mark))
        if not len(rows):
            continue
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        name, tag = rows["name"].to_numpy(), rows["tag"].to_numpy()
        new = np.concatenate([[True], (name[1:] != name[:-1]) | (tag[1:] != tag[:-1])])
        if "body" in rows.column_names:  # one tag for two contents: both are first
            for i in np.flatnonzero(~new):
                new[i] = rows["body"][i] != rows["body"][i - 1] or rows["hi"][i] != rows["hi"][i - 1]
        yield from _marks(rows.filter(pa.array(~new)), SPAN - 1)
        heads = rows.filter(pa.array(new))
        name = name[new]
        before = np.concatenate([[held_shared], name[1:] == name[:-1]])
        after = np.concatenate([name[1:] == name[:-1], [False]])
        yield from _on(heads.slice(0, len(heads) - 1), (before | after)[:-1])
        held, held_shared = heads.slice(len(heads) - 1), bool(before[-1])
    if held is not None:
        yield from _on(held, np.array([True]))


def _marks(rows: pa.Table, more: int = 0) -> Iterator[pa.RecordBatch]:
    if not len(rows):
        return
    none = {f.name: pa.nulls(len(rows), f.type) for f in rows.schema}
    own = {"row": rows["row"], "start": rows["start"], "n": pa.array(rows["n"].to_numpy() + more)}
    yield from pa.table(none | own, schema=rows.schema).combine_chunks().to_batches()


def _on(heads: pa.Table, shared: np.ndarray) -> Iterator[pa.RecordBatch]:
    if "low" in heads.column_names:
        shared = shared & (heads["low"].to_numpy() < heads["high"].to_numpy())
    yield from heads.filter(pa.array(shared)).combine_chunks().to_batches()


def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with a quarter of their starts each: the rank of the pair (rank, block beside), contents that a batch holds twice marked."""
    schema = pa.schema(
        [(c, pa.int64()) for c in ("name", "tag", "ord", "row", "start", "n")] + [(c, pa.int32()) for c in ("hi", "low", "high")] + [("body", pa.binary())]
    )
    names, tags = xxhash.xxh3_64_intdigest, xxhash.xxh3_64_intdigest
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def split(item: dict) -> Iterator[tuple]:
        start, hi, low, high, body = item["start"], item["hi"], item["low"], item["high"], item["body"]
        lo, size = hi - item["n"] + 1, -(-(high - low + 1) // WAYS)
        for a in range(low, high + 1, size):  # offsets of the part; smaller ones start later
            b = min(high, a + size - 1)
            top, least = min(hi, b), max(lo, a)
            if top < least:
                continue
            own = body[hi - top : hi - least + SPAN]
            # the part's strings have in common what lies from a before the anchor to SPAN - b behind it; the block is what the parent lacked
            block = own[top - a : top - low] + own[top - high + SPAN : top - b + SPAN]
            name = signed(names(block, (item["name"] * 255 + a - low) & 0xFFFFFFFFFFFFFFFF))
            yield name, signed(tags(own, top << 8 | least)), item["ord"], item["row"], start + hi - top, top - least + 1, top, a, b, own

    def formed(items: list[tuple]) -> pa.RecordBatch:
        items.sort(key=lambda x: x[:5])
        marks = [(name, None, None, row, start, n + SPAN - 1, 0, 0, 0, None) for (name, _, _, row, start, n, *_), same in zip(items[1:], _same(items), strict=True) if same]
        kept = items[:1] + [x for x, same in zip(items[1:], _same(items), strict=True) if not same]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, *marks, strict=True), schema, strict=True)], schema=schema)

    items: list[tuple] = []
    size = 0
    for batch in batches:
        for item in batch.to_pylist():
            for x in split(item):
                items.append(x)
                size += len(x[-1])
        if size >= BATCH:
            yield formed(items)
            items, size = [], 0
    if items:
        yield formed(items)


def _same(items: list[tuple]) -> Iterable[bool]:
    """Whether an item has the rank, offset and content of the one before it."""
    return [a[0] == b[0] and a[1] == b[1] and a[6] == b[6] and a[9] == b[9] for a, b in pairwise(items)]


def _each(batches: Iterator[pa.RecordBatch], more: list[str]) -> Iterator[tuple[tuple, bytes, list[tuple]]]:
    """Documents with their marks, of rows in which a document (start null) comes before its marks."""
    doc, marks = None, []
    for batch in batches:
        starts = batch.column("start")
        at = [*np.flatnonzero(starts.is_null().to_numpy(zero_copy_only=False)), len(starts)]
        own = {c: batch.column(c) for c in more}
        if at[0] and doc is not None:
            marks.append((batch, 0, at[0]))
        for i, j in pairwise(at):
            if doc is not None:
                yield *doc, marks
            doc, marks = (tuple(x[i].as_py() for x in own.values()), batch.column("body")[i].as_py()), [(batch, i + 1, j)]
    if doc is not None:
        yield *doc, marks


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The extents of contested runs, from documents beside them."""
    columns = ("name", "ord", "row", "start", "n", "hi")
    for _, text, marks in _each(batches, []):
        for batch, i, j in marks:
            part = batch.slice(i, j - i)
            if not len(part):
                continue
            body = [text[s : s + n + SPAN - 1] for s, n in zip(part.column("start").to_pylist(), part.column("n").to_pylist(), strict=True)]
            own = {c: part.column(c) for c in columns}
            span = {"low": pa.array([0] * len(part), pa.int32()), "high": pa.array([RUN - 1] * len(part), pa.int32()), "body": pa.array(body, pa.binary())}
            yield pa.RecordBatch.from_pydict({"name": own.pop("name"), "tag": pa.nulls(len(part), pa.int64())} | own | span)


def removed(text: bytes, start: np.ndarray, n: np.ndarray) -> tuple[int, int, int, str]:
    """(bytes, bytes removed, maximal removed runs, SHA-256 of the rest) for marks in order of their starts."""
    sha, at, gone, spans = hashlib.sha256(), 0, 0, 0
    if len(start):
        end = np.maximum.accumulate(start + n)
        new = np.concatenate([[True], start[1:] > end[:-1]])
        first, last = start[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])]
        view, spans, gone = memoryview(text), len(first), int((last - first).sum())
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            sha.update(view[at:a])
            at = b
    sha.update(text[at:] if at else text)
    return len(text), gone, spans, sha.hexdigest()


def _beside(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Documents and marks in one stream: a row's document, then its marks by their starts."""
    both = docs.unionByName(marks, allowMissingColumns=True)
    return both.repartition("row").sortWithinPartitions("row", F.asc_nulls_first("start"))


def _order(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def marks_of(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The documents as (row, doc_id, ord, body), and tables of marks (row, start, n) whose union covers what is to be removed."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", _order(F.col("doc_id")).alias("ord"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body"),
    )
    found = rows.select("row", "ord", "body").mapInArrow(sampled, RUNS)
    found = materialize(found.repartitionByRange("name", "tag").sortWithinPartitions(*KEY).mapInArrow(ranked, RUNS))
    done, open_ = [found.where("name is null")], found.where("name is not null")
    items = materialize(_beside(rows.select("row", "body"), open_.drop("tag")).mapInArrow(pieces, ITEMS))
    while not items.isEmpty():
        pairs = items.mapInArrow(parted, ITEMS)
        found = materialize(pairs.repartitionByRange("name", "tag").sortWithinPartitions(*KEY).mapInArrow(ranked, ITEMS))
        done.append(found.where("name is null"))
        items = found.where("name is not null")
    return rows, [d.select("row", "start", "n") for d in done]


def remove(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256 of what is left."""
    rows, done = marks_of(docs)
    marks = done[0]
    for d in done[1:]:
        marks = marks.unionByName(d)
    kind = dict(docs.dtypes)["doc_id"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        out: list[tuple] = []
        for (doc_id,), text, parts in _each(batches, ["doc_id"]):
            start = np.concatenate([none, *(b.column("start").slice(i, j - i).to_numpy(zero_copy_only=False) for b, i, j in parts if j > i)])
            n = np.concatenate([none, *(b.column("n").slice(i, j - i).to_numpy(zero_copy_only=False) for b, i, j in parts if j > i)])
            out.append((doc_id, *removed(text, start, n)))
            if len(out) >= 500:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64() if i in (1, 2, 3) else None) for i, (c, v) in enumerate(zip(names, zip(*out, strict=True), strict=True))})

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _beside(rows.drop("ord"), marks).mapInArrow(counted, schema)
