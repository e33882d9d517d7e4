"""Token ids in Parquet files made for selective reads.

A row is a document: its id, its token ids as a list column, their number and checksum, and its place. Documents are
range-sorted by id, so files, row groups and pages hold ranges of ids; footers and page indexes let a reader skip to
the documents that it wants, and a reader of the metadata columns never touches a token page. The writer is the
session's own Parquet writer, which commits through the file system of the target: a lost task is written again.

- ids of a document: 32-bit, dictionary-encoded while a row group's dictionary stays small, else delta-packed (format 2);
- ``row_group`` and ``page`` bytes bound what a selective read fetches; page indexes are written for every column;
- ``part`` and ``at`` give a document's place: ``at`` counts the ids before it in its part. Only the parts' totals, one
  row per part, are gathered to make global offsets.

Texts are encoded by the library, Latin-1 texts word by word with a bounded table of the words that a worker has met.

Edge cases: null and empty texts have only the end id; repeated ids stay side by side, ordered by the first 32
characters of the text and its hash; rows with a null id come first; an empty table writes files without rows; other columns of the input are not looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice, repeat
from operator import attrgetter, is_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, shared_dir

#: Words that a worker remembers, some 250 bytes each.
WORDS_HELD = 800_000
SCHEMA = "doc_id long, part int, at long, n_tokens int, ids_crc32 long, ids array<int>"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts with a tokenizer file; Latin-1 texts word by word where that is the same.

    The tokenizer's own steps (NFC, one space for white space, lower case, splitting into words) come to ``lower`` and
    WORDS on Latin-1 text without its added tokens; the library's model then encodes each new word, and words repeat.
    On loading, this is compared with the library's encoding of whole texts that hold every Latin-1 character; a
    tokenizer that differs is used on whole texts only.
    """

    #: Fixed value: the word pattern of the tokenizer's file, with the letters, numbers and white space of Latin-1 spelt out.
    WORDS = re.compile(
        "'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
        "|[^ \t-\r\x85\xa0a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"
    )
    #: What ``split`` takes for white space and the tokenizer doesn't.
    NOT_SPACE = "\x1c\x1d\x1e\x1f"
    #: ASCII marks but the apostrophe, which begins words of its own.
    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    PROBES = (
        "It's 25 o'clock,\n\n\"naïve\"  ÇA!! #x_1|\té a b c 'll n't Word. word, Été.*** x~ ~ \x1c\x1f\x85\xa0 ½ 10³ µm ª «d'd'Re»",
        "".join(map(chr, range(1, 256))),
        " ".join(map(chr, range(1, 256))),
        " a".join(map(chr, range(1, 256))) + " 1",
    )

    def __init__(self, path: str, words: int | None = None):
        self.words = words or WORDS_HELD
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        # byte-level models read bytes as letters: visible Latin-1 signs are themselves, the others follow from 256 on
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        self.letters = {b: 256 + n for n, b in enumerate(hidden)}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_word = True
        self.by_word = self.encode(list(self.PROBES)) == self.whole(list(self.PROBES))
        self.known.clear()

    def whole(self, texts: list[str]) -> list[bytes]:
        """The library's own encoding of each text, as 32-bit little-endian ids."""
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Encode new words: the library's model on each word as it comes from the tokenizer's own steps."""
        spelt = [w if w.isascii() and w.isalnum() else w.encode().decode("latin-1").translate(self.letters) for w in words]
        tokens = list(map(self.model.tokenize, spelt))
        ids = np.array(list(map(attrgetter("id"), chain.from_iterable(tokens))), dtype="<u4").tobytes()
        ends = (np.cumsum([0, *map(len, tokens)]) * 4).tolist()
        self.known.update(zip(words, map(ids.__getitem__, map(slice, ends, ends[1:])), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts, each as 32-bit little-endian integers."""
        whole: dict[int, bytes] = {}
        flat: list[str] = []
        ends = [0]
        for n, t in enumerate(texts):
            if not (self.by_word and self._latin(t)):
                whole[n] = self.whole([t or ""])[0]
            elif t and any(c in t for c in self.NOT_SPACE):
                flat += self.WORDS.findall(t.lower())
            elif t:
                flat += t.lower().split()
            ends.append(len(flat))
        ids = list(map(self.known.get, flat))
        if None in ids:
            missing = np.flatnonzero(np.fromiter(map(is_, ids, repeat(None)), dtype=bool, count=len(ids))).tolist()
            found = self._found({flat[i] for i in missing})
            for i in missing:
                ids[i] = found[flat[i]]
        return [whole[n] if n in whole else b"".join(ids[a:b]) for n, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]

    def _found(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces between white space that aren't known: their words are learnt and put together."""
        alone = {p for p in pieces if p.isalpha()}
        parts = {p: self._parts(p) for p in pieces - alone}
        words = alone.union(*parts.values())
        new = words.difference(self.known)
        if len(self.known) + len(new) > self.words:  # frequent words came early: the later half goes
            self.known = dict(islice(self.known.items(), self.words // 2))
            new = words.difference(self.known)
        if new:
            self.learn(list(new))
        of = self.known.__getitem__
        found = {p: b"".join(map(of, ws)) for p, ws in parts.items()}
        if len(self.known) + len(found) < self.words // 2:
            self.known.update(found)
        found.update(zip(alone, map(of, alone), strict=True))
        return found

    def _parts(self, piece: str) -> list[str]:
        """WORDS of a piece; letters and an end of plain marks, the usual kind, don't need the pattern."""
        letters = piece.rstrip(self.MARKS)
        return [letters, piece[len(letters) :]] if letters.isalpha() else self.WORDS.findall(piece)

    def _latin(self, text: str | None) -> bool:
        """Whether all of a text is Latin-1 and none of it is an added token."""
        if text is None or text.isascii():
            return not any(x in (text or "") for x in self.added)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not any(x in text for x in self.added)


@lru_cache(maxsize=2)
def encoder(path: str, words: int | None = None) -> Encoder:
    return Encoder(path, words)


def encode(documents: DataFrame, *, tokenizer: str, end_id: int = 2, words: int | None = None) -> DataFrame:
    """SCHEMA's rows, range-sorted by doc_id; ``words`` (or else WORDS_HELD) are held in a worker."""
    bound_batches(documents.sparkSession)
    # the parts are ranges of ids, their number follows the session's shuffle partitions; rows of one id, or none, are
    # ranges of their texts' beginnings and hashes
    order = ["doc_id", F.substring("text", 1, 32), F.xxhash64("text")]
    ranged = documents.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, encode_texts = TaskContext.get().partitionId(), 0, encoder(tokenizer, words).encode
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            texts = batch.column("text")
            step = 64  # documents a batch: bounds the ids held at once
            for low in range(0, len(batch), step):
                ids = [x + end for x in encode_texts(texts[low : low + step].to_pylist())]
                sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                offsets = np.concatenate([[0], sizes.cumsum()])
                flat = np.frombuffer(b"".join(ids), dtype="<i4")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[low : low + step].cast(pa.int64()),
                        pa.array(np.full(len(ids), part, dtype=np.int32)),
                        pa.array(at + offsets[:-1]),
                        pa.array(sizes.astype(np.int32)),
                        pa.array([zlib.crc32(x) for x in ids], type=pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)),
                    ],
                    names=["doc_id", "part", "at", "n_tokens", "ids_crc32", "ids"],
                )
                at += int(offsets[-1])

    return ranged.mapInArrow(encoded, SCHEMA)


def write(
    documents: DataFrame, path: str, *, tokenizer: str, end_id: int = 2, row_group: int = 32 << 20, page: int = 256 << 10, words: int | None = None
) -> None:
    """Encode the documents and write them below ``path``."""
    (
        encode(documents, tokenizer=tokenizer, end_id=end_id, words=words)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", "1")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", row_group)
        .option("parquet.page.size", page)
        .option("parquet.enable.dictionary", "true")
        .parquet(path)
    )


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """``part`` and the number of ids before it: a row per part."""
    parts = spark.read.parquet(path).groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("n")).collect()
    rows, before = [], 0
    for r in sorted(parts):
        rows.append((r["part"], before))
        before += r["n"]
    return spark.createDataFrame(rows, "part int, before long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files with their global ``start``; unused columns are never read."""
    rows = spark.read.parquet(path)
    return rows.join(F.broadcast(offsets(spark, path)), "part").withColumn("start", F.col("before") + F.col("at")).drop("before")


def verify(rows: DataFrame) -> DataFrame:
    """The rows with ``n_tokens`` and ``ids_crc32`` recomputed from the ids that were read."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            raw, ends = ids.flatten().to_numpy().astype("<i4", copy=False).tobytes(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
            sizes = np.diff(ends).astype(np.int64)
            crc = [zlib.crc32(raw[x:y]) for x, y in zip((ends * 4).tolist(), (ends[1:] * 4).tolist(), strict=False)]
            columns = [b.column("doc_id"), b.column("start"), pa.array(sizes), pa.array(crc, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(checked, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(documents: DataFrame, *, tokenizer: str | None = None, path: str | None = None, **parameters) -> DataFrame:
    """Write the files (in the shared folder, if no path is given) and return what reading them back tells."""
    spark, path = documents.sparkSession, path or shared_dir(documents.sparkSession)
    write(documents, path, tokenizer=tokenizer or tokenizer_path(), **parameters)
    return verify(read(spark, path))
