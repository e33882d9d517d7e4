"""Repeated byte strings against a brute-force version that looks at every start."""

import hashlib
import random

import numpy as np
import pytest

from tenure.llm import repeats
from tenure.llm.common import materialize

from .helpers import awkward, empty, table

SCHEMA = "doc_id long, text string"


def brute(rows):
    """Rows in the order of ids (null first, then as they come); every string of 100 bytes is looked up among those before it."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        text = (text or "").encode()
        gone = np.zeros(len(text), bool)
        for s in range(len(text) - 99):
            if text[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(text[s : s + 100])
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        out.append((doc_id, len(text), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def same(spark, rows, parts=1):
    df = spark.createDataFrame(rows, SCHEMA)
    got = repeats.remove(materialize(df.repartition(parts)) if parts > 1 else df)  # as files, see the docstring
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows)


def test_whole_table_equals_brute_force(spark):
    docs = table(spark, "documents")
    got = repeats.remove(docs)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark).coalesce(1)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(repr(tuple(r)) for r in repeats.remove(docs).collect()) == brute(rows)
    assert repeats.remove(empty(spark)).count() == 0


def test_lengths_about_the_threshold(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    rows, n = [], 0
    for size in (98, 99, 100, 101, 149, 150, 151, 200):
        passage = word(size)
        for _ in range(3):
            rows.append((n, word(rng.randrange(300)) + passage + word(rng.randrange(300))))
            n += 1
    same(spark, rows)
    same(spark, [(i, p[:k]) for i, (p, k) in enumerate((word(300), k) for k in (0, 1, 99, 100))] * 2)


def test_runs_of_one_character_and_periods(spark):
    same(spark, [(1, "a" * 1000), (2, "a" * 99), (3, "a" * 100), (4, "ab" * 300), (5, "b" + "ab" * 100), (6, "xyz" * 40 + "q" + "xyz" * 70)])


def test_near_copies_with_single_changes(spark):
    rng = random.Random(2)
    text = " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "Été"]) for _ in range(600))
    rows = [(0, text)]
    for i in range(1, 30):
        at = rng.randrange(len(text))
        rows.append((i, text[:at] + rng.choice("xyz") + text[at + rng.randrange(3) :]))
    same(spark, rows)


def test_pieces_and_batches_don_t_show(spark, monkeypatch):
    rng = random.Random(3)
    common = "".join(rng.choices("abcdefghij ", k=700))
    rows = [(i, "".join(rng.choices("abcdefghij ", k=rng.randrange(900))) + common[rng.randrange(300) :] + "".join(rng.choices("xyz ", k=150))) for i in range(12)]
    whole = repeats.runs([t.encode() for _, t in rows])
    monkeypatch.setattr(repeats, "PIECE", 257)
    cut = repeats.runs([t.encode() for _, t in rows])
    assert whole[2].sum() == cut[2].sum() == sum(max(0, len(t) - 99) for _, t in rows)  # every start is in one run
    monkeypatch.undo()
    same(spark, rows, parts=4)


def test_hot_passage_between_different_neighbours(spark):
    rng = random.Random(4)
    line = "".join(rng.choices("abcdefghij ", k=120))
    same(spark, [(i, "".join(rng.choices("klmnopq ", k=60)) + line + "".join(rng.choices("klmnopq ", k=60))) for i in range(200)], parts=4)


def test_a_hot_extent_leaves_a_batch_once():
    import pyarrow as pa

    text = b"the same text of some hundred bytes or more, again and again, in a third of all documents of a table, say."
    docs = pa.RecordBatch.from_pydict({"row": pa.array(range(500)), "ord": pa.array(range(500)), "body": [text] * 500})
    out = [r for batch in repeats.sampled(iter([docs])) for r in batch.to_pylist()]
    firsts = [r for r in out if r["tag"] is not None]
    assert {r["row"] for r in firsts} == {0} and len(out) - len(firsts) == 499


@pytest.mark.parametrize("text, start, n, want", [(b"abcdef", [], [], (6, 0, 0)), (b"abcdef", [0, 2], [2, 2], (6, 4, 1)), (b"abcdef", [0, 3], [2, 3], (6, 5, 2)), (b"", [], [], (0, 0, 0))])
def test_removed_bytes(text, start, n, want):
    assert repeats.removed(text, np.array(start, np.int64), np.array(n, np.int64))[:3] == want
