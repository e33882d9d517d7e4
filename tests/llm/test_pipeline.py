import hashlib
import re
import zlib

import pytest

import corpus_pipeline as cp
from tenure.llm import token_files

from .helpers import awkward, empty, table
from .test_simhash import brute, check
from .test_text_operators import contamination


def test_stages_keep_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, "documents", sf)
    columns, counts = docs.columns, [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        docs = cp.materialize(stage(spark, docs, sf))
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] and len(cp.STAGES) == 5
    out = cp.STAGES[-1][1](spark, docs, sf).collect()
    assert len(out) == counts[4]
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_run_equals_brute_force(spark):
    """The documents after each stage by plain Python, from the scores of the classifier on; then the tokens of run()."""
    sf = "/root/testdata/sf0.001"
    docs = table(spark, "documents", sf)
    good = {r.doc_id for r in cp.quality_classifier.classify(docs, table(spark, "labels", sf)).where("predicted = 1").collect()}
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in good)
    first = {c for c in check([(i, brute(t)) for i, t, _ in rows])}
    rows = [r for r in rows if r[0] in first]
    items = [tuple(r) for r in table(spark, "benchmark", sf).select("item_id", "text").collect()]
    rows = [r for r in rows if not contamination(r[1], items)[4]]
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    taken = {}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    weight, total = {s: n % 3 + 1 for n, s in enumerate(sources)}, sum(sizes.values())
    own = {s: sum(sizes[i] for i, _, t in rows if t == s) for s in sources}
    capped = set()
    while True:  # the level of the sources below their cap
        free = [s for s in sources if s not in capped]
        level = (total - sum(3 * own[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        if not (over := {s for s in free if weight[s] * level >= 3 * own[s]}):
            break
        capped |= over
    for s in sources:
        room = int((3 * own[s] if s in capped else weight[s] * level) + 1e-6)
        line = sorted((hashlib.md5(f"7:{i}".encode()).hexdigest(), i) for i, _, t in rows if t == s and sizes[i])
        left, whole = room, True
        for _, i in line * 3:
            whole = whole and sizes[i] <= left
            if whole:
                taken[i] = taken.get(i, 0) + 1
                left -= sizes[i]
        fits = [(abs(left - sizes[i]), k, i) for k, i in line if taken.get(i, 0) < 3 and abs(left - sizes[i]) < left]
        if fits:
            taken[min(fits)[2]] = taken.get(min(fits)[2], 0) + 1
    encode = token_files.encoder(token_files.tokenizer_path()).whole
    want, start = [], 0
    for i, t, _ in rows:
        ids = encode([t or ""])[0] + (2).to_bytes(4, "little")
        for _ in range(taken.get(i, 0)):
            want.append((i, start, len(ids) // 4, zlib.crc32(ids)))
            start += len(ids) // 4
    got = cp.run(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert want and sorted(map(tuple, got)) == want


@pytest.mark.parametrize("docs", [awkward, empty])
def test_stages_on_awkward_tables(spark, docs):
    sf = "/root/testdata/sf0.001"
    d = docs(spark)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == d.columns
        out.collect()
    assert cp.token_ids(spark, d, sf).count() == d.count()
