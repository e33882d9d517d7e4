"""Readers, paged sources, writers and the streaming extension."""

import gzip
import json
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tenure.sources import files, paged, schemas, sinks
from tenure.streaming import linkage as streaming


def test_gzip_json_array_and_schema(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        json.dump([{"document_id": "1", "party_type": "2", "name": "A"}, {"document_id": "2"}], f)
    rows = files.read_json_array(spark, str(tmp_path / "a.json.gz"), schemas.PARTIES).orderBy("document_id").collect()
    assert [tuple(r) for r in rows] == [("1", "2", "A"), ("2", None, None)]


def test_deed_map(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"1": [["2020-01-02T00:00", "d1"], ["bad", "d2"]], "2": []}))
    got = files.read_deed_map(spark, str(tmp_path / "m.json")).collect()
    assert [(r.bbl, str(r.doc_date), r.document_id) for r in got] == [("1", "2020-01-02", "d1"), ("1", "None", "d2")]


def test_rates_forget_the_date_after_a_gap(spark):
    lines = [(1, "January 7, 2016"), (2, "Average Rates | 3.97%"), (10, "January 14, 2016"), (12, "Average Rates | 9.99 %"), (20, "Average Rates | 1%")]
    got = files.parse_rates(spark.createDataFrame(lines, "line_no int, line string")).collect()
    assert [(str(r.observed), r.rate, r.consistent) for r in got] == [("2016-01-07", 3.97, True)]


def pages(tmp_path, total=7, size=3):
    for i in range(0, total, size):
        (tmp_path / f"{i}.json").write_text(json.dumps([{"id": str(k), "v": k} for k in range(i, min(i + size, total))]))
    return str(tmp_path)


def test_offset_pages_are_count_checked(spark, tmp_path):
    path = pages(tmp_path)
    assert paged.read_offsets(spark, path, "id string, v string", 7, 3).count() == 7
    (tmp_path / "3.json").write_text("[]")
    with pytest.raises(PySparkException):
        paged.read_offsets(spark, path, "id string, v string", 7, 3).count()


def test_id_lists_are_checked(spark, tmp_path):
    (tmp_path / "ids-00000.json").write_text(json.dumps([{"id": "a"}, {"id": "a"}]))
    (tmp_path / "ids-00001.json").write_text(json.dumps([{"id": "c"}]))
    df = paged.read_ids(spark, str(tmp_path), "id string", ["a", "b", "c"], "id", 2)
    assert sorted(r.id for r in df.collect()) == ["a", "a", "c"]
    with pytest.raises(PySparkException):
        paged.read_ids(spark, str(tmp_path), "id string", ["x", "b", "c"], "id", 2).count()
    with pytest.raises(PySparkException):
        paged.read_ids(spark, str(tmp_path), "id string", ["a", "b", "c"], "id", 2, truncatedAt="2").count()


def test_key_ranges_keep_straddling_keys(spark, tmp_path):
    (tmp_path / "after-.json").write_text(json.dumps([{"id": "a"}, {"id": "b"}]))
    (tmp_path / "after-b.json").write_text(json.dumps([{"id": "b2"}]))
    assert paged.read_ranges(spark, str(tmp_path), "id string", [("", "b"), ("b", "c")]).count() == 3


def test_retries_double_their_pause(monkeypatch):
    pauses, left = [], [2]

    def fetch(path, page):
        if left[0]:
            left[0] -= 1
            raise OSError
        return [1]

    monkeypatch.setattr(paged.time, "sleep", pauses.append)
    assert paged.retried(fetch, "", {}) == [1] and pauses == [0.5, 1.0]
    left[0] = 9
    with pytest.raises(OSError):
        paged.retried(fetch, "", {}, attempts=2)


def test_http_pages_are_cached_by_request(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlsplit

    asked = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            query = parse_qs(urlsplit(self.path).query)
            asked.append(query)
            if len(asked) == 1:
                return self.send_error(503)
            body = json.dumps([{"id": query["offset"][0]}]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/rows"
    options = {"fetcher": "tenure.sources.paged:http_pages", "pause": "0.01", "cache": (tmp_path / "c").as_uri()}
    read = lambda n: sorted(r.id for r in paged.read_offsets(spark, url, "id string", n, 1, **options).collect())
    assert read(2) == ["0", "1"] and len(asked) == 3 and read(2) == ["0", "1"] and len(asked) == 3
    assert read(4) == ["0", "1", "2", "3"] and len(asked) == 5 and sorted(q["offset"][0] for q in asked[3:]) == ["2", "3"]
    server.shutdown()
    assert read(4) == ["0", "1", "2", "3"]


def test_a_cache_gives_whole_entries_only(spark, tmp_path):
    pages, cache = tmp_path / "p", str(tmp_path / "c")
    pages.mkdir()
    for i in range(0, 6, 2):
        (pages / f"{i}.json").write_text(json.dumps([{"id": i, "x": None}, {"id": i + 1, "x": True}]))
    read = lambda **o: sorted((r.id, r.x) for r in paged.read_offsets(spark, str(pages), "id string, x string", 6, 2, **o).collect())
    want = read()
    assert read(cache=cache) == want
    held = spark.read.schema(paged.ENTRY).parquet(cache)
    cut = held.withColumn("page", F.when(F.col("request").contains('"offset": 2'), F.slice("page", 1, 1)).otherwise(F.col("page")))
    cut.union(held.where(F.col("request").contains('"offset": 4'))).write.parquet(f"{cache}2")  # one is cut, one is there twice
    (pages / "0.json").unlink()
    assert read(cache=f"{cache}2") == want and spark.read.parquet(f"{cache}2").count() == 5
    (pages / "2.json").write_text("[]")
    with pytest.raises(Exception, match="0 rows, counted 2"):
        read(cache=f"{cache}3")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 31, 32, 33, 100])
def test_the_end_is_found_by_doubling_and_halving(monkeypatch, n):
    asked = []

    def fetch(path, page):
        asked.append(page["offset"])
        return [{}] * max(0, min(page["limit"], n - page["offset"]))

    monkeypatch.setattr(paged, "fetcher_of", lambda options: fetch)
    assert paged.rows_until_short("", 2) == n
    assert len(asked) <= 2 * (n // 2 + 2).bit_length() and len(set(asked)) == len(asked)


def test_batches_hold_every_key(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    got = paged.batched(df, "k", 150)
    assert got.count() == 1000 and got.select("batch").distinct().count() == 7


def test_rendering():
    table = sinks.latex_table([("a", -1.5), ("b", None)], ["x", "y"])
    assert "a & $-$1.50" in table and table.startswith(r"\begin{tabular}{lr}")
    assert sinks.macros({"n_pairs": 6006, "d": -0.5}) == "\\newcommand{\\npairs}{6,006}\n\\newcommand{\\d}{$-$0.50}"
    assert json.loads(sinks.result_json({"a": 1.0})) == {"a": 1.0}


def test_manifest(spark, tmp_path):
    (tmp_path / "x.txt").write_text("abc")
    h = sinks.file_hashes(spark, str(tmp_path)).first()
    assert h.bytes == 3 and h.sha256.startswith("ba7816bf")
    m = sinks.Manifest({"x": h.sha256})
    with m.stage("one"):
        pass
    with pytest.raises(RuntimeError), m.stage("two"):
        raise RuntimeError
    assert [s["status"] for s in json.loads(m.text())["stages"]] == ["ok", "failed: RuntimeError"]


def test_interval_join_over_streams(spark, tmp_path):
    t0 = datetime(2020, 1, 1)
    sale = spark.createDataFrame([("p", t0)], "bbl string, sale_ts timestamp")
    filing = spark.createDataFrame([("p", t0 + timedelta(days=d)) for d in (-16, -15, 180, 181)], "bbl string, doc_ts timestamp")
    for name, df in (("s", sale), ("f", filing)):
        df.write.parquet(str(tmp_path / name))
    read = lambda name, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    joined = streaming.interval_join(read("s", sale), read("f", filing))
    q = joined.writeStream.format("memory").queryName("linked").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("linked").count() == 2


def test_pages_are_read_by_runs_from_shelves(spark, tmp_path, monkeypatch):
    """Many small pages make few files and tasks; tasks get their pages alone; a shelf that is written anew is read anew."""
    import pickle

    rows = spark.range(1000).select(F.col("id").cast("string").alias("k"), (F.floor(F.col("id") / 2) * 2).cast("string").alias("page"))
    shelved = rows.withColumn("shelf", F.floor(F.col("page").cast("long") / (2 * paged.SHELF)))
    shelved.coalesce(1).write.partitionBy("shelf").json(str(tmp_path / "p"))
    assert len(list((tmp_path / "p").glob("*/*.json"))) == 5
    options = {"fetcher": "tenure.sources.paged:table_pages"}
    got = paged.read_until_short(spark, str(tmp_path / "p"), "k string", 2, tasks="7", **options)
    assert sorted(int(r.k) for r in got.collect()) == list(range(1000)) and got.rdd.getNumPartitions() == 7
    requests = json.dumps([[{"offset": i, "limit": 2}, 2] for i in range(0, 1000, 2)])
    reader = paged.PagedReader(None, {"path": "p", "requests": requests})
    assert len(reader.partitions()) <= 200 and len(reader.pages()) == 500 and "requests" not in pickle.loads(pickle.dumps(reader)).options
    page = {"offset": 4, "limit": 2}
    assert [r["k"] for r in paged.table_pages(str(tmp_path / "p"), page)] == ["4", "5"]
    shelved.where("page % 8 = 0").write.mode("overwrite").partitionBy("shelf").json(str(tmp_path / "p"))
    assert paged.table_pages(str(tmp_path / "p"), page) == []
