"""Paged sources as a Spark data source: count-checked offsets, disjoint key ranges, id lists, aggregates, cached pages.

``PagedSource`` reads pages through a fetcher: by default files ``<path>/<offset>.json`` as a paging service would
return them, or shelves of pages that Spark wrote (``table_pages``); ``http_pages`` asks a service over HTTP, and another
fetcher is passed by its import path. Pages are read by executors, a run of neighbouring ones a task (option ``tasks``: so many
at most); every page is checked against the count that it should have, and retried with growing pauses. Where a service tells no count, its end is searched for first, so pages
are read side by side then too.

With a ``cache`` (a path under any scheme that Spark reads) pages are kept as a table of request, number of rows and rows.
A request is taken from there only if its entry has the number of rows that it says and that the request should have;
only the others are asked for, and Spark's writer adds them, so a lost task leaves no half of a page.
"""

from __future__ import annotations

import importlib
import json
import os
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetcher = Callable[[str, dict], list[dict]]


class PageError(RuntimeError):
    """A page had other rows than were counted for it."""


def _name(page: dict) -> str:
    """What a page is called in a folder of pages."""
    if "ids" in page:
        return f"ids-{page['index']:05d}"
    if "where" in page:
        return f"where-{page['index']:05d}"
    return f"after-{page['after']}" if "after" in page else str(page["offset"])


def file_pages(path: str, page: dict) -> list[dict]:
    """A page out of a local folder of JSON arrays; an offset beyond the last has no rows."""
    name = f"{path}/{_name(page)}.json"
    if "offset" in page and not os.path.exists(name):
        return []
    with open(name) as f:
        return json.load(f)


#: Offset pages that lie on one shelf.
SHELF = 100
#: The shelf that this process read last: its files, as listed, and its rows by page.
_last: tuple[list, dict[str, list[dict]]] = ([], {})


def table_pages(path: str, page: dict) -> list[dict]:
    """A page out of JSON lines that Spark wrote by ``shelf``, under any scheme; one that isn't there has no rows.

    A row names its ``page``. SHELF offset pages share a shelf, others have their own, so there are fewer files than pages;
    neighbouring pages come from one reading of their shelf, as long as its files are the same.
    """
    from pyarrow import fs

    global _last
    system, base = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    shelf = page["offset"] // (page["limit"] * SHELF) if "offset" in page else _name(page)
    found = system.get_file_info(fs.FileSelector(f"{base}/shelf={shelf}", allow_not_found=True))
    files = sorted((f.path, f.size, f.mtime_ns) for f in found if f.base_name.endswith(".json"))
    if files != _last[0]:
        pages: dict[str, list[dict]] = {}
        for name, *_ in files:
            with system.open_input_stream(name) as f:
                for line in f.read().decode().split("\n"):
                    if line:
                        row = json.loads(line)
                        pages.setdefault(row.pop("page"), []).append(row)
        _last = (files, pages)
    return _last[1].get(_name(page), [])


def http_pages(path: str, page: dict) -> list[dict]:
    """A page of a service that answers GET requests with JSON arrays; the page's fields are the query."""
    query = {k: json.dumps(v) if isinstance(v, (list, dict)) else v for k, v in page.items() if v is not None}
    with urllib.request.urlopen(f"{path}?{urllib.parse.urlencode(query)}", timeout=60) as answer:
        return json.load(answer)


def retried(fetch: Fetcher, path: str, page: dict, attempts: int = 5, pause: float = 0.5) -> list[dict]:
    """Call a fetcher until it answers; the pause doubles after each failure."""
    for attempt in range(attempts):
        try:
            return fetch(path, page)
        except Exception:
            if attempt == attempts - 1:
                raise
            time.sleep(pause * 2**attempt)
    raise AssertionError


def fetcher_of(options: dict) -> Fetcher:
    module, _, name = options.get("fetcher", f"{__name__}:file_pages").partition(":")
    return getattr(importlib.import_module(module), name)


def rows_until_short(path: str, size: int, **options: str) -> int:
    """Rows of a service that ends with its first short page, from about 2 log2(pages) pages: doubled offsets, then halved.

    Pages after a short one are taken for empty; a short one before the end is an error of the counted read that follows.
    """
    fetch, pause = fetcher_of(options), float(options.get("pause", "0.5"))
    length = lambda k: len(retried(fetch, path, {"offset": k * size, "limit": size}, pause=pause))
    full, short = -1, 0  # the last page known to be full, the first known to be short
    while (n := length(short)) >= size:
        full, short = short, 2 * short + 1
    while short - full > 1:
        middle = (full + short) // 2
        if (m := length(middle)) >= size:
            full = middle
        else:
            short, n = middle, m
    return short * size + n


class Run(InputPartition):
    """Neighbouring pages, each with the rows that it should have."""

    def __init__(self, pages: list[tuple[dict, int | None]]):
        self.pages = pages


def _request(path: str, page: dict, columns: list[str]) -> str:
    return json.dumps([path, page, columns], sort_keys=True)


class PagedReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.schema, self.options = schema, options

    def __getstate__(self) -> dict:
        """Tasks get their own pages, not the lists that all pages were planned from."""
        return {"schema": self.schema, "options": {k: v for k, v in self.options.items() if k not in ("requests", "ids", "where", "ranges")}}

    def pages(self) -> list[tuple[dict, int | None]]:
        o = self.options
        if "requests" in o:  # chosen pages, each with the rows that it should have
            return [(p, n) for p, n in json.loads(o["requests"])]
        size = int(o.get("pagesize", "50000"))
        if "ids" in o:
            ids = json.loads(o["ids"])
            return [({"ids": ids[i : i + size], "index": n}, None) for n, i in enumerate(range(0, len(ids), size))]
        if "where" in o:  # aggregates that the service computes, one for each filter
            return [({"where": w, "index": n}, None) for n, w in enumerate(json.loads(o["where"]))]
        if "ranges" in o:  # disjoint keys, so a key that straddles pages loses no row
            return [({"after": a, "upto": b}, None) for a, b in json.loads(o["ranges"])]
        total = int(o["count"])
        return [({"offset": i, "limit": size}, min(size, total - i)) for i in range(0, total, size)]

    def partitions(self) -> list[Run]:
        pages = self.pages()
        each = max(1, -(-len(pages) // int(self.options.get("tasks", "200"))))
        return [Run(pages[i : i + each]) for i in range(0, len(pages), each)]

    def read(self, partition: Run) -> Iterator[tuple]:
        if partition is not None:  # Spark's stand-in for no pages at all
            for page, expected in partition.pages:
                yield from self._page(page, expected)

    def _page(self, page: dict, expected: int | None) -> Iterator[tuple]:
        fetch, pause = fetcher_of(self.options), float(self.options.get("pause", "0.5"))
        rows = retried(fetch, self.options["path"], page, pause=pause)
        limit = int(self.options.get("truncatedat", "50000"))
        if expected is not None and len(rows) != expected:
            raise PageError(f"{page}: {len(rows)} rows, counted {expected}")
        if "ids" in page:
            if len(rows) >= limit:
                raise PageError(f"{page['index']}: {len(rows)} rows, the service may have cut them")
            wanted, key = set(page["ids"]), self.options["key"]
            if extra := {r[key] for r in rows} - wanted:
                raise PageError(f"rows of keys that weren't asked for: {sorted(extra)[:3]}")
        if "where" in page:  # an aggregate's rows carry the filter that they answer
            rows = [r | page["where"] for r in rows]
        whole = "columns" in self.options  # the page as one row of a cache
        names = json.loads(self.options["columns"]) if whole else [f.name for f in self.schema.fields]
        texts = [tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows]
        if whole:
            yield _request(self.options["path"], page, names), len(texts), [list(t) for t in texts]
        else:
            yield from texts


class PagedSource(DataSource):
    """``spark.read.format("paged")``: options path, count or ids or ranges, pagesize, key, fetcher. Text columns only."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema) -> PagedReader:
        return PagedReader(schema, self.options)


#: A cache's columns: the request, its number of rows, and the rows' values in the order of the columns asked for.
ENTRY = "request string, n int, page array<array<string>>"


def _held(spark: SparkSession, cache: str, wanted: DataFrame) -> DataFrame:
    """One whole entry of each wanted request that the cache has."""
    try:
        entries = spark.read.schema(ENTRY).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRY)
    whole = (F.size("page") == F.col("n")) & (F.col("expected").isNull() | (F.col("expected") == F.col("n")))
    return entries.join(F.broadcast(wanted), "request").where(whole).select("request", "n", "page").dropDuplicates(["request"])


def _load(spark: SparkSession, schema: str, cache: str | None = None, **options: str) -> DataFrame:
    """Rows of the pages that the options plan; with a cache only what it lacks is asked for. Requests are known here."""
    spark.dataSource.register(PagedSource)
    source = spark.read.format("paged").options(**options)
    if cache is None:
        return source.schema(schema).load()
    columns = spark.createDataFrame([], schema).columns
    pages = {_request(options["path"], page, columns): (page, n) for page, n in PagedReader(None, options).pages()}
    wanted = spark.createDataFrame([(r, n) for r, (_, n) in pages.items()], "request string, expected int")
    known = {r.request for r in _held(spark, cache, wanted).select("request").collect()}  # requests that were planned here
    if lacking := [pages[r] for r in pages if r not in known]:
        source = source.options(requests=json.dumps(lacking), columns=json.dumps(columns))
        source.schema(ENTRY).load().write.mode("append").parquet(cache)
    rows = _held(spark, cache, wanted).select(F.explode("page").alias("r"))
    return rows.select(*[F.col("r")[i].alias(c) for i, c in enumerate(columns)])


def read_offsets(spark: SparkSession, path: str, schema: str, count: int, page: int = 50_000, **options: str) -> DataFrame:
    """``count`` rows by offset pages, each page checked against its share of the count."""
    return _load(spark, schema, path=path, count=str(count), pagesize=str(page), **options)


def read_ids(spark: SparkSession, path: str, schema: str, ids: list[str], key: str, page: int = 150, **options: str) -> DataFrame:
    """Rows of an id list in batches; a batch that may have been cut short, or holds other keys, is an error."""
    return _load(spark, schema, path=path, ids=json.dumps(ids), key=key, pagesize=str(page), **options)


def read_ranges(spark: SparkSession, path: str, schema: str, ranges: list[tuple[str, str]], **options: str) -> DataFrame:
    """Rows by disjoint key ranges instead of a cursor, which would lose rows of a key that straddles pages."""
    return _load(spark, schema, path=path, ranges=json.dumps(ranges), **options)


def read_until_short(spark: SparkSession, path: str, schema: str, page: int = 50_000, **options: str) -> DataFrame:
    """Rows by offset pages up to the first that is short, where a service tells no count; its end is searched for first."""
    return read_offsets(spark, path, schema, rows_until_short(path, page, **options), page, **options)


def read_aggregates(spark: SparkSession, path: str, schema: str, filters: list[dict[str, str]], **options: str) -> DataFrame:
    """What a service that aggregates answers to each filter; the filter's fields are columns of the rows."""
    return _load(spark, schema, path=path, where=json.dumps(filters), **options)


def batched(df: DataFrame, key: str, size: int = 150) -> DataFrame:
    """Distinct keys in numbered batches of at most about ``size``: what a lookup service is asked for."""
    ids = df.select(key).where(F.col(key).isNotNull()).distinct()
    n = max(1, -(-ids.count() // size))
    return ids.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
