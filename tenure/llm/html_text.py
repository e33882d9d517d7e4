"""Main text of web pages: markup roles, and differencing against the page with the nearest URL.

A page is cut into lines, one per block element. Elements and roles whose meaning is furniture (navigation, header,
footer, aside, form, script, style) and hidden elements settle their lines: these are dropped. An explicit article settles
its lines as well: they stay, and no class word drops the article or an element that holds it. An article whose class says
that it is a comment or a card (``comment``, ``related-card``; ``post related`` is a post) is none. Within an article,
comments, adverts, notices, breadcrumbs, page numbers, subscriptions and share boxes are dropped by their class or id; other
parts under a word of furniture (``menu-items``, ``search``) are open, and so are all lines outside. Pages are sorted by
host and path; each is paired with the neighbour of its host that shares the longer beginning of the path, their lines
are aligned by a longest common subsequence, and open lines that both have are deleted as template. Of what is left,
lines under a class or id that names furniture go too: a whole word, or a compound of it and a word for a box or for its
place on the site (``comment-list``, ``site-header``). Compounds that only contain the word (``post-header``,
``related-work``) leave their lines open. Lines of the main element, or of the page if it has none, stay. Beside an
article they stay only where there was another page to compare with; open lines within it stay unless they are deleted.

A neighbour that is a copy of the page is passed over for the next. A copy has nearly all of what is left of the page
without the lines that at least half of the further, different neighbours have too (three pages before and after are
looked at); without a further neighbour, nearly all of its lines. So with less than two different pages in reach (small
hosts, long runs of copies) a page whose lines are nearly all template keeps them, and a run of near copies that fills the
neighbourhood is taken for pages of a template.

Pairing moves hashes of lines only. Positions in the order of URLs come from a range sort and the parts' row counts, so
a host with a third of all pages is spread like any other. The pages' html is never shuffled unless more pages have
open lines than may be broadcast. An alignment takes memory in proportion to the lines of the two pages.

Edge cases: null and empty html give an empty text; a null url has no host and is paired with nothing; repeated rows
are returned each, equal rows with equal texts; an empty table gives an empty result. Other columns of the input are not
looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_small, materialize

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL,
)
LOOSE_END = re.compile(r"[^>]*(?:>|\Z)")
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.IGNORECASE)
ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
words = lambda s: frozenset(s.split())
#: Elements by what they mean for the text.
VOID = words("area base br col embed hr img input link meta param source track wbr")
RAW = words("script style template noscript iframe textarea noembed noframes xmp title")
BLOCK = words(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead tr ul"
)
DROPPED = RAW | words("head nav footer aside form button select dialog menu svg object canvas audio video map search")
#: Elements of DROPPED that may wrap a whole page; an article inside is the page's.
WRAPPERS = words("form")
ROLES = words("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar")
#: Words of a class or id that name furniture outside an article.
MARKS = words(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup sidebar sidebars widget widgets menu menus nav navbar "
    "navigation breadcrumb breadcrumbs pagination pager share sharing social comment comments commentlist disqus respond replies footer "
    "login related recommended header masthead banner search toolbar topbar"
)
#: What they name inside an article: alone, or before a word for a box.
INNER = words(
    "ad ads advert adverts advertisement advertising adsense sponsored promo comment comments commentlist disqus respond replies share "
    "sharing social newsletter subscribe subscription signup cookie cookies consent popup modal overlay sidebar notice notices breadcrumb "
    "breadcrumbs pagination pager"
)
#: Words that name furniture inside an article only before a word for a box.
LISTED = words("related recommended")
BOXES = words(
    "area list section box bar button buttons links slot banner container wrapper unit form thread widget block signup notice icons tools "
    "body card cards content item items posts articles stories author"
)
#: Words that are furniture at the end of a compound only after a mark or a word of SITE.
EITHER = words("header banner notice notices related recommended widget widgets search share")
SITE = words("site page main global top bottom left right primary secondary mobile desktop sticky fixed app web privacy")
#: Adverts, whatever they stand before.
ADVERTS = words("ad ads advert adverts advertisement advertising adsense sponsored")
#: Words of an article that is a reader's comment or a card for another page, and those of one that isn't.
CARDS = words("comment comments reply replies related recommended promo promoted ad ads advert advertisement sponsored")
PROSE = words("post entry article story hentry")
#: Before a mark these say that something has it, not that it is it.
HAVING = words("has have with without no is not show hide hidden")
#: A neighbour with this share of a page's own lines is a copy.
COPY = 0.8
#: Pages before and after that are looked at.
REACH = 3
#: Bits of a table that an alignment holds.
TABLE = 1 << 26


def path_key(url: str | None) -> tuple[str | None, str | None]:
    """Host and path of a URL; the query and the fragment don't place a page."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or None), parts.path.rstrip("/")
    except ValueError:
        return None, None


#: What is known of a line: settled as text, open, under a class word that names furniture, or open within an article.
FIXED, OPEN, MARKED, HINTED = 0, 1, 2, 3
#: What a class or id says: nothing, a word of furniture in another sense maybe, furniture.
NONE, HINT, FURNITURE = 0, 1, 2


def _tokens(rest: str) -> list[str]:
    """The words of class and id."""
    return [t for k, *v in ATTRIBUTE.findall(rest) if k.lower() in ("class", "id") for t in "".join(v).lower().split()]


def _parts(token: str) -> list[str]:
    return [x for x in re.split(r"[^a-z0-9]+", token) if x]


def _names(parts: list[str], inside: bool) -> int:
    """What a word or a compound says, in an article or outside."""
    first, last = parts[0], parts[-1]
    if len(parts) == 1:
        return FURNITURE if first in (INNER if inside else MARKS) else HINT if first in MARKS else NONE
    if first in HAVING or first not in MARKS and last not in MARKS:
        return NONE
    if inside:
        return FURNITURE if first in INNER | LISTED and last in BOXES else HINT
    boxed = first in MARKS and last in BOXES | MARKS or first in ADVERTS
    return FURNITURE if boxed or last in MARKS and (last not in EITHER or first in SITE) else HINT


def _named(rest: str, inside: bool) -> int:
    """What a class or id says, by the word of it that says most."""
    return max((_names(p, inside) for p in map(_parts, _tokens(rest)) if p), default=NONE)


def _is_card(rest: str) -> bool:
    """Whether an article's class says that it is a comment or leads to another page."""
    tokens = _tokens(rest)
    if not PROSE.isdisjoint(tokens):
        return False
    named = [p for p in map(_parts, tokens) if p and p[0] in CARDS]
    return any(len(p) == 1 or p[-1] in BOXES or p[-1].isdigit() for p in named)


def _is_hidden(rest: str) -> bool:
    return "hidden" in rest.lower() and bool(HIDDEN.search(QUOTED.sub("", rest)))


def _role(rest: str) -> str:
    return next(("".join(v).lower() for k, *v in ATTRIBUTE.findall(rest) if k.lower() == "role"), "") if "role" in rest.lower() else ""


@dataclass(frozen=True)
class _Place:
    """Where a line lies: in an article or main element, in settled furniture (``out``), under the marked element ``mark``, in a part of an article that a word hints at."""

    article: bool = False
    main: bool = False
    out: bool = False
    wrapped: bool = False
    mark: int = 0
    hint: bool = False

    def inside(self, name: str, rest: str, number: int) -> _Place:
        """The place within a child element."""
        if self.out and not self.wrapped:
            return self
        if name in ("html", "body"):
            return self
        if _is_hidden(rest):
            return replace(self, out=True, wrapped=False)
        if name == "article":
            if "=" not in rest or not _is_card(rest):
                return replace(self, article=True, out=False, wrapped=False)
            return replace(self, out=True, wrapped=False) if self.article or self.out else replace(self, mark=self.mark or number)
        role = _role(rest) if "=" in rest else ""
        if name == "main" or role == "main":
            return replace(self, main=True, out=False, wrapped=False)
        settled = self.article or self.main
        if name in DROPPED or name == "header" and not settled or role in ROLES and not (settled and role == "banner"):
            return replace(self, out=True, wrapped=name in WRAPPERS and not settled)
        if "=" in rest and not self.mark and not self.out:
            said = _named(rest, self.article)
            if self.article and said:
                return replace(self, out=True, wrapped=False) if said == FURNITURE else replace(self, hint=True)
            if said == FURNITURE:
                return replace(self, mark=number)
        return self


def blocks_of(html: str | None) -> list[tuple[str, int]]:
    """The lines that no furniture element holds, in page order, and what is known of each."""
    lines, found = [], _parsed(html)
    marked = {place.mark for _, place in found if place.article and place.mark}
    free = any(place.article and not place.mark for _, place in found)
    # an article under a mark is the page's if there is no other; then the mark says nothing
    released = set() if free else marked
    mains = any(place.main and (not place.mark or place.mark in released) for _, place in found)
    for line, place in found:
        mark = place.mark and place.mark not in released
        if place.article and not mark:
            lines.append((line, HINTED if place.hint else FIXED))
        elif mark:
            lines.append((line, MARKED))
        else:
            lines.append((line, OPEN if place.main or not mains else MARKED))
    return lines


def lines_of(html: str | None) -> tuple[list[str], list[bool]]:
    """The lines of a page that is compared with nothing, and whether each lies in an article."""
    kept = kept_lines(blocks_of(html), (), False)
    return [x for x, _ in kept], [k == FIXED for _, k in kept]


def kept_lines(blocks: list[tuple[str, int]], deleted, compared: bool) -> list[tuple[str, int]]:
    """Settled lines, and open lines that aren't deleted; those beside an article only where differencing had another page."""
    opened, gone = compared or all(k not in (FIXED, HINTED) for _, k in blocks), set(deleted)
    return [(x, k) for i, (x, k) in enumerate(blocks) if k == FIXED or (k == HINTED or k == OPEN and opened) and i not in gone]


def _parsed(html: str | None) -> list[tuple[str, _Place]]:
    source, at, size = html or "", 0, len(html or "")
    stack: list[tuple[str, _Place]] = []
    here, number = _Place(), 0
    lines: list[tuple[str, _Place]] = []
    text: list[str] = []

    def close() -> None:
        line = " ".join("".join(text).split())
        text.clear()
        if line:
            lines.append((line, here))

    def pop(height: int) -> None:
        nonlocal here
        here = stack[height][1]
        del stack[height:]

    while at < size:
        less = source.find("<", at)
        if less < 0:
            less = size
        if less > at and not here.out:
            text.append(entities.unescape(source[at:less]))
        m = TOKEN.match(source, less) if less < size else None
        if not m:
            if less < size:
                after = source[less + 1 : less + 2]
                if after == "/" or after.isalpha() and after.isascii():  # a tag with a stray quote, or "</" and no name
                    at = LOOSE_END.match(source, less + 1).end()
                    continue
                if not here.out:
                    text.append("<")
            at = less + 1
            continue
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK:
            close()
        if m["end"]:
            height = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if height is not None:
                pop(height)
            continue
        if name in VOID:
            continue
        if name in ("p", "li") and stack and stack[-1][0] == name:
            pop(len(stack) - 1)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
            at = end.end() if end else size
            continue
        if m["rest"].endswith("/") and name in ("svg", "canvas", "object"):
            continue
        stack.append((name, here))
        number += 1
        here = here.inside(name, m["rest"], number)
    close()
    return lines


def _rows(x: list[int], y: list[int]) -> Iterator[int]:
    """Row by row of the table of common subsequences, the places where it doesn't grow as bits of a long integer."""
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    row = full = (1 << len(y)) - 1
    for v in x:
        u = row & where.get(v, 0)
        row = (row + u | row - u) & full
        yield row


def _lengths(x: list[int], y: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of x with each beginning of y, the empty one too."""
    row = (1 << len(y)) - 1
    for row in _rows(x, y):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _middle(x: list[int], y: list[int]) -> list[int]:
    """Places in x of a longest common subsequence; a table of more than TABLE bits is halved instead of held."""
    if not x or not y:
        return []
    if len(x) > 1 and len(x) * len(y) > TABLE:
        half = len(x) // 2
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        return _middle(x[:half], y[:cut]) + [half + p for p in _middle(x[half:], y[cut:])]
    rows, i, j, out = list(_rows(x, y)), len(x), len(y), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def common(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    tail = 0
    while tail < high - low and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[low : len(a) - tail], b[low : len(b) - tail]
    both = set(x) & set(y)
    at, y = [i for i, v in enumerate(x) if v in both], [v for v in y if v in both]
    middle = _middle([x[i] for i in at], y)
    return [*range(low), *(low + at[p] for p in middle), *range(len(a) - tail, len(a))]


def shared_lines(own: list[int], kinds: list[int], neighbours: list[tuple[int, list[int]]]) -> tuple[list[int], bool]:
    """Places of the lines to delete, those shared with the nearest neighbour that isn't a copy; whether there is one."""
    different = {tuple(n): set(n) for _, n in neighbours if list(n) != own}
    for _, other in sorted(neighbours, key=lambda n: -n[0]):
        if list(other) == own:
            continue
        further = [lines for n, lines in different.items() if n != tuple(other)]
        template = {x for x in own if further and 2 * sum(x in lines for lines in further) >= len(further)}
        places, left = common(own, other), sum(x not in template for x in own)
        if not left or sum(own[p] not in template for p in places) < COPY * left:
            return [p for p in places if kinds[p] != FIXED], True
    return [], False


SIGNED = "page_id long, url string, html_hash long, host string, path string, lines array<long>, kinds array<tinyint>"
ROW = ["page_id", "url", "html_hash"]


def signatures(pages: DataFrame) -> DataFrame:
    """SIGNED's rows: what pairing needs of each page."""

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page_id, url, html, h in zip(b["page_id"], b["url"], b["html"], b["h"], strict=True):
                blocks = blocks_of(html)
                hashes = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x, _ in blocks]
                rows.append((None if pd.isna(page_id) else int(page_id), url, h, *path_key(url), hashes, [k for _, k in blocks]))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in SIGNED.split(", ")])
            yield out.astype({"page_id": "Int64"})

    return pages.select("page_id", "url", "html", F.xxhash64("html").alias("h")).mapInPandas(signed, SIGNED)


def differenced(pages: DataFrame) -> DataFrame:
    """ROW, ``deleted`` (numbers of the lines shared with the neighbour), ``compared`` and ``opened`` (has open lines).

    A row for each different page that has lines to decide, or lines under a mark, and a host; equal rows have one.
    """
    order = ["host", "path", *ROW]
    ranged = signatures(pages).where("host is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    n = F.monotonically_increasing_id()
    ranged = materialize(ranged.withColumn("part", F.shiftright(n, 33).cast("int")).withColumn("k", n.bitwiseAND((1 << 33) - 1)))
    before, offset = [], 0
    for r in sorted(ranged.groupBy("part").count().collect()):  # a row per part
        before.append((r["part"], offset))
        offset += r["count"]
    at = pages.sparkSession.createDataFrame(before, "part int, before long")
    placed = ranged.join(F.broadcast(at), "part").withColumn("at", F.col("before") + F.col("k")).drop("part", "k", "before")
    steps = F.explode(F.array(*[F.lit(k) for d in range(1, REACH + 1) for k in (-d, d)])).alias("step")
    near = placed.select("at", "host", "path", "lines", steps).groupBy((F.col("at") + F.col("step")).alias("at")).agg(
        F.collect_list(F.struct(F.abs("step").alias("far"), "host", "path", "lines")).alias("near")  # a page's few neighbours
    )
    paired = placed.where(F.exists("kinds", lambda k: k != FIXED)).join(near, "at", "left")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                near = sorted((o for o in (() if r.near is None else r.near) if o["host"] == r.host), key=lambda o: o["far"])
                near = [(_alike(r.path, o["path"]), list(o["lines"])) for o in near]
                kinds = list(r.kinds)
                places, told = shared_lines(list(r.lines), kinds, near)
                rows.append((None if pd.isna(r.page_id) else int(r.page_id), r.url, r.html_hash, places, told, OPEN in kinds or HINTED in kinds))
            yield pd.DataFrame(rows, columns=[*ROW, "deleted", "compared", "opened"]).astype({"page_id": "Int64"})

    found = paired.mapInPandas(compared, "page_id long, url string, html_hash long, deleted array<int>, compared boolean, opened boolean")
    one = F.max(F.struct(F.size("deleted").alias("n"), "deleted", "compared", "opened")).alias("r")
    return materialize(found.groupBy(*ROW).agg(one).select(*ROW, "r.deleted", "r.compared", "r.opened"))


def _alike(a: str | None, b: str | None) -> int:
    """Length of the common beginning of two paths."""
    n = 0
    for x, y in zip(a or "", b or "", strict=False):
        if x != y:
            break
        n += 1
    return n


@F.pandas_udf(T.StringType())
def text_of(html: pd.Series, deleted: pd.Series, compared: pd.Series) -> pd.Series:
    out = []
    for page, gone, told in zip(html, deleted, compared, strict=True):
        gone = () if gone is None else np.asarray(gone).tolist()
        out.append("\n\n".join(x for x, _ in kept_lines(blocks_of(page), gone, told is not None and bool(told))))
    return pd.Series(out, dtype=object)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    rows = pages.select("page_id", "url", "html", F.xxhash64("html").alias("html_hash"))
    rows = join_small(rows, differenced(pages).where("opened").drop("opened"), ROW)
    rows = rows.select("page_id", "url", text_of("html", "deleted", "compared").alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
