"""The queries of this subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, html_text, mixing, quality_classifier, quality_rules, repeats, secrets, simhash, token_counts, token_files, warc
from .common import shared_dir, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives with torn copies of one in a hundred records between the whole ones: every page comes back all the same."""
    return warc.round_trip(table(spark, sf_dir, "pages"), torn=100)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = decontaminate.items_digest().alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.life_cycle(table(spark, sf_dir, "documents"), shared_dir(spark))


def op10_token_counts_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.by_version(table(spark, sf_dir, "documents"), shared_dir(spark), token_files.tokenizer_path())


def op11_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_source_mixing": op3_source_mixing,
    "op4_warc_salvage": op4_warc_salvage,
    "op5_simhash": op5_simhash,
    "op6_secret_scan": op6_secret_scan,
    "op7_html_extraction": op7_html_extraction,
    "op8_decontamination": op8_decontamination,
    "op9_token_ids": op9_token_ids,
    "op10_token_counts": op10_token_counts,
    "op10_token_counts_by_version": op10_token_counts_by_version,
    "op11_repeated_strings": op11_repeated_strings,
    "op12_centroid_clustering": op12_centroid_clustering,
}


#: From the contract: sizes, targets by the level at which no source is above its cap, copies one after another in the order
#: of the id's hash as long as they end within the target, and one copy of one row that comes nearest to what is left. The
#: first copy is read when the demand, (1 - s) t + s t^2 of the target, reaches its place, known to the hash's bucket of words.
MIXING_SQL = r"""
with recursive d as (
    select row_number() over () as r, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
        md5(concat('7:', cast(doc_id as varchar))) as k
    from documents
), s as (
    select source, sum(size) as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from d group by 1
), level(n, l) as (
    select 0, cast(0 as double)
    union all
    select n + 1, (select (cast(sum(source_size) as double) - coalesce(sum(case when not 3 * source_size > w * level.l then 3 * source_size end), 0))
        / nullif(sum(case when 3 * source_size > w * level.l then w end), 0) from s)
    from level where n < 40 and l is not null
), t as (
    select source, source_size, round(least(cast(3 * source_size as double), w * (select max(l) from level)), 6) as target from s
), copies as (
    select r, d.source, size, k, target, sum(size) over (partition by d.source order by e, k, r) as ends
    from d join t on t.source is not distinct from d.source, range(3) as x(e) where size > 0
), whole as (
    select r, source, size, k, count(*) filter (ends <= floor(target + 1e-6)) as n, max(floor(target + 1e-6)) as room from copies group by 1, 2, 3, 4
), rest as (
    select source, max(room) - sum(size * n) as left_over from whole group by 1
), one as (
    select r, row_number() over (partition by w.source order by abs(left_over - size), k, r) as nth
    from whole w join rest on rest.source is not distinct from w.source where n < 3 and abs(left_over - size) < left_over
), line as (
    select source, b, words, coalesce(sum(words) over (partition by source order by b rows between unbounded preceding and 1 preceding), 0) as before
    from (select source, substr(k, 1, 3) as b, sum(size) as words from d group by 1, 2)
), place as (
    select d.r, least(1.0, cast(case when whole.n > 0 then line.before + cast(cast(concat('0x', substr(d.k, 4, 8)) as bigint) as double) / 4294967296 * line.words
        when one.r is not null then whole.room - rest.left_over end as double) / target) as share, (w - 2) / cast(2 as double) as slope
    from d join s on s.source is not distinct from d.source join t on t.source is not distinct from d.source
        join line on line.source is not distinct from d.source and line.b = substr(d.k, 1, 3) join whole on whole.r = d.r
        join rest on rest.source is not distinct from d.source left join one on one.nth = 1 and one.r = d.r
    where whole.n > 0 or one.r is not null
), read as (
    select r, case when slope = 0 then share else (sqrt(pow(1 - slope, 2) + 4 * slope * share) - (1 - slope)) / (2 * slope) end as first_position from place
)
select doc_id, cast(d.size as bigint) as size, cast(source_size as bigint) as source_size, target,
    cast(d.size * (coalesce(whole.n, 0) + case when one.r is not null then 1 else 0 end) as bigint) as taken,
    cast(coalesce(whole.n, 0) + case when one.r is not null then 1 else 0 end as bigint) as copies, round(first_position, 6) as first_position
from d join t on t.source is not distinct from d.source left join whole on whole.r = d.r left join one on one.nth = 1 and one.r = d.r left join read on read.r = d.r
"""

WARC_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages), g as (select *, strlen(h) as n, max(page_id) over (partition by h) as m from p)
select page_id, n as payload_bytes, sha1(h) as payload_digest, case when n >= 1000 and page_id <> m then 'revisit' else 'response' end as record_type,
    case when n >= 1000 and page_id <> m then m end as refers_to
from g
"""

_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _FOLDED + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION_SQL = f"""
with i as (select item_id, {_WORDS} as w from benchmark), iz as (select *, least(13, len(w)) as z from i where len(w) > 0),
iw as (select distinct item_id, z, array_to_string(list_slice(w, n, n + z - 1), ' ') as g from (select *, unnest(range(1, len(w) - z + 2)) as n from iz)),
d as (select doc_id, coalesce({_WORDS}, []) as w from documents),
dw as (select doc_id, z, n, array_to_string(list_slice(w, n, n + z - 1), ' ') as g
    from (select doc_id, w, z, unnest(range(1, len(w) - z + 2)) as n from d, (select distinct z from iw) where len(w) >= z)),
h as (select doc_id, dw.z, n, item_id from dw join iw on iw.z = dw.z and iw.g = dw.g),
c as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(n, n + z)) as x from h) group by 1),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from h) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join c on c.doc_id = d.doc_id left join t on t.doc_id = d.doc_id
"""

TOKEN_COUNTS_SQL = r"""
with c as (select source, lang, coalesce(len(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 0) as n from documents)
select source, lang, 'words-2' as tokenizer, count(*) as documents, cast(sum(n) as bigint) as tokens from c where n > 0 group by 1, 2
"""

#: Every string of 100 bytes as 200 hexadecimal digits, numbered among its equals; a byte goes if such a start lies up to 99 before it.
REPEATS_SQL = """
with d as materialized (select row_number() over (order by doc_id nulls first) as r, doc_id, hex(encode(coalesce(text, ''))) as hx from documents),
p as materialized (select r, doc_id, i, substr(hx, 2 * i + 1, 2) as b, case when i + 100 <= len(hx) // 2 then md5(substr(hx, 2 * i + 1, 200)) end as w
    from (select *, unnest(range(len(hx) // 2)) as i from d)),
w as (select r, i, row_number() over (partition by w order by r, i) > 1 as again from p where w is not null),
c as (select p.r, p.i, b, max(case when again then 1 else 0 end) over (partition by p.r order by p.i rows between 99 preceding and current row) = 1 as gone
    from p left join w on w.r = p.r and w.i = p.i),
g as (select *, gone and not coalesce(lag(gone) over (partition by r order by i), false) as begins from c),
t as (select r, count(*) as n_bytes, count(*) filter (gone) as n_removed, count(*) filter (begins) as n_spans, string_agg(b, '' order by i) filter (not gone) as rest
    from g group by 1)
select doc_id, coalesce(n_bytes, 0) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(rest, ''))) as kept_sha256
from d left join t on t.r = d.r
"""

#: The rounds of Lloyd's algorithm written one after another: distances in long form, then exact floors of the means.
_ROUND = """
a{n} as materialized (select r, c, d from (select r, c, d, row_number() over (partition by r order by d, c) as q
    from (select k.r, m.c, sum((k.x - m.x) * (k.x - m.x)) as d from k join c{n} m on m.i = k.i group by 1, 2)) where q = 1)"""
_MEANS = """, c{m} as materialized (select o.c, o.i, coalesce((s - (s % n + n) % n) // n, o.x) as x from c{n} o
    left join (select a.c, k.i, sum(k.x) as s, count(*) as n from a{n} a join k on k.r = a.r group by 1, 2) g on g.c = o.c and g.i = o.i),"""
CENTROIDS_SQL = (
    """
with e as (select row_number() over () as r, vec_id, embedding from embeddings where len(embedding) = 64),
l as (select r, vec_id, generate_subscripts(embedding, 1) as i, cast(unnest(embedding) as double) as x from e),
k as materialized (select r, vec_id, i, cast(floor(256 * x) as bigint) as x from l where r not in (select r from l where x is null or not isfinite(x))),
h as (select r, row_number() over (order by sha256(concat('2:', cast(vec_id as varchar)))) - 1 as c from k where i = 1 qualify c < 40),
c0 as materialized (select c, i, x from h join k on k.r = h.r),"""
    + "".join(_ROUND.format(n=n) + _MEANS.format(n=n, m=n + 1) for n in range(5))
    + _ROUND.format(n=5)
    + """, s as (select c, sha256(string_agg(cast(cast(x as bigint) as varchar), ',' order by i)) as centroid_sha256 from c5 group by 1)
select vec_id, cast(a.c as integer) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by a.c) as bigint) as cluster_inertia,
    cast(sum(d) over () as bigint) as inertia, centroid_sha256
from a5 a join k on k.r = a.r and k.i = 1 join s on s.c = a.c
"""
)

#: The others learn, resolve components, extract or tokenise; their tests hold them against brute force.
ORACLE_SQL = {
    "op3_source_mixing": MIXING_SQL,
    "op4_warc_salvage": WARC_SQL,
    "op8_decontamination": DECONTAMINATION_SQL,
    "op10_token_counts": TOKEN_COUNTS_SQL,
    "op11_repeated_strings": REPEATS_SQL,
    "op12_centroid_clustering": CENTROIDS_SQL,
}
