"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import ann, bpe, extract, gam, mixing, prefixes, rank_profiles, ranking, revisits, rules, simhash, trie_scoring, variants
from driftline.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
COUNTERPARTS: dict[str, str] = {}


def register(sql: str | None = None) -> Callable:
    def add(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[query.__name__] = query
        if sql:
            COUNTERPARTS[query.__name__] = sql
        return query

    return add


@register()
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract.main_text(pages, extract.fitted()).select(F.col("id").alias("page_id"), "url", "text", F.col("n_chars"))


@register()
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), path)).withColumnRenamed("id", "doc_id")


@register()
def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = ann.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@register()
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = trie_scoring.score(docs, learn=fold("doc_id") != 1)
    return found.select(
        F.col("id").alias("doc_id"), (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


MIX_SQL = r"""
with docs as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), sources as (
    select source, sum(size)::bigint as source_size from docs group by source
), weighed as (
    select *, (row_number() over (order by source is null, source) - 1) as place from sources
), limits as (
    select *, (place % 3 + 1) as weight, 3 * source_size as most from weighed
), shares as (
    select *, row_number() over w as n,
        sum(source_size) over () - coalesce(sum(most) over (w rows between unbounded preceding and 1 preceding), 0) as remaining,
        sum(weight) over () - coalesce(sum(weight) over (w rows between unbounded preceding and 1 preceding), 0) as weights
    from limits window w as (order by most / weight, place)
), level as (
    select arg_min(remaining::bigint, n) as remaining, arg_min(weights::bigint, n) as weights, min(n) as n
    from shares where most * weights > remaining * weight
), targets as (
    select s.source, s.source_size,
        case when l.n is null or s.n < l.n then most::double else l.remaining * s.weight / l.weights end as target
    from shares s cross join level l
), placed as (
    select d.doc_id, d.size, t.source_size, t.target, case when t.source_size = 0 then 0 else floor(t.target / t.source_size)::bigint end as epochs,
        coalesce(sum(d.size) over (partition by d.source order by md5('mix:' || d.doc_id), d.doc_id, d.size
                          rows between unbounded preceding and 1 preceding), 0) as before
    from docs d join targets t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
    (epochs * size + greatest(0, least(size, floor(target - epochs * source_size) - before)))::bigint as taken
from placed
"""


@register(MIX_SQL)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@register()
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "perplexity"
    )


@register()
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = gam.train(docs, table(spark, sf_dir, "labels"), learn=fold("doc_id") != 0)
    return gam.classify(docs, model).select(F.col("id").alias("doc_id"), (fold("id") == 0).alias("held_out"), "score", "predicted")


@register()
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return prefixes.token_counts(table(spark, sf_dir, "documents"), path, limit=4096).withColumnRenamed("id", "doc_id")


def captures(pages: DataFrame) -> DataFrame:
    """A crawl of the pages: a response each, revisits before and after it, some again in full, some that failed."""
    stamp = lambda s: F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd HH:mm:ss")
    p, k = F.col("page_id"), F.col("k")
    first = F.lit(1704067200) + p * 7919 % 2592000
    moments = F.array(*[F.lit(x) for x in range(6)])
    rows = pages.select("page_id", "url", F.length("html").alias("n"), F.md5("html").alias("digest")).withColumn("k", F.explode(moments))
    rows = rows.filter(~((k == 4) & (p % 3 != 0)) & ~((k == 5) & (p % 11 != 0)))
    at = first + F.when(k == 1, 3600).when(k == 2, 7200).when(k == 3, -3600).when(k == 4, 5400).when(k == 5, 3000).otherwise(0)
    quoted = F.concat(F.lit('"'), "digest", F.lit('"'))
    tag = F.when((k == 2) & (p % 5 == 0), '"changed"').when(k == 2, F.concat(F.lit("W/"), quoted)).otherwise(quoted)
    shared = F.concat(F.lit("Date: "), stamp(at), F.lit("\r\nETag: "), tag)
    full = F.concat(F.lit("Server: s\r\nContent-Type: text/html\r\nCache-Control: max-age=60\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n"), shared)
    short = F.concat(F.lit("Cache-Control: max-age=600\r\nContent-Length: 0\r\nVary: Accept\r\n"), shared)
    revisit = k.isin(1, 2, 3)
    url = F.when(k == 1, F.concat(F.upper(F.substring("url", 1, 4)), F.substring("url", 5, 1 << 30), F.lit("#again"))).otherwise(F.col("url"))
    return rows.select(
        F.concat_ws("-", p, k).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        F.when(revisit, revisits.NOT_MODIFIED[1]).alias("profile"),
        url.alias("url"),
        F.timestamp_seconds(at).alias("captured_at"),
        F.when(revisit, 304).when(k == 5, 500).otherwise(200).alias("status"),
        F.when(revisit, short).otherwise(full).alias("headers"),
    )


REVISIT_SQL = r"""
with base as (
    select page_id, md5(html) as digest, length(html) as n, 1704067200 + page_id * 7919 % 2592000 as t,
        regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)([^?#]*)(\?[^#]*)?', ['scheme', 'host', 'path', 'query']) as u from pages
), named as (
    select *, lower(u.scheme) || '://' || regexp_replace(lower(u.host), case lower(u.scheme) when 'http' then ':(80)?$' else ':(443)?$' end, '')
        || case when u.path = '' then '/' else u.path end
        || case when len(u.query) < 2 then '' else '?' || array_to_string(list_sort(string_split(u.query[2:], '&')), '&') end as canonical
    from base
), responses as (
    select canonical, moment, max(id) as id, arg_max(digest, id) as digest, arg_max(n, id) as n from (
        select canonical, digest, n, t + unnest([0, 5400]) as moment, unnest([0, 4]) as k, page_id || '-' || k as id, page_id from named)
    where k = 0 or page_id % 3 = 0 group by canonical, moment
), again as (
    select page_id, canonical, digest, t + unnest([3600, 7200, -3600]) as moment, unnest([1, 2, 3]) as k from named
), joined as (
    select a.page_id || '-' || a.k as record_id, a.canonical, a.moment, r.id as response_id, r.n, r.digest as old,
        case when a.k = 2 and a.page_id % 5 = 0 then 'changed' else a.digest end as new, a.k
    from again a asof left join responses r on a.canonical = r.canonical and a.moment > r.moment
)
select record_id, canonical, response_id,
    case when response_id is null then 'missing' when old = new then 'resolved' else 'changed' end as outcome,
    case when old = new then
        'cache-control: max-age=600' || chr(10) || 'content-length: ' || n || chr(10) || 'content-type: text/html' || chr(10)
        || 'date: ' || strftime(make_timestamp((moment * 1000000)::bigint), '%Y-%m-%d %H:%M:%S') || chr(10)
        || 'etag: ' || case when k = 2 then 'W/' else '' end || '"' || new || '"' || chr(10) || 'server: s' || chr(10) || 'vary: Accept' end as headers
from joined
"""


@register(REVISIT_SQL)
def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(captures(table(spark, sf_dir, "pages")))
    return found.select("record_id", "canonical", "response_id", "outcome", revisits.header_text(F.col("headers")).alias("headers"))


@register()
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


RANKED_SQL = r"""
with cut as (
    select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
    from documents
), docs as (
    select doc_id, terms, len(terms)::bigint as n, row_number() over (order by doc_id) as place from cut where len(terms) > 0
), totals as (
    select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from docs
), items as (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
), asked as (
    select item_id, term, count(*)::bigint as q from items group by all
), held as (
    select doc_id, place, n, term, count(*)::bigint as tf from (select doc_id, place, n, unnest(terms) as term from docs)
    where term in (select term from asked) group by all
), weights as (
    select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from held, totals group by term
), scores as (
    select item_id, place, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::bigint as score
    from asked join held using (term) join weights using (term), totals group by all
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scores where score > 0
qualify rank <= 10
"""


@register(RANKED_SQL)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
    return found.withColumnRenamed("id", "doc_id")


VARIANTS_SQL = r"""
with steps as (
    select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) as t
    from (select unnest(range(256)) as i)
), found as (
    select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
    from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) as r from documents) group by all
), hashed as (
    select run, n, xor(list_reduce(flatten(list_transform(string_split(doc_id || ':' || run, ''),
            lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [192 | (unicode(x)::bigint >> 6), 128 | (unicode(x)::bigint & 63)] end)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) as h
    from found, steps where length(run) >= 6
), results as (
    select n, case when h % 199 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word from hashed
), words as (
    select word, sum(n)::bigint as n from results where length(word) >= 6 group by word having sum(n) >= 5
), places as (
    select word, n, unnest(range(1, length(word) + 1)) as i from words
), holes as (
    select word, i, left(word, i - 1) as a, substr(word, i + 1) as b from places
), near as (
    select x.word, y.word as other from holes x join holes y on x.i = y.i and x.a = y.a and x.b = y.b and x.word <> y.word
    union select x.word, y.word from holes x join words y on y.word = x.a || x.b
    union select y.word, x.word from holes x join words y on y.word = x.a || x.b
), best as (
    select near.word, count(*) as n_near, arg_max(struct_pack(w := o.word, n := o.n), (o.n, -p.place)) as top
    from near join words o on o.word = near.other join (select word, row_number() over (order by word) as place from words) p on p.word = o.word group by near.word
), forms as (
    select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when top.n >= 5 * w.n then top.w end as form, case when top.n >= 5 * w.n then top.n end as form_n
    from words w left join best b on b.word = w.word
), ways as (
    with recursive way as (
        select word, word as here, form as next from forms
        union all select way.word, f.word, f.form from way join forms f on f.word = way.next
    ) select word, here as root from way where next is null
)
select word, form, root, n, n_near, form_n from forms join ways using (word)
"""


@register(VARIANTS_SQL)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(table(spark, sf_dir, "documents"))


LANGUAGE_SQL = r"""
with steps as (
    select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) as t
    from (select unnest(range(256)) as i)
), docs as (
    select doc_id, lang, text, xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: unicode(x)::bigint),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 4 = 2 as held_out
    from documents, steps
), words as (
    select doc_id, word, count(*) as n from (
        select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}]+')) as word from docs where regexp_matches(text, '\p{L}')) group by all
), parts as (
    select doc_id, n, substr(' ' || word || ' ', i, size) as gram from words, (values (1), (2), (3)) s(size), unnest(range(1, length(word) + 4 - size)) u(i)
), counts as (
    select doc_id, gram, sum(n) as n from parts where gram <> ' ' group by all
), own as (
    select doc_id, gram, row_number() over (partition by doc_id order by n desc, gram) - 1 as place from counts qualify place < 400
), learned as (
    select lang, gram, row_number() over (partition by lang order by sum(n) desc, gram) - 1 as place
    from counts join docs using (doc_id) where not held_out and lang is not null group by lang, gram qualify place < 400
), sizes as (
    select doc_id, count(*) as size from own group by doc_id
), away as (
    select doc_id, lang, 400 * any_value(size) + sum(abs(own.place - learned.place) - 400) as away
    from own join learned using (gram) join sizes using (doc_id) group by doc_id, lang
), nearest as (
    select * from away qualify row_number() over (partition by doc_id order by away, lang) = 1
)
select doc_id, held_out, coalesce(n.lang, case when size > 0 then (select min(lang) from learned) end, 'und') as lang_pred, coalesce(1 - away::double / (400 * size), 0) as score
from docs left join nearest n using (doc_id) left join sizes using (doc_id)
"""


@register(LANGUAGE_SQL)
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = rank_profiles.learn_profiles(docs, learn=fold("doc_id", 4) != 2)
    return rank_profiles.identify(docs, profiles).select(F.col("id").alias("doc_id"), (fold("id", 4) == 2).alias("held_out"), "lang_pred", "score")
