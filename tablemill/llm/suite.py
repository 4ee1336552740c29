"""Registered queries of this subpackage: name -> (query over whole tables, the same in SQL or None)."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, divergence, exact_dedup, language_id, mixing, near_dedup, quality, ranked_search, sharding, substring_dedup, suffix_dedup, toxicity, warc

QUERIES = {}


def query(sql=None):
    def add(function):
        QUERIES[function.__name__] = (function, sql)
        return function

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_substring_dedup(spark, folder):
    return substring_dedup.remove_repeats(_table(spark, folder, "documents"), keep_text=False)


@query(
    r"""
    with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
    g as (select t, min(doc_id) as keep_id, count(*) as group_size from d group by t)
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from d join g using (t)
    """
)
def op2_exact_dedup(spark, folder):
    return exact_dedup.exact_groups(_table(spark, folder, "documents"))


@query()
def op3_sharding(spark, folder):
    return sharding.shard_digest(_table(spark, folder, "documents"))


@query(
    r"""
    with w as (
      select 'd' as kind, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents
      union all
      select 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
    items as (select id, words, least(10, len(words)) as n from w where kind = 'b' and len(words) > 0),
    tests as (select distinct id, n, array_to_string(words[k + 1:k + n], ' ') as test
      from (select id, words, n, unnest(range(0, len(words) - n + 1)) as k from items)),
    places as (select id, n, k, array_to_string(words[k + 1:k + n], ' ') as test from (
      select w.id, words, n, unnest(range(0, len(words) - n + 1)) as k from w, (select distinct n from tests) where kind = 'd' and len(words) >= n)),
    found as (select p.id, p.k, p.n, t.id as item from places p join tests t on p.test = t.test and p.n = t.n),
    hit as (select id, count(distinct h) as n_hit from (select id, unnest(range(k, k + n)) as h from found) group by id),
    named as (select id, count(*) as n_items, string_agg(item, ',' order by item) as items
      from (select distinct id, cast(item as varchar) as item from found) group by id)
    select w.id as doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
      sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from w left join hit on hit.id = w.id left join named on named.id = w.id where kind = 'd'
    """
)
def op4_decontaminate(spark, folder):
    found = decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


@query()
def op5_near_dedup(spark, folder):
    return near_dedup.near_groups(_table(spark, folder, "documents"))


@query()
def op6_language_id(spark, folder):
    return language_id.identify(_table(spark, folder, "documents"))


@query(
    """
    with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as digest from pages),
    f as (select digest, min(page_id) as first from p where n >= 100 group by digest)
    select page_id, n as payload_bytes, p.digest as payload_digest,
      case when page_id > first then 'revisit' else 'response' end as record_type,
      case when page_id > first then first end as refers_to
    from p left join f on p.digest = f.digest and n >= 100
    """
)
def op7_warc(spark, folder):
    return warc.round_trip(_table(spark, folder, "pages")).drop("url")


@query()
def op8_mixing(spark, folder):
    chosen = mixing.copies(_table(spark, folder, "documents"))
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query()
def op9_suffix_dedup(spark, folder):
    return suffix_dedup.remove_repeats(_table(spark, folder, "documents"), keep_bytes=False)


@query()
def op10_toxicity(spark, folder):
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@query(
    r"""
    with w as (
      select 'd' as kind, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words from documents
      union all
      select 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') from benchmark),
    whole as (select count(*) filter (len(words) > 0) as docs, cast(sum(len(words)) as bigint) as terms from w where kind = 'd'),
    q as (select id as item, term, count(*) as n from (select id, unnest(words) as term from w where kind = 'b') group by all),
    t as (select id, term, count(*) as tf from (select id, unnest(words) as term from w where kind = 'd') semi join q using (term) group by all),
    weights as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from t, whole group by term, docs),
    lengths as (select id, 25 + ((75 * len(words)::hugeint * docs) // terms) as m from w, whole where kind = 'd' and len(words) > 0),
    scored as (select item, id as doc_id, cast(sum(n * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
      from q join t using (term) join weights using (term) join lengths using (id) group by all),
    ranked as (select *, row_number() over (partition by item order by score desc, doc_id) as rank from scored where score > 0)
    select item as item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10
    """
)
def op11_ranked_search(spark, folder):
    return ranked_search.rank_documents(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@query()
def op12_quality(spark, folder):
    return quality.quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@query(
    r"""
    with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words
      from documents),
    w as (select lang, source, r, unnest(words) as term from d),
    kept as (select lang, term, count(*) as all_n from w group by lang, term having count(distinct r) >= 3),
    v as (select lang, count(*) as kinds, sum(all_n) as lang_total from kept group by lang),
    c as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by all),
    g as (select lang, source, coalesce(any_value(total), 0) as total, coalesce(any_value(kinds), 0) as kinds, coalesce(any_value(lang_total), 0) as lang_total
      from (select distinct lang, source from d) left join (select lang, source, sum(n) as total from c group by all) using (lang, source) left join v using (lang) group by all),
    cells as (select lang, source, term, coalesce(n, 0) as n, all_n, 1 + (1000000000::hugeint * (coalesce(n, 0) + 1)) // (total + kinds)::hugeint as p,
        1 + (1000000000::hugeint * (all_n + 1)) // (lang_total + kinds)::hugeint as q
      from g join kept using (lang) left join c using (lang, source, term)),
    apart as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
      from cells a join cells b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
    pairs as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value
      from g a join g b on a.lang = b.lang and a.source <> b.source left join apart p on p.lang = a.lang and p.source = a.source and p.item = b.source),
    typical as (select lang, source, 'term' as part, term as item, cast(((p - q) * (p - q)) // q as bigint) as value from cells where n > 0 and p > q)
    select lang, source, part, item, value, cast(rank as integer) as rank
    from (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from (select * from pairs union all select * from typical))
    where part = 'pair' or rank <= 200
    """
)
def op13_source_divergence(spark, folder):
    return divergence.audit(_table(spark, folder, "documents"))
