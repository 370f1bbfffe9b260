"""Key-message mapping, display keywords and the whole analysis of an upload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.functions import text
from scrivener.functions.quality import half_up
from scrivener.operators.mapping import map_messages, semantic_scores
from scrivener.plans import sql
from scrivener.session import cut, once, table


def key_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct key messages that uploads were matched with, under one key each."""
    rows = table(spark, sf_dir, "key_message_matches").where("key_message_id is not null and brand_product is not null and key_message is not null")
    key = F.concat_ws("::", "key_message_id", "brand_product", "key_message")
    named = rows.select(key.alias("record_key"), "key_message_id", "brand_product", "key_message", "key_words")
    return named.groupBy("record_key", "key_message_id", "brand_product", "key_message").agg(F.min("key_words").alias("key_words"))


def unit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc, unit, text`` of all units of uploads."""
    rows = once(table(spark, sf_dir, "source_chunks").select("unit_id", "upload_id", "text"), "unit_id")
    return rows.where("upload_id is not null and text <> ''").select(F.col("upload_id").alias("doc"), F.col("unit_id").alias("unit"), "text")


def newest_analyses(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """The newest analysis of every upload."""
    rows = once(table(spark, sf_dir, "analysis_results").select("analysis_id", "upload_id", "created_at", *cols), "analysis_id").where("upload_id is not null")
    best = rows.groupBy("upload_id").agg(F.max(F.struct("created_at", "analysis_id", *cols)).alias("x"))
    return best.select("upload_id", "x.*").drop("created_at")


def _mapped(spark: SparkSession, sf_dir: str, top_k: int, fuzzy: bool) -> DataFrame:
    docs = newest_analyses(spark, sf_dir, "file_type").select(F.col("upload_id").alias("doc"), "file_type")
    messages = cut(key_messages(spark, sf_dir))
    rows = map_messages(docs, unit_texts(spark, sf_dir), messages, top_k, fuzzy=fuzzy)
    return rows.join(messages, "record_key").select(F.col("doc").alias("upload_id"), "place", "key_message_id", "brand_product", "key_message", "confidence_score")


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most ten key messages of every upload, with boosts by exact, possible and misread brands and the brand lock."""
    return _mapped(spark, sf_dir, 10, True)


def exact_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``mapping``, but misread brands don't count."""
    return _mapped(spark, sf_dir, 10, False)


def all_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All key messages of every upload that score above 0, without a threshold; ten of audio and video."""
    return _mapped(spark, sf_dir, 0, False)


def message_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best likeness of any window of an upload with a key message."""
    return semantic_scores(unit_texts(spark, sf_dir), cut(key_messages(spark, sf_dir))).select(F.col("doc").alias("upload_id"), "record_key", half_up(F.col("semantic"), 4).alias("score"))


def shown_keywords(brand: Column, stored: Column, most: int = 6) -> Column:
    """Two names of the brand and the stored key words, cut at commas, semicolons and bars; each once, at most ``most``."""
    names = F.slice(F.filter(text.brand_aliases(brand), lambda a: F.length(a) > 3), 1, 2)
    parts = F.transform(F.split(text.clean_text(stored), r"[,;|]\s*"), text.clean_text)
    full = F.filter(F.concat(F.coalesce(names, F.array().cast("array<string>")), parts), lambda x: x != "")
    first = F.filter(full, lambda x, i: F.array_position(F.transform(full, F.lower), F.lower(x)) == i + 1)
    return F.array_join(F.slice(first, 1, most), ", ")


def display_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key words shown with every key message."""
    rows = key_messages(spark, sf_dir).where(text.clean_text(F.col("key_words")) != "")
    return rows.select("record_key", shown_keywords(F.col("brand_product"), F.col("key_words")).alias("keywords"))


QUERIES = {
    "cq2_mapping": mapping, "cq2_exact_mapping": exact_mapping, "tk1_all_mapping": all_mapping, "j1_message_scores": message_scores,
    "kw4_display_keywords": display_keywords,
}

_KEYS = """(select key_message_id || '::' || brand_product || '::' || key_message as record_key, key_message_id, brand_product, key_message, min(key_words) as key_words
    from key_message_matches where key_message_id is not null and brand_product is not null and key_message is not null group by all)"""
_TERMS = rf"list_filter(regexp_extract_all(lower(X), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda t: not list_contains({sql.STOP}, t))"
_SEMANTIC = rf"""
    with k as {_KEYS}, u as (select upload_id, unit_id, {sql.clean('text')} as t from {sql.UNITS} where upload_id is not null),
    w as (select upload_id, flatten(list({sql.words('t')} order by unit_id)) as w from u where t <> '' group by 1),
    s as (select upload_id, w, unnest(range(0, len(w), 130)) as a from w),
    ct as (select upload_id, a, term, count(*) as tf from (select upload_id, a, unnest({_TERMS.replace('X', "array_to_string(w[a + 1:a + 160], ' ')")}) as term from s) group by all),
    kt as (select record_key, term, count(*) as tf from (select record_key, unnest({_TERMS.replace('X', "brand_product || ' ' || key_message")}) as term from k) group by all),
    n as (select upload_id, count(*) + (select count(*) from k) as n from s group by 1), kdf as (select term, count(*) as d from kt group by 1),
    cdf as (select upload_id, term, count(*) as d from ct group by all),
    cw as (select ct.upload_id, a, ct.term, tf * (ln((1.0 + n) / (1 + cdf.d + coalesce(kdf.d, 0))) + 1) as w from ct join cdf using (upload_id, term) left join kdf on kdf.term = ct.term join n using (upload_id)),
    kw as (select n.upload_id, record_key, kt.term, tf * (ln((1.0 + n) / (1 + coalesce(cdf.d, 0) + kdf.d)) + 1) as w from kt cross join n join kdf on kdf.term = kt.term
        left join cdf on cdf.upload_id = n.upload_id and cdf.term = kt.term),
    cn as (select upload_id, a, sqrt(sum(w * w)) as l from cw group by all), kn as (select upload_id, record_key, sqrt(sum(w * w)) as l from kw group by all),
    dot as (select cw.upload_id, a, record_key, sum(cw.w * kw.w) as d from cw join kw on cw.upload_id = kw.upload_id and cw.term = kw.term group by all),
    sem as (select upload_id, record_key, round(max(d / cn.l / kn.l), 6) as semantic from dot join cn using (upload_id, a) join kn using (upload_id, record_key) group by all)
"""
_RANKED = _SEMANTIC + rf""",
    al as (select alias, min(brand_product) as brand_product from (
        select distinct brand_product, unnest(list_transform([b, p, f, trim(regexp_split_to_array(f, '[-\s/(]')[1])], lambda x: lower(x))) as alias
        from (select brand_product, b, p, trim(regexp_replace(p, '(?i)\b({'|'.join(text.DOSAGE_FORMS)})\b', '', 'g')) as f
            from (select distinct brand_product, trim(brand_product) as b, trim(regexp_replace(trim(brand_product), '\(.*?\)', '', 'g')) as p from k))) where length(alias) > 2
        group by 1 having count(distinct brand_product) = 1),
    full_text as (select upload_id, string_agg(t, chr(10) order by unit_id) as t from u where t <> '' group by 1),
    ex as (select upload_id, brand_product, min(length(regexp_extract(' ' || lower(t), '(?s)^(.*?[^a-z0-9])' || regexp_escape(alias) || '(?:[^a-z0-9]|$)', 1)) - 1) as position
        from full_text join al on contains(lower(t), alias) where regexp_matches(' ' || lower(t), '[^a-z0-9]' || regexp_escape(alias) || '(?:[^a-z0-9]|$)') group by all),
    firsts as (select upload_id, line from (select unit_id, upload_id, trim(regexp_replace(lower(list_filter(list_transform(string_split(t, chr(10)), lambda s: trim(s)),
        lambda s: length(s) between 3 and 60 and regexp_full_match(s, '[A-Z][A-Z0-9\s\-/()]+'))[1]), '\(.*?\)', '', 'g')) as line from u) where line <> ''
        qualify row_number() over (partition by upload_id order by unit_id) = 1),
    po as (select distinct upload_id, brand_product from firsts join (select distinct brand_product from k) on contains(line, lower(brand_product)) or contains(lower(brand_product), line)),
    br as (select coalesce(po.upload_id, ex.upload_id) as upload_id, coalesce(po.brand_product, ex.brand_product) as brand_product,
        case when po.upload_id is not null then 'possible' else 'exact' end as kind, case when po.upload_id is not null then 1.0::double else 0.99::double - least(position, 200) * 0.0001::double end as brand_score
        from po full join ex on po.upload_id = ex.upload_id and po.brand_product = ex.brand_product),
    cand as (select d.upload_id, k.record_key, coalesce(semantic, 0.0) as semantic, kind, brand_score, file_type, max(brand_score) over (partition by d.upload_id) as surest
        from (select upload_id, file_type from {sql.ANALYSES} where upload_id is not null qualify row_number() over (partition by upload_id order by created_at desc nulls last, analysis_id desc) = 1) d
        cross join k left join sem on sem.upload_id = d.upload_id and sem.record_key = k.record_key left join br on br.upload_id = d.upload_id and br.brand_product = k.brand_product
        where semantic is not null or kind is not null),
    sc as (select *, case kind when 'possible' then least(0.95::double, semantic + 0.18::double) when 'exact' then least(0.99::double, semantic + 0.18::double) else semantic end as score,
        file_type in ('pdf', 'ppt', 'pptx', 'image', 'video') and surest is not null as locked from cand),
    lk as (select *, max(score) over (partition by upload_id) as top, row_number() over (partition by upload_id order by score desc, record_key) as place
        from sc where not coalesce(locked, false) or brand_score >= surest - 0.0005::double),
    th as (select *, case when locked and surest < 1 then greatest(0.05::double, top - 0.05::double) when surest is not null then 0.25::double else 0.40::double end as least from lk)
    select upload_id, cast(place as int) as place, key_message_id, brand_product, key_message, floor(score * 10000.0::double + 0.5) / 10000.0::double as confidence_score from th join k using (record_key)
"""

SQL = {
    "j1_message_scores": _SEMANTIC + "select upload_id, record_key, floor(semantic * 10000.0::double + 0.5) / 10000.0::double as score from sem",
    "cq2_exact_mapping": _RANKED + "where place <= 10 and score >= least",
    "tk1_all_mapping": _RANKED + "where case when file_type in ('audio', 'video') then place <= 10 and score >= least else score > 0 end",
    "kw4_display_keywords": rf"""
        with k as {_KEYS}, a as (select record_key, list_filter(list_distinct_ordered, lambda x: length(x) > 3)[1:2] as names, key_words from (
            select record_key, key_words, list_filter([b, p, f, g], lambda x: length(x) > 2) as raw, list_transform(list_filter(list_zip(range(1, 5), [b, p, f, g]),
                lambda z: length(z[2]) > 2 and list_position([b, p, f, g], z[2]) = z[1]), lambda z: z[2]) as list_distinct_ordered
            from (select record_key, key_words, lower(b) as b, lower(p) as p, lower(f) as f, lower(trim(regexp_split_to_array(f, '[-\s/(]')[1])) as g
            from (select *, trim(regexp_replace(p, '(?i)\b({'|'.join(text.DOSAGE_FORMS)})\b', '', 'g')) as f
            from (select record_key, key_words, trim(brand_product) as b, trim(regexp_replace(trim(brand_product), '\(.*?\)', '', 'g')) as p from k)))) where {sql.clean('key_words')} <> ''),
        l as (select record_key, list_filter(list_concat(names, list_transform(regexp_split_to_array({sql.clean('key_words')}, '[,;|]\s*'), lambda x: {sql.clean('x')})), lambda x: x <> '') as l from a)
        select record_key, array_to_string(list_transform(list_filter(list_zip(range(1, len(l) + 1), l), lambda z: list_position(list_transform(l, lambda x: lower(x)), lower(z[2])) = z[1]), lambda z: z[2])[1:6], ', ') as keywords from l""",
}
