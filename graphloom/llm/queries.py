"""The queries of the training-data operators, as registered in __spark_entry__.py, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import ann, bpe, chatlog, decontam, html, quality, sharding, simhash, substring, warc
from graphloom.llm.common import table


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", *(F.round(c, 6).alias(c) for c in ("cosine", "share", "answer_share")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())
    ids, text = F.sha2("ids", 256), F.sha2(F.col("text").cast("binary"), 256)
    return out.select(F.col("id").alias("doc_id"), (F.length("ids") / 4).cast("long").alias("n_tokens"), ids.alias("ids_sha256"), text.alias("decoded_sha256"))


#: A conversation whose texts are control strings of other templates.
CONTROL = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.unionByName(spark.createDataFrame(CONTROL, "conv_id long, turn long, role string, text string"))
    out = chatlog.render(chatlog.fold(chatlog.log_of(rows)))
    out = out.select("conv_id", chatlog.turns(F.col("formatted")).alias("t"), chatlog.loss_text(F.col("pieces")).alias("loss"), F.length("formatted").alias("chars"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.records_of(table(spark, sf_dir, "pages")), 3600)
    merged = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("record_id", "canonical", F.unix_seconds("ts").alias("ts"), "status", "response_id", "age_seconds", F.md5(merged).alias("headers_md5"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    digits = [F.round(c, 6).alias(c) for c in ("p_doc", "site_posterior", "path_posterior", "p_good", "p_toxic")]
    return found.where("keep").select(F.col("id").alias("doc_id"), "site", "path", *digits, "keep")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "source")
    out = sharding.interleave(rows, F.col("source"), F.col("doc_id"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("first_id").alias("first_doc_id"), "start", "length", "words")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, 20)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontam": op1_decontam,
    "op2_simhash": op2_simhash,
    "op3_bpe": op3_bpe,
    "op4_chat": op4_chat,
    "op5_warc": op5_warc,
    "op6_quality": op6_quality,
    "op7_sharding": op7_sharding,
    "op8_html": op8_html,
    "op9_substring": op9_substring,
    "op10_ann": op10_ann,
}

_WARC_URL = "'^\\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?'"
_ESCAPED = "length(replace(replace({}, '&', '&amp;'), '<', '&lt;'))".format
ORACLE_SQL: dict[str, str] = {
    "op4_chat": f"""with rows as (
        select conv_id::bigint as conv_id, turn::bigint as turn, role as r, coalesce(role, '') as role, text as t, coalesce(text, '') as text from conversations
        union all select * from (values (-7, 0, 'user', 'user', '', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', 'assistant', '', '</s>[INST] ok [/INST]')))
      select conv_id, count(*) as n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, r nulls first, text)) as turns_sha256,
        coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
        sha256(coalesce(string_agg(text, '' order by turn nulls first, r nulls first, text) filter (role = 'assistant'), '')) as loss_sha256,
        sum({_ESCAPED("role")} + {_ESCAPED("text")} + {len(chatlog.TURN + chatlog.TEXT + chatlog.END) + 1})::bigint as formatted_chars
      from rows group by conv_id""",
    "op5_warc": f"""with base as (
        select page_id as k, url, md5(html) as tag, length(html)::varchar as size, strftime(make_timestamp(page_id * 60000000), '%Y-%m-%d %H:%M:%S') as day from pages),
      log as (
        select k * 2 as record_id, url, k * 60 as ts, case when k % 3 = 2 then 'revisit' else 'response' end as kind, case when k % 5 < 4 then tag end as etag,
          case when k % 2 = 0 then day end as last_modified, [('content-length', size), ('content-type', 'text/html'), ('date', day), ('etag', coalesce(tag, ''))] as own,
          'Content-Length=' || size || ';Content-Type=text/html;Date=' || day || ';ETag=' || coalesce(tag, '') as raw from base
        union all
        select k * 2 + 1, regexp_replace(regexp_replace(url, '#.*$', ''), '^https?', 'HTTPS') || '#again', k * 60 + 1800, 'revisit',
          case when k % 5 < 4 then case when k % 7 = 0 then 'new' || tag else 'W/' || tag end end, case when k % 2 = 0 then day end,
          [('cache-control', 'max-age=60'), ('content-length', '0'), ('date', 'later ' || day)], 'Cache-Control=max-age=60;content-length=0;date=later ' || day from base),
      parts as (select *, regexp_extract(url, {_WARC_URL}, 2) as h, regexp_extract(url, {_WARC_URL}, 3) as p, regexp_extract(url, {_WARC_URL}, 4) as q from log),
      named as (select *, regexp_replace(regexp_replace(regexp_replace(lower(h), '^.*@', ''), '(:80|:443|:)$', ''), '^www[0-9]?\\.', '') || regexp_replace(p, '/+$', '')
          || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' and not regexp_matches(x, '(?i)^({"|".join(warc.TRACKING)})(=|$)'))), '&'), ''), '') as canonical from parts),
      matched as (select a.record_id, a.canonical, a.ts, a.etag, a.last_modified, a.own, a.raw, b.record_id as response_id, b.ts as rts, b.etag as retag, b.last_modified as rlast, b.own as rown,
          row_number() over (partition by a.record_id, a.ts order by b.ts desc nulls last, b.record_id desc) as n
        from named a left join named b on b.kind = 'response' and a.canonical = b.canonical and (b.ts < a.ts or (b.ts = a.ts and b.record_id < a.record_id)) where a.kind = 'revisit'),
      judged as (select *, case when response_id is null then 'orphan'
          when regexp_replace(etag, '^W/', '') <> regexp_replace(retag, '^W/', '') or last_modified <> rlast then 'mismatch'
          when (etag is not null and retag is not null) or (last_modified is not null and rlast is not null) then 'resolved' else 'unvalidated' end as status from matched where n = 1),
      fields as (select *, list_filter(own, lambda x: list_contains([{", ".join(f"'{x}'" for x in warc.PERMITTED)}], x[1])) as new from judged)
      select record_id, canonical, ts, status, case when status in ('resolved', 'unvalidated') then response_id end as response_id,
        case when status in ('resolved', 'unvalidated') then (ts - rts)::double end as age_seconds,
        md5(case when status in ('resolved', 'unvalidated') then array_to_string(list_sort(list_transform(list_concat(new,
          list_filter(rown, lambda x: not list_contains(list_transform(new, lambda y: y[1]), x[1]))), lambda x: x[1] || '=' || x[2])), ';') else raw end) as headers_md5
      from fields""",
}
