"""The operators applied to whole tables, and SQL for the same results where SQL can say it."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, contamination, jaccard, mixing, quality, sharding, substring, tiff, toxicity, urlglob
from .common import schema, table

#: Rules of the page filter and, for pages without a rule, globs of unwanted hosts.
URL_RULES = [
    urlglob.Rule("allow", "org", "/"),
    urlglob.Rule("block", "example.org", "/es/"),
    urlglob.Rule("block", "example.org", "/en/1"),
    urlglob.Rule("allow", "com", "/fr/"),
    urlglob.Rule("block", "com", "/de/"),
]
URL_BLOCKED = ["*casino*/*", "*-bets.*/*", "*cheap-pills*/*"]


def op1_chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], schema(conv_id="long", turn="long", role="string", text="string"))
    return chat.read_chat(chat.format_chat(rows.unionByName(probe))).drop("n_tokens", "loss_tokens")


def op2_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tiff.texts_to_tiff(table(spark, sf_dir, "documents"))
    stored = stored.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    return _payload_digest(tiff.tiff_pages(stored, "media", ("doc_id", "n_bytes", "media_bytes", "media_sha256")))


def _payload_digest(pages: DataFrame) -> DataFrame:
    """Page rows of each document, which follow each other, as one row; features come from the pixels."""
    out = schema(doc_id="long", n_bytes="long", payload_bytes="long", payload_sha256="string", tail_crc32="long", media_bytes="long", media_sha256="string", feature="string", pages="int", error="string")
    names = ["doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "width", "height", "compression", "tiled", "pixels", "error"]

    def run(batches):
        first, state = None, None
        for b in batches:
            done = []
            columns = [b.column(n).to_pylist() for n in names]
            for doc, n, size, sha, page, width, height, compression, tiled, pixels, error in zip(*columns, strict=True):
                if not page and not (error and first and first[0] == doc):  # a new document
                    if first:
                        done.append(_digest_row(first, state))
                    first = (doc, n, size, sha, width, compression, tiled)
                    state = [hashlib.sha256(), 0, b"", np.zeros(256, np.int64), 0, 0, None]
                if error:
                    state[6] = error
                    continue
                state[0].update(pixels)
                state[1] += len(pixels)
                state[2] = (state[2] + pixels)[-64:]
                state[3] += np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
                state[4] += 1
                state[5] += height
            if done:
                yield pa.Table.from_pylist(done, schema=_DIGEST).to_batches()[0]
        if first:
            yield pa.Table.from_pylist([_digest_row(first, state)], schema=_DIGEST).to_batches()[0]

    return pages.select(*names).mapInArrow(run, out)


_DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
    + [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pages", pa.int32()), ("error", pa.string())]
)


def _digest_row(first: tuple, state: list) -> dict:
    share = state[3][state[3] > 0] / max(1, state[1])
    mean = float(state[3] @ np.arange(256)) / max(1, state[1])
    feature = f"{first[4]}x{state[5]}/{state[4]} c{first[5]} {'tiles' if first[6] else 'strips'} mean={mean:.4f} entropy={-float(share @ np.log2(share)):.4f} ink={int((state[3] > 0).sum())}"
    return {"doc_id": first[0], "n_bytes": first[1], "payload_bytes": state[1], "payload_sha256": state[0].hexdigest(), "tail_crc32": zlib.crc32(state[2]), "media_bytes": first[2], "media_sha256": first[3], "feature": feature, "pages": state[4], "error": state[6]}


def op3_fm_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs, 35).select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").alias("n_spans"))


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(quality.bucket("doc_id", 4) == 2, F.lit(False))
    scored = quality.score_texts(docs, net)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = jaccard.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_shingles", "component_id")


def op6_sampled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_table(table(spark, sf_dir, "documents"), 24)
    return rows.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op7_minhash_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("hits").cast("long").alias("hits"), F.max("q").cast("long").alias("item_shingles"), F.max("containment").alias("containment"))


def op8_url_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlglob.judge_urls(pages, URL_RULES, URL_BLOCKED).drop("url")


def op9_crf_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(quality.bucket("doc_id", 3) == 1, F.lit(False))
    tagged = toxicity.tag_texts(docs, chain)
    return tagged.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "toxic_words", "spans")


def op10_hash_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_table(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_tokens": op1_chat_tokens,
    "op2_tiff_pages": op2_tiff_pages,
    "op3_fm_substrings": op3_fm_substrings,
    "op4_byte_cnn": op4_byte_cnn,
    "op5_jaccard_components": op5_jaccard_components,
    "op6_sampled_shards": op6_sampled_shards,
    "op7_minhash_contained": op7_minhash_contained,
    "op8_url_globs": op8_url_globs,
    "op9_crf_spans": op9_crf_spans,
    "op10_hash_mix": op10_hash_mix,
}

ORACLE: dict[str, str] = {
    "op1_chat_tokens": r"""
        with turns as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), long as (
            select *, length(role) + length(text) + len(regexp_extract_all(role || chr(10) || text, '␛|<s>|</s>|<\|turn\|>|<\|text\|>|<\|stop\|>|\[INST\]|\[/INST\]')) + length('<|turn|><|text|><|stop|>') as chars from turns
        )
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
               coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
               (sum(chars) + length('<s></s>'))::bigint as formatted_chars
        from long group by conv_id""",
    "op3_fm_substrings": r"""
        with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
        word as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from w),
        win as (select *, md5(string_agg(word, ' ') over ahead) as passage, count(*) over ahead as n from word
            window ahead as (partition by doc_id order by pos rows between current row and 34 following)),
        repeated as (select *, n = 35 and count(*) over (partition by passage, n) > 1 as hit from win),
        gone as (select *, bool_or(hit) over (partition by doc_id order by pos rows between 34 preceding and current row) as removed from repeated),
        runs as (select *, removed and not coalesce(lag(removed) over (partition by doc_id order by pos), false) as begins from gone),
        kept as (select doc_id, count(*) as n_words, count(*) filter (removed) as n_removed, string_agg(word, ' ' order by pos) filter (not removed) as rest, count(*) filter (begins) as n_spans from runs group by doc_id)
        select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(rest, '')) as kept_sha256, coalesce(n_spans, 0)::int as n_spans
        from documents left join kept using (doc_id)""",
    "op5_jaccard_components": r"""
        with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
        s as (select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
            when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w),
        size as (select doc_id, count(*) as n from s group by doc_id),
        link as (select a.doc_id as u, b.doc_id as v from s a join s b on a.g = b.g and a.doc_id <> b.doc_id join size x on x.doc_id = a.doc_id join size y on y.doc_id = b.doc_id
            group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
        reach(a, b) as (select doc_id, doc_id from documents union select a, v from reach join link on b = u),
        least as (select a as doc_id, min(b) as component_id from reach group by a)
        select doc_id, coalesce(n, 0) as n_shingles, component_id from least left join size using (doc_id)""",
    "op7_minhash_contained": r"""
        with doc as (select doc_id, text, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        have as (select distinct doc_id, text, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
            when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from doc),
        item as (select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from benchmark),
        want as (select distinct item_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
            when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from item),
        size as (select item_id, count(*) as q from want group by item_id),
        hit as (select doc_id, text, item_id, count(*) as hits from have join want using (s) group by all)
        select doc_id, item_id, max(hits) as hits, any_value(q) as item_shingles, max(hits::double / q) as containment
        from hit join size using (item_id) where 100 * hits >= 80 * q group by doc_id, item_id""",
    "op8_url_globs": r"""
        with parts as (
            select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
        ), split as (
            select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
            from parts
        ), rules(verdict, rule_host, rule_path) as (
            values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
        ), best as (
            select page_id, arg_max(rule_host || rule_path, strlen(rule_host || rule_path)) as rule,
                   arg_max(verdict, strlen(rule_host || rule_path)) as verdict
            from split join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
            group by page_id
        )
        select page_id, host, path, rule, coalesce(best.verdict, case when starts_with(path, '/') and
            (contains(host, 'casino') or contains(host, '-bets.') or contains(host, 'cheap-pills')) then 'block' else 'allow' end) as verdict
        from split left join best using (page_id)""",
}
