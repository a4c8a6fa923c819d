"""The queries of the thirteen operators over the given tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spanledger.llm import alignment, bpe, exact_dedup, html_text, language_id, lexical_search, license_scan, lm_scoring, mixing, quality_rules, secrets, simhash, warc
from spanledger.llm.common import settled, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.languages(table(spark, folder, "documents"))


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    return settled(lambda: warc.archived(table(spark, folder, "pages")), "op2_warc")


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return settled(lambda: exact_dedup.exact_duplicates(table(spark, folder, "documents")), "op3_exact_dedup")


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.licenses(table(spark, folder, "documents"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return settled(lambda: simhash.near_duplicates(table(spark, folder, "documents")), "op5_simhash")


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, folder, "documents"), VOCABULARY)


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return settled(lambda: secrets.secret_spans(table(spark, folder, "documents")), "op7_secrets")


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return settled(lambda: quality_rules.quality_rules(table(spark, folder, "documents")), "op8_quality_rules")


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return settled(lambda: mixing.mixed_sizes(table(spark, folder, "documents")), "op9_mixing")


def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return settled(lambda: html_text.main_texts(table(spark, folder, "pages")), "op10_html_text")


def op11_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return settled(lambda: lm_scoring.lm_scores(table(spark, folder, "documents")), "op11_lm_scores")


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return settled(
        lambda: lexical_search.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark")),
        "op12_lexical_search",
    )


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return settled(
        lambda: alignment.alignments(table(spark, folder, "documents"), BYTE_VOCABULARY, PIECE_VOCABULARY),
        "op13_alignment",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_warc,
        op3_exact_dedup,
        op4_license_scan,
        op5_simhash,
        op6_bpe,
        op7_secrets,
        op8_quality_rules,
        op9_mixing,
        op10_html_text,
        op11_lm_scores,
        op12_lexical_search,
        op13_alignment,
    )
}

ORACLE: dict[str, str] = {
    "op2_warc": r"""
        with payloads as (
          select page_id, coalesce(html, '') as payload from pages
        ), digests as (
          select page_id, strlen(payload)::bigint as payload_bytes, sha1(payload) as hex from payloads
        ), digits as (
          -- five hex digits at a time are four of base 32
          select *, array_to_string([
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                          ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::bigint + 1, 1)
                   for i in range(32)], '') as payload_digest,
                 max(page_id) over (partition by hex) as last
          from digests
        )
        select page_id, payload_bytes, payload_digest,
               case when page_id = last then 'response' else 'revisit' end as record_type,
               case when page_id <> last then last end as refers_to
        from digits
    """,
    "op3_exact_dedup": r"""
        with texts as (
          select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
          from documents
        )
        select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id = min(doc_id) over same as kept, text_sha256
        from texts window same as (partition by text_sha256)
    """,
    "op7_secrets": secrets.oracle(),
    "op9_mixing": r"""
        with docs as (
          select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size
          from documents
        ), sizes as (
          select source, sum(size)::bigint as source_size from docs group by source
        ), numbered as (
          select *, row_number() over (order by source nulls last) - 1 as src from sizes
        ), weighed as (
          select *, case src % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 2 * source_size as cap,
                 1.5::double * (select sum(source_size) from sizes)::bigint as total
          from numbered
        ), levels as (
          -- the level at which the total is shared when sources up to this limit are full
          select a.*, (select coalesce(sum(b.cap), 0)::bigint from weighed b
                       where (b.cap / b.weight, b.src) < (a.cap / a.weight, a.src)) as before,
                 (select sum(b.weight)::bigint from weighed b
                  where (b.cap / b.weight, b.src) >= (a.cap / a.weight, a.src)) as open_weight
          from weighed a
        ), shared as (
          select *, (total - before) / open_weight as level from levels
        ), targets as (
          select src, source, source_size,
                 case when cap <= level * weight then cap::double
                      else least(cap::double, weight * (select min_by(level, (cap / weight, src)) from shared
                                                        where cap > level * weight)) end as target,
                 case when source_size > 0
                      then ceil(source_size / ceil(source_size / 32))::bigint else 1 end as block
          from shared
        ), blocked as (
          select *, ceil(source_size / block)::bigint as blocks from targets
        ), slotted as (
          select *, case when source_size > 0
                         then round(target * blocks / source_size * 1024)::bigint else 0 end as slots
          from blocked
        ), spans as (
          select *, (select sum(slots) from slotted)::bigint as all_slots,
                 (select coalesce(sum(slots), 0) from slotted b where b.src < a.src)::bigint as slots_before
          from slotted a where slots > 0
        ), points as (
          select slot, ((slot::hugeint * 679535556991) % 1099511627776)::bigint as point
          from range((select ceil(max(all_slots) / 1024)::bigint from spans)) t(slot)
        ), ranked as (
          select src, blocks, row_number() over (partition by src order by slot) - 1 as rank
          from points join spans
            on point >= floor(slots_before::double / all_slots * 1099511627776)
           and point < floor((slots_before + slots)::double / all_slots * 1099511627776)
        ), copies as (
          select src, rank % blocks as block_no, count(*) as copies from ranked
          where rank < 2 * blocks group by all
        ), placed as (
          select doc_id, size, src, source_size, target, block,
                 sum(size) over (partition by src order by md5(coalesce(doc_id::varchar, '')), doc_id, size
                                 rows unbounded preceding)::bigint - size as start
          from docs join blocked on docs.source is not distinct from blocked.source
        ), shares as (
          select src, start, size,
                 unnest(range(start // block, (start + size - 1) // block + 1)) as block_no, block
          from placed where size > 0
        ), taken as (
          select shares.src, start,
                 sum(copies * (least(start + size, (shares.block_no + 1) * block)
                               - greatest(start, shares.block_no * block)))::bigint as taken
          from shares join copies using (src, block_no) group by all
        )
        select doc_id, size, source_size, target,
               case when size > 0 then coalesce(taken, 0) else 0 end::bigint as taken
        from placed left join taken using (src, start)
    """,
    "op12_lexical_search": r"""
        with texts as (
          select row_number() over () as row, doc_id,
                 regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
          from documents
        ), lengths as (
          select row, doc_id, len(terms) as n from texts where len(terms) > 0
        ), totals as (
          select count(*) as docs, sum(n)::bigint as all_terms from lengths
        ), times as (
          select row, term, count(*) as tf from (select row, unnest(terms) as term from texts) group by all
        ), items as (
          select row_number() over () as item, item_id,
                 list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as terms
          from benchmark
        ), asked as (
          select item, item_id, unnest(terms) as term from items
        ), weights as (
          select term, floor(1000 * ln((2.0::double * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w
          from times, totals where term in (select term from asked) group by term
        ), scores as (
          select item, item_id, row, doc_id,
                 sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // all_terms))))::bigint as score
          from asked join weights using (term) join times using (term) join lengths using (row), totals
          group by all
        ), ranked as (
          select item_id, row_number() over (partition by item order by score desc, doc_id nulls last, row)::int as rank,
                 doc_id, score
          from scores where score > 0
        )
        select item_id, rank, doc_id, score from ranked where rank <= 50
    """,
}
