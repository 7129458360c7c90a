"""The thin queries over the operators, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import discriminant, exact_dedup, fill_middle, line_dedup, mixing, near_dedup, packing, pii, quality, search, suffix_dedup, suffix_lm, url_filter
from marginalia.llm.common import UPPER
from marginalia.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"), digest=True)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return quality.quality(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "good")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find_spans(docs, pii.train(docs))
    base, every = pii.spans_text(F.col("base")), pii.spans_text(F.concat("base", "added"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def op10_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.score(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discriminant.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    own = (op1_suffix_array_dedup, op2_url_filter, op3_best_fit_packing, op4_line_dedup, op5_exact_dedup, op6_minhash_near_dedup, op7_quality_rules, op8_mix_sources, op9_pii, op10_suffix_tree_lm, op11_fill_in_middle, op12_quality_classifier, op13_ranked_search)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    lowered = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
    return {
        "op5_exact_dedup": f"""
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
            FROM (SELECT doc_id, {lowered} AS t FROM documents) WINDOW w AS (PARTITION BY t)""",
        "op8_mix_sources": r"""
            WITH sized AS (
                SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
            ), sources AS (
                SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
            ), weighed AS (
                SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight FROM sources
            ), levels AS (
                SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS lev FROM weighed
            ), walked AS (
                SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS open_level
                FROM levels WINDOW b AS (ORDER BY lev, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
            ), aimed AS (
                SELECT source, source_size, least(cap, coalesce(max(CASE WHEN open_level <= lev THEN open_level END) OVER () * weight, cap)) AS target FROM walked
            ), ranked AS (
                SELECT doc_id, size, source_size, target, row_number() OVER (PARTITION BY s.source ORDER BY size, doc_id) - 1 AS nth,
                    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                    ('0x' || md5('mix:' || coalesce('=' || s.source, 'null'))[1:8])::UBIGINT::DOUBLE / 4294967296 AS start
                FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source
            )
            SELECT doc_id, size, source_size, target, CAST((floor((nth + 1) * rate + start) - floor(nth * rate + start)) * size AS BIGINT) AS taken FROM ranked""",
        "op11_fill_in_middle": r"""
            WITH cut AS (
                SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents
            ), drawn AS (
                SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM cut
            ), placed AS (
                SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn
            ), parted AS (
                SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM placed
            )
            SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
                sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM parted""",
        "op13_ranked_search": rf"""
            WITH found AS (
                SELECT doc_id, row_number() OVER () AS r, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
            ), counted AS (SELECT r, doc_id, term, count(*) AS tf FROM found GROUP BY ALL),
            sized AS (SELECT r, sum(tf)::BIGINT AS n FROM counted GROUP BY r),
            totals AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM sized),
            wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
            weighed AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counted, totals GROUP BY term, nn),
            scored AS (
                SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // l))))::BIGINT AS score
                FROM wanted JOIN weighed USING (term) JOIN counted USING (term) JOIN sized USING (r), totals GROUP BY item_id, doc_id, r
            ), placed AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank FROM scored WHERE score > 0)
            SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= 10""",
    }
