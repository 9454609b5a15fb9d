"""Registered queries of the corpus operators, and their SQL where there is any."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from logkiln.llm import alignment, decontaminate, language, lm, packing, periodic, pii, repeats, rules, simhash, sketches, templates, warc
from logkiln.llm.common import crc_mod, documents
from logkiln.staging import shared_folder


def op1_lm_scores(spark, d):
    scored = lm.score_corpus(documents(spark, d), crc_mod(7) != 2)
    return scored.select("doc_id", (~F.col("learning")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_arc_to_warc(spark, d):
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    records = warc.archive_pages(spark, spark.read.parquet(f"{d}/pages.parquet"), folder)
    kept = records.where(F.col("warc_type").isin("response", "revisit"))
    return kept.select(
        F.col("headers")["x-record-key"].cast("bigint").alias("page_id"),
        F.col("headers")["x-payload-length"].cast("bigint").alias("payload_bytes"),
        F.substring_index(F.col("headers")["warc-payload-digest"], ":", -1).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.col("headers")["x-refers-to-key"].cast("bigint").alias("refers_to"),
    )


def op3_line_templates(spark, d):
    done = templates.drop_repeated_lines(documents(spark, d))
    return done.select("doc_id", "n_dropped_lines", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op4_repeats(spark, d):
    return repeats.digest(repeats.remove_repeats(documents(spark, d)))


def op5_personal_data(spark, d):
    found = pii.find_pii(documents(spark, d))
    spans = F.col("spans")
    number = [pii.count_of(spans, k).cast("bigint").alias(f"n_{k}") for k in pii.BASE]
    base = F.filter(spans, lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *number, F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(spans).alias("spans"))


def op6_language_id(spark, d):
    docs = documents(spark, d)
    model = language.learn(docs.where(crc_mod(4) != 2))
    rows = docs.withColumn("held_out", crc_mod(4) == 2)
    return language.predict(rows, model, keep=("doc_id", "held_out"))


def op7_packing(spark, d):
    import public_tokenizers

    return packing.pack(documents(spark, d), public_tokenizers.path("word_bpe_49k.json"))


def op8_decontamination(spark, d):
    return decontaminate.find_matches(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))


def op9_simhash(spark, d):
    found = simhash.near_duplicates(documents(spark, d))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_quality_rules(spark, d):
    docs = documents(spark, d)
    marked, found = rules.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    return rules.judge(docs, marked, found)


def op11_token_alignment(spark, d):
    import public_tokenizers

    return alignment.link_statistics(documents(spark, d), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_fast_sketches(spark, d):
    return sketches.near_duplicates(documents(spark, d))


def op13_periodic_runs(spark, d):
    done = periodic.collapse_runs(periodic.with_periodic_tails(documents(spark, d)))
    best = periodic.most_periodic(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return done.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op3_line_templates": op3_line_templates,
    "op4_repeats": op4_repeats,
    "op5_personal_data": op5_personal_data,
    "op6_language_id": op6_language_id,
    "op7_packing": op7_packing,
    "op8_decontamination": op8_decontamination,
    "op9_simhash": op9_simhash,
    "op10_quality_rules": op10_quality_rules,
    "op1_lm_scores": op1_lm_scores,
    "op2_arc_to_warc": op2_arc_to_warc,
    "op11_token_alignment": op11_token_alignment,
    "op12_fast_sketches": op12_fast_sketches,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL = {
    "op2_arc_to_warc": """
        WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                     sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
}
