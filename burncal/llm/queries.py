"""The registered queries of the text operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burncal.llm import centroids, decontaminate, licenses, media, merkle, mixing, oracles, packing, pieces, quality, secrets, simhash, suffixes, toxicity
from burncal.llm.common import documents, held_out, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir))


def op2_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    offsets = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), offsets.alias("offending"))


def op3_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_shards(documents(spark, sf_dir))
    return packed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )


def op5_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest_media(media.encode_media(documents(spark, sf_dir)))


def op6_char_cnn_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(documents(spark, sf_dir)))


def op7_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op8_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest_documents(documents(spark, sf_dir), n=3)


def op9_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_minhash_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.manifest(documents(spark, sf_dir))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_apportioned_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_crf_toxicity": op2_crf_toxicity,
    "op3_covering_simhash": op3_covering_simhash,
    "op4_vector_packing": op4_vector_packing,
    "op5_signature_sniffing": op5_signature_sniffing,
    "op6_char_cnn_secrets": op6_char_cnn_secrets,
    "op7_benchmark_windows": op7_benchmark_windows,
    "op8_nbest_pieces": op8_nbest_pieces,
    "op9_fourier_quality": op9_fourier_quality,
    "op10_minhash_licenses": op10_minhash_licenses,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_apportioned_mix": op12_apportioned_mix,
    "op13_sort_means": op13_sort_means,
}

ORACLES: dict[str, str] = {
    # bytes as two hexadecimal digits, in blocks of 200 bytes that overlap by 49; a window is the 100 digits of 50 bytes
    "op1_suffix_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, cast(length(hex(encode(coalesce(text, '')))) / 2 as bigint) as n from documents),
bl as (select doc_id, n, q, substring(h, 400 * q + 1, 498) as part from (select *, unnest(range((n + 199) // 200)) as q from d) x),
o as (select doc_id, n, 200 * q + i as p, substring(part, 2 * i + 1, 100) as s from (select *, unnest(range(least(200, n - 200 * q))) as i from bl) x),
w as (select doc_id, p, hash(s) as s from o where p + 50 <= n),
m as (select s, min(doc_id) as first_doc from w group by s),
hit as (select w.doc_id, w.p from w join m using (s) where m.first_doc < w.doc_id),
c as (select o.doc_id, o.p, substring(o.s, 1, 2) as x,
        coalesce(max(hit.p) over (partition by o.doc_id order by o.p rows unbounded preceding) >= o.p - 49, false) as gone
      from o left join hit on hit.doc_id = o.doc_id and hit.p = o.p),
e as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by p), false) as rise from c),
k as (select doc_id, count(*) filter (gone) as n_removed, count(*) filter (rise) as n_spans, string_agg(x, '' order by p) filter (not gone) as kept from e group by doc_id)
select d.doc_id, n as n_bytes, coalesce(k.n_removed, 0) as n_removed, coalesce(k.n_spans, 0) as n_spans, sha256(unhex(coalesce(k.kept, ''))) as kept_sha256
from d left join k using (doc_id)""",
    "op11_merkle_manifest": oracles.OP11,
    "op12_apportioned_mix": oracles.OP12,
    "op13_sort_means": oracles.OP13,
}
