"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulcro.llm.common import store, table
from pulcro.llm.decontaminate import contaminations
from pulcro.llm.html_text import extract_text
from pulcro.llm.jaccard_join import similar_documents
from pulcro.llm.line_dedup import dedup_lines
from pulcro.llm.lm_scoring import score_documents
from pulcro.llm.packing import pack_documents
from pulcro.llm.periodic_runs import find_runs
from pulcro.llm.prefix_trie import numbered_turns, prefix_trie
from pulcro.llm.quality import classify
from pulcro.llm.secret_scan import find_secrets
from pulcro.llm.sharding import regular_tree, shard_documents
from pulcro.llm.topk import top_k
from pulcro.llm.warc import read_warc, resolve_revisits, write_warc
from pulcro.session import scratch_path


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(
        table(spark, sf_dir, "documents"),
        tokenizer_file("byte_bpe_50k.json"),
        tokenizer_file("byte_bpe_50k.tiktoken"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    told = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    count = "cast(size(filter(secrets, s -> s.kind = '{0}')) as bigint) as n_{0}"
    return found.selectExpr(
        "doc_id",
        *[count.format(k) for k in ("assign", "access", "hex", "entropy")],
        f"sha2({told.format("filter(secrets, s -> s.kind != 'entropy')")}, 256) as base_sha256",
        f"{told.format('secrets')} as spans",
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", "n_tokens", "perplexity", "entropy", "threshold", "keep")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = shard_documents(docs, regular_tree(24), regular_tree(25))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_matched", "n_windows", "coverage", "exact")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_copies", "n_links")


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """In a tenth of the documents the words from one on repeat with a period; both follow from the id."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = (h / 10).cast("long")
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    rows = docs.select("doc_id", g.alias("g"), F.col("text").alias("plain"), F.when(h % 10 == 0, words).alias("text"))
    n = "size(text)"
    rows = rows.withColumn("a", F.expr(f"cast(if({n} > 0, g % {n}, 0) as int)"))
    rows = rows.withColumn("p", F.expr(f"cast(1 + floor(({n} - a) / (3 + g % 8)) as int)"))
    cycle = f"flatten(array_repeat(slice(text, a + 1, p), cast(ceil(({n} - a) / p) as int)))"
    planted = f"array_join(concat(slice(text, 1, a), slice({cycle}, 1, {n} - a)), ' ')"
    return rows.select("doc_id", F.expr(f"if(text is null, plain, {planted})").alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(_with_planted_runs(table(spark, sf_dir, "documents")))
    told = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    return found.select("doc_id", "found.*").selectExpr(
        "doc_id", "n_runs", "start", "length", "period",
        "cast(floor(1000 * length / period) as bigint) as exponent_milli",
        f"sha2({told}, 256) as runs_sha256", "sha2(collapsed, 256) as collapsed_sha256", "n_kept",
    )


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with up to eight turns of the first of their five; turns and all numbers."""
    ids = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    ids = ids.withColumns({
        "h": F.crc32(F.col("conv_id").cast("string")) % 9, "base": F.col("conv_id") - F.col("conv_id") % 5,
    })
    lenders = ids.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    ids = ids.join(lenders, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))))
    ids = store(ids.withColumn("n_turns", F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "rebuilt")
    own = turns.join(ids, "conv_id").where("place >= h").withColumn("depth", F.expr("lent + place - h + 1"))
    lent = turns.where("place < 8").withColumnRenamed("conv_id", "base").join(ids, "base").where("place < h")
    lent = lent.withColumn("depth", F.col("place") + 1)
    columns = ["conv_id", "depth", "n_turns", "t1", "t2", "bytes"]
    return own.select(*columns).unionByName(lent.select(*columns)), ids.select("conv_id", "n_turns")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = store(numbered_turns(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie(*_rebuilt(turns))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    found = resolve_revisits(read_warc(spark, path, payloads=False))
    revisit = F.col("record_type") == "revisit"
    return found.select(
        F.col("page").cast("long").alias("page_id"),
        F.col("full_bytes").alias("payload_bytes"),
        F.col("full_digest").alias("payload_digest"),
        "record_type",
        F.when(revisit, F.col("full_page").cast("long")).alias("refers_to"),
        "target_uri",
        "problem",
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_secret_scan,
        op3_quality_classifier,
        op4_sharding,
        op5_benchmark_decontamination,
        op6_html_extraction,
        op7_topk_search,
        op8_line_dedup,
        op9_lm_scoring,
        op10_ngram_jaccard_join,
        op11_periodic_runs,
        op12_prefix_trie,
        op13_warc,
    )
}
