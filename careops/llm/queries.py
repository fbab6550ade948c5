"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careops.llm import collocations, html_text, langid, lm, mixing, packing, periodic, quality, simhash, substring, token_files, topk, warc
from careops.llm.common import SPACE_RE, WORD_RE, cut_lineage, read_table, remainder, scratch_path

TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rest = remainder(F.col("doc_id"), 5)
    model = langid.fit(docs, rest != 0)
    held = docs.withColumn("held_out", F.coalesce(rest == 0, F.lit(True)))
    return langid.identify(held, model, keep=("doc_id", "held_out"), spans=False)


def op2_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.filter_quality(read_table(spark, sf_dir, "documents")).drop("rejected_by")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (html_text.extract(read_table(spark, sf_dir, "pages"))
            .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars")))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(read_table(spark, sf_dir, "embeddings"), scale=1024)
    return topk.top_k(vectors, F.pmod("vec_id", F.lit(100)) == 0, k=10)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(read_table(spark, sf_dir, "documents"), window=13)
    line = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE_RE, " "))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(line, 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False).drop("ids")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rest = remainder(F.col("doc_id"), 7)
    marked = docs.withColumn("held_out", F.coalesce(rest == 2, F.lit(True)))
    return lm.fit_and_score(marked, rest != 2, keep=("doc_id", "held_out"))


def op9_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(read_table(spark, sf_dir, "pages"), path)
    return (warc.resolve_revisits(cut_lineage(warc.read_archives(spark, path, with_payload=False)))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return collocations.collocations(docs, max_words=5, least=100, top=2000, cover_percent=100).drop("words")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with every tenth text, by crc32 of its id, made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(WORD_RE), F.lit(0))
    marked = docs.withColumns({"_g": F.floor(h / 10), "_words": F.when(h % 10 == 0, words)})
    n = F.size("_words")
    marked = marked.withColumn("_a", F.when(n > 0, (F.col("_g") % n).cast("int")))
    marked = marked.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    head = F.slice("_words", F.lit(1), F.col("_a"))
    cycle = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    times = F.ceil((n - F.col("_a")) / F.col("_p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(cycle, times)), F.lit(1), n - F.col("_a"))
    line = F.when(F.col("_a").isNotNull(), F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text"))
    return marked.select("doc_id", line.alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_runs(read_table(spark, sf_dir, "documents")), least=12)
    first = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"),
                                                               (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = found.withColumn("_first", first)
    length, period = F.col("_first.length"), -F.col("_first.period")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_first.start")).alias("start"),
                        length.alias("length"), period.alias("period"),
                        F.floor(1000 * length / period).alias("exponent_milli"),
                        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(read_table(spark, sf_dir, "documents"), path, tokenizer_path(WORD_TOKENIZER))
    return token_files.read_tokens(spark, path, with_ids=False).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_quality_cascade": op2_quality_cascade,
    "op3_html_text": op3_html_text,
    "op4_exact_topk": op4_exact_topk,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_packing": op7_packing,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_warc_revisit": op9_warc_revisit,
    "op10_mix_sources": op10_mix_sources,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_files": op13_token_files,
}
