"""One registered query per operator: whole table in, full result out."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import chat, decontaminate, exact_dedup, language, lexical, mixing, sharding, simhash, spelling, suffixes, term_score, toxicity, url_filter
from holdfast.llm.common import held_out, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard(table(spark, sf_dir, "documents"), n_shards=16)
    text = F.coalesce("text", F.lit(""))
    return sharded.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, budget=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], turns.schema)
    return chat.format_chat(turns.unionByName(more)).mapInArrow(
        _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _read_back(batches):
    """Digests of what the formatted conversations hold, piece by piece."""
    now = None

    def done() -> pa.RecordBatch:
        row = {**now, "turns_sha256": now["turns_sha256"].hexdigest(), "loss_sha256": now["loss_sha256"].hexdigest()}
        return pa.RecordBatch.from_pylist([row], pa.schema([
            ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    ready = []
    for batch in batches:
        for x in batch.to_pylist():
            if x["piece"] == 0:
                ready += [done()] if now else []
                now = {"conv_id": x["conv_id"], "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0}
            turns = chat.read_turns(x["formatted"])
            loss = chat.read_loss(x["formatted"], x["loss_starts"], x["loss_ends"])
            now["turns_sha256"].update("".join(f"{role}\n{text}\n" for role, text in turns).encode())
            now["loss_sha256"].update(loss.encode())
            now["n_turns"] += len(turns)
            now["loss_chars"] += len(loss)
            now["formatted_chars"] += len(x["formatted"])
        if ready:
            yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
            ready = []
    if now:
        yield done()


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), alpha=0.5)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "toxic_tokens", "span_starts", "span_ends")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the target is what people have labelled as good
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return term_score.score(table(spark, sf_dir, "documents"), good, order=2)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = language.identify(documents, language.learn(documents))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


FIRST_FETCH = "2024-01-01"


def block_list(pages: DataFrame) -> DataFrame:
    """A dated block list over the hosts, parent domains and top folders of the pages: about a quarter of them are listed
    once, some of these are taken off later and some of those listed again. A digest of the entry decides the dates."""
    name = url_filter.host(F.col("url"))
    keys = pages.select(F.explode(F.array(
        name, F.regexp_extract(name, r"^[^.]+\.([^.]+\..+)$", 1),
        F.concat(name, F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^/?#]+/)", 1)),
    )).alias("entry")).filter("entry <> ''").distinct()
    h = keys.withColumn("h", F.conv(F.substring(F.md5("entry"), 1, 8), 16, 10).cast("long")).filter("h % 4 = 0")
    start = F.floor(F.col("h") / 4) % 300
    stay = 1 + F.floor(F.col("h") / 1200) % 90

    def event(action: str, day: Column, when: Column) -> Column:
        date = F.date_add(F.lit(FIRST_FETCH).cast("date"), day.cast("int"))
        return F.when(when, F.struct(F.lit(action).alias("action"), date.alias("listed_at")))

    always = F.lit(True)
    events = h.select("entry", F.explode(F.array(
        event("add", start, always), event("remove", start + stay, F.col("h") % 3 > 0),
        event("add", start + stay + 14, F.col("h") % 3 > 1))).alias("e"))
    return events.filter("e IS NOT NULL").select("entry", "e.action", "e.listed_at")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # the table has no fetch time: captures are spread over a year by their number
    day = F.date_add(F.lit(FIRST_FETCH).cast("date"), (F.col("page_id") * 37 % 366).cast("int"))
    return url_filter.judge(pages.withColumn("fetched_at", day), block_list(pages))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", suffixes.removed_bytes().cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_simhash": op3_simhash,
    "op4_chat": op4_chat,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_lm_score": op8_lm_score,
    "op9_language": op9_language,
    "op10_url_filter": op10_url_filter,
    "op11_search": op11_search,
    "op12_spelling": op12_spelling,
    "op13_suffix_dedup": op13_suffix_dedup,
}
