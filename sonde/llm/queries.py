"""The dealt operators over the driver tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.llm import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13
from sonde.llm.common import tune
from sonde.session import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    """crc32 of the id's decimal text modulo n."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % n


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = op1.fit(docs.where(remainder(4) != 2))
    return op1.identify(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2.remove_repeats(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits")


def op4_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5.mix(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    forest = op6.fit(docs, labels.where(remainder(5) != 0))
    return op6.classify(docs, forest).select("doc_id", (remainder(5) == 0).alias("held_out"), "score",
                                             (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7.scan(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8.join(table(spark, sf_dir, "documents"))


def op9_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_dir(spark, "token-blocks")
    op9.write_blocks(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return op9.read_blocks(spark.read.parquet(path))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.shard(table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    merges = op11.compile_merges(op11.read_ranks(Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()))
    return op11.round_trip(table(spark, sf_dir, "documents"), merges)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = [Path(public_tokenizers.path(name)).read_bytes() for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return op12.align_documents(table(spark, sf_dir, "documents"), op12.byte_level(files[0]), op12.sentence_pieces(files[1])).drop("a", "b")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13.digest(op13.transform(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _mixing_sql() -> str:
    """The same fit as a chain of common table expressions."""
    topic = ("CASE WHEN text IS NULL THEN 'none' WHEN contains(text, 'http') THEN 'web' WHEN contains(text, ' | ') THEN 'list' "
             "WHEN octet_length(encode(text)) < 500 THEN 'note' WHEN octet_length(encode(text)) < 5000 THEN 'article' ELSE 'book' END")
    steps = [
        f"k AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic} AS topic, "
        "coalesce(octet_length(encode(text)) // 4, 0) + 1 AS tokens FROM documents)",
        "c AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM k GROUP BY ALL)"]
    for axis in op5.AXES:
        steps.append(f"g_{axis} AS (SELECT {axis}, pow(sum(tokens), {op5.TEMPER}) AS p FROM c GROUP BY 1)")
        steps.append(f"t_{axis} AS (SELECT {axis}, p / (SELECT sum(p) FROM g_{axis}) AS share FROM g_{axis})")
    steps.append("w0 AS MATERIALIZED (SELECT *, tokens::DOUBLE AS weight FROM c)")
    n = 0
    for _ in range(op5.ROUNDS):
        for axis in op5.AXES:
            steps.append(f"w{n + 1} AS MATERIALIZED (SELECT w.source, w.lang, w.topic, w.tokens, w.weight * t.share / "
                         f"sum(w.weight) OVER (PARTITION BY w.{axis}) AS weight FROM w{n} w JOIN t_{axis} t USING ({axis}))")
            n += 1
    steps.append(f"r AS (SELECT source, lang, topic, round((weight / tokens) / max(weight / tokens) OVER (), 9) AS probability FROM w{n})")
    return ("WITH " + ", ".join(steps) + " SELECT doc_id, source, lang, topic, tokens, probability, "
            "CAST('0x' || substr(md5('0:' || doc_id::VARCHAR), 1, 12) AS BIGINT) / 281474976710656.0 < probability AS sampled "
            "FROM k JOIN r USING (source, lang, topic)")


def _middle_sql() -> str:
    """Units as a list, cut by slices."""
    h = ", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
    part = lambda a, b: f"coalesce(array_to_string(u[{a}:{b}], ''), '')"
    return (f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    e AS (SELECT doc_id, t, {h}, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u FROM d),
    f AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
    g AS (SELECT doc_id, t, n::BIGINT AS n, form, {part(1, 'a')} AS p, {part('a + 1', 'b')} AS m, {part('b + 1', 'n')} AS s FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
        CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
        sha256(t) AS restored_sha256 FROM g""")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language, "op2_suffix_array": op2_suffix_array, "op3_decontamination": op3_decontamination,
    "op4_embedding_join": op4_embedding_join, "op5_mixing": op5_mixing, "op6_quality": op6_quality, "op7_secrets": op7_secrets,
    "op8_jaccard_join": op8_jaccard_join, "op9_token_blocks": op9_token_blocks, "op10_sharding": op10_sharding,
    "op11_byte_bpe": op11_byte_bpe, "op12_alignment": op12_alignment,
    "op13_fill_in_middle": op13_fill_in_middle, "pipeline": pipeline}
ORACLES: dict[str, str] = {"op5_mixing": _mixing_sql(), "op13_fill_in_middle": _middle_sql()}
