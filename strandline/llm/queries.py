"""The numbered queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, digest, hardneg, html, langid, lattice, mixing, quality, ranked, sharding, warc
from .neardup import near_duplicates


def vocab_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public byte-level vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's bytes sound as 8-bit samples; copies and edited copies align."""
    sound = _table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("audio"))
    return audio.recordings(sound, params=audio.TEXT_AS_AUDIO)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, and what they decode to."""
    back = bpe.encode(_table(spark, sf_dir, "documents"), vocab_path(), keep=("doc_id",), decoded_col="decoded")
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return digest.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents by four-word shingles."""
    return near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all pages."""
    return html.page_texts(_table(spark, sf_dir, "pages")).select("page_id", "text")


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): good documents 2, poor ones 0.5."""
    found = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return found.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("weight"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document goes into the mix, drawn by the labels' quality weights."""
    return mixing.mix(_table(spark, sf_dir, "documents"), weights=quality_weights(_table(spark, sf_dir, "labels")))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents by a model of those that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    out = langid.predict(docs.select("doc_id", "text", langid.held_out().alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    found = warc.archived(_table(spark, sf_dir, "pages")).where("kind = 'record'")
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by their own evidence and their sites."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.hierarchical_quality(docs, model)


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to eight shards."""
    return sharding.shards_of(_table(spark, sf_dir, "documents"), shards=8)


def op11_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all, a seventh of the labels moved."""
    vectors = _table(spark, sf_dir, "embeddings")
    return hardneg.mine(vectors, F.col("vec_id") % 100 == 0, noise=F.col("vec_id") % 7 == 0)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for every benchmark item."""
    return ranked.search(ranked.build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def piece_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public vocabulary of pieces and their scores lies."""
    return vocab_path(name)


def op13_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice likelihood of all documents by a model of those that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model, counts = lattice.train(docs.where(lattice.not_held_out()), piece_path())
    own = docs.select("doc_id", "text", (~lattice.not_held_out()).alias("held_out"))
    return lattice.score(own, model, counts, keep=("doc_id", "held_out"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_chroma, op2_bpe, op3_fingerprint, op4_neardup, op5_html, op6_mixing, op7_language, op8_warc, op9_quality, op10_shards, op11_hardneg, op12_search, op13_likelihood)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.ORACLE, "op11_hardneg": hardneg.ORACLE, "op12_search": ranked.ORACLE}
