"""Mixing sources to target weights: how often each text is used, so that every source has its share of the tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import WS, strip
from brindle.llm.sampling import unit_draw
from brindle.llm.tokenize import DEFAULT_VOCABULARY, encode_corpus
from brindle.session import cut_lineage


def source_key(c: Column | str) -> Column:
    """Sources in one spelling: without outer blanks, in lower case, underscore for hyphen; blank is null."""
    return F.nullif(F.translate(F.lower(strip(c)), "-", "_"), F.lit(""))


def mix_plan(sized: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """Per target source its tokens, wanted tokens and repetition rate.

    ``sized``: ``source, n_tokens`` of each distinct text. Without ``total_tokens`` the plan takes the largest total at
    which every source that has tokens keeps its share within its cap. With it, a rate above the cap is cut to the cap.
    Sources without tokens, and shares that are null or not positive, get rate 0.
    """
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    want = targets.select(source_key("source").alias("source"), "target_share", "max_repeats").filter("source is not null")
    want = want.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    plan = want.join(have, "source", "left").select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0)
    reach = plan.agg(F.min(F.when(usable, F.col("tokens") * F.col("max_repeats") / F.col("target_share"))))
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.coalesce(reach.scalar(), F.lit(0.0))
    plan = plan.withColumn("wanted", total * F.col("target_share"))
    rate = F.when(usable, F.least(F.col("max_repeats").cast("double"), F.col("wanted") / F.col("tokens"))).otherwise(0.0)
    return plan.select("source", "target_share", "max_repeats", "tokens", "wanted", rate.alias("rate"))


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 17, vocabulary_path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens, copy_no``: a row for each time that a text is used (``copy_no`` counts from 1).

    A text is used floor(rate) times, and once more with a probability of the rest, drawn from a hash of its id, so
    never more than ``max_repeats`` times. Copies of a text under other ids, in whatever source, are one text: that of
    the smallest id. Null, empty and blank texts have nothing to use; sources without target aren't used. Sizes are
    tokens of the public vocabulary. Texts are read once and leave the reader as a mark and a size, which are shuffled
    by mark and written. The plan has a row per target source and is sent to the documents; a source with a third of
    all documents needs no shuffle of its own.
    """
    texts = documents.select("doc_id", source_key("source").alias("source"), "text").filter(F.col("text").rlike(f"[^{WS}]"))
    wanted = targets.select(source_key("source").alias("source")).filter("source is not null").distinct()
    texts = texts.join(F.broadcast(wanted), "source", "left_semi").withColumn("mark", F.sha2("text", 256))
    sizes = encode_corpus(texts.select(F.struct("doc_id", "source", "mark").alias("id"), "text"), "id", "text", vocabulary_path, count_only=True)
    first = sizes.groupBy("id.mark").agg(F.min(F.struct("id.doc_id", "id.source", "n_tokens")).alias("first"))
    sized = cut_lineage(first.select("first.doc_id", "first.source", "first.n_tokens"))
    plan = mix_plan(sized, targets, total_tokens).select("source", "rate", "max_repeats")
    rest = F.col("rate") - F.floor("rate")
    copies = F.floor("rate") + (unit_draw(F.col("doc_id"), seed) < rest).cast("bigint")
    used = sized.join(F.broadcast(plan), "source").withColumn("copies", copies).filter("copies > 0")
    return used.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy_no"))


def mix_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, n_docs, n_rows, n_tokens, share``: the shares reached; targets without text have 0."""
    got = mix.groupBy("source").agg(F.count_if(F.col("copy_no") == 1).alias("n_docs"), F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").alias("n_tokens"))
    want = targets.select(source_key("source").alias("source"), "target_share").filter("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    rows = want.join(F.broadcast(got), "source", "left").select("source", "target_share", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "n_rows", "n_tokens")])
    whole = rows.agg(F.sum("n_tokens").cast("double")).scalar()
    return rows.select("source", "target_share", "n_docs", "n_rows", "n_tokens", F.coalesce(F.try_divide(F.col("n_tokens").cast("double"), whole), F.lit(0.0)).alias("share"))
