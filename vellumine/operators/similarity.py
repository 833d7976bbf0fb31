"""N-gram overlap between texts: pairwise as expressions, corpus against corpus as an inverted-index join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import patterns as P, text as T
from ..session import checkpointed

TOKEN = f"{P.B}[a-zA-Z0-9_-]+{P.B}"


def tokens(text: Column) -> Column:
    return T.matches_of(F.lower(text), TOKEN)


def ngrams(toks: Column, n: int) -> Column:
    """Distinct n-grams, joined by blanks."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(toks) - n, F.lit(0))), lambda i: i + n <= F.size(toks))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(toks, i + 1, F.lit(n)), " ")))


def risk(overlap: Column, five: Column) -> Column:
    high, moderate, low, clean, _ = P.RISK_LEVELS
    return F.when((overlap >= 25) | (five > 15), high).when((overlap >= 10) | (five > 5), moderate).when(overlap > 0, low).otherwise(clean)


def badge(overlap: Column) -> Column:
    return F.when(overlap < 1, "clean").when(overlap < 5, "moderate").otherwise("high")


def pair_similarity(df: DataFrame, original: str, rewritten: str, n: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """Containment of the original's n-grams in the rewritten text, for n and for 3 and 5, with tier and samples.

    Tokens and n-grams are arrays of one row, so nothing is shuffled. An empty side gives zeroes and its own label.
    """
    empty = (F.coalesce(F.col(original), F.lit("")) == "") | (F.coalesce(F.col(rewritten), F.lit("")) == "")
    base = df.select(*keep, empty.alias("__empty"), F.when(empty, F.array().cast("array<string>")).otherwise(tokens(F.col(original))).alias("__o"), F.when(empty, F.array().cast("array<string>")).otherwise(tokens(F.col(rewritten))).alias("__r"))
    sizes = sorted({3, 5, n})
    grams = base.select(*keep, "__empty", *(ngrams(F.col(s), k).alias(f"{s}{k}") for s in ("__o", "__r") for k in sizes))
    common = grams.select("*", *(F.array_intersect(f"__o{k}", f"__r{k}").alias(f"__c{k}") for k in sizes))
    pct = {k: T.percent(F.size(f"__c{k}"), F.greatest(F.size(f"__o{k}"), F.lit(1))) for k in sizes}
    out = common.select(*keep, F.lit(n).alias("n"), F.size(f"__o{n}").alias("original_ngrams"), F.size(f"__r{n}").alias("rewritten_ngrams"), F.size(f"__c{n}").alias("matching_ngrams"), pct[n].alias("overlap"), pct[3].alias("three_gram_overlap"), pct[5].alias("five_gram_overlap"), F.slice(F.array_sort(f"__c{n}"), 1, 15).alias("matching_sequences"), "__empty")
    return out.select(*keep, "n", "original_ngrams", "rewritten_ngrams", "matching_ngrams", "overlap", (F.round((1000 - F.col("overlap") * 10)) / 10).alias("originality"), "three_gram_overlap", "five_gram_overlap", F.when(F.col("__empty"), P.RISK_LEVELS[4]).otherwise(risk(F.col("overlap"), F.col("five_gram_overlap"))).alias("risk_level"), "matching_sequences")


def gram_rows(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Distinct (id, n-gram) rows."""
    toks = df.select(F.col(id_col), tokens(F.col(text_col)).alias("__t"))
    return toks.select(id_col, F.explode(ngrams(F.col("__t"), n)).alias("gram")).distinct()


#: Up to so many distinct n-grams of all sources are broadcast.
FEW_GRAMS = 2_000_000


def source_overlap(sources: DataFrame, drafts: DataFrame, n: int = 4, source_id: str = "source_idx", draft_id: str = "doc_id") -> DataFrame:
    """For each source and draft that share an n-gram: how many, and the share of the source's that the draft has.

    An inverted index: a draft's n-grams are kept where a source has one of the same 64-bit hash, before anything of the
    drafts is shuffled, and are then compared. The sources' hashes are broadcast if they are few, else joined.
    """
    s = checkpointed(gram_rows(sources, source_id, "text", n).withColumn("h", F.xxhash64("gram")))
    hashes = checkpointed(s.select("h").distinct())
    few = hashes.count() <= FEW_GRAMS
    d = drafts.select(F.col(draft_id), tokens(F.col("text")).alias("__t")).select(draft_id, F.explode(ngrams(F.col("__t"), n)).alias("gram2")).withColumn("h", F.xxhash64("gram2"))
    d = d.join(F.broadcast(hashes) if few else hashes, "h", "left_semi").distinct()
    whole = s.groupBy(source_id).agg(F.count("*").alias("source_ngrams"))
    common = d.join(s, "h").where("gram = gram2").groupBy(source_id, draft_id).agg(F.count("*").alias("common"))
    out = common.join(whole, source_id)
    return out.select(source_id, draft_id, "common", "source_ngrams", T.percent(F.col("common"), F.col("source_ngrams")).alias("overlap"))


def shared_grams(df: DataFrame, id_col: str, a: str, b: str, n: int) -> DataFrame:
    """How many distinct n-grams of one text stand in another of the same row; rows that share none are left out."""
    grams = lambda c: T.let(tokens(F.col(c)), lambda t: ngrams(t, n))
    both = F.array_intersect(grams(a), grams(b))
    return df.select(id_col, F.size(both).cast("long").alias("common")).where("common > 0")
