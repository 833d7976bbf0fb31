"""Style audit: word lists, patterns, sentence rhythm and a score, all as one projection."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import patterns as P, text as T


def present(text: Column, words, bounded: bool = True) -> Column:
    """The words of a list that occur in lower-cased text, in the list's order; each counts once."""
    # a plain search for the letters is quick and rules most words out; only then borders are looked at
    hit = (lambda low, w: low.contains(w) & low.rlike(P.whole([w]))) if bounded else (lambda low, w: low.contains(w))
    return T.let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.array_compact(F.array(*(F.when(hit(low, w), F.lit(w)) for w in words))))


def leaks(text: Column) -> Column:
    return F.flatten(F.array(*(T.matches_of(text, "(?iu)" + p) for p in P.LEAKS)))


def _bounded(words) -> str:
    return "(?iu)" + P.whole(words)


NEGATIVE_PARALLELISM = f"(?iu){P.B}(?:not only{P.B}[^\\n]*?{P.B}but also|not just{P.B}[^\\n]*?{P.B}but also|it is not{P.B}[^\\n]*?{P.B}but{P.B}|rather than{P.B})"


def counts(text: Column) -> dict[str, Column]:
    """The audit's plain counts by name."""
    return {
        "negative_parallelisms": T.count_of(text, NEGATIVE_PARALLELISM),
        "trailing_participles": T.count_of(text, f"(?iu),{P.S}+(?:{P.alternatives(P.PARTICIPLES)}){P.B}"),
        "em_dashes": T.occurrences(text, "—") + T.occurrences(text, "--"),
        "contractions": T.count_of(text, _bounded(P.CONTRACTIONS)),
        "first_second_person": T.count_of(text, _bounded(P.PERSONS)),
        "exclamations": T.occurrences(text, "!"),
        "questions": T.occurrences(text, "?"),
        "opinions": T.count_of(text, _bounded(P.OPINIONS)),
    }


def audit(text: Column) -> dict[str, Column]:
    """Lists and counts of the audit; ``score_of`` adds triggers, score and level to a frame that has them."""
    return {"transitions": present(text, P.TRANSITIONS), "buzzwords": present(text, P.BUZZWORDS), "qualifiers": present(text, P.QUALIFIERS, bounded=False), "leaks": leaks(text), **counts(text), "words": F.greatest(T.word_count(text), F.lit(1)), "sentences": T.sentence_count(text)}


def triggers() -> Column:
    """Weighted sum over the columns of ``audit``."""
    return F.size("transitions") * 3 + F.size("buzzwords") * 2 + F.size("qualifiers") * 3 + F.size("leaks") * 10 + F.col("negative_parallelisms") * 2 + F.col("trailing_participles") * 2 + F.when(F.col("em_dashes") > 3, 1).otherwise(0) + F.col("contractions") * 2 + F.col("opinions") * 4


def score() -> Column:
    """Triggers a hundred words, times twelve, at most 100; below 50 words twice the triggers, times twelve."""
    t, w = F.col("triggers").cast("long"), F.col("words").cast("long")
    long_ = T.one_decimal(t * 1200, w)
    return F.least(F.lit(100.0), F.when(w >= 50, long_).otherwise((t * 24).cast("double")))


def level() -> Column:
    s = F.col("score")
    high, moderate, low, clean = P.AUDIT_LEVELS
    return F.when((s >= 60) | (F.size("leaks") > 0), high).when(s >= 25, moderate).when(s > 0, low).otherwise(clean)


def band(score_: Column) -> Column:
    return F.when(score_ >= 60, "red").when(score_ >= 25, "yellow").otherwise("green")


def rhythm(text: Column) -> Column:
    """Sentence lengths in words: count, mean, sample deviation and a label; the latter three from two sentences on."""
    zero = F.lit(0).cast("long")
    sums = lambda ls: F.struct(F.size(ls).cast("long").alias("n"), F.aggregate(ls, zero, lambda a, x: a + x).alias("total"), F.aggregate(ls, zero, lambda a, x: a + x * x).alias("squares"))

    def figures(s: Column) -> Column:
        n, total = s["n"], s["total"]
        variance = (n * s["squares"] - total * total).cast("double") / (n * (n - 1)).cast("double")
        deviation = F.when(n >= 2, F.floor(F.sqrt(variance) * 10 + 0.5) / 10)
        label = F.when(deviation >= 7, "high").when(deviation >= 4, "moderate").when(deviation.isNotNull(), "low")
        return F.struct(n.cast("int").alias("sentences"), F.when(n >= 2, T.one_decimal(total, n)).alias("mean_length"), deviation.alias("deviation"), label.alias("label"))

    return T.let(T.let(F.transform(T.sentences(text), lambda x: T.words_in(x).cast("long")), sums), figures)
