"""Measures of a text: exposure (length bands, share of code) and style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import either, let
from .patterns import CJK, CODE_LINE, COMMENT_LINE, PHRASES, SPACE, java, needles

WORD = r"[\p{L}\p{N}'’-]+"
SENTENCE_END = f"(?<=[.!?…])[\"'»”]?[{SPACE}]+(?=[«\"'“]?\\p{{Lu}})"
SAMPLE_WORDS = 1000
SHORT, AMPLE = 200, 800
LEAST_WORDS = 120


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def characters(text: Column) -> Column:
    return F.char_length(text).cast("long")


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long")


def token_bounds(text: Column) -> tuple[Column, Column]:
    """Lower and upper estimate of a text's tokens, by characters."""
    n, dense = F.char_length(text), text.rlike(CJK)
    return half_up(n / F.when(dense, 2.0).otherwise(4.5)), half_up(n / F.when(dense, 1.0).otherwise(3.2))


def exposure(text: Column) -> Column:
    """struct(characters, words, low, high, band, code, comment_lines, non_blank_lines)."""
    low, high = token_bounds(text)
    band = F.when(low < SHORT, "too-short").when(low < AMPLE, "uncertain").otherwise("ample")
    lines = F.filter(F.split(text, "\r?\n"), lambda x: x.rlike(f"[^{SPACE}]"))

    def choice(all_: Column) -> Column:
        comments = F.size(F.filter(all_, lambda x: x.rlike(java(COMMENT_LINE))))
        codes = F.size(F.filter(all_, lambda x: x.rlike(java(CODE_LINE).replace("$|", r"\z|"))))
        n = F.size(all_)
        return F.struct((F.when(n > 0, codes / n).otherwise(0.0) > 0.25).alias("code"), comments.cast("long").alias("comments"), n.cast("long").alias("lines"))

    c = let(lines, choice)
    # fields of their own, so that those which nobody selects aren't computed
    return F.struct(
        characters(text).alias("characters"),
        words(text).alias("words"),
        low.alias("low"),
        high.alias("high"),
        band.alias("band"),
        c["code"].alias("code"),
        c["comments"].alias("comment_lines"),
        c["lines"].alias("non_blank_lines"),
    )


def style_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def sentence_lengths(text: Column) -> Column:
    """Words of each sentence that has any."""
    parts = F.split(text, SENTENCE_END)
    return F.filter(F.transform(parts, lambda s: F.regexp_count(s, F.lit(WORD)).cast("long")), lambda n: n > 0)


def mean_and_burstiness(lengths: Column) -> Column:
    """struct(mean, burstiness): burstiness is the sample deviation over the mean."""

    def of(all_: Column) -> Column:
        n = F.size(all_)
        mean = F.when(n > 0, F.aggregate(all_, F.lit(0).cast("long"), lambda a, x: a + x) / n).otherwise(0.0)

        def spread(m: Column) -> Column:
            squares = F.aggregate(all_, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
            deviation = F.when(n < 2, F.lit(0.0)).otherwise(F.sqrt(squares / (n - 1)))
            return F.struct(m.alias("mean"), F.when(m == 0, F.lit(0.0)).otherwise(deviation / m).alias("burstiness"))

        return let(mean, spread)

    return let(lengths, of)


def phrase_counts(text: Column, languages: tuple[str, ...] = ("fr", "en")) -> Column:
    """array of struct(label, count, least) over the phrases of the languages, in their order.

    A pattern runs only on texts that have one of its needles; letters that only some case rules fold count as having them.
    """
    low, odd = F.lower(text), text.rlike("[ſıİ\u212a]")

    def count(pattern: str) -> Column:
        n = F.regexp_count(text, F.lit("(?iu)" + java(pattern)))
        has = [F.contains(low, F.lit(x.lower())) for x in needles(pattern)]
        return (F.when(either([*has, odd]), n).otherwise(F.lit(0)) if has else n).cast("long")

    return F.array(
        *(
            F.struct(F.lit(label).alias("label"), count(pattern).alias("count"), F.lit(least).cast("double").alias("least"))
            for label, language, least, pattern in PHRASES
            if language in languages
        )
    )


def bold_lead_ins(text: Column) -> Column:
    """Share of the paragraphs that open in bold."""
    paragraphs = F.filter(F.split(text, "\n{2,}"), lambda p: p.rlike(f"[^{SPACE}]"))
    bold = f"^[{SPACE}]*(?:[-*+][{SPACE}]+)?\\*\\*[^*\n]{{2,60}}\\*\\*"
    share = let(paragraphs, lambda ps: F.size(F.filter(ps, lambda p: p.rlike(bold))) / F.size(ps))
    return F.when(F.contains(text, F.lit("**")), F.coalesce(share, F.lit(0.0))).otherwise(F.lit(0.0))


def indicators(phrases: Column, n: Column) -> Column:
    """array of struct(label, count, rate) of the phrases that count in a text of n words, by count and label."""
    rate = lambda x: F.when(n > 0, x * 1000 / n).otherwise(0.0)
    kept = F.filter(phrases, lambda p: (p["count"] > 0) & (p["least"].isNull() | ((p["count"] >= 2) & (rate(p["count"]) >= p["least"]))))
    rows = F.transform(kept, lambda p: F.struct((-p["count"]).alias("n"), p["label"].alias("label")))
    return F.transform(F.array_sort(rows), lambda r: F.struct(r["label"].alias("label"), (-r["n"]).alias("count"), rate(-r["n"]).alias("rate")))


#: Columns that with_style() makes, and those that it makes for itself.
STYLE = ("words", "sentences", "mean_sentence", "burstiness", "dash_rate", "bold_lead_ins", "vocabulary_richness", "indicators", "band")
OWN = ("_style_words", "_style_lengths", "_style_spread", "_style_phrases", "_style_present")


def with_style(df: DataFrame, text: Column, prefix: str = "") -> DataFrame:
    """df with all style measures as columns of their own, so that those which nobody selects aren't computed.

    A null text counts as empty. The words and the sentences' lengths are made once, in steps of their own.
    """
    text = F.coalesce(text, F.lit(""))
    name = {c: f"{prefix}{c}" for c in STYLE}
    rows = df.withColumn("_style_words", style_words(text)).withColumn("_style_lengths", sentence_lengths(text))
    rows = rows.withColumn("_style_spread", mean_and_burstiness(F.col("_style_lengths"))).withColumn("_style_phrases", phrase_counts(text))
    n = F.size("_style_words")
    sample = F.transform(F.slice("_style_words", 1, SAMPLE_WORDS), F.lower)
    richness = F.when(n > 0, F.size(F.array_distinct(sample)) / F.least(n, F.lit(SAMPLE_WORDS))).otherwise(0.0)
    rows = rows.withColumns(
        {
            name["words"]: n.cast("long"),
            name["sentences"]: F.size("_style_lengths").cast("long"),
            name["mean_sentence"]: F.col("_style_spread.mean"),
            name["burstiness"]: F.col("_style_spread.burstiness"),
            name["dash_rate"]: F.when(n > 0, F.regexp_count(text, F.lit("[—–]")) * 1000 / n).otherwise(0.0),
            name["bold_lead_ins"]: bold_lead_ins(text),
            name["vocabulary_richness"]: richness,
            name["indicators"]: indicators(F.col("_style_phrases"), n),
        }
    )
    spread = F.col(name["burstiness"])
    present = F.size(name["indicators"]) + ((spread > 0) & (spread < 0.35)).cast("int") + (F.col(name["dash_rate"]) > 4).cast("int")
    rows, at = rows.withColumn("_style_present", present), F.col("_style_present")
    band = F.when(F.col(name["words"]) < LEAST_WORDS, "too-short").when(at >= 6, "many").when(at >= 2, "several").otherwise("few")
    return rows.withColumn(name["band"], band).drop(*OWN)
