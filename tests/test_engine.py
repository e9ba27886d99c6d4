"""The engine's own operators on small texts, negative controls included."""

import pytest
from pyspark.sql import functions as F

from vestige.functions import chars, content, mail, markup, measure
from vestige.functions.patterns import java
from vestige.plans import textpipe


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"]


def test_joiners_that_work_stay(spark):
    kept = "👩‍💻 می‌خواهم ❤️ ⠓⠀⠊"
    assert one(spark, kept, chars.clean_text(F.col("t"))) == kept
    assert one(spark, "a‍ b​ c️⠀", chars.clean_text(F.col("t"))) == "a b c"
    assert one(spark, "é", chars.clean_text(F.col("t"))) == "é"
    assert one(spark, "؅ 1 plain", chars.clean_text(F.col("t"))) == "؅ 1 plain"


def test_payloads():
    tags = "".join(chr(0xE0000 + ord(c)) for c in "hello")
    assert chars.payloads(tags) == ['tag characters → "hello"']
    bits = "".join("‌" if b == "1" else "​" for c in b"key" for b in f"{c:08b}")
    assert 'zero-width binary → "key"' in chars.payloads(bits)
    assert chars.payloads("​‌" * 20) == []


def test_mail_gate_and_strip(spark):
    text = "From: a@b.c\nTo: d@e.f\nX-Mailer: M\n more\nDate: now\n\nBody\r\nx-not: header\n"
    found = one(spark, text, mail.email_headers(F.col("t")))
    assert [(f.label, f.value) for f in found] == [("Sender", "a@b.c"), ("Mail client", "M more")]
    stripped = one(spark, text, mail.strip_tool_headers(F.col("t")))
    assert stripped.text == "From: a@b.c\nTo: d@e.f\nDate: now\n\nBody\r\nx-not: header\n" and stripped.removed == ["X-Mailer"]
    assert one(spark, "From: one\nNote: two\n\nx", mail.email_headers(F.col("t"))) == []


def test_secrets_are_masked(spark):
    secret = "sk-" + "Z" * 40
    found = one(spark, f"key {secret} and {secret}", content.scan_content(F.col("t"), "here"))
    assert len(found) == 1 and secret not in found[0].value and found[0].value.startswith("sk-… (43")
    assert one(spark, "task-list and mask-Z", content.scan_content(F.col("t"), "here")) == []


def test_source_type_must_be_in_the_vocabulary(spark):
    text = 'digitalSourceType="http://x/trainedAlgorithmicMedia" digitalSourceType="constructor"'
    found = one(spark, text, content.find_source_types(F.col("t"), "m"))
    assert [f.value.split(" — ")[0] for f in found] == ["trainedAlgorithmicMedia"]
    assert one(spark, text, content.declares_generative(content.find_source_types(F.col("t"), "m"))) is True


def test_writing_about_a_tool_is_no_attribution(spark):
    df = spark.createDataFrame([(1, "An essay on ChatGPT."), (2, "---\ngenerator: ChatGPT\n---\nx"), (3, None)], "id int, text string")
    found = {r.id: r for r in textpipe.summarize(df, "id").collect()}
    assert not found[1].attributed and found[2].attributed and found[3].verdict == "none"
    assert found[2].tools == ["ChatGPT / OpenAI"] or "ChatGPT / OpenAI" in found[2].tools


def test_redaction_leaves_nothing_removable(spark):
    page = '<html><head><meta name="generator" content="G"></head><body data-ai-x="1"><!-- exported by T -->a​b</body></html>'
    df = spark.createDataFrame([(1, page), (2, "plain​ text")], "id int, text string")
    cleaned = textpipe.redact_text(df)
    assert {r.id: r.cleaned for r in cleaned.collect()}[1] == "<html><head></head><body>ab</body></html>"
    assert textpipe.survivors(cleaned.select("id", "cleaned"), "id").count() == 0


def test_style_of_plain_prose_is_few(spark):
    text = "I walked home. It rained, and the long road by the river was empty but for two dogs and a man with a cart. Fine. " * 8
    style = lambda t: measure.with_style(spark.createDataFrame([(t,)], "t string"), F.col("t")).first()
    s = style(text)
    assert s.band == "few" and s.sentences > 20 and s.indicators == []
    assert style("").band == "too-short"


@pytest.mark.parametrize(("pattern", "text", "hit"), [(r"\bclé\b", "la clé est", True), (r"\bou\b", "éou b", True), (r"(?i)\bcursor\b", "precursor", False)])
def test_boundaries(spark, pattern, text, hit):
    assert one(spark, text, F.col("t").rlike(java(pattern))) is hit


def test_front_matter_and_formats(spark):
    note = "---\nauthor: Ann\nother: y\n---\nbody"
    assert one(spark, note, markup.redact_markdown(F.col("t"))) == "---\nother: y\n---\nbody"
    assert one(spark, note, markup.detect_format(F.col("t"))) == "markdown"
    assert one(spark, "plain", markup.detect_format(F.col("t"))) is None


def test_svg_findings_reads_every_row(spark, tmp_path):
    from vestige.plans.queries import QUERIES

    own = "<svg><desc>own</desc></svg>"
    spark.createDataFrame([(k, own if k in (4, 9) else "plain") for k in range(10)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [(r.doc_id, r.value) for r in QUERIES["svg_findings"](spark, str(tmp_path)).collect()]
    assert {(4, "own"), (9, "own")} <= set(found) and not {2, 3, 7, 8} & {i for i, _ in found}


def test_every_match_has_a_needle(spark):
    """The plain search before a pattern lets every text through that the pattern matches."""
    from vestige.functions.patterns import CONTENT, PHRASES, java, needles

    assert needles(r"\b(?:rich\s+)?tapestry\b") == ["tapestry"] and needles(r"it'?s\b[^.!?]{0,5}\bmen+d") == ["men"]
    assert needles(r"[a-z]+") == [] and needles(r"ab|[0-9]") == []
    said = [
        "il est important, convient de noter", "En Résumé", "DÉCOUVRONS", "N'hésitez pas à x", "voici un aperçu", "non seulement a mais également b", "dans un monde numérique",
        "témoignage de", "joue un rôle clé .", "holistiques", "que ce soit a ou b", "Delve  into", "tapestry", "a testament to", "its worth noting", "navigating the landscapes",
        "in todays digital", "robust", "fostering", "not just a, its b", "this isnt a, it's b", "quietly", "to sum up", "lets dive in", "feel free to", "SE\u017fAMLE\u017f\u017f seamle\u017f\u017f",
    ]
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    plain = F.array(*(F.regexp_count("t", F.lit("(?iu)" + java(p))).cast("long") for *_, p in PHRASES))
    for r in rows.select("t", plain.alias("plain"), measure.phrase_counts(F.col("t")).alias("found")).collect():
        assert [x["count"] for x in r.found] == r.plain and sum(r.plain) > 0, r.t
    assert all(needles(p) for _, _, p, _ in CONTENT)


def test_uncommon_characters_reach_the_exact_pattern(spark):
    """No invisible character or exotic space is among those that the fast test passes by."""
    import regex

    from vestige.functions.patterns import COMMON, EXOTIC_SPACES, beyond

    rows = spark.range(0, 0xD800).select(F.col("id"), F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    passed = {r.id for r in rows.where(~F.col("c").rlike(beyond(COMMON))).collect()}
    hidden = regex.compile(r"\p{Cf}")
    assert 0x41 in passed and not any(hidden.match(chr(x)) for x in passed if not 0x600 <= x <= 0x605)
    assert not passed & {*EXOTIC_SPACES, 0xAD, 0x34F, 0x200B, 0x200D, 0x2800, 0x3164, 0xFE0F}


def test_redaction_tells_what_went_and_what_stayed(spark):
    from vestige.plans import textpipe

    rows = [(1, "a\u200bb \u2010 c\u00a0d"), (2, None), (3, "From: a\nTo: b\nDate: c\nX-Mailer: m\n\nbody"), (4, "<html><p>x\u200by</p>\r\n<p>z\n")]
    df = textpipe.redact_text(spark.createDataFrame(rows, "id long, text string"))
    found = {r.id: (r.cleaned, r.removed, r.kept) for r in df.collect()}
    assert found[1] == ("ab \u2010 c\u00a0d", ["zero-width space"], ["Dashes that are not the ASCII hyphen"])
    assert found[2] == ("", [], []) and found[3] == ("From: a\nTo: b\nDate: c\n\nbody", ["X-Mailer"], [])
    assert found[4][1:] == (["zero-width space"], []) and "\u200b" not in found[4][0]


def test_a_stream_gives_the_findings_of_new_files_once(spark, tmp_path):
    from vestige.streaming.inspect import inspect_stream

    source, sink, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    for n, text in enumerate(["a\u200bb", "plain", "/home/ann/x"]):
        spark.createDataFrame([(n, text)], "id long, text string").write.mode("append").parquet(source)
        inspect_stream(spark, source, "id long, text string", ("id",), sink, marks).awaitTermination()
    assert sorted((r.id, r.label) for r in spark.read.parquet(sink).collect()) == [(0, "zero-width space"), (2, "Linux account")]
