"""Registered queries over the test tables, each with the same in DuckDB SQL where SQL can say it.

The tables hold none of what most operators look for, so a fixed insertion chosen by the row's key
goes into each text on both sides; rows without one are the negative controls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chars, content, findings, mail, markup, measure
from ..functions.patterns import CONTENT, EXOTIC_SPACES, HYPHENS, METAS, PHRASES, SOURCE_TYPES
from ..shipping import ship
from . import textpipe

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLE_SQL[name] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    """A DuckDB string of any text."""
    parts = [f"'{c}'" if c.isascii() and c.isprintable() and c != "'" else f"chr({ord(c)})" for c in text]
    return "(" + " || ".join(parts) + ")" if parts else "''"


def inserted(key: str, every: int, before: dict[int, str], after: dict[int, str], text: str = "text") -> tuple[Callable[[], Column], str]:
    """The text with what its key's remainder puts before and after it, as what makes a column and as SQL."""

    def column(extra: dict[int, str]) -> Column:
        out = F.lit("")
        for k, v in extra.items():
            out = F.when(F.col(key) % every == k, F.lit(v)).otherwise(out)
        return out

    def sql(extra: dict[int, str]) -> str:
        return "''" if not extra else f"CASE {key} % {every} " + " ".join(f"WHEN {k} THEN {quoted(v)}" for k, v in extra.items()) + " ELSE '' END"

    return lambda: F.concat(column(before), F.col(text), column(after)), f"({sql(before)} || {text} || {sql(after)})"


SECRET = "sk-" + "A" * 32
AFTER = {
    1: "​ hidden​", 2: " no-break　wide", 3: " non‐breaking − minus‐", 4: "\tx  \ny \nz \t\nend", 5: " One.  Two. Three.",
    6: "a\r\nb\nc", 7: "\x07 bell \x1b[0m\x07", 8: " раyраl аpple", 9: " ＡBC", 10: " " + SECRET + " ghp_" + "b" * 36 + " " + SECRET,
    11: ' digitalSourceType="trainedAlgorithmicMedia" digitalSourceType: compositeCapture digitalSourceType=digitalArt',
    12: " saved in /home/ann/x and /tmp/run1 by session_abcdef9", 13: "‮ reversed ⁦",
    16: " Il est important de noter : n'hésitez pas à lire, en résumé, ce qui joue un rôle clé et crucial ; que ce soit ici ou là",
    14: " it is important to note that we delve into a tapestry — quietly, quietly", 15: " AKIA" + "Q" * 16 + " api.openai.com/v1 msg_" + "z" * 24,
}
MAIL = "From: A <a@example.org>\nTo: b@example.org\nReceived: one\nReceived: two\n  folded\nX-Mailer: Mailer 1\nX-Custom-Run: 42\nSubject: s\nMessage-ID: <1@host>\n\n"
BEFORE = {0: MAIL}
EVERY = 17
TEXT, TEXT_SQL = inserted("doc_id", EVERY, BEFORE, AFTER)
DOCS_SQL = f"(SELECT doc_id, lang, {TEXT_SQL} AS t FROM documents)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "documents").select("doc_id", "lang", TEXT().alias("t"))


WORD = r"[\p{L}\p{N}'’-]+"
JS_SPACE = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def sql_string(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sql_count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {sql_string(pattern)}))::BIGINT"


@register(
    "exposure_bands",
    f"""WITH m AS (SELECT lang, length(text)::BIGINT AS n, {sql_count('text', f'[^{JS_SPACE}]+')} AS w,
          regexp_matches(text, '[぀-ヿ㐀-䶿一-鿿豈-﫿]') AS dense FROM documents),
      b AS (SELECT lang, n, w, floor(n / CASE WHEN dense THEN 2.0 ELSE 4.5 END + 0.5)::BIGINT AS low,
          floor(n / CASE WHEN dense THEN 1.0 ELSE 3.2 END + 0.5)::BIGINT AS high FROM m)
      SELECT lang, CASE WHEN low < 200 THEN 'too-short' WHEN low < 800 THEN 'uncertain' ELSE 'ample' END AS band,
        count(*)::BIGINT AS documents, sum(n)::BIGINT AS characters, sum(w)::BIGINT AS words, sum(low)::BIGINT AS low, sum(high)::BIGINT AS high
      FROM b GROUP BY ALL""",
)
def exposure_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "documents").select("lang", measure.exposure(F.col("text")).alias("e"))
    return e.groupBy("lang", F.col("e.band").alias("band")).agg(
        F.count("*").alias("documents"), *(F.sum(f"e.{c}").alias(c) for c in ("characters", "words", "low", "high"))
    )


CODE_SQL = r"[;{}]\s*$|^\s*(?:import|from|export|const|let|var|def|class|function|fn|func|public|private|package|use|#include|if|for|while|return|end)\b"


@register(
    "source_code_share",
    f"""WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: regexp_matches(x, '[^{JS_SPACE}]')) AS ls FROM documents),
      c AS (SELECT doc_id, len(ls)::BIGINT AS non_blank_lines,
        len(list_filter(ls, lambda x: regexp_matches(x, {sql_string("^[[:space:]]*(?://|#|--|;|%|[*]|/[*]|<!--|\"\"\"|''')")})))::BIGINT AS comment_lines,
        len(list_filter(ls, lambda x: regexp_matches(x, {sql_string(CODE_SQL)})))::BIGINT AS k FROM l)
      SELECT doc_id, coalesce(k / nullif(non_blank_lines, 0) > 0.25, false) AS code, comment_lines, non_blank_lines FROM c""",
)
def source_code_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "documents").select("doc_id", measure.exposure(F.col("text")).alias("e"))
    return e.select("doc_id", "e.code", "e.comment_lines", "e.non_blank_lines")


BREAK = f"([.!?…])[\"''»”]?[{JS_SPACE}]+([«\"''“]?\\p{{Lu}})"


def phrase_sql(pattern: str) -> str:
    return sql_count("t", "(?i)" + pattern)


@register(
    "style_measures",
    f"""WITH w AS (SELECT doc_id, t, regexp_extract_all(t, {sql_string(WORD)}) AS ws,
          list_filter(list_transform(string_split(regexp_replace(t, '{BREAK}', '\\1' || chr(1) || '\\2', 'g'), chr(1)),
            lambda s: len(regexp_extract_all(s, {sql_string(WORD)}))), lambda n: n > 0) AS ls,
          list_filter(regexp_split_to_array(t, '\n\n+'), lambda p: regexp_matches(p, '[^{JS_SPACE}]')) AS ps FROM {DOCS_SQL}),
      m AS (SELECT *, len(ws) AS n, CASE WHEN len(ls) > 0 THEN list_sum(ls) / len(ls) ELSE 0 END AS mean FROM w),
      s AS (SELECT *, CASE WHEN len(ls) < 2 OR mean = 0 THEN 0 ELSE sqrt(list_sum(list_transform(ls, lambda x: (x - mean) * (x - mean))) / (len(ls) - 1)) / mean END AS burst FROM m)
      SELECT doc_id, n::BIGINT AS words, len(ls)::BIGINT AS sentences, round(mean, 6)::DOUBLE AS mean_sentence, round(burst, 6)::DOUBLE AS burstiness,
        round(CASE WHEN n > 0 THEN len(regexp_extract_all(t, '[—–]')) * 1000 / n ELSE 0 END, 6)::DOUBLE AS dash_rate,
        round(CASE WHEN n > 0 THEN len(list_distinct(list_transform(ws[1:1000], lambda x: lower(x)))) / len(ws[1:1000]) ELSE 0 END, 6)::DOUBLE AS richness
      FROM s""",
)
def style_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = measure.with_style(docs(spark, sf_dir), F.col("t"))
    rounded = {"mean_sentence": "mean_sentence", "burstiness": "burstiness", "dash_rate": "dash_rate", "vocabulary_richness": "richness"}
    return s.select("doc_id", "words", "sentences", *(F.round(c, 6).alias(a) for c, a in rounded.items()))


def counted_sql(pattern: str) -> str:
    """phrase_sql() with the boundaries that are meant after an accented letter."""
    for end in ("résumé", "pas à"):
        pattern = pattern.replace(end + r"\b", end + r"(?:[^\pL\pN_]|$)")
    return phrase_sql(pattern.replace(r"clé|essentiel)\b", r"clé|essentiel)(?:[^A-Za-z0-9_]|$)"))


@register(
    "style_phrases",
    "SELECT * FROM (SELECT doc_id, unnest(["
    + ", ".join(f"{{'label': {quoted(label)}, 'n': {counted_sql(pattern)}}}" for label, _, _, pattern in PHRASES)
    + f"], recursive := true) FROM {DOCS_SQL}) WHERE n > 0",
)
def style_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", F.explode(measure.phrase_counts(F.col("t"))).alias("p"))
    return rows.select("doc_id", "p.label", F.col("p.count").alias("n")).where("n > 0")


def indicator_sql(least: float | None) -> str:
    return "(c > 0)::INT" if least is None else f"(c >= 2 AND c * 1000.0 / n >= {least})::INT"


@register(
    "style_bands",
    f"""WITH w AS MATERIALIZED (SELECT doc_id, t, len(regexp_extract_all(t, {sql_string(WORD)})) AS n,
          list_filter(list_transform(string_split(regexp_replace(t, '{BREAK}', '\\1' || chr(1) || '\\2', 'g'), chr(1)),
            lambda s: len(regexp_extract_all(s, {sql_string(WORD)}))), lambda x: x > 0) AS ls FROM {DOCS_SQL}),
      p AS (SELECT doc_id, sum(i)::INT AS indicators FROM (
        {" UNION ALL ".join(f"SELECT doc_id, {indicator_sql(least)} AS i FROM (SELECT doc_id, n, {counted_sql(pattern)} AS c FROM w)" for _, _, least, pattern in PHRASES)}) GROUP BY doc_id),
      m AS (SELECT *, CASE WHEN len(ls) > 0 THEN list_sum(ls) / len(ls) ELSE 0 END AS mean FROM w JOIN p USING (doc_id)),
      s AS (SELECT *, CASE WHEN len(ls) < 2 OR mean = 0 THEN 0 ELSE sqrt(list_sum(list_transform(ls, lambda x: (x - mean) * (x - mean))) / (len(ls) - 1)) / mean END AS burst,
        CASE WHEN n > 0 THEN len(regexp_extract_all(t, '[—–]')) * 1000 / n ELSE 0 END AS dashes FROM m),
      q AS (SELECT *, indicators + (burst > 0 AND burst < 0.35)::INT + (dashes > 4)::INT AS present FROM s)
      SELECT doc_id, indicators, CASE WHEN n < 120 THEN 'too-short' WHEN present >= 6 THEN 'many' WHEN present >= 2 THEN 'several' ELSE 'few' END AS band FROM q""",
)
def style_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = measure.with_style(docs(spark, sf_dir), F.col("t"))
    return s.select("doc_id", "band", F.size("indicators").alias("indicators"))


INVISIBLE_SQL = "[\\x{AD}\\x{34F}\\x{61C}\\x{200B}\\x{200E}\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{2066}-\\x{206F}\\x{FEFF}]"
SPACES_SQL = "[\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]"


@register(
    "character_counts",
    f"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(t, '{INVISIBLE_SQL}|{SPACES_SQL}')) AS c FROM {DOCS_SQL})
      SELECT doc_id, 'U+' || lpad(upper(to_hex(unicode(c))), 4, '0') AS location, count(*)::BIGINT AS n, regexp_matches(c, '{SPACES_SQL}') AS exotic_space
      FROM c GROUP BY ALL""",
)
def character_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", F.explode(chars.character_counts(F.col("t"))).alias("r"))
    exotic = F.ascii("r.c").isin(list(EXOTIC_SPACES))
    return rows.select("doc_id", findings.code_point(F.col("r.c")).alias("location"), F.col("r.n").cast("long").alias("n"), exotic.alias("exotic_space"))


@register(
    "bidi_controls",
    f"SELECT doc_id, {sql_count('t', '[\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]')} AS n FROM {DOCS_SQL} WHERE regexp_matches(t, '[\\x{{202A}}-\\x{{202E}}\\x{{2066}}-\\x{{2069}}]')",
)
def bidi_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", chars.count(F.col("t"), chars.BIDI).cast("long").alias("n")).where("n > 0")


@register(
    "lookalike_words",
    f"""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{Nd}}]+')) AS ws FROM {DOCS_SQL}),
      m AS (SELECT doc_id, len(list_filter(ws, lambda x: regexp_matches(x, '\\p{{Latin}}')::INT + regexp_matches(x, '\\p{{Cyrillic}}')::INT + regexp_matches(x, '\\p{{Greek}}')::INT > 1))::BIGINT AS mixed_script,
        len(list_filter(ws, lambda x: regexp_matches(x, '[Ａ-Ｚａ-ｚ]') AND regexp_matches(x, '[A-Za-z]')))::BIGINT AS mixed_width FROM w)
      SELECT * FROM m WHERE mixed_script + mixed_width > 0""",
)
def lookalike_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", chars.lookalike_words(F.col("t")).alias("x"))
    sizes = rows.select("doc_id", F.size("x.script").cast("long").alias("mixed_script"), F.size("x.width").cast("long").alias("mixed_width"))
    return sizes.where("mixed_script + mixed_width > 0")


@register(
    "hyphen_lookalikes",
    f"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(t, '[{"".join(map(chr, HYPHENS))}]')) AS c FROM {DOCS_SQL})
      SELECT doc_id, 'U+' || lpad(upper(to_hex(unicode(c))), 4, '0') AS location, count(*)::BIGINT AS n FROM c GROUP BY ALL""",
)
def hyphen_lookalikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", F.explode(chars.hyphen_counts(F.col("t"))).alias("r"))
    return rows.select("doc_id", findings.code_point(F.col("r.c")).alias("location"), F.col("r.n").cast("long").alias("n"))


@register(
    "whitespace_channels",
    f"""SELECT doc_id, len(string_split(t, chr(10)))::BIGINT AS lines,
        len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[ \t]+\r?$')))::BIGINT AS trailing,
        {sql_count('t', f'[.!?] {{2,}}[^{JS_SPACE}]')} AS doubled, {sql_count('t', f'[.!?] [^{JS_SPACE}]')} AS single,
        {sql_count('t', '\r\n')} AS crlf, (len(string_split(t, chr(10))) - 1 - {sql_count('t', '\r\n')})::BIGINT AS lf FROM {DOCS_SQL}""",
)
def whitespace_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", chars.whitespace_counts(F.col("t")).alias("w"))
    return rows.select("doc_id", *(F.col(f"w.{c}").cast("long").alias(c) for c in ("lines", "trailing", "doubled", "single", "crlf", "lf")))


@register(
    "control_characters",
    f"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(t, '[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F]')) AS c FROM {DOCS_SQL})
      SELECT doc_id, unicode(c)::BIGINT AS code_point, count(*)::BIGINT AS n FROM c GROUP BY ALL""",
)
def control_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings.tally(chars.extract(F.col("t"), "[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F]"))
    rows = docs(spark, sf_dir).select("doc_id", F.explode(found).alias("r"))
    return rows.select("doc_id", F.ascii("r.c").cast("long").alias("code_point"), F.col("r.n").cast("long").alias("n"))


DECOMPOSED, DECOMPOSED_SQL = inserted("doc_id", 5, {}, {1: " cafe\u0301 e\u0301te\u0301", 2: " cafe\u0301 and caf\xe9", 3: " caf\xe9"})


@register(
    "normal_forms",
    f"""WITH g AS (SELECT doc_id, unnest(regexp_extract_all({DECOMPOSED_SQL}, '[^\\pM]\\pM+|\\pL')) AS g FROM documents),
      f AS (SELECT doc_id, length(nfc_normalize(g)) < length(g) AS d, regexp_matches(g, '^[À-ÖØ-öø-ÿ]$') AND NOT g IN ('Ø','ø','ß','Æ','æ','Ð','ð','Þ','þ') AS c FROM g)
      SELECT doc_id, count(*) FILTER (d)::BIGINT AS decomposed, count(*) FILTER (c AND NOT d)::BIGINT AS composed FROM f GROUP BY doc_id HAVING count(*) FILTER (d) > 0""",
)
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", chars.normal_forms(DECOMPOSED()).alias("f"))
    return rows.select("doc_id", "f.decomposed", "f.composed").where("decomposed > 0")


@register(
    "clean_text",
    f"SELECT doc_id, sha256(nfc_normalize(regexp_replace(regexp_replace(t, '{INVISIBLE_SQL}', '', 'g'), '{SPACES_SQL}', ' ', 'g'))) AS digest FROM {DOCS_SQL}",
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.sha2(chars.clean_text(F.col("t")), 256).alias("digest"))


PAYLOADS = {
    1: "".join(chr(0xE0000 + ord(c)) for c in "tag says hi"),
    2: "x" + "".join(chr(0xFE00 + b) if b < 16 else chr(0xE0100 + b - 16) for b in b"selector"),
    3: "".join("​" if b == "0" else "‌" for c in b"zero" for b in f"{c:08b}"),
}
HIDDEN, _ = inserted("doc_id", 7, {}, PAYLOADS)
PAYLOAD_SQL = "SELECT doc_id, CASE doc_id % 7 " + " ".join(
    f"WHEN {k} THEN {quoted(v)}" for k, v in {1: 'tag characters → "tag says hi"', 2: 'variation selectors → "selector"', 3: 'zero-width binary → "zero"'}.items()
)


@register("hidden_payloads", PAYLOAD_SQL + " END AS payload FROM documents WHERE doc_id % 7 IN (1, 2, 3)")
def hidden_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(chars.decoded(HIDDEN())).alias("payload"))


def content_sql() -> str:
    rows = []
    for label, kind, pattern, masked in CONTENT:
        name = ("Credential left in file: " if masked else "") + label
        rows.append(f"SELECT doc_id, {quoted(kind)} AS kind, {quoted(name)} AS label, unnest(regexp_extract_all(t, {sql_string(pattern)})) AS raw, {masked} AS masked FROM d")
    prefix = "CASE WHEN regexp_matches(raw[1:8], '[-_]') THEN regexp_extract(raw[1:8], '^(.*[-_])', 1) ELSE regexp_extract(raw, '^[A-Za-z]+')[1:4] END"
    value = f"CASE WHEN masked THEN {prefix} || {quoted('… (')} || length(raw) || {quoted(' characters) — rotate this key')} ELSE raw END"
    return f"WITH d AS MATERIALIZED {DOCS_SQL[:-1]}), r AS ({' UNION ALL '.join(rows)}) SELECT DISTINCT doc_id, kind, label, {value} AS value FROM r"


@register("content_scan", content_sql())
def content_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", F.explode(content.scan_content(F.col("t"), "file contents")).alias("f"))
    return rows.select("doc_id", "f.kind", "f.label", "f.value")


@register(
    "source_types",
    f"""WITH s AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(t, {sql_string("(?:Iptc4xmpExt:)?[Dd]igitalSourceType[\"'[:space:]:=>]+(?:[^\"'<>[:space:]]*[/#])?([A-Za-z]+)")}, 1)) AS term FROM {DOCS_SQL}),
      v AS (SELECT unnest([{", ".join(f"{{'term': '{t}', 'confidence': '{c}'}}" for t, _, _, c in SOURCE_TYPES)}], recursive := true))
      SELECT doc_id, term, confidence FROM s JOIN v USING (term)""",
)
def source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", F.explode(content.find_source_types(F.col("t"), "file contents")).alias("f"))
    return rows.select("doc_id", F.split("f.value", " — ")[0].alias("term"), "f.confidence")


@register(
    "traces",
    f"""WITH d AS MATERIALIZED {DOCS_SQL[:-1]}), r AS (
        SELECT doc_id, 'Linux account' AS label, regexp_extract(t, '/home/([^/[:space:]]+)', 1) AS value FROM d
        UNION ALL SELECT doc_id, 'Temporary directory', regexp_extract(t, '/tmp/[^[:space:]"]*') FROM d
        UNION ALL SELECT doc_id, 'Session identifier', regexp_extract(t, '(?i)\\bsession[_-]([A-Za-z0-9]{{6,}})') FROM d)
      SELECT * FROM r WHERE value <> ''""",
)
def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.array(findings.finding("provenance", "informational", "file contents", "Document body text", F.col("t"))).cast(findings.FINDING)
    rows = docs(spark, sf_dir).select("doc_id", F.explode(content.fingerprint(body)).alias("f"))
    return rows.select("doc_id", "f.label", "f.value")


MAIL_ROWS = [
    ("mail header:from", "Sender", "A <a@example.org>"),
    ("mail header:received", "Relay hop", "one"),
    ("mail header:received", "Relay hop 2", "two folded"),
    ("mail header:x-mailer", "Mail client", "Mailer 1"),
    ("mail header:message-id", "Message identifier", "<1@host>"),
    ("mail header:x-custom-run", "Non-standard header: x-custom-run", "42"),
]


@register(
    "mail_headers",
    f"""WITH r AS (SELECT unnest([{", ".join(f"{{'ord': {k}, 'location': {quoted(a)}, 'label': {quoted(b)}, 'value': {quoted(c)}}}" for k, (a, b, c) in enumerate(MAIL_ROWS))}], recursive := true))
      SELECT doc_id, ord::INT AS ord, location, label, value FROM documents, r WHERE doc_id % {EVERY} = 0""",
)
def mail_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(mail.email_headers(F.col("t"))).alias("ord", "f"))
    return rows.select("doc_id", "ord", "f.location", "f.label", "f.value")


STRIPPED = "".join(line + "\n" for line in MAIL.split("\n")[:-1] if not line.lower().startswith("x-"))
_, STRIPPED_SQL = inserted("doc_id", EVERY, {0: STRIPPED}, AFTER)


@register("strip_tool_headers", f"SELECT doc_id, sha256({STRIPPED_SQL}) AS digest, CASE WHEN doc_id % {EVERY} = 0 THEN 'X-Mailer,X-Custom-Run' ELSE '' END AS removed FROM documents")
def strip_tool_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", mail.strip_tool_headers(F.col("t")).alias("s"))
    return rows.select("doc_id", F.sha2("s.text", 256).alias("digest"), F.array_join("s.removed", ",").alias("removed"))


HEADS = {
    0: '<meta name="generator" content="Pages 1.0">', 1: "<meta content='Ann' name='author'>", 2: "<!-- Generated by Tool 2 -->",
    3: '<p data-ai-model="m1" data-ai="x">', 4: '<meta property="date" content="2020-01-02"><!-- plain -->',
}
PAGE, PAGE_SQL = inserted("page_id", 6, {}, HEADS, "html")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "pages").select("page_id", PAGE().alias("h"))


@register(
    "html_metas",
    f"""WITH m AS (SELECT page_id, unnest(regexp_extract_all({PAGE_SQL}, '(?i)<meta\\s+([^>]*)>', 1)) AS a FROM pages),
      n AS (SELECT page_id, lower(regexp_extract(a, {sql_string("(?i)\\b(?:name|property)\\s*=\\s*[\"']([^\"']+)[\"']")}, 1)) AS name, regexp_extract(a, {sql_string("(?i)\\bcontent\\s*=\\s*[\"']([^\"']*)[\"']")}, 1) AS value FROM m)
      SELECT page_id, name, value FROM n WHERE value <> '' AND name IN ({", ".join(f"'{m[0]}'" for m in METAS)})""",
)
def html_metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir).select("page_id", F.explode(markup.metas(F.col("h"))).alias("m"))
    return rows.select("page_id", "m.name", F.col("m.content").alias("value")).where((F.col("value") != "") & F.col("name").isin([m[0] for m in METAS]))


@register(
    "html_findings",
    f"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'Generator meta tag' WHEN 1 THEN 'Author meta tag' WHEN 2 THEN 'Generator comment'
        WHEN 3 THEN 'AI provenance data attributes' WHEN 4 THEN 'Date meta tag' END AS label,
        CASE page_id % 6 WHEN 0 THEN 'Pages 1.0' WHEN 1 THEN 'Ann' WHEN 2 THEN 'Generated by Tool 2'
        WHEN 3 THEN {quoted('2 attributes — data-ai-model="m1" data-ai="x"')} WHEN 4 THEN '2020-01-02' END AS value FROM pages WHERE page_id % 6 < 5""",
)
def html_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir).select("page_id", F.explode(markup.inspect_html(F.col("h"))).alias("f"))
    return rows.select("page_id", "f.label", "f.value")


@register(
    "redact_html",
    f"SELECT page_id, sha256(html || CASE page_id % 6 WHEN 3 THEN '<p>' WHEN 4 THEN '<!-- plain -->' ELSE '' END) AS digest FROM pages",
)
def redact_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.sha2(markup.redact_html(F.col("h")), 256).alias("digest"))


FRONT = {0: "---\nauthor: Ann\ntitle: T\nmodel: m-1\n---\n", 1: "---\ntool: x\n---\n"}
TAIL = {0: "\nGenerated by Some Tool\n", 2: "\n*Written by Ann*"}
NOTE, NOTE_SQL = inserted("doc_id", 4, FRONT, TAIL)


@register(
    "markdown_findings",
    """WITH r AS (SELECT unnest([{'k': 0, 'label': 'Attribution line', 'value': 'Generated by Some Tool'}, {'k': 0, 'label': 'Author', 'value': 'Ann'},
        {'k': 0, 'label': 'Model', 'value': 'm-1'}, {'k': 1, 'label': 'Tool', 'value': 'x'}, {'k': 2, 'label': 'Attribution line', 'value': '*Written by Ann*'}], recursive := true))
      SELECT doc_id, label, value FROM documents JOIN r ON doc_id % 4 = k""",
)
def markdown_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(markup.inspect_markdown(NOTE())).alias("f"))
    return rows.select("doc_id", "f.label", "f.value")


@register(
    "redact_markdown",
    f"""SELECT doc_id, sha256(CASE doc_id % 4 WHEN 0 THEN {quoted("---" + chr(10) + "title: T" + chr(10) + "---" + chr(10))} ELSE '' END || text ||
        CASE doc_id % 4 WHEN 0 THEN {quoted(TAIL[0])} WHEN 2 THEN {quoted(TAIL[2])} ELSE '' END) AS digest FROM documents""",
)
def redact_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(markup.redact_markdown(NOTE()), 256).alias("digest"))


SVG = {
    0: '<svg xmlns:inkscape="u" inkscape:version="1"><metadata> abc </metadata><title>T</title>', 1: "<svg ><!-- Generator: Tool --><desc>d</desc>", 2: "<!doctype html>",
    3: "---\na: b\n---\n",
}
DRAWING, DRAWING_SQL = inserted("doc_id", 5, SVG, {})


@register("markup_formats", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'svg' WHEN 1 THEN 'svg' WHEN 2 THEN 'html' WHEN 3 THEN 'markdown' ELSE 'text' END AS format FROM documents")
def markup_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(markup.detect_format(DRAWING()), F.lit("text")).alias("format"))


@register(
    "svg_findings",
    """WITH r AS (SELECT unnest([{'k': 0, 'label': 'SVG metadata block', 'value': 'RDF/Dublin Core block, 3 characters'}, {'k': 0, 'label': 'Editor namespace', 'value': 'inkscape'},
        {'k': 0, 'label': 'SVG title (accessibility)', 'value': 'T'}, {'k': 1, 'label': 'Generator comment', 'value': 'Generator: Tool'},
        {'k': 1, 'label': 'SVG description (accessibility)', 'value': 'd'}], recursive := true))
      SELECT doc_id, label, value FROM documents JOIN r ON doc_id % 5 = k""",
)
def svg_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(markup.inspect_svg(DRAWING())).alias("f"))
    return rows.select("doc_id", "f.label", "f.value")


#: What every text with an insertion gives away: (remainder, kind, confidence, location, label, value), in the order of a report.
HIDDEN_KIND, FILE, DERIVED = chars.KIND, "file contents", "derived from file contents"
INSPECTED = [
    *((0, kind, level, f"mail header:{place}", label, value) for kind, level, place, label, value in (
        ("identity", "confirmed", "from", "Sender", "A <a@example.org>"), ("provenance", "confirmed", "x-mailer", "Mail client", "Mailer 1"),
        ("identity", "probable", "received", "Relay hop", "one"), ("identity", "probable", "received", "Relay hop 2", "two folded"),
        ("identity", "probable", "message-id", "Message identifier", "<1@host>"),
        ("provenance", "probable", "x-custom-run", "Non-standard header: x-custom-run", "42"),
    )),
    (1, HIDDEN_KIND, "confirmed", "U+200B", "zero-width space", "2 occurrences"),
    *((2, HIDDEN_KIND, "informational", f"U+{ord(c):04X}", EXOTIC_SPACES[ord(c)], "1 occurrence") for c in AFTER[2] if ord(c) in EXOTIC_SPACES),
    (3, HIDDEN_KIND, "probable", "hyphen lookalikes", "Dashes that are not the ASCII hyphen",
        'U+2010 HYPHEN ×2, U+2212 MINUS SIGN ×1 — indistinguishable from "-" on screen'),
    (7, HIDDEN_KIND, "probable", "control characters", "Control characters in the text",
        "BEL ×2, ESC ×1 — invisible, and one bit per position. ESC is also how a coloured terminal log is written"),
    (8, HIDDEN_KIND, "probable", "mixed-script words", "Letters that look alike but are not", "раyраl, аpple — one word mixing Latin and Cyrillic"),
    (9, HIDDEN_KIND, "probable", "mixed-width words", "Fullwidth letters among ASCII ones", "ＡBC"),
    (10, "identity", "confirmed", FILE, "Credential left in file: OpenAI-style API key", "sk-… (35 characters) — rotate this key"),
    (10, "identity", "confirmed", FILE, "Credential left in file: GitHub token", "ghp_… (40 characters) — rotate this key"),
    *((11, "provenance", level, FILE, "How the file says it was made", f"{term} — {told}") for term in ("trainedAlgorithmicMedia", "digitalArt")
        for t, told, _, level in SOURCE_TYPES if t == term),
    (12, "environment", "confirmed", DERIVED, "Linux account", "ann"),
    (12, "environment", "confirmed", DERIVED, "Temporary directory", "/tmp/run1"),
    (12, "environment", "confirmed", DERIVED, "Session identifier", "session_abcdef9"),
    (13, HIDDEN_KIND, "confirmed", "bidirectional controls", "Text reordering controls",
        "2 controls that can make text display differently from how it is stored (CVE-2021-42574)"),
    (13, HIDDEN_KIND, "confirmed", "U+202E", "bidirectional override", "1 occurrence"),
    (13, HIDDEN_KIND, "confirmed", "U+2066", "bidirectional isolate", "1 occurrence"),
    (15, "identity", "confirmed", FILE, "Credential left in file: AWS access key id", "AKIA… (20 characters) — rotate this key"),
    (15, "provenance", "confirmed", FILE, "Anthropic message id", "msg_" + "z" * 24),
    (15, "provenance", "confirmed", FILE, "LLM provider endpoint", "api.openai.com/v1"),
    (15, "environment", "confirmed", DERIVED, "Anthropic message id", "msg_" + "z" * 24),
    (15, "provenance", "confirmed", DERIVED, "Assistant or agent named in metadata", "ChatGPT / OpenAI"),
]
FIELDS = ("kind", "confidence", "location", "label", "value")


def rows_sql(rows: list[tuple], key: str = "k") -> str:
    """A table of (key, ord, conf_rank, structural and FIELDS) of constant findings, numbered by key."""
    out = []
    for at, (k, *row) in enumerate(rows):
        nth = sum(r[0] == k for r in rows[:at])
        cells = [f"'{key}': {k}", f"'ord': {nth}::INT", f"'conf_rank': {findings.RANKS[row[1]]}::INT", "'structural': false"]
        out.append("{" + ", ".join([*cells, *(f"'{f}': {quoted(v)}" for f, v in zip(FIELDS, row, strict=True))]) + "}")
    return f"(SELECT unnest([{', '.join(out)}], recursive := true))"


WHITE_SQL = f"""SELECT doc_id, len(string_split(t, chr(10))) AS lines, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[ \t]+\r?$'))) AS blanks,
    {sql_count('t', f'[.!?] {{2,}}[^{JS_SPACE}]')} AS doubled, {sql_count('t', f'[.!?] [^{JS_SPACE}]')} AS single, {sql_count('t', '\r\n')} AS crlf FROM {DOCS_SQL}"""
WHITE_ROWS = [
    ("blanks >= 3", "CASE WHEN blanks >= lines / 4 THEN 'probable' ELSE 'informational' END", "line endings", "Trailing whitespace",
        f"blanks || ' of ' || lines || {quoted(' lines end in spaces or tabs — invisible in an editor, and one bit per line')}"),
    ("doubled > 0 AND single > 0", "'probable'", "sentence spacing", "Spacing after full stops is inconsistent",
        f"doubled || ' sentences followed by two or more spaces, ' || single || {quoted(' by one — one bit per sentence')}"),
    ("crlf > 0 AND lines - 1 > crlf", "'probable'", "line endings", "Line endings are mixed",
        f"crlf || ' CRLF and ' || (lines - 1 - crlf) || "
        f"{quoted(' LF in one file — one bit per line. Note that pasting into a browser normalises these away, so this only shows on a file')}"),
]


@register(
    "inspect_documents",
    f"""WITH r AS {rows_sql(INSPECTED)}, w AS ({WHITE_SQL}), f AS (
        {" UNION ALL ".join(f"SELECT doc_id, {level} AS confidence, '{place}' AS location, {quoted(label)} AS label, {value} AS value FROM w WHERE {when}" for when, level, place, label, value in WHITE_ROWS)})
      SELECT doc_id, ord, kind, confidence, location, label, value, conf_rank, structural FROM documents JOIN r ON doc_id % {EVERY} = k
      UNION ALL SELECT doc_id, 0::INT, {quoted(HIDDEN_KIND)}, confidence, location, label, value, CASE confidence WHEN 'probable' THEN 1 ELSE 2 END::INT, false FROM f""",
)
def inspect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of every document, conversation-style texts and markup alike."""
    return textpipe.findings(docs(spark, sf_dir), "doc_id", text_col="t")


PAGE_ROWS = [
    (0, "provenance", "confirmed", '<meta name="generator">', "Generator meta tag", "Pages 1.0"),
    (1, "identity", "confirmed", '<meta name="author">', "Author meta tag", "Ann"),
    (2, "provenance", "confirmed", "comment", "Generator comment", "Generated by Tool 2"),
    (3, "provenance", "confirmed", "data-ai* attributes", "AI provenance data attributes", '2 attributes — data-ai-model="m1" data-ai="x"'),
    (4, "timestamp", "probable", '<meta name="date">', "Date meta tag", "2020-01-02"),
]


@register(
    "inspect_pages",
    f"SELECT page_id, ord, kind, confidence, location, label, value, conf_rank, structural FROM pages JOIN {rows_sql(PAGE_ROWS)} r ON page_id % 6 = k",
)
def inspect_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textpipe.findings(pages(spark, sf_dir), "page_id", text_col="h")


@register(
    "inspect_conversations",
    f"""WITH r AS {rows_sql([(k, *row) for k, of in ((1, 1), (2, 10), (3, 12)) for n, *row in INSPECTED if n == of])}
      SELECT role, kind, label, count(*)::BIGINT AS findings FROM conversations JOIN r ON conv_id % 5 = k GROUP BY ALL""",
)
def inspect_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, _ = inserted("conv_id", 5, {}, {1: AFTER[1], 2: AFTER[10], 3: AFTER[12]})
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text().alias("t"))
    found = textpipe.findings(rows, "conv_id", "turn", "role", text_col="t")
    return found.groupBy("role", "kind", "label").agg(F.count("*").alias("findings"))


@register(
    "document_tally",
    f"SELECT count(*)::BIGINT AS files, count(*) FILTER (doc_id % {EVERY} IN (0, 1, 10, 11, 12, 13, 15))::BIGINT AS with_confirmed, 0::BIGINT AS unreadable FROM documents",
)
def document_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textpipe.tally(textpipe.inspect_text(docs(spark, sf_dir), "t"))


@register(
    "provenance",
    """SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 'markdown' ELSE 'text' END AS format, CASE WHEN doc_id % 4 = 1 THEN 'gpt-4o (OpenAI); LangChain' ELSE '' END AS tools,
        doc_id % 4 IN (1, 2) AS attributed, doc_id % 4 = 2 AS declared, false AS machine_assembled,
        CASE doc_id % 4 WHEN 1 THEN 'attributed' WHEN 2 THEN 'declared' ELSE 'none' END AS verdict FROM documents""",
)
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    note, _ = inserted("doc_id", 4, {0: FRONT[0], 1: "---\ngenerator: gpt-4o via LangChain\n---\n"}, {2: AFTER[11]})
    rows = table(spark, sf_dir, "documents").select("doc_id", note().alias("t"))
    return textpipe.summarize(rows, "doc_id", text_col="t").withColumn("tools", F.array_join("tools", "; "))


#: What a cleaning takes out: remainders whose findings go, and labels of the header lines that go.
CLEANED, DROPPED = (1, 2, 13), ("Mail client", "Non-standard header: x-custom-run")


@register(
    "redaction_survivors",
    f"""WITH r AS {rows_sql([x for x in INSPECTED if x[0] not in CLEANED and x[4] not in DROPPED])}, w AS ({WHITE_SQL}), f AS (
        {" UNION ALL ".join(f"SELECT doc_id, {level} AS confidence, {quoted(label)} AS label FROM w WHERE {when}" for when, level, _, label, _ in WHITE_ROWS)}
        UNION ALL SELECT doc_id, confidence, label FROM documents JOIN r ON doc_id % {EVERY} = k)
      SELECT doc_id, string_agg(DISTINCT label, '; ' ORDER BY label) AS labels FROM f WHERE confidence <> 'informational' GROUP BY doc_id""",
)
def redaction_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = textpipe.redact_text(docs(spark, sf_dir), "t").select("doc_id", "cleaned")
    return textpipe.survivors(cleaned, "doc_id").withColumn("labels", F.array_join("labels", "; "))


@register(
    "redaction_notes",
    f"""WITH r AS {rows_sql(INSPECTED)}, w AS ({WHITE_SQL}), f AS (
        {" UNION ALL ".join(f"SELECT doc_id, true AS stays, {quoted(label)} AS label, {n} + 2 AS ord FROM w WHERE {when}" for n, (when, _, _, label, _) in enumerate(WHITE_ROWS))}
        UNION ALL SELECT doc_id, location IN ({", ".join(quoted(p) for p in chars.KEPT_PLACES)}), label, ord FROM documents JOIN r ON doc_id % {EVERY} = k
          WHERE kind = {quoted(HIDDEN_KIND)} AND confidence <> 'informational'),
      g AS (SELECT doc_id, coalesce(string_agg(label, '; ' ORDER BY ord) FILTER (NOT stays), '') AS removed, coalesce(string_agg(label, '; ' ORDER BY ord) FILTER (stays), '') AS kept FROM f GROUP BY doc_id)
      SELECT doc_id, CASE WHEN doc_id % {EVERY} = 0 THEN 'X-Mailer; X-Custom-Run' ELSE coalesce(removed, '') END AS removed, coalesce(kept, '') AS kept FROM documents LEFT JOIN g USING (doc_id)""",
)
def redaction_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of what a cleaning took out of each text, and of what it left as the text's own."""
    redacted = textpipe.redact_text(docs(spark, sf_dir), "t")
    return redacted.select("doc_id", F.array_join("removed", "; ").alias("removed"), F.array_join("kept", "; ").alias("kept"))
