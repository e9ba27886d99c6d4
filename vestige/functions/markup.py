"""Markup: what SVG, HTML and Markdown say about who made them, and the same without."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import clean_text
from .findings import FINDING, finding, let, none, preview, trim, utf16_length, when
from .patterns import ATTRIBUTION, EDITORS, FRONT_MATTER, GENERATOR_HINT, METAS, SPACE, java

COMMENT = "(?s)<!--(.*?)-->"
HINT = java(GENERATOR_HINT)
BLOCK = r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)"
KEY = f"^([A-Za-z_][\\w-]*)[{SPACE}]*:[{SPACE}]*(.*)$"
DATA_AI = f"(?i)[{SPACE}]data-ai[\\w-]*[{SPACE}]*=[{SPACE}]*[\"'][^\"']*[\"']"
JSON_LD = f"(?is)<script[^>]*type[{SPACE}]*=[{SPACE}]*[\"']application/ld\\+json[\"'][^>]*>(.*?)</script>"
META = f"(?i)<meta[{SPACE}]+([^>]*)>"
NAME = f"(?i)(?<![A-Za-z0-9_])(?:name|property)[{SPACE}]*=[{SPACE}]*[\"']([^\"']+)[\"']"
CONTENT = f"(?i)(?<![A-Za-z0-9_])content[{SPACE}]*=[{SPACE}]*[\"']([^\"']*)[\"']"


def detect_format(text: Column, hint: Column | str | None = None) -> Column:
    """svg, html, markdown, or null where neither content nor hint says so."""
    head = F.substring(text, 1, 4096)
    hinted = F.lit(None).cast("string") if hint is None else F.lit(hint) if isinstance(hint, str) else hint
    return (
        F.when(head.rlike(f"(?i)<svg[{SPACE}>]"), "svg")
        .when(head.rlike(f"(?i)<!doctype[{SPACE}]+html|<html[{SPACE}>]|<head[{SPACE}>]"), "html")
        .when(text.rlike(BLOCK), "markdown")
        .when(hinted.isin("markdown", "svg", "html"), hinted)
    )


def generator_comments(text: Column, location: str) -> Column:
    bodies = F.transform(F.regexp_extract_all(text, F.lit(COMMENT), F.lit(1)), trim)
    told = F.filter(bodies, lambda b: (b != "") & b.rlike(HINT))
    return F.transform(told, lambda b: finding("provenance", "confirmed", location, "Generator comment", b)).cast(FINDING)


def without_generator_comments(text: Column) -> Column:
    """Comments whose inside hints at a generator go; others stay."""
    inside = r"(?s)<!--(?:(?!-->).)*?(?i:" + HINT.removeprefix("(?i)") + r")(?:(?!-->).)*-->"
    return F.when(text.rlike(HINT), F.regexp_replace(text, inside, "")).otherwise(text)


def inspect_svg(text: Column) -> Column:
    inner = F.regexp_extract(text, "(?is)<metadata[^>]*>(.*?)</metadata>", 1)
    has = text.rlike("(?is)<metadata[^>]*>.*?</metadata>")
    signed = inner.rlike("(?i)c2pa|contentcredentials")
    size = F.concat(F.lit("RDF/Dublin Core block, "), utf16_length(trim(inner)).cast("string"), F.lit(" characters"))
    parts = [
        when(has & signed, finding("provenance", "confirmed", "<metadata>", "C2PA content credentials", "manifest present, signature not verified")),
        when(has & ~signed, finding("provenance", "confirmed", "<metadata>", "SVG metadata block", size)),
    ]
    for editor in EDITORS:
        parts.append(
            when(
                text.rlike(f"(?i)xmlns:{editor}=|[{SPACE}]{editor}:[a-z-]+="),
                finding("provenance", "confirmed", f"{editor}: attributes", "Editor namespace", editor),
            )
        )
    parts.append(generator_comments(text, "comment"))
    for tag, label in (("title", "SVG title (accessibility)"), ("desc", "SVG description (accessibility)")):
        value = trim(F.regexp_extract(text, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))
        parts.append(when(value != "", finding("identity", "probable", f"<{tag}>", label, value)))
    return F.concat(*parts)


def redact_svg(text: Column) -> Column:
    out = without_generator_comments(F.regexp_replace(text, "(?is)<metadata[^>]*>.*?</metadata>", ""))
    for editor in EDITORS:
        for pattern in (
            f"[{SPACE}]xmlns:{editor}=\"[^\"]*\"",
            f"[{SPACE}]{editor}:[a-z-]+=\"[^\"]*\"",
            f"<{editor}:[^>]*/>",
            f"(?s)<{editor}:([a-z-]+)[^>]*>.*?</{editor}:\\1>",
        ):
            out = F.regexp_replace(out, "(?i)" + pattern, "")
    return out


def metas(text: Column) -> Column:
    """array of struct(name, content) of the meta elements, names in lower case."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(META), F.lit(1)),
        lambda a: F.struct(F.lower(F.regexp_extract(a, NAME, 1)).alias("name"), F.regexp_extract(a, CONTENT, 1).alias("content")),
    )


def named(found: Column, name: str) -> Column:
    return F.filter(found, lambda m: (m["name"] == name) & (m["content"] != ""))


def inspect_html(text: Column) -> Column:
    def of_metas(all_: Column) -> Column:
        parts = []
        for name, label, kind, level in METAS:
            values = named(all_, name)
            location = f'<meta name="{name}">'
            parts.append(when(F.size(values) > 0, finding(kind, level, location, label, F.get(values, F.lit(0))["content"])))
        return F.concat(*parts)

    attributes = F.transform(F.regexp_extract_all(text, F.lit(DATA_AI), F.lit(0)), trim)

    def of_attributes(all_: Column) -> Column:
        n = F.size(all_)
        value = F.concat(n.cast("string"), F.when(n > 1, " attributes").otherwise(" attribute"), F.lit(" — "), preview(F.array_join(all_, " "), 80))
        return when(n > 0, finding("provenance", "confirmed", "data-ai* attributes", "AI provenance data attributes", value))

    linked = trim(F.regexp_extract(text, JSON_LD, 1))
    size = F.concat(utf16_length(linked).cast("string"), F.lit(" characters, may name an author or publisher"))
    return F.concat(
        let(metas(text), of_metas),
        generator_comments(text, "comment"),
        let(attributes, of_attributes),
        when(linked != "", finding("identity", "probable", '<script type="application/ld+json">', "JSON-LD structured data", size)),
    )


def redact_html(text: Column) -> Column:
    names = "|".join(m[0] for m in METAS)
    # the first name or property of an element counts, so none may come before it
    named = f"(?<![A-Za-z0-9_])(?:name|property)[{SPACE}]*=[{SPACE}]*[\"']"
    meta = f"(?i)<meta[{SPACE}]+(?:(?!{named})[^>])*{named}(?:{names})[\"'][^>]*>[{SPACE}]*"
    out = without_generator_comments(F.regexp_replace(text, meta, ""))
    return F.regexp_replace(out, DATA_AI, "")


def front_matter(text: Column) -> Column:
    """array of struct(key, value) of the scalar entries of a leading block."""
    body = F.regexp_extract(text, BLOCK, 1)
    entries = F.filter(F.split(body, "\r?\n"), lambda x: x.rlike(KEY))
    found = F.transform(entries, lambda x: F.struct(F.regexp_extract(x, KEY, 1).alias("key"), trim(F.regexp_extract(x, KEY, 2)).alias("value")))
    return F.when(text.rlike(BLOCK), found).otherwise(F.array().cast("array<struct<key: string, value: string>>"))


def inspect_markdown(text: Column) -> Column:
    rules = {f: F.create_map(*(F.lit(x) for r in FRONT_MATTER for x in (r[0], r[k]))) for k, f in ((1, "label"), (2, "kind"), (3, "confidence"))}

    def signed(all_: Column) -> Column:
        n = F.size(all_)
        tail = F.slice(all_, F.greatest(n - 7, F.lit(1)), F.lit(8))
        first = F.greatest(n - 7, F.lit(1))
        rows = F.transform(
            tail,
            lambda x, i: F.when(
                x.rlike(java(ATTRIBUTION).removesuffix("$") + r"\z"),
                finding("provenance", "confirmed", F.concat(F.lit("line "), (first + i).cast("string")), "Attribution line", trim(x)),
            ),
        )
        return F.filter(rows, lambda r: r.isNotNull()).cast(FINDING)

    known = F.filter(front_matter(text), lambda e: rules["label"][F.lower(e["key"])].isNotNull() & (e["value"] != ""))
    return F.concat(
        generator_comments(text, "HTML comment"),
        let(F.split(text, "\r?\n"), signed),
        F.transform(
            known,
            lambda e: finding(
                rules["kind"][F.lower(e["key"])],
                rules["confidence"][F.lower(e["key"])],
                F.concat(F.lit("front matter: "), e["key"]),
                rules["label"][F.lower(e["key"])],
                e["value"],
            ),
        ).cast(FINDING),
    )


def redact_markdown(text: Column) -> Column:
    keys = [r[0] for r in FRONT_MATTER]
    kept = F.filter(F.split(F.regexp_extract(text, BLOCK, 1), "\r?\n"), lambda x: ~F.lower(F.regexp_extract(x, KEY, 1)).isin(keys))
    body = F.regexp_replace(text, BLOCK, "")
    whole = let(
        kept,
        lambda k: F.when(F.forall(k, lambda x: trim(x) == ""), body).otherwise(F.concat(F.lit("---\n"), F.array_join(k, "\n"), F.lit("\n---\n"), body)),
    )
    return F.when(text.rlike(BLOCK), whole).otherwise(text)


def visible_text(text: Column) -> Column:
    """Text between tags, with breaks at block ends and the five named references decoded."""
    broken = F.regexp_replace(text, "</w:p>|</a:p>|</text:p>|</text:h>|<w:br[^>]*>|<a:br[^>]*>|<text:line-break[^>]*>", "\n")
    out = F.regexp_replace(broken, "<[^>]*>", "")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def own_findings(text: Column, format_: Column) -> Column:
    """What a format's own places say."""
    return F.when(format_ == "svg", inspect_svg(text)).when(format_ == "html", inspect_html(text)).when(format_ == "markdown", inspect_markdown(text)).otherwise(none())


def redact_markup(text: Column, format_: Column) -> Column:
    """Without what names makers, and without carriers in the text between tags."""
    out = F.when(format_ == "svg", redact_svg(text)).when(format_ == "html", redact_html(text)).when(format_ == "markdown", redact_markdown(text)).otherwise(text)
    # carriers mean nothing in tags either, so cleaning the whole leaves references and scripts as they are
    return clean_text(out, normalize_spaces=False)
