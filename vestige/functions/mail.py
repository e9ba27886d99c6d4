"""Mail: header blocks, what they tell, and what a tool stamped on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .findings import FINDING, finding, let, trim
from .patterns import ANCHORS, HEADERS, SPACE, TOOL_HEADERS

FIELD = r"^([!-9;-~]+):[ \t]*(.*)$"
BLANK = f"^[{SPACE}]*\\z"


def lines(text: Column) -> Column:
    return F.split(text, "\r?\n")


def block_lines(text: Column) -> Column:
    """Lines of the header block: fields and their continuations, up to a blank or any other line."""

    def block(all_: Column) -> Column:
        ends = F.transform(
            all_,
            lambda x, i: F.when(x.rlike(BLANK) | ~(x.rlike(FIELD) | ((i > 0) & x.rlike(r"^[ \t]"))), i).otherwise(F.lit(None).cast("int")),
        )
        return F.slice(all_, 1, F.coalesce(F.array_min(ends), F.size(all_)))

    return let(lines(text), block)


def headers(text: Column) -> Column:
    """array of struct(name, value): names in lower case, continuations joined by a space."""
    start = F.array().cast("array<struct<name: string, value: string>>")

    def add(done: Column, line: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["name"].alias("name"), F.concat(last["value"], F.lit(" "), trim(line)).alias("value"))
        new = F.struct(F.lower(F.regexp_extract(line, FIELD, 1)).alias("name"), trim(F.regexp_extract(line, FIELD, 2)).alias("value"))
        return F.when(line.rlike(r"^[ \t]") & (F.size(done) > 0), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(
            F.array_append(done, new)
        )

    return F.aggregate(block_lines(text), start, add)


def is_mail(found: Column) -> Column:
    """Whether three known names are there, one of them one that every message has."""
    names = F.array_distinct(F.transform(found, lambda h: h["name"]))
    known = F.array(*(F.lit(n) for n in sorted({h[0] for h in HEADERS} | set(ANCHORS))))
    anchors = F.array(*(F.lit(n) for n in ANCHORS))
    return (F.size(F.array_intersect(names, known)) >= 3) & F.arrays_overlap(names, anchors)


def email_headers(text: Column) -> Column:
    """Findings of a message's headers; none where the text is no message."""
    rules = {field: F.create_map(*(F.lit(x) for h in HEADERS for x in (h[0], h[k]))) for k, field in ((1, "label"), (2, "kind"), (3, "confidence"))}

    def rows(found: Column) -> Column:
        ruled = F.filter(found, lambda h: rules["label"][h["name"]].isNotNull() & (h["value"] != ""))

        def numbered(all_: Column) -> Column:
            def row(h: Column, i: Column) -> Column:
                nth = F.size(F.filter(F.slice(all_, 1, i + 1), lambda o: o["name"] == h["name"]))
                label = rules["label"][h["name"]]
                label = F.when(nth > 1, F.concat(label, F.lit(" "), nth.cast("string"))).otherwise(label)
                return finding(rules["kind"][h["name"]], rules["confidence"][h["name"]], F.concat(F.lit("mail header:"), h["name"]), label, h["value"])

            return F.transform(all_, row).cast(FINDING)

        others = F.filter(found, lambda h: h["name"].startswith("x-") & (h["value"] != "") & rules["label"][h["name"]].isNull())

        def once(all_: Column) -> Column:
            first = F.filter(all_, lambda h, i: F.size(F.filter(F.slice(all_, 1, i), lambda o: o["name"] == h["name"])) == 0)
            return F.transform(
                first,
                lambda h: finding(
                    "provenance", "probable", F.concat(F.lit("mail header:"), h["name"]), F.concat(F.lit("Non-standard header: "), h["name"]), h["value"]
                ),
            ).cast(FINDING)

        return F.when(is_mail(found), F.concat(let(ruled, numbered), let(others, once))).otherwise(F.array().cast(FINDING))

    # a text whose first line is no field is no message, and needs no parsing
    return F.when(text.rlike(r"\A[!-9;-~]+:"), let(headers(text), rows)).otherwise(F.array().cast(FINDING))


def strip_tool_headers(text: Column) -> Column:
    """struct(text, removed): without the headers that tools stamp, the body as it was."""
    kind = "struct<text: string, removed: array<string>>"
    state = "struct<kept: array<string>, removed: array<string>, dropping: boolean, inside: boolean>"
    start = F.struct(
        F.array().cast("array<string>").alias("kept"),
        F.array().cast("array<string>").alias("removed"),
        F.lit(False).alias("dropping"),
        F.lit(True).alias("inside"),
    ).cast(state)

    def step(s: Column, line: Column) -> Column:
        body = F.regexp_replace(line, r"\r?\n\z", "")
        name = F.regexp_extract(body, FIELD, 1)
        low = F.lower(name)
        tool = (name != "") & (low.isin(TOOL_HEADERS) | low.startswith("x-"))
        continued = body.rlike(r"^[ \t]") & ~body.rlike(BLANK)
        ends = body.rlike(BLANK)
        dropping = F.when(continued, s["dropping"]).otherwise(tool)

        def made(kept: Column, removed: Column, drop: Column, inside: Column) -> Column:
            return F.struct(kept.alias("kept"), removed.alias("removed"), drop.alias("dropping"), inside.alias("inside"))

        plain = F.array_append(s["kept"], line)
        return (
            F.when(~s["inside"], made(plain, s["removed"], F.lit(False), F.lit(False)))
            .when(ends, made(plain, s["removed"], F.lit(False), F.lit(False)))
            .when(dropping, made(s["kept"], F.when(tool & ~continued, F.array_append(s["removed"], name)).otherwise(s["removed"]), F.lit(True), F.lit(True)))
            .otherwise(made(plain, s["removed"], F.lit(False), F.lit(True)))
        )

    # lines keep their own endings, so those of the body stay as they were
    whole = F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+\z"), F.lit(0))
    stripped = let(F.aggregate(whole, start, step), lambda s: F.struct(F.array_join(s["kept"], "").alias("text"), s["removed"].alias("removed")))
    plain = F.struct(text.alias("text"), F.array().cast("array<string>").alias("removed"))
    return F.when(text.rlike(r"\A[!-9;-~]+:") & let(headers(text), is_mail), stripped).otherwise(plain).cast(kind)
