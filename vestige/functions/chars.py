"""Characters: what shows nothing, looks alike or is arranged to carry bits; and cleaning."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .findings import FINDING, code_point, finding, let, none, preview, tally, when
from .patterns import COMMON, COMPOSED, CONTROLS, EXOTIC, EXOTIC_SPACES, HYPHENS, INVISIBLE_NAMES, LATIN, OTHER_INVISIBLE, SPACE, beyond, carrier

KIND = "invisible-character"
BIDI = "[‪-‮⁦-⁩]"
KEPT_PLACES = ["mixed-script words", "mixed-width words", "hyphen lookalikes", "line endings", "sentence spacing", "control characters"]
ARRANGEMENT = ["line endings", "sentence spacing"]


def extract(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def number(n: Column) -> Column:
    return n.cast("string")


def carriers(text: Column) -> Column:
    """Invisible characters that do nothing for their neighbours, in order; the exact pattern runs on uncommon texts only."""
    return F.when(text.rlike(beyond(COMMON)), extract(text, carrier())).otherwise(F.array().cast("array<string>"))


def name(char: Column) -> Column:
    """Name of an invisible character or an exotic space."""
    cp = F.ascii(char)
    out = F.when(cp.between(0xFE00, 0xFE0F), F.concat(F.lit("variation selector "), number(cp - 0xFE00 + 1)))
    out = out.when(cp.between(0xE0100, 0xE01EF), F.concat(F.lit("variation selector "), number(cp - 0xE0100 + 17)))
    for low, high, label in INVISIBLE_NAMES:
        out = out.when(cp.between(low, high), label)
    for point, label in EXOTIC_SPACES.items():
        out = out.when(cp == point, label)
    return out.otherwise(OTHER_INVISIBLE)


def character_counts(text: Column) -> Column:
    """array of struct(c, n, at) over carriers and exotic spaces."""
    none = F.array().cast("array<struct<c: string, n: int, at: int>>")
    return F.when(text.rlike(beyond(COMMON)), tally(extract(text, f"{carrier()}|{EXOTIC}"))).otherwise(none)


def character_findings(text: Column) -> Column:
    def row(r: Column) -> Column:
        exotic = r["c"].rlike(f"^{EXOTIC}$")
        many = F.concat(number(r["n"]), F.when(r["n"] > 1, " occurrences").otherwise(" occurrence"))
        return finding(KIND, F.when(exotic, "informational").otherwise("confirmed"), code_point(r["c"]), name(r["c"]), many)

    return F.transform(character_counts(text), row).cast(FINDING)


def bidi_findings(text: Column) -> Column:
    def rows(n: Column) -> Column:
        value = F.concat(
            number(n), F.when(n > 1, " controls").otherwise(" control"), F.lit(" that can make text display differently from how it is stored (CVE-2021-42574)")
        )
        return when(n > 0, finding(KIND, "confirmed", "bidirectional controls", "Text reordering controls", value))

    return let(count(text, BIDI), rows)


def lookalike_words(text: Column) -> Column:
    """struct(script array<string>, width array<string>, scripts array<string>)."""
    scripts = {"Latin": r"\p{IsLatin}", "Cyrillic": r"\p{IsCyrillic}", "Greek": r"\p{IsGreek}"}
    words = F.array_distinct(extract(text, r"[\p{L}\p{M}\p{Nd}]+"))

    def names(word: Column) -> Column:
        return F.array_compact(F.array(*(F.when(word.rlike(p), F.lit(n)) for n, p in scripts.items())))

    def of(all_: Column) -> Column:
        mixed = F.filter(all_, lambda w: F.size(names(w)) > 1)
        width = F.filter(all_, lambda w: w.rlike("[Ａ-Ｚａ-ｚ]") & w.rlike("[A-Za-z]"))
        return F.struct(mixed.alias("script"), width.alias("width"), F.array_distinct(F.flatten(F.transform(mixed, names))).alias("scripts"))

    empty = F.array().cast("array<string>")
    nothing = F.struct(empty.alias("script"), empty.alias("width"), empty.alias("scripts"))
    suspect = text.rlike(beyond(LATIN)) & text.rlike(r"[\p{IsCyrillic}\p{IsGreek}Ａ-Ｚａ-ｚ]")
    return F.when(suspect, let(words, of)).otherwise(nothing)


def lookalike_findings(text: Column) -> Column:
    def rows(x: Column) -> Column:
        script = F.concat(preview(F.array_join(x["script"], ", "), 80), F.lit(" — one word mixing "), F.array_join(x["scripts"], " and "))
        return F.concat(
            when(F.size(x["script"]) > 0, finding(KIND, "probable", "mixed-script words", "Letters that look alike but are not", script)),
            when(
                F.size(x["width"]) > 0,
                finding(KIND, "probable", "mixed-width words", "Fullwidth letters among ASCII ones", preview(F.array_join(x["width"], ", "), 80)),
            ),
        )

    return let(lookalike_words(text), rows)


@F.pandas_udf(T.StructType([T.StructField("decomposed", T.LongType()), T.StructField("composed", T.LongType())]))
def _forms(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    import regex

    unit = regex.compile(r"\P{M}\p{M}+|\p{L}")
    wide = lambda s: len(s.encode("utf-16-le"))
    for series in texts:
        rows = []
        for text in series:
            decomposed = composed = 0
            for g in unit.findall(text or ""):
                if wide(unicodedata.normalize("NFC", g)) < wide(g):
                    decomposed += 1
                elif wide(unicodedata.normalize("NFD", g)) > wide(g):
                    composed += 1
            rows.append((decomposed, composed))
        yield pd.DataFrame(rows, columns=["decomposed", "composed"])


def normal_forms(text: Column) -> Column:
    """struct(decomposed, composed): letters in either form; zeros unless a letter is decomposed."""
    # only a text with a mark, or a compatibility ideograph, can hold a decomposed letter
    suspect = F.when(text.rlike(beyond(COMPOSED)) & text.rlike("[\\p{M}\U0002f800-\U0002fa1d]"), text)
    zero = F.lit(0).cast("long")
    return let(
        _forms(suspect),
        lambda f: F.struct(f["decomposed"].alias("decomposed"), F.when(f["decomposed"] > 0, f["composed"]).otherwise(zero).alias("composed")),
    )


def form_findings(forms: Column) -> Column:
    d, c = forms["decomposed"], forms["composed"]
    mixed = F.concat(
        number(d), F.lit(" decomposed and "), number(c), F.lit(" composed accented letters in one document — the choice between them carries about "),
        number(d), F.lit(" bits"),
    )
    alone = F.concat(number(d), F.lit(" decomposed accented letters, none composed — usual for text that passed through macOS"))
    place = "Unicode normalisation"
    return F.when(d == 0, none()).otherwise(
        F.array(
            finding(
                KIND,
                F.when(c > 0, "confirmed").otherwise("informational"),
                place,
                F.when(c > 0, "Same letters written two different ways").otherwise("Text is in decomposed form (NFD)"),
                F.when(c > 0, mixed).otherwise(alone),
            )
        ).cast(FINDING)
    )


def hyphen_counts(text: Column) -> Column:
    """array of struct(c, n), in the order met."""
    return F.array_sort(
        F.transform(tally(extract(text, "[" + "".join(map(chr, HYPHENS)) + "]")), lambda r: F.struct(r["at"].alias("at"), r["c"].alias("c"), r["n"].alias("n")))
    )


def hyphen_findings(text: Column) -> Column:
    def part(r: Column) -> Column:
        label = F.lit("")
        for point, known in HYPHENS.items():
            label = F.when(F.ascii(r["c"]) == point, known).otherwise(label)
        return F.concat(code_point(r["c"]), F.lit(" "), label, F.lit(" ×"), number(r["n"]))

    def rows(all_: Column) -> Column:
        value = F.concat(F.array_join(F.transform(all_, part), ", "), F.lit(' — indistinguishable from "-" on screen'))
        return when(F.size(all_) > 0, finding(KIND, "probable", "hyphen lookalikes", "Dashes that are not the ASCII hyphen", value))

    return let(hyphen_counts(text), rows)


def whitespace_counts(text: Column) -> Column:
    """struct(lines, trailing, doubled, single, crlf, lf)."""
    lines = F.split(text, "\n")
    crlf = count(text, "\r\n")
    after = f"(?=[^{SPACE}])"
    return F.struct(
        F.size(lines).alias("lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"[ \t]+\r?\z"))).alias("trailing"),
        count(text, "[.!?] {2,}" + after).alias("doubled"),
        count(text, "[.!?] " + after).alias("single"),
        crlf.alias("crlf"),
        (F.size(lines) - 1 - crlf).alias("lf"),
    )


def whitespace_findings(text: Column) -> Column:
    def rows(w: Column) -> Column:
        trailing = F.concat(
            number(w["trailing"]), F.lit(" of "), number(w["lines"]), F.lit(" lines end in spaces or tabs — invisible in an editor, and one bit per line")
        )
        spacing = F.concat(
            number(w["doubled"]), F.lit(" sentences followed by two or more spaces, "), number(w["single"]), F.lit(" by one — one bit per sentence")
        )
        endings = F.concat(
            number(w["crlf"]), F.lit(" CRLF and "), number(w["lf"]),
            F.lit(" LF in one file — one bit per line. Note that pasting into a browser normalises these away, so this only shows on a file"),
        )
        level = F.when(w["trailing"] >= w["lines"] / 4, "probable").otherwise("informational")
        return F.concat(
            when(w["trailing"] >= 3, finding(KIND, level, "line endings", "Trailing whitespace", trailing)),
            when(
                (w["doubled"] > 0) & (w["single"] > 0),
                finding(KIND, "probable", "sentence spacing", "Spacing after full stops is inconsistent", spacing),
            ),
            when((w["crlf"] > 0) & (w["lf"] > 0), finding(KIND, "probable", "line endings", "Line endings are mixed", endings)),
        )

    return let(whitespace_counts(text), rows)


def control_findings(text: Column) -> Column:
    def part(r: Column) -> Column:
        label = code_point(r["c"])
        for point, known in CONTROLS.items():
            label = F.when(F.ascii(r["c"]) == point, known).otherwise(label)
        return F.concat(label, F.lit(" ×"), number(r["n"]))

    def rows(all_: Column) -> Column:
        escape = F.when(F.exists(all_, lambda r: r["c"] == "\x1b"), ". ESC is also how a coloured terminal log is written").otherwise("")
        value = F.concat(F.array_join(F.transform(all_, part), ", "), F.lit(" — invisible, and one bit per position"), escape)
        return when(F.size(all_) > 0, finding(KIND, "probable", "control characters", "Control characters in the text", value))

    return let(tally(extract(text, "[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F]")), rows)


PRINTABLE = re.compile(r"[\x20-\x7e\s]+", re.ASCII)
DIGITS = "​‌‍﻿⁠"


def _bits(bits: str) -> str | None:
    if len(bits) < 24:
        return None
    out = "".join(chr(int(bits[k : k + 8], 2)) for k in range(0, len(bits) - 7, 8))
    return out if len(out) >= 3 and all(" " <= c <= "~" for c in out) and len(set(out)) > 1 else None


def payloads(found: str) -> list[str]:
    """What a row of carriers spells in tag characters, variation selectors or zero-width digits."""
    out = []
    tags = "".join(chr(ord(c) - 0xE0000) for c in found if 0xE0001 <= ord(c) <= 0xE007F)
    if len(tags) >= 3 and PRINTABLE.fullmatch(tags):
        out.append(f'tag characters → "{tags}"')
    selectors = [ord(c) - 0xFE00 if 0xFE00 <= ord(c) <= 0xFE0F else ord(c) - 0xE0100 + 16 for c in found if 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF]
    if len(selectors) >= 3:
        try:
            said = bytes(selectors).decode().removeprefix("﻿")
        except (UnicodeDecodeError, ValueError):
            said = ""
        if PRINTABLE.fullmatch(said):
            out.append(f'variation selectors → "{said}"')
    run = [c for c in found if c in DIGITS]
    alphabet = [*dict.fromkeys(run)]
    if len(run) >= 12:
        readings = []
        if len(alphabet) == 2:
            readings = [("binary", "".join("1" if c == one else "0" for c in run)) for one in alphabet[::-1]]
        elif len(alphabet) == 4:
            order = sorted(alphabet)
            readings = [("base-4", "".join(f"{order.index(c):02b}" for c in run))]
        seen = set()
        for scheme, bits in readings:
            said = _bits(bits)
            if said and said not in seen:
                seen.add(said)
                out.append(f'zero-width {scheme} → "{said}"')
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _payloads(rows: pd.Series) -> pd.Series:
    return rows.map(lambda x: payloads(x) if x else [])


def decoded(text: Column) -> Column:
    """Payloads spelled by the text's carriers, as strings."""
    found = F.when(text.rlike(beyond(COMMON)), F.array_join(extract(text, carrier()), ""))
    return F.coalesce(_payloads(found), F.array().cast("array<string>"))


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def without_carriers(text: Column, normalize_spaces: bool = True) -> Column:
    out = F.regexp_replace(text, carrier(), "")
    out = F.regexp_replace(out, EXOTIC, " ") if normalize_spaces else out
    return F.when(text.rlike(beyond(COMMON)), out).otherwise(text)


def clean_text(text: Column, normalize_spaces: bool = True, normalize: bool = True) -> Column:
    """Without carriers, exotic spaces made plain, and in composed form; below U+0300 every text is, cleaned or not."""
    out = without_carriers(text, normalize_spaces)
    return F.coalesce(_composed(F.when(text.rlike(beyond(COMPOSED)), out)), out) if normalize else out


def cleaned(text: str) -> str:
    """What clean_text() gives without making spaces plain, for a string."""
    return unicodedata.normalize("NFC", _carriers().sub("", text))


@cache
def _carriers():
    import regex

    return regex.compile(carrier(), regex.V1)


def scan_text(text: Column, forms: Column | None = None) -> Column:
    """All character findings of a text, in the order of a report."""
    return F.concat(
        bidi_findings(text),
        character_findings(text),
        lookalike_findings(text),
        form_findings(normal_forms(text) if forms is None else forms),
        hyphen_findings(text),
        whitespace_findings(text),
        control_findings(text),
    )
