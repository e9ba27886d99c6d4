"""Document fingerprints: invertible Bloom lookup tables over hashed paragraphs, native throughout.

A text is cut into lines, and lines into paragraphs of at most ``WORDS`` words. A set element is the
64-bit hash of a paragraph together with how often the text has it. The fingerprint is a table of
``CELLS`` cells in three parts; an element is in one cell of each part. A cell holds the number of
its elements, the xor of them and the xor of their check hashes. The table of one version less that
of another holds only elements in which they differ; peeling takes out cells of one element, which
recovers that element's digest and side, until none is left. Where that fails the tables were too
small: then both sets' elements are sorted once by a hash and cut into groups of about ``GROUP``,
whose tables are larger for the elements there are, and a group that fails again is retried with
tables twice and four times as large. Should that fail too, the group's elements are compared as
they are. Sorting and groups keep the work in proportion to the number of paragraphs, but for its
logarithm.

Likeness is the share of elements that two versions have in common: 1 - |difference| / (|a| + |b|),
and 1 for two texts without elements.

Defined results: a null text counts as empty and has the table of zeros; equal texts have equal
fingerprints; null ids come last in descending order, rows of equal id in the order of a hash of
their texts; a table of one row is its own next document; other columns of the input are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORDS = 24
#: Cells of a fingerprint, a multiple of three; elements of a group in a retry.
CELLS, GROUP = 36, 12
#: Rounds of peeling; each takes out all cells of one element.
ROUNDS = 24
#: What peeling recovers: on which side an element is (1 or -1), and its digest.
FOUND = "array<struct<n: bigint, k: bigint>>"
PARAGRAPH = r"[^\S\n]*+(?:\S++[^\S\n]*+){1,%d}+\n?+|\s*?\n|[^\S\n]++"
#: Documents of a bucket of neighbours aimed at, and buckets at most.
NEIGHBOURS, BUCKETS = 1_000, 65_536


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def paragraphs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PARAGRAPH % WORDS), F.lit(0))


def runs(values: Column, same) -> Column:
    """Starts of the runs of a sorted array whose neighbours are the same, and its size at the end."""
    starts = F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda i: (i == 0) | ~same(F.get(values, i), F.get(values, i - 1)))
    return F.when(F.size(values) > 0, F.concat(starts, F.array(F.size(values)))).otherwise(F.array(F.lit(0)))


def spans(starts: Column) -> Column:
    """struct(at, n) of the runs that starts cut."""
    ends = F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0)))
    return F.filter(F.zip_with(starts, ends, lambda a, z: F.struct(a.alias("at"), (z - a).alias("n"))), lambda r: r["n"].isNotNull())


def elements(text: Column) -> Column:
    """The text's set: hashes of its paragraphs, each with its count; one pass over the sorted hashes."""
    hashes = F.array_sort(F.transform(paragraphs(text), lambda p: F.xxhash64(p)))
    counted = lambda all_: F.transform(spans(runs(all_, lambda x, y: x == y)), lambda r: F.xxhash64(F.get(all_, r["at"]), r["n"]))
    return let(hashes, counted)


def check(element: Column) -> Column:
    return F.xxhash64(element, F.lit("check")).bitwiseAND(F.lit(0xFFFFFFFF))


def zero() -> Column:
    return F.struct(*(F.lit(0).cast("long").alias(c) for c in ("n", "k", "x")))


def placed(found: Column, width: Column, sign: int = 1) -> Column:
    """Elements with their sign, check hash and cell in each of the three parts."""
    parts = lambda e: (F.pmod(F.xxhash64(e, F.lit(j), width), width).alias(f"p{j}") for j in range(3))
    return F.transform(found, lambda e: F.struct(F.lit(sign).cast("long").alias("n"), e.alias("k"), check(e).alias("x"), *parts(e)))


def added(cell: Column, items: Column) -> Column:
    return F.aggregate(
        items,
        cell,
        lambda a, e: F.struct((a["n"] + e["n"]).alias("n"), a["k"].bitwiseXOR(e["k"]).alias("k"), a["x"].bitwiseXOR(e["x"]).alias("x")),
    )


def tabulate(items: Column, width: Column) -> Column:
    """Cells of placed elements, as three arrays c0, c1 and c2 of ``width`` cells."""

    def part(j: int) -> Column:
        cells = F.sequence(F.lit(0).cast("long"), width - 1)
        return F.transform(cells, lambda c: added(zero(), F.filter(items, lambda e: e[f"p{j}"] == c))).alias(f"c{j}")

    return F.struct(*(part(j) for j in range(3)))


def table(found: Column, width: Column) -> Column:
    """The table of a set."""
    return let(placed(found, width), lambda items: tabulate(items, width))


def subtract(a: Column, b: Column) -> Column:
    def less(x: Column, y: Column) -> Column:
        return F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["x"].bitwiseXOR(y["x"]).alias("x"))

    return F.struct(*(F.zip_with(a[f"c{j}"], b[f"c{j}"], less).alias(f"c{j}") for j in range(3)))


def peeled(difference: Column, width: Column) -> Column:
    """The elements that a difference of two tables holds, as FOUND; null where peeling fails."""

    def pure(cells: Column) -> Column:
        """What to add to take out the elements that are alone in a cell."""
        every = F.concat(*(F.filter(cells[f"c{j}"], lambda c: (F.abs(c["n"]) == 1) & (check(c["k"]) == c["x"])) for j in range(3)))
        parts = lambda c: (F.pmod(F.xxhash64(c["k"], F.lit(j), width), width).alias(f"p{j}") for j in range(3))
        return F.transform(F.array_distinct(every), lambda c: F.struct((-c["n"]).alias("n"), c["k"].alias("k"), c["x"].alias("x"), *parts(c)))

    def take(state: Column, alone: Column) -> Column:
        def part(j: int) -> Column:
            return F.transform(state["cells"][f"c{j}"], lambda c, i: added(c, F.filter(alone, lambda e: e[f"p{j}"] == i))).alias(f"c{j}")

        cells = F.struct(*(part(j) for j in range(3)))
        more = F.transform(alone, lambda e: F.struct((-e["n"]).alias("n"), e["k"].alias("k"))).cast(FOUND)
        return F.struct(cells.alias("cells"), F.concat(state["found"], more).alias("found"), F.lit(True).alias("live"))

    def stop(state: Column) -> Column:
        return F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(False).alias("live"))

    def step(state: Column, _: Column) -> Column:
        more = let(pure(state["cells"]), lambda alone: F.when(F.size(alone) == 0, stop(state)).otherwise(take(state, alone)))
        return F.when(state["live"], more).otherwise(state)

    def finish(state: Column) -> Column:
        empty = [F.forall(state["cells"][f"c{j}"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["x"] == 0)) for j in range(3)]
        return F.when(empty[0] & empty[1] & empty[2], state["found"])

    start = F.struct(difference.alias("cells"), F.array().cast(FOUND).alias("found"), F.lit(True).alias("live"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, finish)


def differing(items: Column, width: Column) -> Column:
    """The elements in which two sets differ, by tables of three times width cells; null on failure.

    items are signed, those of the second set negative; their table is the difference of both sets' tables.
    """
    signed = lambda e: placed(F.array(e["k"]), width)[0]
    cells = F.transform(items, lambda e: let(signed(e), lambda p: F.struct(e["n"].alias("n"), *(p[c].alias(c) for c in ("k", "x", "p0", "p1", "p2")))))
    return let(cells, lambda all_: peeled(tabulate(all_, width), width))


def exact(items: Column) -> Column:
    """The elements of signed items that are on one side only, by comparison."""
    mine, theirs = (F.transform(F.filter(items, lambda e: e["n"] == n), lambda e: e["k"]) for n in (1, -1))
    one = lambda keys, n: F.transform(keys, lambda k: F.struct(F.lit(n).cast("long").alias("n"), k.alias("k")))
    return F.concat(one(F.array_except(mine, theirs), 1), one(F.array_except(theirs, mine), -1)).cast(FOUND)


def retried(a: Column, b: Column, first: int = 2) -> Column:
    """The elements in which two sets differ, by tables for groups of elements, retried larger; never null.

    first is the number of elements for a cell of a part in the first try.
    """
    groups = F.greatest(F.lit(1), F.ceil((F.size(a) + F.size(b)) / GROUP)).cast("long")

    def signed(all_: Column, n: int, count: Column) -> Column:
        return F.transform(all_, lambda e: F.struct(F.pmod(F.xxhash64(e, F.lit("group")), count).alias("g"), F.lit(n).cast("long").alias("n"), e.alias("k")))

    def tried(items: Column) -> Column:
        width = (F.floor(F.size(items) / first) + 4).cast("long")
        return F.coalesce(*(differing(items, width * k) for k in (1, 2, 4)), exact(items))

    def grouped(items: Column) -> Column:
        inside = F.transform(spans(runs(items, lambda x, y: x["g"] == y["g"])), lambda r: F.slice(items, r["at"] + 1, r["n"]))
        return F.flatten(F.transform(inside, tried))

    return let(groups, lambda count: let(F.array_sort(F.concat(signed(a, 1, count), signed(b, -1, count))), grouped))


def difference(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """The elements in which two versions differ, from their fingerprints' cells or else from larger tables, as FOUND."""
    return F.coalesce(peeled(subtract(cells_a, cells_b), F.lit(CELLS // 3).cast("long")), retried(a, b))


def changes(before: Column, after: Column) -> Column:
    """struct(removed, added): digests of the paragraphs that only the first or only the second text has."""
    width = F.lit(CELLS // 3).cast("long")

    def of(x: Column, y: Column) -> Column:
        side = lambda all_, n: F.array_sort(F.transform(F.filter(all_, lambda e: e["n"] == n), lambda e: e["k"]))
        return let(difference(x, y, table(x, width), table(y, width)), lambda d: F.struct(side(d, 1).alias("removed"), side(d, -1).alias("added")))

    texts = [elements(F.coalesce(t, F.lit(""))) for t in (before, after)]
    return let(texts[0], lambda x: let(texts[1], lambda y: of(x, y)))


def likeness(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """Likeness of two versions from their sets and their fingerprints' cells."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(1 - F.size(difference(a, b, cells_a, cells_b)) / total)


def written_out(cells: Column) -> Column:
    """Cells as lowercase hexadecimal digits: 4 of the number, 16 and 8 of the xors."""
    digits = lambda c, n: F.right(F.lpad(F.hex(c), 16, "0"), F.lit(n))
    every = F.concat(*(cells[f"c{j}"] for j in range(3)))
    return F.lower(F.array_join(F.transform(every, lambda c: F.concat(digits(c["n"], 4), digits(c["k"], 16), digits(c["x"], 8))), ""))


def sketch(text: Column) -> Column:
    """The fingerprint's cells of a text."""
    return table(elements(text), F.lit(CELLS // 3).cast("long"))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as a string."""
    return written_out(sketch(F.coalesce(text, F.lit(""))))


def below(bounds: Column, key: Column, with_equal: bool) -> Column:
    """How many of the sorted bounds are below the key, or equal to it too; by binary search."""
    last = F.size(bounds)

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        at = F.get(bounds, mid)
        right = (at <= key) if with_equal else (at < key)
        low = F.when((s["low"] < s["high"]) & right, mid + 1).otherwise(s["low"])
        high = F.when((s["low"] < s["high"]) & ~right, mid).otherwise(s["high"])
        return F.struct(low.alias("low"), high.alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(18)), F.struct(F.lit(0).alias("low"), last.alias("high")), step, lambda s: s["low"])


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, next_text): each row with the text of the next one in descending id, cyclically.

    Rows are cut into buckets by quantiles of their ids, and an id of so many rows that it fills
    buckets is dealt over them by the hash of the text. A bucket gets a copy of the first row of the
    next one that has rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key, mark = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64("text")
    n = rows.count()
    buckets = max(1, min(BUCKETS, -(-n // NEIGHBOURS)))
    shares = [k / buckets for k in range(1, buckets)]
    # at most BUCKETS numbers, which are the same for every row
    bounds = rows.agg(F.percentile_approx(key, shares, 4 * BUCKETS).alias("b")).first()["b"] if shares and n else []
    cuts = F.split(F.lit(",".join(map(str, bounds or [0]))), ",").cast("array<long>")
    low, high = (below(cuts, F.col("key"), equal) for equal in (False, True))
    share = F.shiftrightunsigned(F.col("mark"), 33) / F.lit(float(1 << 31))
    rows = rows.withColumns({"key": key, "mark": mark}).withColumns({"low": low, "high": high})
    rows = rows.withColumn("bucket", (F.col("low") + F.floor(share * (F.col("high") - F.col("low") + 1))).cast("int")).drop("low", "high")
    place = F.struct("key", "mark")
    firsts = rows.groupBy("bucket").agg(F.max(place).alias("first"))
    down = W.orderBy(F.desc("bucket"))
    # a row of three numbers for each bucket, and there are at most BUCKETS
    top = F.max("first").over(W.orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ghosts = firsts.select("bucket", F.coalesce(F.lead("first").over(down), top).alias("ghost")).select("bucket", "ghost.*")
    copies = rows.select("key", "mark", "text").join(F.broadcast(ghosts), ["key", "mark"])
    copies = copies.groupBy("bucket").agg(*(F.first(c).alias(c) for c in ("key", "mark", "text")))  # rows alike give one
    kind = rows.schema["doc_id"].dataType
    both = rows.select("bucket", "doc_id", "key", "mark", "text", F.lit(False).alias("copy")).unionByName(
        copies.select("bucket", F.lit(None).cast(kind).alias("doc_id"), "key", "mark", "text", F.lit(True).alias("copy"))
    )
    order = W.partitionBy("bucket").orderBy("copy", F.desc("key"), F.desc("mark"))
    return both.withColumn("next_text", F.lead("text").over(order)).where(~F.col("copy")).select("doc_id", "text", "next_text")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The
    edited text has the last third of its code points replaced by as many first ones of the next
    document's text, or all of it.
    """
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substr("next_text", F.lit(1), cut))
    rows = rows.withColumn("edited", edited)
    names = ("text", "edited", "next_text")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *(elements(F.col(c)).alias(c) for c in names))
    width = F.lit(CELLS // 3).cast("long")
    rows = rows.withColumns({f"{c}_cells": table(F.col(c), width) for c in names})
    near = {c: likeness(F.col("text"), F.col(c), F.col("text_cells"), F.col(f"{c}_cells")) for c in ("edited", "next_text")}
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written_out(F.col("text_cells")).alias("fingerprint"),
        written_out(F.col("edited_cells")).alias("edited_fingerprint"),
        near["edited"].alias("near_edited"),
        near["next_text"].alias("near_next"),
    )
