"""Files as rows: listings that pass by what isn't the user's, and texts decoded only where they are texts."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import (
    ALLOWED_CONTROLS, CONTROL_SHARE, DOUBTFUL_SIGNATURES, EARLY, EXTENSIONS, PASSED_FOLDERS, SECRET_FILES, SIGNATURES, SNIFFED,
)

#: Longest file that is read; longer ones come with an error.
MOST_BYTES = 1 << 30
_CONTROLS = re.compile(b"[" + re.escape(bytes(c for c in range(32) if c not in ALLOWED_CONTROLS)) + b"]")


def hint_of(path: Column) -> Column:
    """The format that an extension suggests for what its bytes don't tell."""
    low = F.lower(path)
    return F.when(low.rlike(r"\.(md|markdown|mdx)$"), "markdown").when(low.endswith(".svg"), "svg").when(low.rlike(r"\.html?$"), "html")


def hint_for(path: str) -> str | None:
    """hint_of() for a string."""
    m = re.search(r"\.(?:(md|markdown|mdx)|(svg)|(html?))\Z", path.lower())
    return m and ("markdown" if m[1] else "svg" if m[2] else "html")


def refusal(data: bytes) -> str | None:
    """Why bytes are no text: a signature's name, nul-bytes, control-dense or not-utf8; None for a text."""
    for magic, name in SIGNATURES:
        if data.startswith(magic):
            return f"signature: {name}"
    for magic, name in DOUBTFUL_SIGNATURES:
        if data.startswith(magic) and _CONTROLS.search(data[:EARLY]):
            return f"signature: {name}"
    if b"\0" in data:
        return "nul-bytes"
    head = data[:SNIFFED]
    if head and len(_CONTROLS.findall(head)) / len(head) > CONTROL_SHARE:
        return "control-dense"
    try:
        data.decode()
    except UnicodeDecodeError:
        return "not-utf8"
    return None


@F.pandas_udf(T.StringType())
def refused(content: pd.Series) -> pd.Series:
    """refusal() of each content; null for a text and for a null."""
    return content.map(lambda d: None if d is None else refusal(bytes(d)))


def folder(path: str) -> str:
    """A path without scheme, authority of local files and closing slash."""
    return "/" + re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "", path).strip("/")


def read_files(spark: SparkSession, paths: str | Iterable[str], skip: Iterable[str] = (), walked: bool = True, most: int = MOST_BYTES) -> DataFrame:
    """path, length, content, hint and error of files; folders are walked.

    Of a walk, files with known extensions or names stay, but for those below folders that hold tools' output, whose
    names begin with a dot, or which ``skip`` names. The condition is on the files' metadata, so that what it excludes
    is never opened. A file longer than ``most`` bytes has an error and no content. ``walked=False`` takes all files. Spark's own listing
    leaves out names that begin with a dot or an underscore, so files such as .env come only from other listings
    (wanted() keeps them).
    """
    roots = [paths] if isinstance(paths, str) else list(paths)
    out = None
    for root in roots:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        if walked:
            files = files.where(wanted(F.col("_metadata.file_path"), root, skip))
        out = files if out is None else out.unionByName(files)
    if out is None:
        raise ValueError("no paths")
    read = out.where(F.col("length") <= most).select("path", "length", "content", F.lit(None).cast("string").alias("error"))
    long = out.where(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit("too long").alias("error"))
    return read.unionByName(long).withColumn("hint", hint_of(F.col("path")))


def wanted(path: Column, root: str, skip: Iterable[str] = ()) -> Column:
    """Whether a walk from root takes the file; root itself is taken as it is, a file too."""
    plain = F.regexp_replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/")
    below = F.substring(plain, len(folder(root)) + 1, 1 << 20)
    passed = "|".join(map(re.escape, dict.fromkeys([*PASSED_FOLDERS, *skip])))
    names = "|".join(map(re.escape, SECRET_FILES))
    known = F.lower(below).rlike(rf"/(?:{names})$|/[^/]+\.(?:{'|'.join(EXTENSIONS)})$")
    return (below == "") | (known & ~below.rlike(rf"/(?:{passed}|\.[^/]*)/"))
