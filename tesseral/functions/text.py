"""Column functions for text that differ from Spark's nearest built-in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends; trim only takes blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def padded(number: Column, width: int) -> Column:
    """Zero-padded to `width` digits and longer where needed; lpad would cut longer numbers."""
    return F.format_string(f"%0{width}d", number)


def sha_key(*parts: Column, digits: int = 64) -> Column:
    """SHA-256 of the parts joined by line feeds, as leading hexadecimal digits. A null part makes
    the key null: concat_ws would skip it, and two identities could collide."""
    joined = F.concat_ws("\n", *parts)
    whole = F.when(F.greatest(*(p.isNull().cast("int") for p in (*parts, F.lit("")))) == 0, F.sha2(joined, 256))
    return F.substring(whole, 1, digits)


def seeded_key(seed: str | int, ident: Column) -> Column:
    """Order key of a portable seeded shuffle: any engine with SHA-256 gives the same order."""
    return F.sha2(F.concat_ws("\n", F.lit(str(seed)), ident.cast("string")), 256)


def base64_line(data: Column) -> Column:
    """Base64 without the line ends that Spark puts in."""
    return F.regexp_replace(F.base64(data), r"\s", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]+)?$", 1)


def relative_to(path: Column, base: str) -> Column:
    """The path below `base`, or as it is if it lies elsewhere."""
    base = base.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def resolved(path: Column, base: str) -> Column:
    return F.when(F.startswith(path, F.lit("/")) | path.contains(":/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))


def wrapped(text: Column, width: int) -> Column:
    """Lines of at most `width` characters, cut at blanks; long words and hyphens stay whole."""

    @F.pandas_udf("array<string>")
    def wrap(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import textwrap

        for texts in batches:
            yield texts.map(lambda t: textwrap.wrap(t or "", width, break_long_words=False, break_on_hyphens=False))

    return wrap(text)


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))
