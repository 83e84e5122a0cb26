"""Words of notebook texts: runs of letters and digits, without regard to case or markup."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

def over_all_cores(rows: DataFrame) -> DataFrame:
    """The rows over as many partitions as there are cores, where the files give fewer.

    Large inputs come in more splits than that and are left alone; only a small file, whose one row group
    a single task would read, is exchanged before the costly work on texts.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


WORD = re.compile(r"[^\W_]+")
UNICODE = re.compile(r"\\u([0-9a-fA-F]{4})")


def unescape(text: str) -> str:
    """The text with JSON string escapes resolved; line ends and quotes become spaces."""
    if "\\" not in text:
        return text
    text = text.replace("\\\\", "\x01")
    for escape in ("\\n", "\\r", "\\t", "\\b", "\\f", '\\"', "\\/"):
        text = text.replace(escape, " ")
    if "\\u" in text:
        text = UNICODE.sub(lambda m: chr(int(m[1], 16)), text)
    return text.replace("\x01", "\\")


def is_json(text: str, style: str | None) -> bool:
    """Whether the text is written as a JSON document."""
    return style == "json" or (style is None and text.lstrip()[:1] == "{")


def words(text: str, escaped: bool = False) -> list[str]:
    return WORD.findall((unescape(text) if escaped else text).casefold())
