"""Compression lengths under raw-content zstandard dictionaries, and bounded samples to make them from."""

from __future__ import annotations

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    """A compressor primed with content; its frames carry no size, checksum or dictionary number."""
    if len(content) < 8:
        content = content.ljust(8, b" ")
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(level=level)
    plain = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=0, write_checksum=0, write_dict_id=0)
    return zstandard.ZstdCompressor(compression_params=plain, dict_data=words)


def excerpt(text: str, of: str, most: int) -> Column:
    """At most `most` characters from a place in the text that a hash picks; for samples to learn from only."""
    room = F.greatest(F.length(text) - F.lit(most), F.lit(0)) + 1
    return F.substring(F.col(text), (F.pmod(F.xxhash64(F.col(of), F.lit("excerpt")), room.cast("long")) + 1).cast("int"), F.lit(most))


def sampled(rows: DataFrame, label: str, keys: list[str], most: int, number: dict) -> DataFrame:
    """About `most` rows of each label (a binomial draw, so a few per cent more or less) by a hash of keys, in sample__spot.

    number: how many rows each label has. Rows that are equal in label and keys count once, whatever their number, and
    no label's rows meet in one task.
    """
    spot = F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(1 << 40))
    keep = F.lit(False)
    for value, n in number.items():
        keep = keep | ((F.col(label) == F.lit(value)) & (F.col("sample__spot") < F.lit(int(min(1.0, most / max(1, n)) * (1 << 40)))))
    return rows.withColumn("sample__spot", spot).filter(keep).dropDuplicates([label, "sample__spot"])
