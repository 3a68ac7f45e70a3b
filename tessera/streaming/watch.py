"""Files searched as they arrive (an extension of the batch search): a stream of files, each searched by itself."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.matching import has_hit, with_submatches
from tessera.functions.patterns import compile_pattern
from tessera.model import CELLS, SearchOptions
from tessera.sources.files import EXTENSIONS, file_batches


def watch(spark: SparkSession, folder: str, options: SearchOptions) -> DataFrame:
    """A streaming DataFrame of the matching cells of new files below folder. Stateless, without context rows."""
    pattern, read = compile_pattern(spark, options.patterns, options.case, options.fixed, options.word), options.read

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from file_batches(path, 0, read, opened=io.BytesIO(content.as_buffer()))

    listed = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder).select(F.url_decode(F.regexp_replace(F.replace("path", F.lit("+"), F.lit("%2B")), "^file:/*", "/")).alias("path"), "content")
    listed = listed.where(F.lower(F.regexp_extract("path", r"(\.[^.]+)$", 1)).isin(*EXTENSIONS))
    found = listed.mapInArrow(cells, CELLS)
    hit = has_hit(F.col("text"), pattern)
    kept = found.where(F.col("error").isNotNull() | (~hit if options.invert else hit))
    return with_submatches(kept.where("error is null"), pattern)
