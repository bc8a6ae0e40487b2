"""Helpers as SQL functions of a session; they are SQL expressions, so Catalyst inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> list[str]:
    """Define wrap_<type>(bigint), quantise_int16(v, peak), dequantise_int16(v, peak) and chunk_of(t, size)."""
    made = []

    def define(signature: str, returns: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {returns} RETURN {body}")
        made.append(signature.split("(")[0])

    for bits, held in ((8, "TINYINT"), (16, "SMALLINT"), (32, "INT")):
        define(f"wrap_int{bits}(v BIGINT)", held, f"CAST(shiftright(shiftleft(v, {64 - bits}), {64 - bits}) AS {held})")
    for bits, held in ((8, "SMALLINT"), (16, "INT"), (32, "BIGINT")):
        define(f"wrap_uint{bits}(v BIGINT)", held, f"CAST(v & {2**bits - 1} AS {held})")
    define("quantise_int16(v DOUBLE, peak DOUBLE)", "SMALLINT", "CAST(CASE WHEN peak = 0 THEN v ELSE v / nullif(peak, 0) * 32766 END AS SMALLINT)")
    define("dequantise_int16(v SMALLINT, peak DOUBLE)", "DOUBLE", "CASE WHEN peak = 0 THEN CAST(v AS DOUBLE) ELSE CAST(v AS DOUBLE) * (peak / 32766) END")
    define("chunk_of(t BIGINT, size BIGINT)", "INT", "CAST(t DIV size AS INT)")
    return made
