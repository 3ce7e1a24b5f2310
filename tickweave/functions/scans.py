"""Recursions x_t = factor x_(t-1) + term_t along a symbol's rows, in blocks.

Each step is an affine map, and maps compose: a block of rows is one map, found by doubling. The maps of blocks, one row each, are applied one
after the other; then every block starts from its value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import BLOCK


def composed(factors: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slopes, offsets) of the maps up to and with each row, from each row's x -> factor x + term."""
    slopes, offsets, step = factors.astype(float), terms.astype(float), 1
    while step < len(slopes):
        offsets[step:] = offsets[step:] + slopes[step:] * offsets[:-step]
        slopes[step:] = slopes[step:] * slopes[:-step]
        step *= 2
    return slopes, offsets


def affine_scan(rows: DataFrame, order: str, factor: Column, term: Column, name: str, size: int | None = None) -> DataFrame:
    """rows with the column `name`: factor times its value in the symbol's row before, plus term; the first row of a symbol has its term.

    order numbers a symbol's rows, each once, gaps are fine. A null term or factor makes its row and all later ones null. A null symbol is one of its own.
    """
    keyed = rows.withColumns({"_key": F.coalesce(F.concat(F.lit("="), "symbol"), F.lit("!")), "_block": F.floor(F.col(order) / (size or BLOCK)), "_f": factor.cast("double"), "_t": term.cast("double")})

    def numbers(block: pa.Table, column: str) -> np.ndarray:
        return block[column].combine_chunks().to_numpy(zero_copy_only=False).astype(float)  # nulls become NaN

    def whole(block: pa.Table) -> pa.Table:
        block = block.sort_by(order)
        slopes, offsets = composed(numbers(block, "_f"), numbers(block, "_t"))
        return pa.table({"_key": block["_key"][:1], "_block": block["_block"][:1], "_slope": slopes[-1:], "_offset": offsets[-1:]})

    maps = keyed.select("_key", "_block", order, "_f", "_t").groupBy("_key", "_block").applyInArrow(whole, "_key string, _block long, _slope double, _offset double")

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, value = None, 0.0
        for batch in batches:
            starts = np.empty(batch.num_rows)
            for i, (key, slope, offset) in enumerate(zip(batch.column("_key").to_pylist(), batch.column("_slope").to_pylist(), batch.column("_offset").to_pylist(), strict=True)):
                if key != own:
                    own, value = key, 0.0
                starts[i], value = value, slope * value + offset
            yield pa.record_batch([batch.column("_key"), batch.column("_block"), pa.array(starts)], names=["_key", "_block", "_start"])

    # a row for each block
    starts = maps.repartition("_key").sortWithinPartitions("_key", "_block").mapInArrow(in_order, "_key string, _block long, _start double")

    def walk(block: pa.Table) -> pa.Table:
        block = block.sort_by(order)
        slopes, offsets = composed(numbers(block, "_f"), numbers(block, "_t"))
        out = slopes * block["_start"][0].as_py() + offsets
        return block.drop_columns(["_key", "_block", "_start", "_f", "_t"]).append_column(name, pa.array(out, pa.float64(), mask=np.isnan(out)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{name}` double"
    return keyed.join(starts, ["_key", "_block"]).groupBy("_key", "_block").applyInArrow(walk, schema)
