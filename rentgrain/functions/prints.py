"""Order-free fingerprints of rows, by which two bags of rows are compared without joining them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bag_print(columns: list[str]) -> Column:
    """An aggregate that is equal for equal bags of rows: sums and exclusive-ors of two hashes of each row.

    Hashes pass over missing values, so which columns are missing is hashed as well. Sums tell how often
    a row occurs; they are exact up to 10^18 rows.
    """
    missing = [F.col(c).isNull() for c in columns]
    hashes = [F.xxhash64(*columns, *missing), F.xxhash64(F.lit("second"), *missing, *columns)]
    return F.struct(
        F.count("*").alias("rows"),
        *[F.sum(h.cast("decimal(20,0)")).alias(f"sum{k}") for k, h in enumerate(hashes)],
        *[F.bit_xor(h).alias(f"xor{k}") for k, h in enumerate(hashes)],
    )
