"""Differences between two copies of a table, field by field.

Both sides are unpivoted to key-field-value cells with a signed count (+1 for
the first copy, -1 for the second): one cell for the key itself, and one for
each field.  Cells that both copies hold cancel.  A key that does not cancel is
on one side only, by its sign; of other keys the fields that do not cancel differ.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PLAIN_NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"


def canonical_number(value: Column) -> Column:
    """One spelling for each plain decimal number; any other string as it is.

    Leading zeros, zeros at the end of the fraction, and the sign of zero go.
    """
    bare = F.regexp_replace(F.regexp_replace(value, r"^(-?)0+(?=[0-9])", "$1"), r"(\.[0-9]*?)0+$", "$1")
    bare = F.regexp_replace(bare, r"\.$", "")
    return F.when(value.rlike(_PLAIN_NUMBER), F.when(bare == "-0", "0").otherwise(bare)).otherwise(value)


def differences(first: DataFrame, second: DataFrame, key: Column, fields: Mapping[str, Column], *, version: Column | None = None, labels: tuple[str, str] = ("only_first", "only_second")) -> DataFrame:
    """``row_key, field``: one row for every key on one side only, and for every field that differs.

    ``key`` and ``fields`` are expressions over the columns that both inputs
    have; rows with a null key are left out.  Of several rows of a key on one
    side the one with the greatest ``version`` counts (null and NaN are least,
    and equal versions are settled by the greatest values), so repeated rows
    count once.  Values compare exactly, and null equals only null.  With an
    empty side every key of the other side comes out; extra columns don't
    matter.  One exchange by key serves both the choice of the rows and the
    cancelling of the cells, and the choice is made before the exchange as far
    as possible, so a key that holds a large share of the rows is no burden.
    """
    names = list(fields)
    inner = [f"f{i}" for i in range(len(names))]

    def side(df: DataFrame, sign: int) -> DataFrame:
        columns = [fields[n].cast("string").alias(c) for n, c in zip(names, inner, strict=True)]
        ver = [] if version is None else [F.when(~F.isnan(version.cast("double")), version.cast("double")).alias("v")]
        return df.select(key.alias("row_key"), F.lit(sign).alias("sign"), F.struct(*ver, *columns).alias("r")).where("row_key is not null")

    both = side(first, 1).unionByName(side(second, -1))
    one = both.groupBy("row_key").agg(*(F.max(F.when(F.col("sign") == s, F.col("r"))).alias(n) for s, n in ((1, "a"), (-1, "b"))))

    def cells(name: str, sign: int) -> Column:
        """The key's cell, without a field, and those of its fields; none if the side lacks the key."""
        own = F.struct(F.lit(None).cast("int").alias("field"), F.lit(None).cast("string").alias("value"), F.lit(sign).alias("sign"))
        each = [F.struct(F.lit(i).alias("field"), F.col(f"{name}.{c}").alias("value"), F.lit(sign).alias("sign")) for i, c in enumerate(inner)]
        return F.when(F.col(name).isNull(), F.array().cast("array<struct<field:int,value:string,sign:int>>")).otherwise(F.array(own, *each))

    long = one.select("row_key", F.explode(F.concat(cells("a", 1), cells("b", -1))).alias("c")).select("row_key", "c.*")
    left = long.groupBy("row_key", "field", "value").agg(F.sum("sign").alias("n")).where("n <> 0")
    # No more cells of a key are left than it has fields on both sides.
    key_sign = F.max(F.when(F.col("field").isNull(), F.col("n"))).alias("key_sign")
    by_key = left.groupBy("row_key").agg(key_sign, F.collect_set("field").alias("fields"))
    named = F.transform("fields", lambda i: F.element_at(F.array(*map(F.lit, names)), i + 1))
    only = F.array(F.when(F.col("key_sign") > 0, labels[0]).otherwise(labels[1]))
    return by_key.select("row_key", F.explode(F.when(F.col("key_sign").isNull(), named).otherwise(only)).alias("field"))
