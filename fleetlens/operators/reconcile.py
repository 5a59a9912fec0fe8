"""Open/resolved state tables: raise, refresh and resolve as one full outer join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.expressions import severity_rank, ts_lit
from fleetlens.operators.latest import first_per_key


def one_per_key(current: DataFrame, key: str, text: str) -> DataFrame:
    """Reduce conditions that share a key: worst severity, then smallest text."""
    return first_per_key(current, [key], severity_rank("Severity"), F.asc_nulls_first(text))


def reconcile(
    prev: DataFrame,
    current: DataFrame,
    key: str,
    as_of,
    refresh,
    text: str,
    scope: Column | None = None,
) -> DataFrame:
    """The state table after one evaluation.

    * open row whose condition still holds: ``refresh`` columns and LastSeen are
      updated, FirstSeen and all else kept;
    * new condition: a new open row;
    * open row whose condition is gone: resolved, if it lies within ``scope``;
    * resolved rows: kept as history. A condition that returns gets a new row.
    """
    now = ts_lit(as_of)
    types = {f.name: f.dataType for f in prev.schema.fields}
    current = one_per_key(current, key, text)
    given = current.columns
    cur = current.select(*[F.col(c).alias(f"_c_{c}") for c in given])
    opened = prev.filter(~F.col("Resolved"))
    joined = opened.join(cur, F.col(key) == F.col(f"_c_{key}"), "full")
    seen, known = F.col(f"_c_{key}").isNotNull(), F.col(key).isNotNull()
    gone = known & ~seen & (F.lit(True) if scope is None else F.coalesce(scope, F.lit(False)))
    special = {
        "FirstSeen": F.coalesce("FirstSeen", now),
        "LastSeen": F.when(seen, now).otherwise(F.col("LastSeen")),
        "Resolved": F.when(known, gone).otherwise(F.lit(False)),
        "ResolvedAt": F.when(gone, now).otherwise(F.col("ResolvedAt")),
    }
    out = []
    for c, kind in types.items():
        if c in special:
            value = special[c]
        elif c not in given:
            value = F.col(c)
        elif c in refresh:
            value = F.when(seen, F.col(f"_c_{c}")).otherwise(F.col(c))
        else:
            value = F.when(known, F.col(c)).otherwise(F.col(f"_c_{c}"))
        out.append(value.cast(kind).alias(c))
    return joined.select(*out).unionByName(prev.filter(F.col("Resolved")))
