"""Inventory: servers, owners, and the targets a collection run contacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import constants as K
from fleetlens.functions.expressions import nullif, ts_lit
from fleetlens.operators.latest import first_per_key


def last_change(changes: DataFrame, keys, order: str | None = None) -> DataFrame:
    """One change per key: the last by ``order``; without it, a fixed one."""
    by = [F.desc(order)] if order else [F.desc_nulls_last(c) for c in changes.columns if c not in keys]
    return first_per_key(changes, keys, *by) if by else changes.distinct()


def upsert_by_key(dim: DataFrame, rows: DataFrame, key, keep_if_null=(), on_insert=None, order=None) -> DataFrame:
    """Update matching rows, add the others, leave the rest.

    ``rows`` may hold a subset of the columns. A NULL in a ``keep_if_null``
    column keeps the stored value. ``on_insert`` gives values for new rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    on_insert = on_insert or {}
    changes = last_change(rows, keys, order)
    given = changes.columns
    changes = changes.select(*[F.col(c).alias(f"_c_{c}") for c in given])
    cond = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_c_{k}") for k in keys])
    joined = dim.join(changes, cond, "full")
    stored, changed = F.col(keys[0]).isNotNull(), F.col(f"_c_{keys[0]}").isNotNull()
    out = []
    for c, kind in [(f.name, f.dataType) for f in dim.schema.fields]:
        new = F.col(f"_c_{c}") if c in given else None
        if new is None:
            value = F.when(stored, F.col(c)).otherwise(on_insert[c]) if c in on_insert else F.col(c)
        else:
            update = F.coalesce(new, F.col(c)) if c in keep_if_null else new
            insert = F.coalesce(new, on_insert[c]) if c in on_insert else new
            value = F.when(changed & stored, update).when(changed, insert).otherwise(F.col(c))
        out.append(value.cast(kind).alias(c))
    return joined.select(*out)


def _new_id(*keys):
    """A stable positive identity for a new row."""
    return F.xxhash64(*keys).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def register_servers(servers: DataFrame, contacted: DataFrame, as_of) -> DataFrame:
    """Servers that answered: platform and environment refreshed, active again, old name kept if none is given."""
    rows = contacted.withColumn("IsActive", F.lit(True))
    if "Environment" not in rows.columns:
        rows = rows.withColumn("Environment", F.lit("PROD"))
    return upsert_by_key(servers, rows, "ServerName", ["FriendlyName"], _server_defaults(as_of))


def _server_defaults(as_of):
    return {
        "ServerID": _new_id("_c_ServerName"),
        "Environment": F.lit("PROD"),
        "IsActive": F.lit(True),
        "CreatedAt": ts_lit(as_of),
        "AuthType": F.lit("windows"),
        "HasPassword": F.lit(False),
    }


def upsert_servers(servers: DataFrame, changes: DataFrame, as_of, order: str | None = None) -> DataFrame:
    """Edits from a form: unknown platform or authentication fall back; no new password keeps the stored one."""
    rows = changes
    for c, allowed in (("Platform", K.PLATFORMS), ("AuthType", K.AUTH_TYPES)):
        if c in rows.columns:
            rows = rows.withColumn(c, F.when(F.col(c).isin(allowed), F.col(c)).otherwise(F.lit(allowed[0])))
    if "HasPassword" in rows.columns:  # false means that none was sent
        rows = rows.withColumn("HasPassword", F.when(F.col("HasPassword"), True))
    return upsert_by_key(servers, rows, "ServerName", ["HasPassword"], _server_defaults(as_of), order)


def upsert_owners(owners: DataFrame, changes: DataFrame, as_of, order: str | None = None) -> DataFrame:
    """Owner edits: by id where one is given, else by server, database and application.

    A blank database means the whole instance; an unknown tier is the lowest.
    An id that does not exist adds a row.
    """
    natural = ["ServerName", "DatabaseName", "AppName"]
    rows = (
        changes.withColumn("AppOwnerID", nullif("AppOwnerID", 0))
        .withColumn("DatabaseName", F.coalesce(nullif("DatabaseName", ""), F.lit(K.WHOLE_INSTANCE)))
        .withColumn("Criticality", F.when(F.col("Criticality").isin(K.TIERS), F.col("Criticality")).otherwise(K.TIERS[-1]))
        .withColumn("UpdatedAt", ts_lit(as_of))
    )
    by_id = rows.filter("AppOwnerID IS NOT NULL")
    by_name = rows.filter("AppOwnerID IS NULL").drop("AppOwnerID")
    updated = upsert_by_key(owners, by_id, "AppOwnerID", order=order)
    fresh = {"AppOwnerID": _new_id(*[f"_c_{c}" for c in natural])}
    return upsert_by_key(updated, by_name, natural, on_insert=fresh, order=order)


def delete_by_id(dim: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The dimension without the rows whose ``key`` is listed."""
    return dim.join(ids.select(key).distinct(), key, "left_anti")


def rows_deleted(dim: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """How many rows :func:`delete_by_id` removes."""
    gone = dim.join(ids.select(key).distinct(), key, "left_semi")
    return gone.agg(F.count(F.lit(1)).alias("RowsDeleted"))


# ---------------------------------------------------------------------- targets


def servers_in_group(registered: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Servers registered under a named group."""
    wanted = groups.filter(F.col("name") == group).select("server_group_id")
    return registered.join(wanted, "server_group_id", "left_semi").select(F.col("server_name").alias("ServerName"))


def resolve_targets(registry: DataFrame | None, config: DataFrame, inventory: DataFrame, platform: str) -> DataFrame:
    """Who a run contacts and how.

    Configured entries win over registered ones; active inventory rows fill
    gaps. A Redshift cluster needs a host and has no registry.
    """

    def source(df, name, priority, auth, user):
        return df.select(
            F.lit(platform).alias("Platform"),
            "ServerName",
            auth.alias("AuthType"),
            user.alias("UserName"),
            F.lit(name).alias("Source"),
            F.lit(priority).alias("_priority"),
        )

    active = inventory.filter(F.col("IsActive") & (F.col("Platform") == platform))
    if platform == "Redshift":
        active = active.filter(F.col("Host").isNotNull())
    sql_login = F.col("UserName").isNotNull()
    parts = [
        source(config, "config", 0, F.when(sql_login, "sql").otherwise("windows"), F.col("UserName")),
        source(active, "inventory", 2, F.coalesce("AuthType", F.lit("windows")), F.col("UserName")),
    ]
    if registry is not None and platform == "MSSQL":
        parts.append(source(registry, "registry", 1, F.lit("windows"), F.lit(None).cast("string")))
    rows = reduce(DataFrame.unionByName, parts)
    return first_per_key(rows, ["Platform", "ServerName"], "_priority", F.asc_nulls_last("UserName")).drop("_priority")
