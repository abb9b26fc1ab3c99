"""Feed normalisation and table upserts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskline.functions import parse_iso
from deskline.operators.upsert import load_new, upsert
from deskline.sources.schemas import CONTRACT_UNIT_COLS, TIME_ENTRY_COLS


def _lit_ts(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")


def _stamp(df: DataFrame, c: str) -> Column:
    """Text stamps go through B1; typed stamps pass (as zone-less)."""
    if c not in df.columns:
        return F.lit(None).cast("timestamp_ntz")
    if dict(df.dtypes)[c] == "string":
        return parse_iso(c).cast("timestamp_ntz")
    return F.col(c).cast("timestamp_ntz")


def _get(df: DataFrame, c: str, typ: str) -> Column:
    return (F.col(c) if c in df.columns else F.lit(None)).cast(typ)


def normalize_units(df: DataFrame) -> DataFrame:
    """I4 + B6: contract-unit feed -> ContractUnits columns.

    Prices and units default to 0, the invoice text to ''; stamps through B1. Extra columns
    (arrival order) are kept at the end for the upsert.
    """
    extra = [c for c in df.columns if c not in CONTRACT_UNIT_COLS]
    return df.select(
        _get(df, "id", "bigint").alias("id"),
        _get(df, "contractID", "bigint").alias("contractID"),
        _get(df, "serviceID", "bigint").alias("serviceID"),
        _stamp(df, "startDate").alias("startDate"),
        _stamp(df, "endDate").alias("endDate"),
        _stamp(df, "approveAndPostDate").alias("approveAndPostDate"),
        F.coalesce(_get(df, "unitCost", "double"), F.lit(0.0)).alias("unitCost"),
        F.coalesce(_get(df, "unitPrice", "double"), F.lit(0.0)).alias("unitPrice"),
        F.coalesce(_get(df, "internalCurrencyPrice", "double"), F.lit(0.0)).alias("internalCurrencyPrice"),
        _get(df, "organizationalLevelAssociationID", "bigint").alias("organizationalLevelAssociationID"),
        F.coalesce(_get(df, "invoiceDescription", "string"), F.lit("")).alias("invoiceDescription"),
        F.coalesce(_get(df, "units", "double"), F.lit(0.0)).alias("units"),
        *extra,
    )


def normalize_time_entries(df: DataFrame, as_of) -> DataFrame:
    """I5 + B6: contractID null -> 0, lastModified null -> ``as_of``; stamps through B1."""
    extra = [c for c in df.columns if c not in TIME_ENTRY_COLS and c != "userDefinedFields"]
    types = {"id": "bigint", "contractID": "bigint", "contractServiceBundleID": "bigint", "contractServiceID": "bigint",
             "creatorUserID": "bigint", "hoursToBill": "double", "hoursWorked": "double", "internalNotes": "string",
             "isNonBillable": "boolean", "resourceID": "bigint", "roleID": "bigint", "summaryNotes": "string",
             "taskID": "bigint", "ticketID": "bigint", "timeEntryType": "int"}
    cols = []
    for c in TIME_ENTRY_COLS:
        if c == "contractID":
            v = F.coalesce(_get(df, c, "bigint"), F.lit(0).cast("bigint"))
        elif c == "lastModifiedDateTime":
            v = F.coalesce(_stamp(df, c), _lit_ts(as_of))
        elif c in types:
            v = _get(df, c, types[c])
        else:
            v = _stamp(df, c)
        cols.append(v.alias(c))
    return df.select(*cols, *extra)


def failed_rules(rules: dict[str, Column]) -> Column:
    """The names of the rules that do not hold; a null result counts as a failure."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good rows, rejects with the failed rule names, accepted/failed counts).

    Each rule is a boolean Column that must be true; a null result counts as a failure.
    """
    valid = reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in rules.values()], F.lit(True))
    counts = df.groupBy(valid.alias("valid")).agg(F.count(F.lit(1)).alias("rows"))
    return df.filter(valid), df.filter(~valid).withColumn("failed_rules", failed_rules(rules)), counts


def upsert_units(target: DataFrame, batch: DataFrame, order_by: Sequence[str],
                 target_empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """ContractUnits on ``id``; every other column is updated, last arrival wins.

    ``target_empty`` (first load) skips the join: the result is the batch's dedupe.
    """
    if target_empty:
        return load_new(target, batch, ["id"], order_by)
    return upsert(target, batch, ["id"], order_by)


def upsert_time_entries(target: DataFrame, batch: DataFrame, order_by: Sequence[str],
                        target_empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """TimeEntries on ``id``; every other column is updated, last arrival wins.

    Arrival order, not ``lastModifiedDateTime``: an older modification arriving later overwrites a
    newer one (no late-data check), as in the row-by-row MERGE.
    """
    if target_empty:
        return load_new(target, batch, ["id"], order_by)
    return upsert(target, batch, ["id"], order_by)


def upsert_contracts(target: DataFrame, batch: DataFrame, order_by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """U1 (inferred): Contracts on ``id``; every other column is updated."""
    return upsert(target, batch, ["id"], order_by)
