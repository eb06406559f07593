"""The SKU catalogue: header search, clean entries, duplicates, lookup and containers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import constants as K
from spanforge.functions import text as T

FIELDS = ("category", "description", "common_name", "spec", "uom", "unit_price")
#: name, diameter in inches, volume in quarts
CONTAINERS = [("1 qt", 4.0, 1.0), ("2 qt", 5.5, 2.0), ("3 qt", 6.5, 3.0), ("1 gal", 6.5, 4.0), ("2 gal", 8.5, 8.0), ("3 gal", 10.0, 12.0), ("5 gal", 12.0, 20.0)]


def header_rows(cells: DataFrame, keys: list[str], first_rows: int = 25) -> DataFrame:
    """First row of each sheet that names a SKU column and three known columns or more: ``header_row``."""
    named = cells.filter(F.col("row_no") <= first_rows).withColumn("name", T.column_name(F.col("value")))
    rows = named.groupBy(*keys, "row_no").agg(F.count_distinct(F.when(F.col("name").isin(*K.KNOWN_COLUMNS), F.col("name"))).alias("known"), F.max(F.col("name") == "raw_sku").alias("has_sku"))
    return rows.filter("has_sku and known >= 3").groupBy(*keys).agg(F.min("row_no").alias("header_row"))


def table_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows below each sheet's header with the known columns as fields; the first column of a name counts."""
    found = cells.join(header_rows(cells, keys), keys)
    heads = found.filter(F.col("row_no") == F.col("header_row")).groupBy(*keys, T.column_name(F.col("value")).alias("name")).agg(F.min("col_no").alias("col_no"))
    body = found.filter(F.col("row_no") > F.col("header_row")).join(heads, [*keys, "col_no"])
    return body.groupBy(*keys, "row_no").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in K.KNOWN_COLUMNS])


def entries(rows: DataFrame) -> DataFrame:
    """Clean catalogue entries; ``missing_sku`` marks rows without one."""
    out = rows.withColumns({c: T.clean_text(F.col(c)) for c in ("category", "description", "common_name", "spec", "uom")})
    return out.withColumns({"unit_price": T.clean_price(F.col("unit_price")), "sku": T.require_valid_sku(T.clean_sku_cell(F.col("raw_sku"))), "pot_prior": T.spec_prior(F.col("spec"))}).withColumn("missing_sku", F.col("sku").isNull())


def completeness(prior_available: Column, *fields: Column) -> Column:
    """Filled fields, and two more for a parsed prior."""
    filled = reduce(lambda a, b: a + b, [F.when(f.isNotNull() & (f.cast("string") != ""), 1).otherwise(0) for f in fields])
    return filled + F.when(F.coalesce(prior_available, F.lit(False)), 2).otherwise(0)


def dedupe(rows: DataFrame, *, key: str = "sku", order: str = "ord", score: str = "score", fields: list[str]) -> DataFrame:
    """Winner of each key, how many rows it had and whether any conflicted with the winner before it.

    A later row wins only with a higher score. It conflicts when a field that both have
    filled differs from the winner so far, so what conflicts depends on the order.
    """
    values = F.struct(*[F.col(f).cast("string").alias(f) for f in fields])
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.max(F.struct(F.col(score), (-F.col(order)).alias("o"), values.alias("v"))).over(before)
    differs = reduce(lambda a, b: a | b, [F.coalesce((F.col(f"w.v.{f}") != F.col(f).cast("string")) & (F.col(f"w.v.{f}") != "") & (F.col(f).cast("string") != ""), F.lit(False)) for f in fields])
    judged = rows.withColumn("w", so_far).withColumn("conflict", differs).drop("w")
    best = Window.partitionBy(key).orderBy(F.col(score).desc(), order)
    whole = Window.partitionBy(key)
    out = judged.withColumns({"nth": F.row_number().over(best), "n_rows": F.count(F.lit(1)).over(whole), "has_conflict": F.bool_or("conflict").over(whole)})
    return out.filter("nth = 1").drop("nth", "conflict")


def build_report(all_rows: DataFrame, winners: DataFrame) -> DataFrame:
    """One row: rows seen, without SKU, kept, repeated, conflicting, and the first 25 specifications that were not parsed."""
    unparsed = F.array_contains(F.col("pot_prior.notes"), "spec_unparsed")
    seen = all_rows.agg(F.count(F.lit(1)).alias("n_rows_seen"), F.count_if("missing_sku").alias("n_missing_sku"))
    first = all_rows.filter(unparsed).select("spec").distinct().orderBy("spec").limit(25)
    specs = first.agg(F.array_sort(F.collect_list("spec")).alias("unparsed_specs"))
    kept = winners.agg(F.count(F.lit(1)).alias("n_skus"), F.count_if(F.col("n_rows") > 1).alias("n_repeated"), F.count_if("has_conflict").alias("n_conflicting"))
    return seen.crossJoin(F.broadcast(kept)).crossJoin(F.broadcast(specs))  # one row each


def lookup(rows: DataFrame, catalogue: DataFrame, *, sku: str = "sku") -> DataFrame:
    """Left join on the SKU: the exact one, else in upper case, else in any case; ``status`` found or not_found.

    Each step is an equality join against catalogue keys that are unique for it, so no
    row multiplies. Rows without a SKU get keys of their own that meet nothing, so that they
    do not all go to one task.
    """
    clean = rows.withColumn("clean_sku", T.require_valid_sku(F.col(sku)))
    own_key = F.concat(F.lit("\0"), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("string"))
    clean = clean.withColumn("exact_key", F.coalesce("clean_sku", own_key))
    fields = [c for c in catalogue.columns if c != "sku"]
    entry = F.struct(*[F.col(c) for c in fields])
    exact = catalogue.select(F.col("sku").alias("exact_key"), entry.alias("exact"))
    loose = catalogue.groupBy(F.lower("sku").alias("low_sku")).agg(F.min_by(entry, "sku").alias("loose"))
    joined = clean.withColumn("low_sku", F.lower("exact_key")).join(exact, "exact_key", "left").join(loose, "low_sku", "left")
    item = F.coalesce("exact", "loose")
    return joined.select(*rows.columns, "clean_sku", F.when(item.isNotNull(), "found").otherwise("not_found").alias("status"), *[item[c].alias(c if c not in rows.columns else f"catalogue_{c}") for c in fields])


def sku_mapping(items: DataFrame) -> DataFrame:
    """One table of three JSON forms: a list of records, an object by SKU, ``{items: ...}``. ``items``: json text per file."""
    record = "struct<sku:string,category:string,common_name:string,spec:string>"
    as_list = F.from_json(F.col("json"), f"array<{record}>")
    inner = F.get_json_object("json", "$.items")
    body = F.coalesce(inner, F.col("json"))
    body_list, body_map = F.from_json(body, f"array<{record}>"), F.from_json(body, f"map<string,{record}>")
    is_list = lambda c: F.ltrim(c).startswith("[")
    entries_ = F.when(is_list(F.col("json")), as_list).when(is_list(body), body_list).otherwise(F.transform(F.map_entries(body_map), lambda e: e["value"].withField("sku", F.coalesce(e["value"]["sku"], e["key"]))))
    return items.select(F.explode(entries_).alias("e")).select("e.*").withColumn("sku", T.require_valid_sku(F.col("sku"))).filter("sku is not null")


def nearest(rows: DataFrame, volume: str = "volume_qt") -> DataFrame:
    """Each volume's nearest container, the first on a tie, with the confidence that the distance gives."""
    best = T.nearest_container(F.col(volume), CONTAINERS)
    return rows.withColumns({"container": best["name"], "container_diameter_in": best["diameter_in"], "container_delta": best["delta"], "confidence": F.when(best["delta"] <= 1.0, "medium").when(best["delta"].isNotNull(), "low")})
