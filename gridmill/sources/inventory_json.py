"""Instance inventory documents: nested JSON array to flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INVENTORY_SCHEMA = (
    "array<struct<account:struct<name:string,owner_id:string>,instance_id:string,"
    "create_date:string,region:struct<name:string>,engine:string,version:string,"
    "auto_update:boolean,is_multi_zone:boolean,endpoint:string,username:string,"
    "flavor:string,price_per_month:string,hourly_cost:string,is_active:boolean>>"
)


def flatten_inventory(documents: DataFrame, col: str = "value") -> DataFrame:
    """16 columns per instance of every document; a lone object counts as one instance."""
    rows = documents.select(F.inline(F.from_json(F.col(col), INVENTORY_SCHEMA)))
    endpoint = F.split("endpoint", ":")
    return rows.select(
        F.col("account.name").alias("account_name"),
        F.col("account.owner_id").alias("account_number"),
        F.col("instance_id").alias("instance_name"),
        F.col("create_date"),
        F.col("region.name").alias("region"),
        "engine",
        "version",
        "auto_update",
        "is_multi_zone",
        F.get(endpoint, F.lit(0)).alias("endpoint"),
        F.get(endpoint, F.lit(1)).alias("port"),
        F.col("username").alias("master_user"),
        F.col("flavor").alias("db_class"),
        _money("price_per_month").alias("ppm"),
        _money("hourly_cost").alias("pph"),
        "is_active",
    )


def _money(col: str) -> Column:
    """'$1,234.00' as a number; a blank cost is 0.00."""
    digits = F.regexp_replace(F.col(col), r"[$,]", "")
    return F.when(digits == "", F.lit("0.00")).otherwise(digits).try_cast("decimal(18,4)")
