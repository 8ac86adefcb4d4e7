"""Entity chains in cells: one row per chain with its six components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierflow.functions import text as X

COMPONENTS = ("reference", "system_info", "process", "personal", "physical_quantity", "quantity_value")


def parse_chains(df: DataFrame, cell: Column, keep: list[str]) -> DataFrame:
    """One row per chain that names a reference; null and blank cells give none."""
    chains = df.select(*keep, F.posexplode(F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), ";"), X.ustrip), lambda x: x != "")).alias("chain_no", "chain"))
    return with_components(chains, "chain").where("reference != ''").select(*keep, (F.col("chain_no") + 1).alias("chain_no"), "chain", *COMPONENTS)


def with_components(chains: DataFrame, chain: str) -> DataFrame:
    """Adds the six components of each chain (as text.chain_fields), in steps, so that no chain is divided twice."""
    blank = lambda x: F.when(X.ustrip(x) == "#", "").otherwise(X.ustrip(x))
    piped = F.col(chain).contains("|")
    r = chains.withColumn("_piped", piped).withColumn("_raw", F.when(F.col("_piped"), F.split(chain, r"\|")).otherwise(F.split(chain, "-")))
    r = r.withColumn("_f", F.transform("_raw", blank)).withColumn("_n", F.size("_f"))
    n, f = F.col("_n"), F.col("_f")
    at = lambda i: F.coalesce(F.get(f, F.lit(i)), F.lit(""))
    extra = F.array_join(F.filter(F.slice(f, 7, F.greatest(n - 6, F.lit(0))), lambda x: x != ""), "|")
    value = F.when((n > 6) & (extra != ""), F.btrim(F.concat(at(5), F.lit("|"), extra), F.lit("|"))).otherwise(at(5))
    head = blank(F.array_join(F.slice("_raw", 1, F.greatest(n - 4, F.lit(0))), "-"))
    right = lambda k: F.when(n >= 5, F.get(f, n - k)).otherwise(at(5 - k))
    old = ~F.col("_piped")
    made = {
        "reference": F.when(old & (n >= 5), head).otherwise(at(0)),
        "system_info": F.when(old, right(4)).otherwise(at(1)),
        "process": F.when(old, right(3)).otherwise(at(2)),
        "personal": F.when(old, right(2)).otherwise(at(3)),
        "physical_quantity": F.when(old | (n == 5), "").otherwise(at(4)),
        "quantity_value": F.when(old, right(1)).when(n == 5, at(4)).otherwise(value),
    }
    return r.withColumns(made).drop("_piped", "_raw", "_f", "_n")
