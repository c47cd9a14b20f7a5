"""Ordered resolution of conflicts: of two that can't both stand the weaker goes, unless the stronger went itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import events as ev
from ..session import shared_dir
from .fate import NONE, discard

c = F.col


def losers(edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """edges (strong, weak), each pair of rivals once, without cycles -> id of those that lose, as if all were taken from the strongest on.

    In a round every node without an open stronger rival stands, and its rivals lose; what these would
    have beaten is open again. So rounds follow the longest chain of rivals, not their number, and
    nothing but whether edges are left comes to the driver. Tables are checkpointed in the shared folder.
    """
    shared_dir(edges.sparkSession)
    edges = edges.select("strong", "weak").distinct().checkpoint()
    lost = edges.select(c("weak").alias("id")).limit(0)
    for _ in range(most_rounds):
        if edges.isEmpty():
            return lost
        stands = edges.select(c("strong").alias("id")).distinct().join(edges.select(c("weak").alias("id")).distinct(), "id", "left_anti")
        gone = edges.join(stands.withColumnRenamed("id", "strong"), "strong", "left_semi").select(c("weak").alias("id")).distinct().checkpoint()
        lost = lost.unionByName(gone).checkpoint()
        edges = edges.join(gone.withColumnRenamed("id", "strong"), "strong", "left_anti").join(gone.withColumnRenamed("id", "weak"), "weak", "left_anti").checkpoint()
    raise RuntimeError("conflicts did not settle")


def strength() -> Column:
    """What decides between two events: kinds of reads, supporting reads, a small e-value, then the id."""
    kinds = (c("split1") > 0).cast("int") + (c("split2") > 0).cast("int") + (c("disc") > 0).cast("int")
    return F.struct(kinds.alias("kinds"), ev.support().cast("bigint").alias("support"), (-c("evalue")).alias("evalue"), c("event_id").alias("name"))


def homologous_partners(df: DataFrame, homologs: DataFrame) -> DataFrame:
    """Live events of homologous genes get the fate homologs; of two that share a gene and whose other genes are homologs, the weaker one does.

    homologs (gene1, gene2): pairs in any order. Reads of one event that map to a homolog make the
    other, so events with the same breakpoint in the partner are no rivals. The strongest events are
    settled first, whatever the table's order.
    """
    pairs = homologs.select("gene1", "gene2").unionByName(homologs.select(c("gene2").alias("gene1"), c("gene1").alias("gene2"))).where("gene1 <> gene2").distinct()
    df = discard(df.join(pairs.withColumn("__own", F.lit(True)), ["gene1", "gene2"], "left"), "homologs", c("__own")).drop("__own")
    live = df.where(c("fate") == NONE).withColumn("power", strength())
    side = lambda own, other: live.select("event_id", "power", c(f"gene{own}").alias("shared"), c(f"gene{other}").alias("partner"), c(f"bp{other}").alias("at"))
    sides = side(1, 2).unionByName(side(2, 1))
    asks = sides.join(pairs.select(c("gene1").alias("partner"), c("gene2").alias("rival")), "partner")
    met = sides.select(c("event_id").alias("e2"), c("power").alias("p2"), "shared", c("partner").alias("rival"), c("at").alias("at2"))
    edges = asks.join(met, ["shared", "rival"]).where((c("at") != c("at2")) & (c("power") > c("p2"))).select(c("event_id").alias("strong"), c("e2").alias("weak"))
    out = losers(edges).withColumnRenamed("id", "event_id").withColumn("__lost", F.lit(True))
    return discard(df.join(out, "event_id", "left"), "homologs", c("__lost")).drop("__lost")
