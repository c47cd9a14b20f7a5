"""Reads and events projected from the star schema, so that every operator runs over the driver's tables.

The projections are arithmetic that Spark and other engines evaluate alike; the operators are the
library's own. The SQL beside each query says the same in plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import events as ev
from ..functions import sequence as sq
from ..functions import cigar
from ..operators import event_filters as ef
from ..operators import annotate, conflicts, fate, intervals, pivot, rules, stats
from ..operators import read_filters as rf

GENE = "{g} * 20000 AS g{i}_start, {g} * 20000 + 30000 + ({g} % 3) * 40000 AS g{i}_end, {g} % 3 <> 0 AS g{i}_strand, {g} % 11 = 5 AS g{i}_dummy, {g} % 2 = 0 AS g{i}_coding"

READS = """
SELECT concat_ws('.', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS read_key,
       l_orderkey AS read_group, gene1, gene2, gene1 % 4 AS contig1, gene2 % 4 AS contig2,
       gene1 * 20000 + tens * 7 AS bp1,
       CASE WHEN gene1 = gene2 THEN gene1 * 20000 + tens * 7 + five * 31 ELSE gene2 * 20000 + five * 11 END AS bp2,
       dir1, dir2,
       CASE WHEN l_linenumber <= 2 THEN 'split1' WHEN l_linenumber = 3 THEN 'split2' ELSE 'discordant' END AS role,
       CASE WHEN l_orderkey % 17 = 0 THEN 'homopolymer' WHEN l_partkey % 19 = 0 THEN 'mismatches' WHEN l_suppkey % 23 = 0 THEN 'duplicates' ELSE 'none' END AS fate,
       l_partkey % 5 <> 0 AS exonic1, l_suppkey % 5 <> 0 AS exonic2,
       gene1 * 20000 + tens * 7 + CASE WHEN dir1 = 'downstream' THEN -10 - l_linenumber * 5 ELSE 10 + l_linenumber * 5 END AS start1,
       gene2 * 20000 + five * 11 + CASE WHEN dir2 = 'downstream' THEN -8 - l_linenumber * 4 ELSE 8 + l_linenumber * 4 END AS start2,
       l_orderkey % 3 = 0 AS forward, CAST(floor(l_extendedprice) AS BIGINT) % 100 AS score, l_quantity AS quantity
FROM (SELECT *, l_partkey % 40 AS gene1, CASE WHEN l_suppkey % 7 = 0 THEN l_partkey % 40 ELSE 40 + l_suppkey % 10 END AS gene2,
             CAST(floor(l_quantity / 10) AS BIGINT) AS tens, l_orderkey % 5 AS five,
             CASE WHEN l_linestatus = 'O' THEN 'downstream' ELSE 'upstream' END AS dir1,
             CASE WHEN l_returnflag = 'A' THEN 'upstream' ELSE 'downstream' END AS dir2
      FROM {lineitem}) AS l
"""

EVENTS = f"""
SELECT *, concat_ws(':', CAST(gene1 AS STRING), CAST(gene2 AS STRING), CAST(bp1 AS STRING), CAST(bp2 AS STRING), dir1, dir2) AS event_id,
       (bp1 + gene2) % 3 = 0 AS spliced1, (bp2 + gene1) % 2 = 0 AS spliced2,
       CAST((bp1 * 7 + bp2 * 3 + gene2) % 100 AS DOUBLE) / 100 AS evalue, (bp1 * 13) % 97 AS cov1, (bp2 * 17) % 89 AS cov2,
       CASE WHEN (bp1 + bp2) % 9 = 0 THEN bp1 + 50 END AS gbp1, CASE WHEN (bp1 + bp2) % 9 = 0 THEN bp2 - 30 END AS gbp2,
       bp1 + CASE WHEN dir1 = 'downstream' THEN -(gene2 % 40) ELSE gene2 % 40 END AS anchor1,
       bp2 + CASE WHEN dir2 = 'downstream' THEN -(gene1 % 45) ELSE gene1 % 45 END AS anchor2,
       contig1 = 3 AND gene1 % 7 = 0 AS viral1, contig2 = 3 AND gene2 % 7 = 0 AS viral2,
       {GENE.format(g="gene1", i=1)}, {GENE.format(g="gene2", i=2)},
       CAST(gene1 % 10 AS DOUBLE) / 10 AS g1_intronic_fraction, CAST(gene2 % 10 AS DOUBLE) / 10 AS g2_intronic_fraction,
       CASE (bp1 + 2 * bp2 + gene2) % 8 WHEN 0 THEN 'relative_support' WHEN 1 THEN 'min_support' WHEN 2 THEN 'select_best' WHEN 3 THEN 'in_vitro'
            WHEN 4 THEN 'intronic' WHEN 5 THEN 'inconsistently_clipped' ELSE 'none' END AS fate,
       (bp1 + bp2) % 5 AS unique_reads, (bp1 + bp2) % 4 AS exonic_reads, CAST(floor((bp2 - bp1) * (gene1 % 3 + 1) / 3) AS BIGINT) AS spliced_distance,
       (bp1 + bp2) % 3 = 0 AS ambiguous, bp1 % 2 = 0 AS strand1, bp2 % 2 = 0 AS strand2,
       gene1 * 7 % 50 AS x1, gene2 * 11 % 60 AS x2, bp1 % 3 AS clipped1, bp2 % 4 AS clipped2, gene1 % 10 AS neighbours,
       gene1 % 6 = 0 AS terminal1, gene2 % 6 = 1 AS terminal2, bp1 % 4 <> 0 AS side_covered1, bp2 % 3 <> 0 AS side_covered2,
       gene1 % 2 = 0 AS same_coding_exon, (split1 + split2) * 4 AS all_split, listed_split % 3 AS spared_split1, listed_split % 2 AS spared_split2, 0.1 AS duplicate_rate,
       gene1 % 4 + 1 AS p1, gene2 % 5 + 1 AS p2, 1000 + gene1 * 10 AS l1, 2000 + gene2 * 10 AS l2, CAST((bp1 + bp2) % 3 AS INT) AS confidence
FROM (SELECT gene1, gene2, contig1, contig2, bp1, bp2, dir1, dir2,
             CAST(count(CASE WHEN role = 'split1' AND fate = 'none' THEN 1 END) AS BIGINT) AS split1,
             CAST(count(CASE WHEN role = 'split2' AND fate = 'none' THEN 1 END) AS BIGINT) AS split2,
             CAST(count(CASE WHEN role = 'discordant' AND fate = 'none' THEN 1 END) AS BIGINT) AS disc,
             count(*) AS listed, count(CASE WHEN role <> 'discordant' THEN 1 END) AS listed_split, max(exonic1) AS exonic1, max(exonic2) AS exonic2
      FROM reads_v GROUP BY gene1, gene2, contig1, contig2, bp1, bp2, dir1, dir2) AS e
"""

GENES = "SELECT p_partkey AS id, p_partkey % 4 AS contig, p_partkey * 53 AS start, p_partkey * 53 + p_size * 40 AS {end}, p_partkey % 40 AS gene FROM {part}"
POINTS = "SELECT concat_ws('.', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS point, l_suppkey % 4 AS contig, (l_orderkey * 31 + l_partkey) % 120000 AS pos FROM {lineitem}"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

Frame = Callable[[str], DataFrame]
_DUCK_READS = READS.replace("{lineitem}", "lineitem")
_WITH = (
    f"WITH reads_v AS ({_DUCK_READS}), events_v AS ({EVENTS}), "
    f"genes_v AS ({GENES.replace('{part}', 'part').replace('{end}', chr(34) + 'end' + chr(34))}), points_v AS ({POINTS.replace('{lineitem}', 'lineitem')}) "
)


class Tables:
    """The projections as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def reads(self) -> DataFrame:
        return self.spark.sql(READS, lineitem=self.table("lineitem"))

    @property
    def events(self) -> DataFrame:
        return self.spark.sql(EVENTS.replace("reads_v", "{reads}"), reads=self.reads)

    @property
    def genes(self) -> DataFrame:
        return self.spark.sql(GENES.replace("{end}", "`end`"), part=self.table("part"))

    @property
    def points(self) -> DataFrame:
        return self.spark.sql(POINTS, lineitem=self.table("lineitem"))


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a function of Tables as a query, with its SQL over reads_v, events_v, genes_v and points_v."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[key] = _WITH + sql
        return f

    return add


#: SQL of the derived predicates.
RT = "(contig1 = contig2 AND bp2 - bp1 < 400000 AND dir1 = 'downstream' AND dir2 = 'upstream')"
OVER = "(bp1 BETWEEN g2_start AND g2_end OR bp2 BETWEEN g1_start AND g1_end)"
INTRA = "(gene1 = gene2 OR (bp1 BETWEEN g2_start - 10000 AND g2_end + 10000 AND bp2 BETWEEN g1_start - 10000 AND g1_end + 10000))"
BOTH = "(spliced1 AND spliced2 AND CASE WHEN g1_strand = g2_strand THEN dir1 <> dir2 ELSE dir1 = dir2 END)"
ITD = "(gene1 = gene2 AND bp2 - bp1 >= 0 AND bp2 - bp1 < 100 AND dir1 = 'upstream' AND dir2 = 'downstream')"
SUP = "(split1 + split2 + disc)"
FIVE1 = "CASE WHEN g1_strand THEN dir1 = 'downstream' ELSE dir1 = 'upstream' END"
FIVE2 = "CASE WHEN g2_strand THEN dir2 = 'downstream' ELSE dir2 = 'upstream' END"


def discarded(name: str, condition: str) -> str:
    return f"SELECT event_id, CASE WHEN fate = 'none' AND coalesce({condition}, false) THEN '{name}' ELSE fate END AS fate FROM events_v"


def recovered(fates: str, condition: str, source: str = "events_v") -> str:
    return f"SELECT event_id, CASE WHEN fate IN ({fates}) AND coalesce({condition}, false) THEN 'none' ELSE fate END AS fate FROM {source}"


def fates(df: DataFrame) -> DataFrame:
    return df.select("event_id", "fate")


# reads

DUP = "contig1, contig2, bp1, bp2, dir1, dir2"


@query(
    """SELECT read_key, CASE WHEN fate = 'none' AND row_number() OVER (PARTITION BY fate = 'none', CASE WHEN start1 > start2 THEN contig2 ELSE contig1 END, CASE WHEN start1 > start2 THEN contig1 ELSE contig2 END,
       least(start1, start2), greatest(start1, start2) ORDER BY read_key) > 1 THEN 'duplicates' ELSE fate END AS fate FROM reads_v"""
)
def mark_duplicates(t: Tables) -> DataFrame:
    d = rf.ordered_ends(t.reads, F.col("contig1"), F.col("contig2"), F.col("start1"), F.col("start2"))
    return rf.mark_duplicates(d, ["contig1", "contig2", "pos1", "pos2"]).select("read_key", "fate")


@query("SELECT read_key, CASE WHEN fate = 'none' AND forward THEN 'duplicates' ELSE fate END AS fate FROM reads_v")
def flagged_duplicates(t: Tables) -> DataFrame:
    return rf.mark_duplicates(t.reads, [], external="forward").select("read_key", "fate")


@query(f"SELECT avg(CASE WHEN n > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate FROM (SELECT row_number() OVER (PARTITION BY {DUP} ORDER BY read_key) AS n, fate FROM reads_v WHERE fate = 'none')")
def duplicate_rate(t: Tables) -> DataFrame:
    d = rf.mark_duplicates(t.reads.where("fate = 'none'"), DUP.split(", "))
    return d.agg(F.avg(F.when(F.col("fate") == "duplicates", 1.0).otherwise(0.0)).alias("rate"))


@query("SELECT read_key, CASE WHEN fate = 'none' AND (contig1 = 3 OR contig2 = 3) THEN 'low_coverage_viral_contigs' ELSE fate END AS fate FROM reads_v")
def low_coverage_reads(t: Tables) -> DataFrame:
    return rf.discard_contigs(t.reads, "low_coverage_viral_contigs", t.spark.range(3, 4).toDF("contig"), ("contig1", "contig2")).select("read_key", "fate")


@query("SELECT read_key, count(*) OVER (PARTITION BY read_group) > 1 AS multimapper FROM reads_v")
def mark_multimappers(t: Tables) -> DataFrame:
    return rf.mark_multimappers(t.reads).select("read_key", "multimapper")


@query("SELECT read_key, CASE WHEN fate = 'none' AND row_number() OVER (PARTITION BY read_group ORDER BY score DESC, gene1 DESC, gene2 % 2 DESC, bp1, bp2, read_key) > 1 THEN 'multimappers' ELSE fate END AS fate FROM reads_v")
def best_alignment_per_read(t: Tables) -> DataFrame:
    return ef.best_alignment(t.reads.withColumn("support", F.col("gene1")).withColumn("coding", F.col("gene2") % 2)).select("read_key", "fate")


#: Reads with their alignment's score, and the events that they support; a fragment is an order.
MULTI = """, known AS (SELECT read_key, read_group, r.event_id, role, score, r.fate, row_number() OVER (PARTITION BY read_group ORDER BY score DESC, split1 + split2 + disc DESC, g1_coding DESC, g2_coding DESC,
      e.contig1, e.contig2, e.bp1, e.bp2, e.dir1, e.dir2, e.event_id, read_key) AS n
      FROM (SELECT *, concat_ws(':', gene1, gene2, bp1, bp2, dir1, dir2) AS event_id FROM reads_v) r JOIN events_v e USING (event_id)),
    marked AS (SELECT *, CASE WHEN fate = 'none' AND n > 1 THEN 'multimappers' ELSE fate END AS after FROM known)"""


def _evidence(t: Tables) -> DataFrame:
    return t.reads.withColumn("event_id", F.concat_ws(":", "gene1", "gene2", "bp1", "bp2", "dir1", "dir2")).select("read_group", "read_key", "event_id", "role", "score", "fate")


@query(MULTI + " SELECT read_key, after AS fate FROM marked")
def multimapper_reads(t: Tables) -> DataFrame:
    return ef.multimappers(_evidence(t), t.events)[0].select("read_key", "fate")


@query(
    MULTI
    + f""", gone AS (SELECT event_id, count(CASE WHEN role = 'split1' THEN 1 END) AS a, count(CASE WHEN role = 'split2' THEN 1 END) AS b, count(CASE WHEN role = 'discordant' THEN 1 END) AS d FROM marked WHERE after = 'multimappers' GROUP BY event_id),
    less AS (SELECT e.event_id, e.fate, fate = 'none' AND a IS NOT NULL AND {SUP} > 0 AS o, split1, split2, disc, a, b, d FROM events_v e LEFT JOIN gone USING (event_id)),
    done AS (SELECT event_id, fate, o, CASE WHEN o THEN greatest(0, split1 - a) ELSE split1 END AS split1, CASE WHEN o THEN greatest(0, split2 - b) ELSE split2 END AS split2, CASE WHEN o THEN greatest(0, disc - d) ELSE disc END AS disc FROM less)
    SELECT event_id, split1, split2, disc, CASE WHEN o AND {SUP} = 0 THEN 'multimappers' ELSE fate END AS fate FROM done"""
)
def multimapper_events(t: Tables) -> DataFrame:
    return ef.multimappers(_evidence(t), t.events)[1].select("event_id", "split1", "split2", "disc", "fate")


@query(
    """SELECT gene1, gene2, bp1, bp2, dir1, dir2, least(count(CASE WHEN role = 'split1' AND fate = 'none' THEN 1 END), 300)::BIGINT AS split1,
       least(count(CASE WHEN role = 'split2' AND fate = 'none' THEN 1 END), 300)::BIGINT AS split2, least(count(CASE WHEN role = 'discordant' AND fate = 'none' THEN 1 END), 300)::BIGINT AS disc,
       count(*) AS listed, count(CASE WHEN role <> 'discordant' THEN 1 END) AS listed_split, bool_or(exonic1) AS exonic1, bool_or(exonic2) AS exonic2,
       CASE WHEN dir1 = 'downstream' THEN min(start1) ELSE max(start1) END AS anchor1, CASE WHEN dir2 = 'downstream' THEN min(start2) ELSE max(start2) END AS anchor2
       FROM reads_v GROUP BY gene1, gene2, contig1, contig2, bp1, bp2, dir1, dir2"""
)
def pivot_events(t: Tables) -> DataFrame:
    return pivot.pivot_events(t.reads).drop("fate", "contig1", "contig2")


@query(
    """SELECT gene1, gene2, bp1, bp2, dir1, dir2, CASE WHEN count(CASE WHEN fate = 'none' THEN 1 END) > 0 THEN 'none'
       ELSE coalesce(arg_min(CASE WHEN fate <> 'duplicates' THEN fate END, CASE WHEN fate <> 'duplicates' THEN read_key END), 'duplicates') END AS fate
       FROM reads_v GROUP BY gene1, gene2, contig1, contig2, bp1, bp2, dir1, dir2"""
)
def fate_first_wins(t: Tables) -> DataFrame:
    return pivot.pivot_events(t.reads).select("gene1", "gene2", "bp1", "bp2", "dir1", "dir2", "fate")


@query("SELECT concat_ws(':', gene1, gene2, bp1, bp2, dir1, dir2) AS event_id, sum(CASE WHEN forward THEN 1 ELSE 0 END) > sum(CASE WHEN forward THEN 0 ELSE 1 END) AS strand, sum(CASE WHEN forward THEN 1 ELSE 0 END) = sum(CASE WHEN forward THEN 0 ELSE 1 END) AS ambiguous FROM reads_v WHERE NOT (role = 'discordant' AND fate = 'mismatches') GROUP BY event_id")
def strand_vote(t: Tables) -> DataFrame:
    e = t.reads.withColumn("event_id", F.concat_ws(":", "gene1", "gene2", "bp1", "bp2", "dir1", "dir2"))
    e = e.withColumn("read_fate", F.when(F.col("fate") == "mismatches", F.lit("hairpin")).otherwise(F.col("fate")))
    return stats.strand_vote(e)


@query(
    """, named AS (SELECT concat_ws(':', gene1, gene2, bp1, bp2, dir1, dir2) AS event_id, fate AS name, count(*) AS n FROM reads_v WHERE fate <> 'none' GROUP BY ALL),
       ids AS (SELECT DISTINCT concat_ws(':', gene1, gene2, bp1, bp2, dir1, dir2) AS event_id FROM reads_v)
       SELECT ids.event_id, coalesce(string_agg(name || '(' || n || ')', ',' ORDER BY name), '.') AS filters FROM ids LEFT JOIN named USING (event_id) GROUP BY ids.event_id"""
)
def filters_column(t: Tables) -> DataFrame:
    e = t.reads.select(F.concat_ws(":", "gene1", "gene2", "bp1", "bp2", "dir1", "dir2").alias("event_id"), F.lit("none").alias("event_fate"), F.col("fate").alias("read_fate"))
    return ef.fates_column(e)


@query("SELECT gene1, gene2, dir1, dir2, read_key FROM (SELECT *, row_number() OVER (PARTITION BY gene1, gene2, dir1, dir2 ORDER BY read_key) AS n FROM reads_v) WHERE n <= 300")
def capped_reads(t: Tables) -> DataFrame:
    return pivot.capped(t.reads, ("gene1", "gene2", "dir1", "dir2"), "read_key").select("gene1", "gene2", "dir1", "dir2", "read_key")


@query(
    """SELECT e.event_id, least(count(DISTINCT r.read_key), 300)::BIGINT AS near_pairs FROM events_v e LEFT JOIN (SELECT gene1 AS a, gene2 AS b, dir1 AS x, dir2 AS y, start1 AS pos1, start2 AS pos2, read_key FROM reads_v WHERE role = 'discordant') r
       ON e.fate = 'none' AND a = gene1 AND b = gene2 AND x = dir1 AND y = dir2
       AND CASE WHEN dir1 = 'downstream' THEN pos1 BETWEEN bp1 - 40 AND bp1 + CASE WHEN split1 + split2 > 0 THEN 2 ELSE 40 END ELSE pos1 BETWEEN bp1 - CASE WHEN split1 + split2 > 0 THEN 2 ELSE 40 END AND bp1 + 40 END
       AND CASE WHEN dir2 = 'downstream' THEN pos2 BETWEEN bp2 - 40 AND bp2 + CASE WHEN split1 + split2 > 0 THEN 2 ELSE 40 END ELSE pos2 BETWEEN bp2 - CASE WHEN split1 + split2 > 0 THEN 2 ELSE 40 END AND bp2 + 40 END
       GROUP BY e.event_id"""
)
def discordant_support(t: Tables) -> DataFrame:
    pairs = t.reads.where("role = 'discordant'").select("gene1", "gene2", "dir1", "dir2", F.col("start1").alias("pos1"), F.col("start2").alias("pos2"), "read_key")
    return pivot.discordant_support(t.events, pairs, 40).select("event_id", "near_pairs")


# event predicates


def _predicate(name: str, condition: Callable[[], F.Column], sql: str) -> None:
    query(discarded(name, sql), name)(lambda t: fates(fate.discard(t.events, name, condition())))


_predicate("non_coding_neighbors", ef.non_coding_neighbors, f"{RT} AND NOT g1_coding AND NOT g2_coding")
_predicate("intragenic_exonic", ef.intragenic_exonic, f"(gene1 = gene2 OR {OVER}) AND exonic1 AND exonic2 AND NOT (spliced1 AND spliced2) AND (spliced_distance = bp2 - bp1 OR spliced_distance / greatest(bp2 - bp1, 1) < 0.33::DOUBLE)")
_predicate("min_support", ef.min_support, f"{SUP} < 2 OR ({OVER} AND split1 + split2 < 2)")
_predicate("relative_support", ef.relative_support, f"evalue >= 0.3::DOUBLE OR ({INTRA} AND split1 + split2 = 0)")
_predicate("intronic", ef.intronic, "exonic_reads = 0 AND NOT viral1 AND NOT viral2")
_predicate("no_genomic_support", ef.no_genomic_support, "confidence = 0 AND gbp1 IS NULL AND NOT viral1 AND NOT viral2")
_predicate("short_anchor", ef.short_anchor, "NOT (spliced1 AND spliced2) AND (abs(bp1 - anchor1) < 23 OR abs(bp2 - anchor2) < 23)")
_predicate(
    "end_to_end", ef.end_to_end,
    f"""NOT (viral1 OR viral2 OR (NOT {RT} AND gene1 <> gene2 AND (spliced1 OR spliced2)))
    AND (disc + split1 = 0 OR disc + split2 = 0 OR split1 + split2 = 0 OR ({OVER} AND (split1 = 0 OR split2 = 0))) AND (g1_dummy OR NOT {FIVE1}) AND (g2_dummy OR NOT {FIVE2})
    AND (disc < 10 OR (contig1 = contig2 AND bp2 - bp1 < 1000000) OR (exonic1 AND exonic2 AND g1_intronic_fraction > 0.66::DOUBLE AND g2_intronic_fraction > 0.66::DOUBLE))""",
)
_predicate(
    "marginal_read_through", lambda: ef.marginal_read_through(0.0005),
    f"""{RT} AND {SUP} < 0.07::DOUBLE * greatest(cov1, cov2) AND CASE
    WHEN NOT g1_dummy AND g1_strand THEN (bp1 - g1_start) / greatest(g1_end - g1_start, 1) > 0.0005::DOUBLE
    WHEN NOT g2_dummy AND NOT g2_strand THEN (g2_end - bp2) / greatest(g2_end - g2_start, 1) > 0.0005::DOUBLE
    WHEN NOT g1_dummy AND NOT g1_strand THEN (bp1 - g1_start) / greatest(g1_end - g1_start, 1) > 0.0005::DOUBLE
    WHEN NOT g2_dummy AND g2_strand THEN (g2_end - bp2) / greatest(g2_end - g2_start, 1) > 0.0005::DOUBLE ELSE false END""",
)
_predicate(
    "no_coverage", ef.no_coverage,
    f"""NOT (NOT {RT} AND ((split1 + split2 > 0 AND split1 + disc > 0 AND split2 + disc > 0) OR spliced1 OR spliced2)) AND NOT ({RT} AND spliced1 AND spliced2)
    AND ((NOT terminal1 AND NOT side_covered1) OR (NOT terminal2 AND NOT side_covered2))""",
)

INVITRO = f"""(split1 + split2 + least(clipped1, clipped2) <= 2 + 0.0001::DOUBLE * (x1 + x2)) AND (2 * (split1 + split2 + least(clipped1, clipped2)) <= disc OR split1 + split2 + least(clipped1, clipped2) <= 2) AND x1 + x2 > 20
  AND NOT ({SUP} >= 10 AND 4 * {SUP} >= greatest(cov1, cov2) AND cov1 > {SUP} AND cov2 > {SUP} AND (spliced1 OR spliced2) AND (spliced1 OR NOT exonic1) AND (spliced2 OR NOT exonic2))
  AND (rt > 1 OR (rt > 0 AND (x1 > 20 OR x2 > 20)) OR x1 > 40 OR x2 > 40 OR (x1 > 20 AND x2 > 20) OR neighbours > 8 OR {SUP} <= 1)"""


@query(
    f"""SELECT event_id, CASE WHEN (fate = 'none' OR ((spliced1 OR spliced2) AND fate IN ('relative_support', 'min_support', 'homopolymer'))) AND {INVITRO} THEN 'in_vitro' ELSE fate END AS fate
    FROM (SELECT *, CASE WHEN NOT exonic1 THEN 0.5 WHEN NOT spliced1 THEN 1 ELSE 0 END + CASE WHEN NOT exonic2 THEN 0.5 WHEN NOT spliced2 THEN 1 ELSE 0 END AS rt FROM events_v)"""
)
def in_vitro(t: Tables) -> DataFrame:
    return fates(ef.filter_in_vitro(t.events, 20))


@query(
    """SELECT event_id, CASE WHEN fate <> 'none' THEN fate WHEN {a} THEN 'non_coding_neighbors' WHEN {b} THEN 'min_support' WHEN {c} THEN 'relative_support' ELSE 'none' END AS fate FROM events_v""".format(
        a=f"{RT} AND NOT g1_coding AND NOT g2_coding", b=f"{SUP} < 2 OR ({OVER} AND split1 + split2 < 2)", c=f"evalue >= 0.3::DOUBLE OR ({INTRA} AND split1 + split2 = 0)"
    )
)
def fused_predicates(t: Tables) -> DataFrame:
    return fates(fate.discard_all(t.events, ef.event_predicates()))


@query(recovered("'end_to_end', 'intronic', 'mismappers', 'no_coverage', 'in_vitro', 'relative_support'", "gbp1 IS NOT NULL"))
def genomic_support(t: Tables) -> DataFrame:
    return fates(ef.recover_genomic(t.events))


@query(
    f"""SELECT event_id, CASE WHEN back THEN 'none' ELSE fate END AS fate, split1 + CASE WHEN back THEN spared_split1 ELSE 0 END AS split1, split2 + CASE WHEN back THEN spared_split2 ELSE 0 END AS split2 FROM (
    SELECT *, fate IN ('relative_support', 'intragenic_exonic', 'hairpin', 'inconsistently_clipped', 'mismatches') AND {ITD} AND same_coding_exon AND all_split >= 10
    AND (all_split / greatest(greatest(cov1, cov2) * (1 - 0.1::DOUBLE), 1) > 0.07::DOUBLE OR all_split >= 300) AS back FROM events_v)"""
)
def tandem_duplications(t: Tables) -> DataFrame:
    return ef.tandem_duplications(t.events.withColumn("duplicate_rate", F.lit(0.1).cast("double"))).select("event_id", "fate", "split1", "split2")


#: Gapped alignments of lineitem rows, with the bounds of two genes.
GAPPED = """SELECT concat_ws('.', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS read_key, l_partkey % 50 * 10 AS start,
  concat(CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_linenumber AS STRING) || 'S' WHEN l_orderkey % 7 = 0 THEN '4H' ELSE '' END, CAST(10 + l_suppkey % 30 AS STRING), 'M', CAST(100 + l_orderkey % 40 * 10 AS STRING), CASE WHEN l_partkey % 5 = 0 THEN 'D' ELSE 'N' END,
    CAST(5 + l_partkey % 20 AS STRING), 'M', CASE WHEN l_suppkey % 2 = 0 THEN '3I' || CAST(6 + l_orderkey % 5 AS STRING) || 'M200N8M' ELSE '' END, CASE WHEN l_linenumber > 4 THEN CAST(l_linenumber AS STRING) || 'S' ELSE '' END) AS cigar,
  300 + l_suppkey % 60 * 10 AS end1, 330 + l_suppkey % 60 * 10 + l_partkey % 9 * 15 AS start2 FROM {lineitem}"""


@query(
    f""", g AS ({GAPPED.replace("{lineitem}", "lineitem").replace("STRING", "VARCHAR")}),
    o AS (SELECT *, list_transform(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), lambda x: {{'n': x[:-2]::INT, 'op': x[-1:]}}) AS ops FROM g),
    w AS (SELECT *, len(ops) AS k, list_transform(range(1, len(ops) + 1), lambda i: start + coalesce(list_sum(list_transform(list_filter(ops[1:i], lambda x: x.op IN ('M', 'D', 'N', '=', 'X')), lambda x: x.n)), 0)) AS after_,
        list_transform(range(1, len(ops) + 1), lambda i: coalesce(list_sum(list_transform(list_filter(ops[1:i - 1], lambda x: x.op IN ('M', 'I', 'S', '=', 'X')), lambda x: x.n)), 0)) AS q_ FROM o),
    h AS (SELECT *, list_concat([start], after_) AS at_, list_filter(range(1, k + 1), lambda i: ops[i].op = 'N' AND ((list_concat([start], after_)[i] <= end1 AND after_[i] > end1) OR (list_concat([start], after_)[i] < start2 AND after_[i] >= start2)))[1] AS i FROM w WHERE k >= 3),
    t AS (SELECT *, list_transform(ops, lambda x: x.n::VARCHAR || x.op) AS s, list_sum(list_transform(list_filter(ops, lambda x: x.op IN ('M', 'I', 'S')), lambda x: x.n)) AS whole FROM h WHERE i IS NOT NULL)
    SELECT read_key, (i - 1)::INT AS place, q_[i]::INT AS q, at_[i]::INT AS at_intron, after_[i]::INT AS behind,
      q_[i]::BIGINT || CASE WHEN ops[1].op = 'H' THEN 'H' ELSE 'S' END || array_to_string(s[i + 1:], '') AS tail, array_to_string(s[1:i - 1], '') || (whole - q_[i])::BIGINT || CASE WHEN ops[k].op = 'H' THEN 'H' ELSE 'S' END AS head FROM t"""
)
def split_at_introns(t: Tables) -> DataFrame:
    """Gapped alignments cut at the skip that spans two genes."""
    c = F.col
    d = t.spark.sql(GAPPED, lineitem=t.table("lineitem")).withColumn("ops", cigar.parse(c("cigar")))
    # exploded, not filtered: a filter would be pushed below and walk the operations once more
    d = d.withColumn("hit", F.explode(F.filter(F.array(cigar.spanning_intron(c("start"), c("ops"), c("end1"), c("start2"))), lambda x: x.isNotNull())))
    return d.select("read_key", c("hit.i").alias("place"), "hit.q", c("hit.at").alias("at_intron"), c("hit.after").alias("behind"), cigar.text(cigar.from_intron(c("ops"), c("hit"))).alias("tail"), cigar.text(cigar.to_intron(c("ops"), c("hit"), cigar.query_length(c("ops")))).alias("head"))


SITES = "SELECT DISTINCT p_partkey % 40 AS gene, CASE WHEN p_size % 2 = 0 THEN 'upstream' ELSE 'downstream' END AS direction, CAST((p_partkey * 53) % 1200 + d AS INT) AS pos FROM {part}, {slack}"


@query(
    f""", g AS ({GAPPED.replace("{lineitem}", "lineitem").replace("STRING", "VARCHAR")}),
    r AS (SELECT g.*, l_partkey % 40 AS g1, (l_partkey + 1) % 40 AS g2, l_orderkey % 2 = 0 AS fw1, l_suppkey % 2 = 0 AS fw2, CASE WHEN l_linenumber = 1 THEN l_orderkey % 4 = 1 END AS known2
      FROM g JOIN (SELECT DISTINCT concat_ws('.', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS read_key, l_partkey, l_orderkey, l_suppkey, l_linenumber FROM lineitem) l USING (read_key)),
    o AS (SELECT *, list_transform(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), lambda x: {{'n': x[:-2]::INT, 'op': x[-1:]}}) AS ops FROM r),
    w AS (SELECT *, list_transform(range(0, len(ops) + 1), lambda i: start + coalesce(list_sum(list_transform(list_filter(ops[1:i], lambda x: x.op IN ('M', 'D', 'N', '=', 'X')), lambda x: x.n)), 0)) AS at_ FROM o WHERE len(ops) > 1),
    j AS (SELECT read_key, g1, g2, i, ops[i].op AS op, at_[i] AS before_, at_[i + 1] AS after_ FROM (SELECT *, unnest(range(1, len(ops) + 1)) AS i FROM w)),
    p AS (SELECT read_key, i, unnest([g1, g2]) AS gene, CASE WHEN i = 1 THEN 'upstream' ELSE 'downstream' END AS direction, before_ AS pos FROM j WHERE op IN ('S', 'H')
      UNION ALL SELECT read_key, i, unnest([g1, g2]), 'downstream', before_ FROM j WHERE op = 'N' UNION ALL SELECT read_key, i, unnest([g1, g2]), 'upstream', after_ FROM j WHERE op = 'N'),
    s AS ({SITES.replace("{part}", "part").replace("{slack}", "(SELECT unnest([-2, -1, 0, 1, 2]) AS d)")}),
    m AS (SELECT read_key, i, list(DISTINCT gene ORDER BY gene) AS met, min(gene % 3 <> 0) AS lo, max(gene % 3 <> 0) AS hi FROM p JOIN s USING (gene, direction, pos) GROUP BY ALL),
    f AS (SELECT read_key, arg_min(met, i) AS met, arg_min(lo, i) AS lo, arg_min(hi, i) AS hi FROM m GROUP BY read_key),
    q AS (SELECT read_key, CASE WHEN len(met) < 2 THEN met ELSE list_sort([g1, g2]) END AS genes, CASE WHEN lo = hi THEN lo END AS a, known2 AS b, fw1 = fw2 AS same FROM r LEFT JOIN f USING (read_key))
    SELECT DISTINCT read_key, array_to_string(genes, ',') AS genes, CASE WHEN a IS NULL AND b IS NOT NULL THEN b <> same WHEN a IS NOT NULL AND b IS NOT NULL AND (a <> b) <> same THEN NULL ELSE a END AS strand1,
      CASE WHEN b IS NULL AND a IS NOT NULL THEN a <> same WHEN a IS NOT NULL AND b IS NOT NULL AND (a <> b) <> same THEN NULL ELSE b END AS strand2 FROM q"""
)
def splice_aware_genes(t: Tables) -> DataFrame:
    """Genes and strands of gapped alignments by the splice sites that their junctions meet, and by their mates."""
    c = F.col
    own = ("l_partkey", "l_orderkey", "l_suppkey", "l_linenumber")
    # all of a read follows from these
    d = t.spark.sql(GAPPED.replace("SELECT ", f"SELECT {', '.join(own)}, ", 1), lineitem=t.table("lineitem").select(*own).distinct())
    none = F.lit(None)
    d = d.select(
        "read_key", F.lit(False).alias("is_split"), c("start").cast("int").alias("m1_start"), cigar.parse(c("cigar")).alias("m1_ops"), F.array_sort(F.array(c("l_partkey") % 40, (c("l_partkey") + 1) % 40)).alias("m1_genes"), (c("l_orderkey") % 2 == 0).alias("m1_strand"), none.cast("boolean").alias("m1_predicted"),
        F.lit(0).alias("m2_start"), cigar.parse(F.lit("50M")).alias("m2_ops"), F.array(c("l_partkey") % 40).alias("m2_genes"), (c("l_suppkey") % 2 == 0).alias("m2_strand"), F.when(c("l_linenumber") == 1, c("l_orderkey") % 4 == 1).alias("m2_predicted"),
        F.lit(0).alias("sp_start"), cigar.parse(F.lit("*")).alias("sp_ops"), F.array().cast("array<bigint>").alias("sp_genes"), none.cast("boolean").alias("sp_strand"), none.cast("boolean").alias("sp_predicted"),
    )
    genes = t.spark.range(40).select("id", (c("id") % 3 != 0).alias("strand"))
    sites = t.spark.sql(SITES, part=t.table("part"), slack=t.spark.range(-2, 3).withColumnRenamed("id", "d"))
    out = annotate.by_splice_sites(d, genes, sites)
    return out.select("read_key", F.array_join("m1_genes", ",").alias("genes"), c("m1_predicted").alias("strand1"), c("m2_predicted").alias("strand2"))


# rankers and recoveries over groups

RANK = "CASE WHEN split1 > 0 AND split2 > 0 THEN 3 WHEN (split1 > 0 OR split2 > 0) AND disc > 0 THEN 2 WHEN split1 > 0 OR split2 > 0 THEN 1 ELSE 0 END"


@query(f"SELECT event_id, {RANK} AS rank FROM events_v")
def rank_evidence(t: Tables) -> DataFrame:
    return t.events.select("event_id", ev.evidence_rank().alias("rank"))


@query(
    f"""SELECT event_id, CASE WHEN fate = 'none' AND n > 1 THEN 'select_best' ELSE fate END AS fate FROM (SELECT *, row_number() OVER (PARTITION BY gene1, gene2, dir1, dir2, fate = 'none'
    ORDER BY {RANK} DESC, {SUP} DESC, exonic1::INT + exonic2::INT DESC, exonic1::INT DESC, CASE WHEN dir1 = 'downstream' THEN -bp1 ELSE bp1 END, CASE WHEN dir2 = 'downstream' THEN -bp2 ELSE bp2 END, contig1, contig2, event_id) AS n FROM events_v)"""
)
def select_best(t: Tables) -> DataFrame:
    return fates(ef.select_best(t.events))


#: A scan of each key's events by breakpoints, whose counts change as it goes: one step of the recursion is one event.
_NEAR = """x.i <> n AND abs(x.bp1 - me.bp1) <= 7 AND ((CASE WHEN dir1 = dir2 THEN x.bp1 + x.bp2 = me.bp1 + me.bp2 ELSE x.bp2 - x.bp1 = me.bp2 - me.bp1 END) OR (me.itd AND abs(x.bp2 - me.bp2) <= 7))
      AND (x.s1 + x.s2 > 0 OR (me.itd AND x.listed > 0))"""


@query(
    f""", scan AS (WITH RECURSIVE r AS (
      SELECT gene1, gene2, dir1, dir2, contig1, contig2, 1 AS n, list({{'i': i, 'id': event_id, 'bp1': bp1, 'bp2': bp2, 's1': split1, 's2': split2, 'disc': disc, 'listed': listed_split, 'itd': itd, 'merged': false}} ORDER BY i) AS s
      FROM (SELECT *, {ITD} AS itd, row_number() OVER (PARTITION BY gene1, gene2, dir1, dir2, contig1, contig2 ORDER BY bp1, bp2, event_id) AS i FROM events_v WHERE fate = 'none' OR {ITD}) GROUP BY ALL
      UNION ALL
      SELECT gene1, gene2, dir1, dir2, contig1, contig2, n + 1,
        CASE WHEN (CASE WHEN me.itd THEN me.listed ELSE me.s1 + me.s2 END) > 0 AND len(list_filter(near, lambda x: x.s1 + x.s2 + x.disc > me.s1 + me.s2 + me.disc OR (x.s1 + x.s2 + x.disc = me.s1 + me.s2 + me.disc AND x.listed > me.listed))) = 0
        THEN list_transform(s, lambda x: {{'i': x.i, 'id': x.id, 'bp1': x.bp1, 'bp2': x.bp2, 's1': x.s1 + CASE WHEN x.i = n THEN coalesce(list_sum(list_transform(near, lambda y: y.s1)), 0) ELSE 0 END::BIGINT,
             's2': x.s2 + CASE WHEN x.i = n THEN coalesce(list_sum(list_transform(near, lambda y: y.s2)), 0) ELSE 0 END::BIGINT, 'disc': x.disc,
             'listed': x.listed + CASE WHEN x.i = n AND me.itd THEN coalesce(list_sum(list_transform(near, lambda y: y.listed)), 0) ELSE 0 END::BIGINT, 'itd': x.itd,
             'merged': x.merged OR list_contains(list_transform(near, lambda y: y.i), x.i)}})
        ELSE s END
      FROM (SELECT *, list_filter(s, lambda x: {_NEAR}) AS near FROM (SELECT *, s[n] AS me FROM r WHERE n <= len(s)))
    ) SELECT unnest(s) AS x FROM r WHERE n = len(s) + 1)
    SELECT event_id, CASE WHEN x.merged THEN 'merge_adjacent' ELSE fate END AS fate, coalesce(x.s1, split1) AS split1, coalesce(x.s2, split2) AS split2, coalesce(x.listed, listed_split) AS listed_split
    FROM events_v LEFT JOIN scan ON x.id = event_id"""
)
def merge_adjacent_best(t: Tables) -> DataFrame:
    return ef.merge_adjacent(t.events, 7).select("event_id", "fate", "split1", "split2", "listed_split")


RIVALS = "SELECT DISTINCT least(o_custkey, o_orderkey * 7919 % 997) AS strong, greatest(o_custkey, o_orderkey * 7919 % 997) AS weak FROM {orders} WHERE o_custkey <> o_orderkey * 7919 % 997"


@query(
    f""", edges AS ({RIVALS.replace("{orders}", "orders")}), adj AS (SELECT strong, list(weak) AS weaks, row_number() OVER (ORDER BY strong) AS i FROM edges GROUP BY strong),
    loop AS (WITH RECURSIVE r AS (SELECT 1::BIGINT AS n, []::BIGINT[] AS gone UNION ALL
      SELECT n + 1, CASE WHEN list_contains(gone, strong) THEN gone ELSE list_distinct(list_concat(gone, weaks)) END FROM r JOIN adj ON i = n) SELECT arg_max(gone, n) AS gone FROM r)
    SELECT unnest(gone) AS id FROM loop"""
)
def conflict_rounds(t: Tables) -> DataFrame:
    """Who loses when rivals are settled from the strongest on."""
    return conflicts.losers(t.spark.sql(RIVALS, orders=t.table("orders")))


MANY = f"NOT {RT} AND (spliced1 OR spliced2) AND gene1 <> gene2 AND NOT {OVER}"
LOWS = "'inconsistently_clipped', 'relative_support', 'min_support', 'select_best'"


@query(
    f""", cells AS (SELECT gene1, gene2, count(DISTINCT (floor(bp1 / 10), floor(bp2 / 10))) AS n FROM events_v WHERE {MANY} AND fate IN ('none', {LOWS}) GROUP BY ALL)
    SELECT event_id, CASE WHEN fate IN ({LOWS}) AND {MANY} AND coalesce(n, 0) >= 12 THEN 'none' ELSE fate END AS fate FROM events_v LEFT JOIN cells USING (gene1, gene2)"""
)
def many_breakpoints(t: Tables) -> DataFrame:
    return fates(ef.many_spliced(t.events, 12))


@query(
    """, passed AS (SELECT gene1, gene2, dir1, dir2, max((bp1, bp2)) AS p FROM events_v WHERE fate = 'none' GROUP BY ALL)
    SELECT event_id, CASE WHEN fate NOT IN ('none', 'merge_adjacent', 'blacklist', 'end_to_end', 'duplicates') AND gene1 <> gene2 AND spliced1 AND spliced2
      AND (abs(p[1] - bp1) > 2 OR abs(p[2] - bp2) > 2) THEN 'none' ELSE fate END AS fate FROM events_v LEFT JOIN passed USING (gene1, gene2, dir1, dir2)"""
)
def isoform_recover(t: Tables) -> DataFrame:
    return fates(ef.isoforms(t.events))


COUNTED = f"(fate IN ('none', 'in_vitro', 'intronic', 'relative_support', 'min_support') OR (fate = 'inconsistently_clipped' AND {BOTH})) AND unique_reads > 0"
PAIRED = f""", votes AS (SELECT * FROM events_v WHERE {COUNTED}), same AS (SELECT gene1, gene2, dir1, dir2, sum(unique_reads)::BIGINT AS s FROM votes GROUP BY ALL),
    back AS (SELECT gene1 AS a, gene2 AS b, dir1 AS x, dir2 AS y, bp1 AS b1, bp2 AS b2, {BOTH} AS bs, unique_reads AS u FROM votes WHERE NOT {RT}),
    opposite AS (SELECT event_id, sum(u)::BIGINT AS o FROM events_v JOIN back ON a = gene1 AND b = gene2 AND x <> dir1 AND y <> dir2
      WHERE {BOTH} AND (bs OR (((dir1 = 'downstream') <> (bp1 > b1)) AND ((dir2 = 'downstream') <> (bp2 > b2)))) GROUP BY event_id),
    supported AS (SELECT e.*, coalesce(s, 0) + coalesce(o, 0) AS pair_reads FROM events_v e LEFT JOIN same USING (gene1, gene2, dir1, dir2) LEFT JOIN opposite USING (event_id))"""


@query(PAIRED + " SELECT event_id, pair_reads FROM supported")
def reciprocal_pairs(t: Tables) -> DataFrame:
    return ef.pair_support(t.events).select("event_id", "pair_reads")


ELIGIBLE = f"{BOTH} AND gene1 <> gene2 AND NOT {OVER} AND NOT {RT} AND fate IN ('relative_support', 'min_support', 'in_vitro') AND pair_reads >= 2"


@query(
    PAIRED + f""", hist AS (SELECT {SUP} AS reads, count(*) AS n FROM supported WHERE {ELIGIBLE} GROUP BY ALL), cum AS (SELECT reads, sum(n) OVER (ORDER BY reads DESC) AS c FROM hist),
    least_ AS (SELECT coalesce(max(reads) + 1, 1) AS m FROM cum WHERE c >= 200)
    SELECT event_id, CASE WHEN {ELIGIBLE} AND {SUP} >= m + CASE WHEN contig1 = contig2 AND abs(bp2 - bp1) < 1000000 THEN 1 ELSE 0 END THEN 'none' ELSE fate END AS fate FROM supported, least_"""
)
def both_spliced_threshold(t: Tables) -> DataFrame:
    return fates(ef.recover_spliced(t.events))


@query(
    f""", d AS (SELECT *, split1 + split2 AS s, {SUP} AS n, listed / greatest(1, cov1, cov2) AS share,
      (split1 > 0)::INT + (split2 > 0)::INT + (disc > 0)::INT AS kinds,
      fate = 'none' AND {RT} AND EXISTS (SELECT 1 FROM events_v o WHERE o.fate = 'none' AND o.split1 + o.split2 > 0 AND o.dir1 = 'downstream' AND o.dir2 = 'upstream'
        AND ((o.gene1 = e.gene1 AND o.gene2 <> e.gene2) OR (o.gene1 <> e.gene1 AND o.gene2 = e.gene2)) AND (o.bp1 <> e.bp1 OR o.bp2 <> e.bp2) AND o.bp2 > e.bp1 AND o.bp1 < e.bp2) AS dels,
      EXISTS (SELECT 1 FROM events_v o WHERE o.gene1 = e.gene1 AND o.gene2 = e.gene2 AND o.spliced1 AND o.spliced2 AND (abs(o.bp1 - e.bp1) > 2 OR abs(o.bp2 - e.bp2) > 2)) AS others FROM events_v e),
    a AS (SELECT *, CASE WHEN evalue > 0.3::DOUBLE OR n < 2 THEN 0 WHEN {RT} THEN CASE WHEN kinds >= 2 AND n >= 10 THEN CASE WHEN s >= 10 AND share > 0.07::DOUBLE THEN 2 ELSE 1 END WHEN dels THEN 1 ELSE 0 END
      WHEN gene1 = gene2 OR {OVER} THEN CASE WHEN s = 0 THEN 0 WHEN NOT exonic1 AND NOT exonic2 THEN CASE WHEN split1 > 0 AND split2 > 0 THEN 2 ELSE 1 END
        WHEN NOT exonic1 OR NOT exonic2 THEN CASE WHEN split1 > 3 AND split2 > 3 THEN 2 ELSE 1 END ELSE 0 END ELSE 2 END AS c0 FROM d),
    b AS (SELECT *, CASE WHEN c0 = 0 AND gene1 = gene2 AND exonic1 AND exonic2 AND NOT spliced1 AND NOT spliced2 AND bp2 - bp1 < 100 AND split1 > 0 AND split2 > 0 AND s >= 10 AND share > 0.15::DOUBLE
      AND dir1 = 'upstream' AND dir2 = 'downstream' THEN 1 ELSE c0 END AS c1 FROM a),
    c AS (SELECT *, CASE WHEN c1 < 2 AND spliced1 AND spliced2 AND NOT {RT} AND gene1 <> gene2 AND others THEN c1 + 1 ELSE c1 END AS c2 FROM b),
    c3 AS (SELECT *, CASE WHEN gene1 <> gene2 AND c2 > 0 AND NOT spliced1 AND NOT spliced2 THEN c2 - 1 ELSE c2 END AS k3 FROM c),
    c4 AS (SELECT *, CASE WHEN split1 > 20 AND split2 > 20 AND n > 60 THEN 2 ELSE k3 END AS k4 FROM c3),
    c5 AS (SELECT *, CASE WHEN k4 = 0 THEN 0 WHEN s = 0 OR split1 + disc = 0 OR split2 + disc = 0 THEN k4 - 1 WHEN 20 * s < disc THEN k4 - 1 WHEN evalue > 0.2::DOUBLE OR share < 0.01::DOUBLE THEN 1 ELSE k4 END AS k5 FROM c4)
    SELECT event_id, (CASE WHEN fate <> 'none' THEN 0 WHEN k5 < 2 AND gbp1 IS NOT NULL AND ((evalue < 0.3::DOUBLE AND n >= 2) OR (spliced1 AND spliced2 AND gene1 <> gene2) OR abs(bp1 - gbp1) + abs(bp2 - gbp2) < 20000
      OR contig1 <> contig2 OR (abs(bp2 - bp1) > 1000000 AND gene1 <> gene2)) THEN k5 + 1 ELSE k5 END)::INT AS confidence FROM c5"""
)
def confidence_ladder(t: Tables) -> DataFrame:
    return ef.assign_confidence(t.events.drop("confidence")).select("event_id", "confidence")


@query(
    f""", best AS (SELECT *, {SUP} AS support, first(confidence) OVER w AS bc, first({SUP}) OVER w AS bs, first(evalue) OVER w AS be FROM events_v WHERE fate = 'none'
      WINDOW w AS (PARTITION BY gene1, gene2 ORDER BY confidence DESC, {SUP} DESC, evalue, bp1, bp2, event_id))
    SELECT event_id, row_number() OVER (ORDER BY bc DESC, bs DESC, be, gene1, gene2, confidence DESC, support DESC, evalue, bp1, bp2, event_id) AS place FROM best"""
)
def output_order(t: Tables) -> DataFrame:
    return ef.output_order(t.events.where("fate = 'none'")).select("event_id", "place")


@query(
    f"""SELECT event_id, CASE WHEN contig1 <> contig2 THEN CASE WHEN g1_dummy OR g2_dummy OR (dir1 = dir2 AND g1_strand <> g2_strand) OR (dir1 <> dir2 AND g1_strand = g2_strand) THEN 'translocation'
      WHEN NOT {FIVE1} AND NOT {FIVE2} THEN 'translocation/3''-3''' ELSE 'translocation/5''-5''' END
    WHEN dir1 = 'downstream' AND dir2 = 'upstream' THEN CASE WHEN {RT} THEN 'deletion/read-through' ELSE 'deletion' END || CASE WHEN g1_dummy OR g2_dummy OR g1_strand = g2_strand THEN '' WHEN g1_strand THEN '/5''-5''' ELSE '/3''-3''' END
    WHEN dir1 = dir2 THEN CASE WHEN g1_dummy OR g2_dummy OR g1_strand <> g2_strand THEN 'inversion' WHEN dir1 = 'upstream' AND NOT g1_strand THEN 'inversion/5''-5''' ELSE 'inversion/3''-3''' END
    ELSE CASE WHEN g1_dummy OR g2_dummy OR g1_strand = g2_strand THEN CASE WHEN gene1 = gene2 AND spliced1 AND spliced2 THEN 'duplication/non-canonical_splicing' WHEN {ITD} THEN 'duplication/ITD' ELSE 'duplication' END
      WHEN NOT g1_strand THEN 'duplication/5''-5''' ELSE 'duplication/3''-3''' END END AS type FROM events_v"""
)
def event_type(t: Tables) -> DataFrame:
    return t.events.select("event_id", ev.event_type().alias("type"))


AGREE1 = "(spliced1 OR (NOT ambiguous AND NOT g1_dummy AND strand1 = g1_strand))"
AGREE2 = "(spliced2 OR (NOT ambiguous AND NOT g2_dummy AND strand2 = g2_strand))"
OUT1 = "CASE WHEN strand1 THEN dir1 = 'downstream' ELSE dir1 = 'upstream' END"
OUT2 = "CASE WHEN strand2 THEN dir2 = 'downstream' ELSE dir2 = 'upstream' END"


@query(
    f"""SELECT event_id, CASE WHEN {AGREE1} THEN CASE WHEN {FIVE1} THEN 1 ELSE 2 END WHEN {AGREE2} THEN CASE WHEN {FIVE2} THEN 2 ELSE 1 END
      WHEN NOT ambiguous THEN CASE WHEN ({OUT1}) AND NOT ({OUT2}) THEN 1 WHEN NOT ({OUT1}) AND ({OUT2}) THEN 2 ELSE 0 END
      WHEN NOT exonic1 AND NOT exonic2 THEN 0
      WHEN NOT exonic1 THEN CASE WHEN {FIVE2} THEN 2 WHEN {RT} AND split1 + split2 = 0 THEN 1 ELSE 0 END
      WHEN NOT exonic2 THEN CASE WHEN {FIVE1} THEN 1 WHEN {RT} AND split1 + split2 = 0 THEN 1 ELSE 0 END
      WHEN (NOT g1_dummy AND g1_strand AND dir1 = 'downstream') OR (NOT g1_strand AND dir1 = 'upstream') THEN 1
      WHEN (NOT g2_dummy AND g2_strand AND dir2 = 'downstream') OR (NOT g2_strand AND dir2 = 'upstream') THEN 2 ELSE 0 END AS five FROM events_v"""
)
def transcript_start(t: Tables) -> DataFrame:
    return t.events.select("event_id", stats.transcript_start().alias("five"))


@query(
    """SELECT event_id, CASE WHEN g1_dummy THEN '.' WHEN g1_strand THEN '+' ELSE '-' END || '/' || CASE WHEN ambiguous THEN '.' WHEN strand1 THEN '+' ELSE '-' END AS strands,
    CASE confidence WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS label FROM events_v"""
)
def labels(t: Tables) -> DataFrame:
    c = F.col
    return t.events.select("event_id", ev.strand_label(c("g1_strand"), c("g1_dummy"), c("strand1"), c("ambiguous")).alias("strands"), ev.confidence_label(c("confidence")).alias("label"))


# statistics

#: The shares of event classes, with their defaults where they are too few.
SHARES = f"""
    , distal AS (SELECT *, spliced1 OR spliced2 AS one FROM events_v WHERE fate = 'none' AND (contig1 <> contig2 OR bp2 - bp1 > 500000) AND {SUP} >= 2 AND split1 + split2 > 0 AND NOT g1_dummy AND NOT g2_dummy),
    a AS (SELECT count(CASE WHEN one THEN 1 END) AS spliced, count(CASE WHEN NOT one AND exonic1 AND exonic2 THEN 1 END) AS exonic, count(CASE WHEN NOT one AND NOT exonic1 AND NOT exonic2 THEN 1 END) AS intronic,
          count(CASE WHEN NOT one AND exonic1 <> exonic2 THEN 1 END) AS mixed FROM distal),
    b AS (SELECT count(CASE WHEN dir1 = 'upstream' AND dir2 = 'downstream' THEN 1 END) AS dup, count(CASE WHEN dir1 = dir2 THEN 1 END) AS inv FROM events_v WHERE fate = 'none' AND gene1 = gene2 AND split1 + split2 >= 2),
    d AS (SELECT count(CASE WHEN gene1 = gene2 THEN 1 END) AS same, count(CASE WHEN gene1 <> gene2 THEN 1 END) AS different FROM events_v WHERE spliced1 AND spliced2),
    g AS (SELECT gene, bool_or(rt) AS rt FROM (SELECT unnest([gene1, gene2]) AS gene, {RT} AS rt FROM events_v WHERE NOT g1_dummy AND NOT g2_dummy AND split1 + split2 > 0) GROUP BY gene),
    h AS (SELECT coalesce(count(CASE WHEN rt THEN 1 END) / nullif(count(*), 0), 0)::DOUBLE AS read_through FROM g)"""


@query(
    SHARES
    + """ SELECT CASE WHEN ok THEN spliced ELSE 10 END::DOUBLE AS spliced, CASE WHEN ok THEN exonic ELSE 65 END::DOUBLE AS exonic, CASE WHEN ok THEN intronic ELSE 10 END::DOUBLE AS intronic, CASE WHEN ok THEN mixed ELSE 15 END::DOUBLE AS mixed,
      CASE WHEN dup + inv >= 100 THEN dup ELSE 1 END::DOUBLE AS dup, CASE WHEN dup + inv >= 100 THEN inv ELSE 1 END::DOUBLE AS inv, CASE WHEN same + different >= 100 THEN same ELSE 0 END::DOUBLE AS same,
      CASE WHEN same + different >= 100 THEN different ELSE 100 END::DOUBLE AS different, round(read_through, 9) AS read_through
      FROM (SELECT *, spliced + exonic + intronic + mixed >= 100 AND spliced > 0 AND exonic > 0 AND intronic > 0 AND mixed > 0 AS ok FROM a, b, d, h)"""
)
def event_shares(t: Tables) -> DataFrame:
    got = stats.DEFAULT_SHARES | stats.event_shares(t.events)
    return t.spark.range(1).select(*(F.round(F.lit(v), 9).alias(k) for k, v in got.items()))


PARTNERS = """, both_ AS (SELECT gene1 AS gene, gene2 AS other, bp1, bp2 FROM events_v WHERE fate = 'none' AND gene1 <> gene2 UNION ALL SELECT gene2, gene1, bp1, bp2 FROM events_v WHERE fate = 'none' AND gene1 <> gene2),
    first_ AS (SELECT gene, bp1, bp2, min(other) AS other FROM both_ GROUP BY ALL), n_ AS (SELECT gene, count(DISTINCT other) AS n FROM first_ GROUP BY gene)"""


@query(PARTNERS + " SELECT p.gene, count(*) AS partners FROM (SELECT DISTINCT gene, other FROM first_) p JOIN n_ a ON a.gene = p.gene JOIN n_ b ON b.gene = p.other WHERE a.n >= b.n GROUP BY p.gene")
def partner_counts(t: Tables) -> DataFrame:
    return stats.partner_counts(t.events)


@query(
    f"""SELECT event_id, round(ln(greatest(base * CASE WHEN {INTRA} THEN 2.0::DOUBLE / 2 * CASE WHEN {SUP} >= 1 THEN pow({SUP} - 0.42::DOUBLE, -2.11::DOUBLE) * pow(10::DOUBLE, -1.11::DOUBLE)
        * CASE WHEN d < 1000 THEN pow(greatest(400.0::DOUBLE, d) / 1000, -2.0::DOUBLE) ELSE 1 END * CASE WHEN d < 400 THEN pow(d / 400, -4.58::DOUBLE) ELSE 1 END ELSE 1 END
      ELSE CASE WHEN {SUP} >= 1 THEN pow({SUP} - 0.73::DOUBLE, -2.28::DOUBLE) * pow(10::DOUBLE, -1.75::DOUBLE)
        * CASE WHEN {RT} THEN pow(greatest(bp2 - bp1, 1) / 400000::DOUBLE, -0.63::DOUBLE) WHEN contig1 = contig2 AND bp2 - bp1 < 400000 THEN pow(greatest(bp2 - bp1, 1) / 400000::DOUBLE, -1.53::DOUBLE) ELSE 1 END ELSE 1 END END
      * CASE WHEN spliced1 OR spliced2 THEN 10 WHEN exonic1 AND exonic2 THEN 65 WHEN NOT exonic1 AND NOT exonic2 THEN 10 ELSE 15 END * 0.04::DOUBLE, 1e-30)), 6) AS log_evalue
    FROM (SELECT *, greatest(spliced_distance, 1)::DOUBLE AS d, greatest(10000.0::DOUBLE / l1 * greatest(p1 - 1, 1), 10000.0::DOUBLE / l2 * greatest(p2 - 1, 1))
      * CASE WHEN {SUP} < 2 THEN 1 ELSE greatest(1.0::DOUBLE, 2.5::DOUBLE * pow(0.02::DOUBLE, {SUP} - 2)) END AS base FROM events_v)"""
)
def evalue(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(F.log(F.greatest(stats.evalue(t.events, 50_000_000), F.lit(1e-30))), 6).alias("log_evalue"))


@query(""", n AS (SELECT gene1 AS gene, count(*) AS reads FROM reads_v GROUP BY gene1), s AS (SELECT reads, row_number() OVER (ORDER BY reads, gene) - 1 AS i, count(*) OVER () AS k FROM n)
    SELECT reads AS threshold FROM s WHERE i = least(floor(k * 0.9::DOUBLE), k - 1)""")
def high_expression_genes(t: Tables) -> DataFrame:
    return stats.order_statistic(stats.gene_read_counts(t.reads, "gene1"), "reads", 0.9)


FRAGMENTS = "SELECT concat_ws('.', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS fragment, l_suppkey % 4 AS contig, (l_partkey * 37 + l_orderkey) % 20000 AS s, (l_partkey * 37 + l_orderkey) % 20000 + 20 + CAST(l_quantity AS BIGINT) AS e FROM {lineitem}"
COVERAGE = f""", frag AS ({FRAGMENTS.replace("{lineitem}", "lineitem")}), spread AS (SELECT fragment, contig, s, e, unnest(range(s // 20, e // 20 + 1)) AS win FROM frag),
    cov AS (SELECT contig, win, least(count(*), 65535)::BIGINT AS depth FROM (SELECT DISTINCT fragment, contig, win FROM spread WHERE least(e, win * 20 + 19) - greatest(s, win * 20) + 1 >= 10) GROUP BY contig, win)"""


def _coverage(t: Tables, most: int = 65_535) -> DataFrame:
    return stats.coverage(t.spark.sql(FRAGMENTS, lineitem=t.table("lineitem")), most=most)


@query(COVERAGE + " SELECT contig, win, depth FROM cov")
def coverage_windows(t: Tables) -> DataFrame:
    return _coverage(t).select("contig", "win", F.col("depth").cast("bigint").alias("depth"))


@query(COVERAGE + " SELECT contig, win, least(depth, 12)::BIGINT AS depth FROM cov")
def saturated_depth(t: Tables) -> DataFrame:
    return _coverage(t, 12).select("contig", "win", F.col("depth").cast("bigint").alias("depth"))


@query(COVERAGE + " SELECT e.event_id, coalesce(depth, 0) AS depth FROM events_v e LEFT JOIN cov ON cov.contig = contig1 AND win = floor((bp1 % 20000) / 20) + CASE WHEN dir1 = 'upstream' THEN -1 ELSE 1 END")
def neighbour_window(t: Tables) -> DataFrame:
    points = t.events.select("event_id", "contig1", (F.col("bp1") % 20_000).alias("at"), "dir1")
    return stats.depth_at(points, _coverage(t), "contig1", "at", "dir1", "depth").select("event_id", F.col("depth").cast("bigint").alias("depth"))


@query(COVERAGE + " SELECT event_id, EXISTS (SELECT 1 FROM frag WHERE frag.contig = contig1 AND s // 20 > ((bp1 % 20000) // 20) AND s // 20 <= (bp1 % 20000 + 60) // 20) AS hit FROM events_v")
def fragment_starts_semi(t: Tables) -> DataFrame:
    starts = t.spark.sql(FRAGMENTS, lineitem=t.table("lineitem")).select("contig", F.floor(F.col("s") / 20).alias("win"))
    points = t.events.select(F.col("event_id").alias("point_id"), "contig1", (F.col("bp1") % 20_000).alias("lo"), (F.col("bp1") % 20_000 + 60).alias("hi"))
    return stats.starts_near(points, starts, "contig1", "lo", "hi", "hit").select(F.col("point_id").alias("event_id"), "hit")


EDGES = "SELECT contig1 AS contig, CASE WHEN read_group % 2 = 0 THEN 'start' ELSE 'end' END AS kind, CAST(floor((start1 + read_group % 5 * 60) / 20) AS BIGINT) AS win FROM {reads} WHERE read_group % 3 = 0"
OUTER_EXONS = "SELECT p_partkey % 50 AS gene, p_partkey % 50 * 20000 + p_size * 6 AS start, p_partkey % 50 * 20000 + p_size * 6 + 20 AS {end}, CASE WHEN p_size % 3 = 0 THEN 1 END AS prev_end, CASE WHEN p_size % 2 = 0 THEN 1 END AS next_start FROM {part}"


def _side(i: int) -> str:
    up = f"dir{i} = 'upstream'"
    slack = "CASE WHEN split1 + split2 = 0 THEN 200 ELSE 0 END"
    return f"""EXISTS (SELECT 1 FROM edges WHERE edges.contig = contig{i} AND CASE WHEN {up} THEN kind = 'start' AND win > (bp{i} - {slack}) // 20 AND win <= greatest(bp{i} + 200, anchor{i}) // 20
      ELSE kind = 'end' AND win >= least(bp{i} - 200, anchor{i}) // 20 AND win < (bp{i} + {slack}) // 20 END) OR EXISTS (SELECT 1 FROM exons WHERE exons.gene = gene{i} AND bp{i} BETWEEN start AND "end" AND (prev_end IS NULL OR next_start IS NULL))"""


@query(
    f""", edges AS (SELECT DISTINCT * FROM ({EDGES.replace("{reads}", "reads_v")})), exons AS ({OUTER_EXONS.replace("{part}", "part").replace("{end}", chr(34) + "end" + chr(34))})
    SELECT event_id, CASE WHEN fate = 'none' AND NOT (NOT {RT} AND ((split1 + split2 > 0 AND split1 + disc > 0 AND split2 + disc > 0) OR spliced1 OR spliced2)) AND NOT ({RT} AND spliced1 AND spliced2)
      AND (NOT ({_side(1)}) OR NOT ({_side(2)})) THEN 'no_coverage' ELSE fate END AS fate FROM events_v"""
)
def coverage_by_edges(t: Tables) -> DataFrame:
    """Weak events without normal fragments about a breakpoint, by the windows in which fragments start and end."""
    edges = t.spark.sql(EDGES, reads=t.reads).distinct()
    return fates(ef.filter_no_coverage(t.events, edges, t.spark.sql(OUTER_EXONS.replace("{end}", "`end`"), part=t.table("part"))))


@query(COVERAGE + """, len_ AS (SELECT DISTINCT s_suppkey % 4 AS contig, 20100 AS length FROM supplier), m AS (SELECT contig, sum(depth) / 1006 AS mean FROM cov GROUP BY contig)
    SELECT cov.contig, count(*) AS deep FROM cov JOIN m USING (contig) JOIN len_ USING (contig) WHERE depth > mean * 1.6::DOUBLE GROUP BY cov.contig HAVING count(*) < 1.6::DOUBLE * 1006 OR count(*) * 20 <= 100""")
def low_coverage_contigs(t: Tables) -> DataFrame:
    lengths = t.table("supplier").select((F.col("s_suppkey") % 4).alias("contig"), F.lit(20_100).alias("length")).distinct()
    return stats.low_coverage_contigs(_coverage(t), lengths, share=1.6)


VIRAL = ", n AS (SELECT l_suppkey, count(*) AS k FROM lineitem GROUP BY ALL), e AS (SELECT s_suppkey AS contig, coalesce(k, 0) AS reads, coalesce(k, 0) / (1000 + s_suppkey * 17 % 500)::DOUBLE AS expression FROM supplier LEFT JOIN n ON l_suppkey = s_suppkey)"


def _viral(t: Tables) -> DataFrame:
    lengths = t.table("supplier").select(F.col("s_suppkey").alias("contig"), (1000 + F.col("s_suppkey") * 17 % 500).alias("length"))
    return stats.viral_expression(t.table("lineitem").select(F.col("l_suppkey").alias("contig")), lengths)


@query(VIRAL + ", r AS (SELECT expression, row_number() OVER (ORDER BY expression DESC, contig DESC) AS n FROM e WHERE expression > 0) SELECT coalesce(min(expression), 0) AS threshold FROM r WHERE n <= 5")
def viral_top_n(t: Tables) -> DataFrame:
    return stats.viral_threshold(_viral(t))


@query(
    """, e AS (SELECT s_suppkey AS contig, CAST(coalesce(n, 0) AS DOUBLE) / 1000 AS expression FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY l_suppkey) ON l_suppkey = s_suppkey),
    r AS (SELECT *, row_number() OVER (ORDER BY expression DESC, contig DESC) AS n, count(*) OVER () AS k FROM e), f AS (SELECT max(expression) AS least FROM r WHERE n = k - least(50, k) + 1),
    s AS (SELECT contig, avg(CASE WHEN d THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS part FROM (SELECT DISTINCT l_suppkey AS contig, l_partkey % 7 AS gene, l_partkey % 7 < l_suppkey % 5 AS d FROM lineitem) GROUP BY contig)
    SELECT contig FROM e LEFT JOIN s USING (contig), f WHERE (expression = 0 OR expression < 0.58::DOUBLE) AND NOT coalesce(coalesce(part, 0) >= 0.33::DOUBLE AND expression > 0 AND expression >= least, false)"""
)
def weak_viruses(t: Tables) -> DataFrame:
    li = t.table("lineitem")
    n = li.where("l_suppkey % 3 = 0").groupBy(F.col("l_suppkey").alias("contig")).agg(F.count("*").alias("n"))
    e = t.table("supplier").select(F.col("s_suppkey").alias("contig")).join(n, "contig", "left").select("contig", (F.coalesce("n", F.lit(0)) / 1000).alias("expression"))
    sites = li.select(F.col("l_suppkey").alias("contig"), (F.col("l_partkey") % 7).alias("gene"), (F.col("l_partkey") % 7 < F.col("l_suppkey") % 5).alias("is_dummy"))
    return stats.weak_viruses(e, 0.58, sites)


@query(VIRAL + " SELECT contig, reads, expression FROM e")
def viral_expression(t: Tables) -> DataFrame:
    return _viral(t).select("contig", "reads", "expression")


@query(
    """, trim AS (WITH RECURSIVE r AS (
      SELECT 1 AS k, avg(value) AS m, stddev_samp(value) AS s, count(value) AS n, -1e300::DOUBLE AS low, 1e300::DOUBLE AS high, -1::BIGINT AS before FROM events
      UNION ALL
      SELECT k + 1, avg(value), stddev_samp(value), count(value), greatest(low, m - 2 * s), least(high, m + 2 * s), n FROM r, events
      WHERE n <> before AND value BETWEEN greatest(low, m - 2 * s) AND least(high, m + 2 * s) GROUP BY k, m, s, n, low, high, before) SELECT * FROM r)
    SELECT round(m, 6) AS mean, round(s, 6) AS deviation, n AS kept FROM trim ORDER BY k DESC LIMIT 1"""
)
def iterative_trim(t: Tables) -> DataFrame:
    m, s, n = stats.iterative_trim(t.table("events"), "value", 2.0)
    return t.spark.createDataFrame([(m, s, n)], "mean double, deviation double, kept bigint").select(F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "kept")


#: Exons with neighbours and coding parts.
EXONS = """SELECT p_partkey % 40 AS gene, p_partkey * 53 AS start, p_partkey * 53 + p_size * 3 AS {end}, CASE WHEN p_partkey % 3 > 0 THEN 1 END AS prev_end, CASE WHEN p_partkey % 5 > 1 THEN 1 END AS next_start,
  CASE WHEN p_size % 2 = 0 THEN p_partkey * 53 + p_size % 4 END AS coding_start, CASE WHEN p_size % 2 = 0 THEN p_partkey * 53 + p_size * 3 - p_size % 3 END AS coding_end FROM {part}"""


@query(
    f""", x AS ({EXONS.replace("{part}", "part").replace("{end}", '"end"')}), asks AS (SELECT point, CAST(pos % 40 AS BIGINT) AS gene, pos % 11000 AS pos, CASE WHEN contig % 2 = 0 THEN 'upstream' ELSE 'downstream' END AS direction FROM points_v)
    SELECT point, EXISTS (SELECT 1 FROM x WHERE x.gene = asks.gene AND CASE WHEN direction = 'upstream'
        THEN abs(x.start - pos) <= 2 AND (prev_end IS NOT NULL OR (next_start IS NULL AND coding_start IS NOT NULL) OR coalesce(x.start = coding_start, false))
        ELSE abs(x."end" - pos) <= 2 AND (next_start IS NOT NULL OR (prev_end IS NULL AND coding_start IS NOT NULL) OR coalesce(x."end" = coding_end, false)) END) AS spliced FROM asks"""
)
def splice_sites(t: Tables) -> DataFrame:
    sites = intervals.splice_sites(t.spark.sql(EXONS.replace("{end}", "`end`"), part=t.table("part")))
    asks = t.points.select("point", (F.col("pos") % 40).cast("bigint").alias("gene"), (F.col("pos") % 11000).alias("pos"), F.when(F.col("contig") % 2 == 0, F.lit("upstream")).otherwise(F.lit("downstream")).alias("direction"))
    return intervals.spliced(asks, sites, "gene", "direction", "pos", "spliced").select("point", "spliced")


# intervals


@query("""SELECT point, id FROM points_v JOIN genes_v ON points_v.contig = genes_v.contig AND pos BETWEEN start AND "end" """)
def gene_point_join(t: Tables) -> DataFrame:
    return intervals.point_join(t.points, t.genes, width=2000).select("point", "id")


@query("""SELECT a.id AS left_id, b.id AS right_id FROM genes_v a JOIN genes_v b ON a.contig = b.contig AND a.start <= b."end" AND b.start <= a."end" """)
def gene_range_join(t: Tables) -> DataFrame:
    b = t.genes.select(F.col("id").alias("right_id"), F.col("contig").alias("r_contig"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return intervals.range_join(t.genes.withColumnRenamed("id", "left_id"), b, width=2000).select("left_id", "right_id")


@query("""SELECT point, EXISTS (SELECT 1 FROM genes_v WHERE gene = pos % 40 AND abs(start - pos) <= 2) AS spliced FROM points_v""")
def boundary_semi_join(t: Tables) -> DataFrame:
    p = t.points.select("point", (F.col("pos") % 40).alias("gene"), F.lit("upstream").alias("direction"), "pos")
    return intervals.spliced(p, intervals.boundary_sites(t.genes), "gene", "direction", "pos", "spliced").select("point", "spliced")


@query(
    """, l AS (SELECT contig, "end" AS at_, min(id) AS id FROM genes_v GROUP BY ALL), r AS (SELECT contig, start AS at_, min(id) AS id FROM genes_v GROUP BY ALL)
    SELECT p.point, l.id AS left_id, p.pos - l.at_ AS left_distance, r.id AS right_id, r.at_ - p.pos AS right_distance
    FROM points_v p ASOF LEFT JOIN l ON p.contig = l.contig AND p.pos > l.at_ ASOF LEFT JOIN r ON p.contig = r.contig AND p.pos < r.at_"""
)
def flanking_genes(t: Tables) -> DataFrame:
    return intervals.flanking(t.points, t.genes).select("point", "left_id", "left_distance", "right_id", "right_distance")


ISLAND = """, marked AS (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY {by} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new_ FROM genes_v),
    numbered AS (SELECT *, sum(new_) OVER (PARTITION BY {by} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM marked), merged AS (SELECT {by}, min(start) AS start, max("end") AS "end" FROM numbered GROUP BY {by}, island)"""


@query(ISLAND.format(by="contig") + ' SELECT contig, start, "end" FROM merged')
def merge_gene_intervals(t: Tables) -> DataFrame:
    return intervals.merge_intervals(t.genes, ["contig"])


@query(ISLAND.format(by="gene") + ' SELECT gene, sum("end" - start + 1)::BIGINT AS length FROM merged GROUP BY gene')
def exonic_length(t: Tables) -> DataFrame:
    return intervals.covered_length(t.genes, ["gene"])


@query(
    """, edges AS (SELECT DISTINCT contig, unnest([start, "end" + 1]) AS seg_start FROM genes_v), cut AS (SELECT contig, seg_start, lead(seg_start) OVER (PARTITION BY contig ORDER BY seg_start) - 1 AS seg_end FROM edges)
    SELECT c.contig, seg_start, seg_end, string_agg(g.id::VARCHAR, ',' ORDER BY g.id) AS ids FROM cut c JOIN genes_v g ON g.contig = c.contig AND seg_start BETWEEN start AND "end" WHERE seg_end IS NOT NULL GROUP BY ALL"""
)
def interval_segments(t: Tables) -> DataFrame:
    return intervals.segments(t.genes).withColumn("ids", F.array_join("ids", ","))


@query(
    """, e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS at_ FROM events), n AS (SELECT *, CASE WHEN at_ - lag(at_) OVER (PARTITION BY user_id ORDER BY at_) <= 10000 THEN 0 ELSE 1 END AS new_ FROM e)
    SELECT event_id, user_id, (sum(new_) OVER (PARTITION BY user_id ORDER BY at_))::BIGINT AS island FROM n"""
)
def dummy_islands(t: Tables) -> DataFrame:
    e = t.table("events").select("user_id", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"))
    return intervals.islands(e, ["user_id"], "at", 10_000).select("event_id", "user_id", "island")


# rules and variants

_G, _H = "(s_suppkey % 40)", "(40 + s_suppkey % 10)"
_SPAN = "CASE {k} WHEN 'gene' THEN {g} * 20000 WHEN 'range' THEN {g} * 20000 - 1000 WHEN 'position' THEN {g} * 20000 + s_suppkey % 5 * {step} END AS {p}_start, CASE {k} WHEN 'gene' THEN {g} * 20000 + 30000 + {g} % 3 * 40000 WHEN 'range' THEN {g} * 20000 + 60000 WHEN 'position' THEN {g} * 20000 + s_suppkey % 5 * {step} END AS {p}_end"
#: A rule for each supplier, of all kinds.
RULES = f"""
SELECT rule_id, a_kind, b_kind, {_G} % 4 AS a_contig, {_H} % 4 AS b_contig, {_SPAN.format(k="a_kind", g=_G, p="a", step=7)}, {_SPAN.format(k="b_kind", g=_H, p="b", step=11)},
       CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 2 = 0 END AS a_strand, CASE WHEN s_suppkey % 7 = 0 THEN s_suppkey % 2 = 1 END AS b_strand,
       CASE WHEN a_kind = 'gene' THEN {_G} END AS a_gene_id, CASE WHEN b_kind = 'gene' THEN {_H} END AS b_gene_id, tag
FROM (SELECT *, s_suppkey AS rule_id, concat('t', CAST(s_nationkey AS STRING)) AS tag,
             CASE s_suppkey % 3 WHEN 0 THEN 'range' WHEN 1 THEN 'position' ELSE 'gene' END AS a_kind,
             CASE s_suppkey % 13 WHEN 0 THEN 'any' WHEN 1 THEN 'split_read_donor' WHEN 2 THEN 'split_read_acceptor' WHEN 3 THEN 'split_read_any' WHEN 4 THEN 'discordant_mates' WHEN 5 THEN 'read_through'
               WHEN 6 THEN 'low_support' WHEN 7 THEN 'filter_spliced' WHEN 8 THEN 'not_both_spliced' WHEN 9 THEN 'range' WHEN 10 THEN 'position' ELSE 'gene' END AS b_kind
      FROM {{supplier}}) AS r
"""
_RULES = f", rules AS ({RULES.format(supplier='supplier')})"


def _rules(t: Tables) -> DataFrame:
    return t.spark.sql(RULES, supplier=t.table("supplier"))


def fits(p: str, i: int, reach: int = 0) -> str:
    """SQL of one side of a rule."""
    there = f"(contig{i} = {p}_contig AND ({p}_strand IS NULL OR ambiguous OR strand{i} = {p}_strand))"
    part = f"""CASE WHEN g{i}_start >= {p}_start AND g{i}_end <= {p}_end THEN 1 WHEN g{i}_start < {p}_start AND g{i}_end > {p}_end THEN ({p}_end - {p}_start) / (g{i}_end - g{i}_start + 1)
      WHEN g{i}_start BETWEEN {p}_start AND {p}_end THEN ({p}_end - g{i}_start) / (g{i}_end - g{i}_start + 1) WHEN g{i}_end BETWEEN {p}_start AND {p}_end THEN (g{i}_end - {p}_start) / (g{i}_end - g{i}_start + 1) ELSE 0 END"""
    return f"""coalesce(CASE {p}_kind WHEN 'range' THEN {there} AND {part} > 0.5::DOUBLE
      WHEN 'position' THEN {there} AND (bp{i} = {p}_start OR (split1 + split2 = 0 AND CASE WHEN dir{i} = 'downstream' THEN bp{i} BETWEEN {p}_start - {reach} AND {p}_start ELSE bp{i} BETWEEN {p}_start AND {p}_start + {reach} END))
      WHEN 'gene' THEN gene{i} = {p}_gene_id WHEN 'any' THEN true WHEN 'split_read_donor' THEN disc + split{i} = 0 WHEN 'split_read_acceptor' THEN disc + split{3 - i} = 0 WHEN 'split_read_any' THEN disc = 0
      WHEN 'discordant_mates' THEN split1 + split2 = 0 WHEN 'read_through' THEN {RT} WHEN 'low_support' THEN evalue > 0.3::DOUBLE WHEN 'filter_spliced' THEN evalue > 0.3::DOUBLE AND spliced1 AND spliced2
      WHEN 'not_both_spliced' THEN NOT spliced1 OR NOT spliced2 END, false)"""


EITHER = "(({a1}) AND ({b2})) OR (({a2}) AND ({b1}))"
#: The first region at the 5' side; either way round if that isn't known and the breakpoints lie apart.
_FREE = "(bp1 + bp2 + gene1) % 3 = 0 AND NOT (contig1 = contig2 AND abs(bp2 - bp1) < 1000000)"
_TWO = "(bp1 + bp2 + gene1) % 3 = 2"


def _ordered(reach: int = 0) -> str:
    return f"(({_FREE} OR NOT {_TWO}) AND {fits('a', 1, reach)} AND {fits('b', 2, reach)}) OR (({_FREE} OR {_TWO}) AND {fits('a', 2, reach)} AND {fits('b', 1, reach)})"


def _sided(t: Tables) -> DataFrame:
    return t.events.withColumn("five", (F.col("bp1") + F.col("bp2") + F.col("gene1")) % 3)


@query(_RULES + " SELECT event_id, rule_id FROM events_v JOIN rules ON " + EITHER.format(a1=fits("a", 1, 25), b2=fits("b", 2, 25), a2=fits("a", 2, 25), b1=fits("b", 1, 25)))
def blacklist_bins(t: Tables) -> DataFrame:
    return rules.rule_hits(t.events, _rules(t), reach=25)


@query(_RULES + f" SELECT event_id, rule_id FROM events_v JOIN rules ON {_ordered()}")
def known_pairs(t: Tables) -> DataFrame:
    return rules.rule_hits(_sided(t), _rules(t), ordered=True)


@query(
    _RULES
    + f""", h AS (SELECT event_id, bool_or(a_kind = 'position' AND b_kind = 'position') AS exact FROM events_v JOIN rules ON {_ordered(25)} GROUP BY event_id)
    SELECT event_id, CASE WHEN fate IN ('relative_support', 'min_support') AND gene1 <> gene2 AND exact IS NOT NULL
      AND (exact OR {SUP} >= 2 OR ({BOTH} AND cov1 + cov2 < 200 AND (contig1 <> contig2 OR abs(bp2 - bp1) > 1000000))) THEN 'none' ELSE fate END AS fate FROM events_v LEFT JOIN h USING (event_id)"""
)
def known_fusions(t: Tables) -> DataFrame:
    return fates(rules.recover_known(_sided(t), _rules(t), 25))


@query(_RULES + f", h AS (SELECT event_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM events_v JOIN rules ON {_ordered()} GROUP BY event_id) SELECT event_id, coalesce(tags, '.') AS tags FROM events_v LEFT JOIN h USING (event_id)")
def tag_events(t: Tables) -> DataFrame:
    return rules.tags(_sided(t), _rules(t)).select("event_id", "tags")


VARIANTS = "SELECT o_orderkey % 4 AS contig1, o_custkey % 4 AS contig2, CASE WHEN o_orderkey % 2 = 0 THEN 'downstream' ELSE 'upstream' END AS dir1, CASE WHEN o_orderkey % 3 = 0 THEN 'downstream' ELSE 'upstream' END AS dir2, (o_orderkey * 7919) % 800000 AS pos1, (o_custkey * 104729 + o_orderkey) % 1000000 AS pos2 FROM {orders}"


@query(
    f""", v AS ({VARIANTS.replace("{orders}", "orders")}),
    e AS (SELECT *, dir1 = 'upstream' AS up1, CASE WHEN g1_dummy THEN bp1 ELSE g1_start END - 100000 AS lo1, CASE WHEN g1_dummy THEN bp1 ELSE g1_end END + 100000 AS hi1,
      CASE WHEN g2_dummy THEN bp2 ELSE g2_start END - 100000 AS lo2, CASE WHEN g2_dummy THEN bp2 ELSE g2_end END + 100000 AS hi2 FROM events_v),
    ahead AS (SELECT event_id, min(pos1) AS first_ FROM e JOIN v USING (contig1, contig2, dir1, dir2) WHERE NOT up1 AND pos1 >= bp1 - 5 GROUP BY event_id),
    h AS (SELECT event_id, min((abs(pos1 - bp1) + abs(pos2 - bp2), CASE WHEN up1 THEN -pos1 ELSE pos1 END, pos2, pos1)) AS b FROM e LEFT JOIN ahead USING (event_id) JOIN v USING (contig1, contig2, dir1, dir2)
      WHERE CASE WHEN up1 THEN pos1 >= lo1 AND pos1 < bp1 + 5 ELSE pos1 = first_ AND pos1 <= hi1 END
        AND CASE WHEN dir2 = 'upstream' THEN pos2 BETWEEN lo2 AND bp2 + 5 ELSE pos2 BETWEEN bp2 - 5 AND hi2 END
        AND CASE WHEN contig1 <> contig2 THEN true WHEN up1 AND dir2 = 'downstream' THEN NOT {ITD} OR (bp1 - pos1 < 100 AND pos2 - bp2 < 100)
          WHEN NOT up1 AND dir2 = 'upstream' THEN pos1 < bp2 AND pos2 > bp1 WHEN up1 THEN pos2 > bp1 ELSE pos1 < bp2 END
      GROUP BY event_id)
    SELECT e.event_id, b[4] AS gbp1, b[3] AS gbp2, b[1] AS gdist FROM events_v e LEFT JOIN h USING (event_id)"""
)
def nearest_sv(t: Tables) -> DataFrame:
    return pivot.nearest_variant(t.events.drop("gbp1", "gbp2"), t.spark.sql(VARIANTS, orders=t.table("orders"))).select("event_id", "gbp1", "gbp2", "gdist")


# sequences

DNA = "translate(regexp_replace(lower(text), '[^a-z]', ''{g}), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
_DNA = DNA.replace("{g}", ", 'g'")


def _dna(t: Tables, table: str = "documents", key: str = "doc_id") -> DataFrame:
    return t.table(table).select(key, F.expr(DNA.replace("{g}", "")).alias("seq"))


@query(f"SELECT doc_id, md5(reverse(translate({_DNA}, 'ACGT', 'TGCA'))) AS digest FROM documents")
def reverse_complement(t: Tables) -> DataFrame:
    return _dna(t).select("doc_id", F.md5(sq.reverse_complement(F.col("seq"))).alias("digest"))


_CODONS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sq.CODONS.items()) + "}"


@query(f", s AS (SELECT doc_id, regexp_extract_all({_DNA}, '...') AS c FROM documents) SELECT doc_id, md5(coalesce(array_to_string(list_transform(c, lambda x: {_CODONS}[x]), ''), '')) AS digest FROM s")
def translate_codons(t: Tables) -> DataFrame:
    return _dna(t).select("doc_id", F.md5(sq.translate_codons(F.col("seq"))).alias("digest"))


@query(f"SELECT doc_id, regexp_matches({_DNA}, 'A{{6}}|C{{6}}|G{{6}}|T{{6}}') AS homopolymer FROM documents")
def homopolymer(t: Tables) -> DataFrame:
    return _dna(t).select("doc_id", sq.has_homopolymer(F.col("seq"), 6).alias("homopolymer"))


@query(
    f""", s AS (SELECT doc_id, unnest(regexp_extract_all({_DNA}, '.{{1,100}}')) AS seq FROM documents), l AS (SELECT doc_id, seq, left(seq, length(seq) - 1) AS k FROM s),
    w AS (SELECT doc_id, seq, k, list_distinct(list_transform(range(1, length(k) - 1), lambda i: substr(k, i, 3))) AS words FROM l),
    n AS (SELECT doc_id, seq, coalesce(list_max(list_transform(words, lambda x: (length(k) - length(replace(k, x, ''))) // 3)), 0)::INT AS most FROM w)
    SELECT doc_id, seq, most, length(seq) >= 3 AND most >= floor(length(seq) * 0.3::DOUBLE / 3 + 0.5::DOUBLE) AS low_entropy FROM n"""
)
def kmer_entropy(t: Tables) -> DataFrame:
    reads = _dna(t).select("doc_id", F.explode(F.regexp_extract_all("seq", F.lit("(.{1,100})"))).alias("seq"))
    return reads.select("doc_id", "seq", rf.low_entropy_counts(F.col("seq")).alias("most"), rf.low_entropy(F.col("seq"), 0.3).alias("low_entropy"))


@query(
    f""", d AS (SELECT 'd' || doc_id AS id, unnest(list_distinct(list_transform(range(1, length(s) - 22), lambda i: substr(s, i, 24)))) AS kmer FROM (SELECT doc_id, {_DNA} AS s FROM documents)),
    b AS (SELECT 'b' || item_id AS id, unnest(list_distinct(list_transform(range(1, length(s) - 22), lambda i: substr(s, i, 24)))) AS kmer FROM (SELECT item_id, {_DNA} AS s FROM benchmark)),
    n AS (SELECT id, count(*) AS n FROM b GROUP BY id)
    SELECT d.id AS doc, b.id AS item, count(*) AS shared, count(*) / any_value(n.n) AS fraction FROM d JOIN b USING (kmer) JOIN n ON n.id = b.id GROUP BY d.id, b.id"""
)
def kmer_homology(t: Tables) -> DataFrame:
    cut = lambda d, k, p: d.select(F.concat(F.lit(p), F.col(k)).alias("id"), F.explode(F.array_distinct(sq.kmers(F.col("seq"), 24))).alias("kmer"))
    d, b = cut(_dna(t), "doc_id", "d"), cut(_dna(t, "benchmark", "item_id"), "item_id", "b")
    n = b.groupBy("id").agg(F.count("*").alias("n"))
    shared = d.select(F.col("id").alias("doc"), "kmer").join(b.withColumnRenamed("id", "item"), "kmer").groupBy("doc", "item").agg(F.count("*").alias("shared"))
    return shared.join(n.withColumnRenamed("id", "item"), "item").select("doc", "item", "shared", (F.col("shared") / F.col("n")).alias("fraction"))


@query(""", k AS (SELECT DISTINCT item_id AS id, unnest(list_transform(range(1, length(s) - 10), lambda i: substr(s, i, 12))) AS kmer FROM (SELECT item_id, {dna} AS s FROM benchmark)), n AS (SELECT id, count(*) AS n FROM k GROUP BY id)
    SELECT x.id AS a, y.id AS b, count(*) AS shared, count(*) / least(any_value(n.n), any_value(m.n)) AS fraction FROM k x JOIN k y ON x.kmer = y.kmer AND x.id < y.id JOIN n ON n.id = x.id JOIN n m ON m.id = y.id GROUP BY x.id, y.id""".replace("{dna}", _DNA))
def related_strains(t: Tables) -> DataFrame:
    k = _dna(t, "benchmark", "item_id").select(F.col("item_id").alias("id"), F.explode(sq.kmers(F.col("seq"), 12)).alias("kmer"))
    return stats.containment(k)


@query(f"SELECT item_id, pos, list_sum(list_transform(range(0, 8), lambda i: (CASE substr(s, pos + i + 1, 1) WHEN 'T' THEN 0 WHEN 'G' THEN 1 WHEN 'C' THEN 2 ELSE 3 END) * (4 ** (7 - i))::BIGINT))::BIGINT AS code FROM (SELECT item_id, s, unnest(range(0, length(s) - 7)) AS pos FROM (SELECT item_id, {_DNA} AS s FROM benchmark))")
def kmer_index_codes(t: Tables) -> DataFrame:
    """The codes of all 8-mers with their places from 0."""
    places = _dna(t, "benchmark", "item_id").select("item_id", F.posexplode(sq.kmers(F.col("seq"), 8)).alias("pos", "kmer"))
    return places.select("item_id", "pos", sq.kmer_code(F.col("kmer")).alias("code"))


# text attributes


@query("""SELECT page_id, nullif(regexp_extract(url, 'utm_source=([^;]*)', 1), '') AS source, nullif(regexp_extract(html, '(?:^|[; ])class="([^"]*)"', 1), '') AS css FROM pages""")
def attribute_parse(t: Tables) -> DataFrame:
    html = F.regexp_replace("html", '="', ' "')
    return t.table("pages").select("page_id", sq.gff3_attribute(F.col("url"), "utm_source").alias("source"), sq.gtf_attribute(html, "class").alias("css"))


@query("SELECT p_partkey, 'xA~' || chr((33 + p_partkey % 94)::INT) || p_name AS decoded, regexp_replace('xA~' || chr((33 + p_partkey % 94)::INT) || p_name, '[^!-~]|[,|]', '_', 'g') AS name FROM part")
def percent_decode(t: Tables) -> DataFrame:
    escaped = F.concat(F.lit("x%41%7e%"), F.hex((33 + F.col("p_partkey") % 94).cast("int")), F.col("p_name"))
    return t.table("part").select("p_partkey", sq.percent_decoded(escaped).alias("decoded"), sq.domain_name(escaped).alias("name"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 'a' || 'chr' || p_brand ELSE p_brand END AS contig, 'ENSG' || p_partkey AS gene_id FROM part")
def identifiers(t: Tables) -> DataFrame:
    n = F.col("p_partkey") % 3
    name = F.concat(F.when(n == 0, F.lit("chr")).when(n == 1, F.lit("")).otherwise(F.lit("achr")), "p_brand")
    gene = F.concat(F.lit("ENSG"), "p_partkey", F.when(n == 1, F.lit("")).otherwise(F.concat(F.lit("."), "p_size")))
    return t.table("part").select("p_partkey", sq.strip_chr(name).alias("contig"), sq.strip_version(gene).alias("gene_id"))


@query(
    f""", r AS (SELECT *, row_number() OVER (PARTITION BY {DUP} ORDER BY read_key) AS n FROM reads_v WHERE fate = 'none'), e AS (SELECT gene1, gene2, dir1, dir2, bp1, bp2, count(*) AS support FROM r WHERE n = 1 GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY gene1, gene2, dir1, dir2 ORDER BY support DESC, CASE WHEN dir1 = 'downstream' THEN -bp1 ELSE bp1 END, CASE WHEN dir2 = 'downstream' THEN -bp2 ELSE bp2 END) AS k FROM e WHERE support >= 1)
    SELECT gene1, gene2, dir1, dir2, bp1, bp2, support FROM b WHERE k = 1"""
)
def flagship(t: Tables) -> DataFrame:
    """Which gene pairs are joined, at which best breakpoint, by how many fragments that are no duplicates?"""
    marked = rf.mark_duplicates(t.reads, DUP.split(", ")).where("fate = 'none'")
    e = marked.groupBy("gene1", "gene2", "dir1", "dir2", "bp1", "bp2").agg(F.count("*").alias("support"))
    outer = lambda i: F.when(F.col(f"dir{i}") == ev.DOWN, -F.col(f"bp{i}")).otherwise(F.col(f"bp{i}"))
    best = F.max_by(F.struct("bp1", "bp2", "support"), F.struct("support", -outer(1), -outer(2)))
    return e.groupBy("gene1", "gene2", "dir1", "dir2").agg(best.alias("b")).select("gene1", "gene2", "dir1", "dir2", "b.bp1", "b.bp2", "b.support")
