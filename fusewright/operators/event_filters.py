"""Event-level steps: predicates, rankers and recoveries over the flat columns of functions.events.

Further columns that some steps read: evalue, cov1, cov2 (depth at the retained side), anchor1,
anchor2, gbp1, gbp2 (nearest structural variant; null without), viral1, viral2, listed (supporting
reads of any fate), event_id (unique).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import events as ev
from ..functions.events import DOWN, UP
from ..session import settled, stored
from .fate import NONE, discard, recover

c = F.col
PAIR = ("gene1", "gene2")
KEY = ("gene1", "gene2", "dir1", "dir2")
PLACE = ("contig1", "contig2", "bp1", "bp2", "dir1", "dir2")


def _bool(x: str) -> Column:
    return c(x).cast("int")


#: Counts of an event that a tandem duplication takes over with the reads it merges.
LISTED = ("listed_split", "listed", "all_split", "spared_split1", "spared_split2")


def merge_run(run: list[dict], reach: int, longest: int) -> list[dict]:
    """One scan over events of a key by (bp1, bp2); counts change while it goes, and it doesn't matter whether an event was merged before.

    An event with at least as many supporting reads as each of its neighbours (then as many listed
    split reads) takes their split reads, and they are merged. Neighbours are shifts of each other by
    up to reach; of a tandem duplication all whose breakpoints are that near, and its listed reads count.
    """
    itd = [e["same_gene"] and e["up_down"] and 0 <= e["bp2"] - e["bp1"] < longest for e in run]
    line = [e["bp1"] + e["bp2"] if e["same_dir"] else e["bp2"] - e["bp1"] for e in run]
    first = 0
    for i, e in enumerate(run):
        while run[first]["bp1"] < e["bp1"] - reach:
            first += 1
        if not (e["listed_split"] if itd[i] else e["split1"] + e["split2"]):
            continue
        near, j = [], first
        while j < len(run) and run[j]["bp1"] <= e["bp1"] + reach:
            x = run[j]
            close = line[j] == line[i] or (itd[i] and abs(x["bp2"] - e["bp2"]) <= reach)
            if j != i and close and (x["split1"] + x["split2"] or (itd[i] and x["listed_split"])):
                near.append(x)
            j += 1
        rank = lambda x: (x["split1"] + x["split2"] + x["disc"], x["listed_split"])
        if any(rank(x) > rank(e) for x in near):
            continue
        for x in near:
            x["merged"] = True
        for k in ("split1", "split2", *(LISTED if itd[i] else ())):
            e[k] += sum(x[k] for x in near)
    return run


def merge_adjacent(df: DataFrame, reach: int = 5, longest: int = 100) -> DataFrame:
    """Best supported events take the split reads of events that are shifts of them by up to reach; those get the fate merge_adjacent.

    Live events count, and tandem duplications up to longest bases of any fate. A shift keeps bp1 +
    bp2 if the directions are equal, else bp2 - bp1: such a diagonal, or the whole key where tandem
    duplications may stand, falls into runs whose steps in bp1 are at most reach. Events that are
    alone in their run stay in the plan; others are streamed by run through merge_run(), whose order
    matters. Neither a hot gene pair nor a diagonal is one task, only a run is.
    """
    import pandas as pd

    listed = [k for k in LISTED if k in df.columns]
    ours = ev.is_tandem_duplication(longest)
    both = c("same_gene") & c("up_down")
    line = F.when(both, F.lit(0)).when(c("same_dir"), c("bp1") + c("bp2")).otherwise(c("bp2") - c("bp1"))
    key = ["gene1", "gene2", "dir1", "dir2", "contig1", "contig2"]
    live = df.where((c("fate") == NONE) | ours).select("event_id", *key, "bp1", "bp2", *(c(k).cast("bigint").alias(k) for k in ("split1", "split2", "disc", *listed)))
    live = live.withColumns({"same_gene": ev.same_gene(), "same_dir": c("dir1") == c("dir2"), "up_down": (c("dir1") == UP) & (c("dir2") == DOWN)}).withColumn("line", line)
    by = Window.partitionBy(*key, "line").orderBy("bp1", "bp2", "event_id")
    live = live.withColumn("step", (c("bp1") - F.lag("bp1").over(by) > reach).cast("int")).withColumn("run", F.sum(F.coalesce("step", F.lit(0))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    live = live.withColumn("n", F.count("*").over(Window.partitionBy(*key, "line", "run"))).where("n > 1").drop("n", "step")
    for k in LISTED:
        if k not in listed:
            live = live.withColumn(k, c("split1") + c("split2") if k == "listed_split" else F.lit(0).cast("bigint"))
    run = [*key, "line", "run"]
    live = live.repartition(*run).sortWithinPartitions(*run, "bp1", "bp2", "event_id")

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        columns = ["event_id", "merged", "split1", "split2", *LISTED]

        def done(rows: list[dict]) -> pd.DataFrame:
            return pd.DataFrame([{k: x.get(k, False) for k in columns} for x in merge_run(rows, reach, longest)], columns=columns)

        for frame in frames:
            out = []
            for x in frame.to_dict("records"):
                if held and any(held[-1][k] != x[k] for k in run):
                    out.append(done(held))
                    held = []
                held.append(x)
            if out:
                yield pd.concat(out)
        if held:
            yield done(held)

    counts = ["split1", "split2", *listed]
    changed = live.mapInPandas(scan, "event_id string, merged boolean, " + ", ".join(f"{k} bigint" for k in ("split1", "split2", *LISTED)))
    changed = changed.select("event_id", c("merged").alias("__merged"), *(c(k).alias(f"__{k}") for k in counts))
    out = df.join(changed, "event_id", "left").withColumns({k: F.coalesce(c(f"__{k}"), c(k)).cast(df.schema[k].dataType) for k in counts})
    return out.withColumn("fate", F.when(c("__merged"), F.lit("merge_adjacent")).otherwise(c("fate"))).drop("__merged", *(f"__{k}" for k in counts))


def multimappers(evidence: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """evidence (read_group, read_key, event_id, role, score, fate) and events with the losers' fate multimappers, and events' counters without them.

    Of a fragment's alignments the one of the best score stays; of equal ones that whose event has
    most support, then coding genes, then the first by breakpoints. An event that loses all its reads
    gets the fate too.
    """
    facts = stored(events.select("event_id", ev.support().alias("__support"), _bool("g1_coding").alias("__coding1"), _bool("g2_coding").alias("__coding2"), *(c(k).alias(f"__{k}") for k in PLACE)))
    down = lambda k: F.struct(c(k).isNull().alias("none"), (-c(k)).alias("v"))
    order = [down("__support"), down("__coding1"), down("__coding2"), *(c(f"__{k}") for k in PLACE), c("event_id")]
    # a read stands in several events: its best one speaks for it
    known = evidence.join(facts, "event_id", "left").repartition("read_group")
    known = known.withColumn("__n", F.row_number().over(Window.partitionBy("read_group", "read_key").orderBy(*order)))
    best = F.min_by("read_key", F.when(c("__n") == 1, F.struct(down("score").alias("score"), *(o.alias(f"o{i}") for i, o in enumerate(order)), c("read_key"))))
    known = known.withColumn("__best", best.over(Window.partitionBy("read_group")))
    marked = discard(known, "multimappers", c("read_key") != c("__best")).select(*evidence.columns)
    gone = marked.where(c("fate") == "multimappers").groupBy("event_id").agg(*(F.sum((c("role") == r).cast("int")).alias(f"__{k}") for r, k in (("split1", "split1"), ("split2", "split2"), ("discordant", "disc"))))
    out = events.join(gone, "event_id", "left")
    open_ = (c("fate") == NONE) & c("__split1").isNotNull() & (ev.support() > 0)
    out = out.withColumn("__open", open_).withColumns({k: F.when(c("__open"), F.greatest(F.lit(0), c(k) - c(f"__{k}"))).otherwise(c(k)).cast("bigint") for k in ("split1", "split2", "disc")})
    out = out.withColumn("fate", F.when(c("__open") & (ev.support() == 0), F.lit("multimappers")).otherwise(c("fate")))
    return marked, out.drop("__open", "__split1", "__split2", "__disc")


def best_alignment(alignments: DataFrame, group: str = "read_group") -> DataFrame:
    """Of a fragment's alignments (read_group, read_key, score, support, coding, bp1, bp2, fate) all but the best get the fate multimappers."""
    w = Window.partitionBy(group)
    ranked = w.orderBy(c("score").desc(), c("support").desc(), c("coding").desc(), "bp1", "bp2", "read_key")
    marked = alignments.withColumn("__rank", F.row_number().over(ranked))
    return discard(marked, "multimappers", c("__rank") > 1).drop("__rank")


def non_coding_neighbors() -> Column:
    return ev.is_read_through() & ~c("g1_coding") & ~c("g2_coding")


def intragenic_exonic(fraction: float = 0.33) -> Column:
    """Both breakpoints in exons of one gene, though under fraction of what lies between them is exonic, or all of it. spliced_distance: along the gene's transcripts."""
    near = ev.same_gene() | ev.overlaps_both_genes()
    d = ev.distance()
    return near & c("exonic1") & c("exonic2") & ~(c("spliced1") & c("spliced2")) & ((c("spliced_distance") == d) | (c("spliced_distance") / F.greatest(d, F.lit(1)) < fraction))


def min_support(least: int = 2) -> Column:
    return (ev.support() < least) | (ev.overlaps_both_genes() & (ev.split_reads() < least))


def relative_support(cutoff: float = 0.3) -> Column:
    return (c("evalue") >= cutoff) | (ev.is_intragenic() & (ev.split_reads() == 0))


def select_best(df: DataFrame) -> DataFrame:
    """Keeps the best of the live events of a gene pair and its directions: rank, support, exonic sides, outermost breakpoints, then the key.

    Hot gene pairs cost one sorted window of their events; the sort spills.
    """
    outer = lambda i: F.when(c(f"dir{i}") == DOWN, -c(f"bp{i}")).otherwise(c(f"bp{i}"))
    order = [ev.evidence_rank().desc(), ev.support().desc(), (_bool("exonic1") + _bool("exonic2")).desc(), _bool("exonic1").desc(), outer(1), outer(2), c("contig1"), c("contig2"), c("event_id")]
    w = Window.partitionBy(*KEY, (c("fate") == NONE)).orderBy(*order)
    return discard(df.withColumn("__n", F.row_number().over(w)), "select_best", c("__n") > 1).drop("__n")


#: Fates from which many spliced events recover.
FROM_SPLICED = ("inconsistently_clipped", "relative_support", "min_support", "select_best")


def many_spliced(df: DataFrame, least: int = 4) -> DataFrame:
    """Recovers spliced events of gene pairs with at least so many distinct spliced breakpoint pairs, in bins of 10."""
    eligible = ~ev.is_read_through() & (c("spliced1") | c("spliced2")) & ~ev.same_gene() & ~ev.overlaps_both_genes()
    cell = F.struct(F.floor(c("bp1") / 10), F.floor(c("bp2") / 10))
    counts = df.where(eligible & c("fate").isin(NONE, *FROM_SPLICED)).groupBy(*PAIR).agg(F.countDistinct(cell).alias("__cells"))
    return recover(df.join(counts, list(PAIR), "left"), FROM_SPLICED, eligible & (c("__cells") >= least)).drop("__cells")


#: Fates whose events never come back as isoforms.
NO_ISOFORM = ("merge_adjacent", "blacklist", "end_to_end", "duplicates")


def isoforms(df: DataFrame, apart: int = 2) -> DataFrame:
    """Recovers events spliced on both sides whose gene pair and directions have a passing event elsewhere (the one of greatest (bp1, bp2))."""
    passed = df.where(c("fate") == NONE).groupBy(*KEY).agg(F.max(F.struct("bp1", "bp2")).alias("__p"))
    away = (F.abs(c("__p.bp1") - c("bp1")) > apart) | (F.abs(c("__p.bp2") - c("bp2")) > apart)
    ok = ~c("fate").isin(*NO_ISOFORM) & ~ev.same_gene() & c("spliced1") & c("spliced2") & away
    out = df.join(passed, list(KEY), "left")
    return out.withColumn("fate", F.when((c("fate") != NONE) & F.coalesce(ok, F.lit(False)), F.lit(NONE)).otherwise(c("fate"))).drop("__p")


def recovery_threshold(counts: DataFrame, most: int = 200) -> int:
    """counts (reads, n) -> the least number of reads with which fewer than most events recover: 1 more than the largest whose running count from above reaches it."""
    w = Window.orderBy(c("reads").desc()).rowsBetween(Window.unboundedPreceding, 0)
    got = counts.withColumn("cum", F.sum("n").over(w)).where(c("cum") >= most).agg(F.max("reads")).first()[0]
    return 1 if got is None else got + 1


#: Fates from which events spliced on both sides recover, and those whose events count as support.
FROM_LOW_SUPPORT = ("relative_support", "min_support", "in_vitro")
COUNTED = (NONE, "in_vitro", "intronic", "relative_support", "min_support")


def pair_support(df: DataFrame) -> DataFrame:
    """Adds pair_reads: unique reads of all countable events of the gene pair with the same or with opposite directions.

    unique_reads is the number that an event counts for. A reciprocal event counts if it is no
    read-through and is spliced on both sides or lies so that one genomic break explains both. Those
    spliced on both sides are summed by key; only the others, one row for each breakpoint pair, meet
    the asking ones. Five branches read the events, which are computed once.
    """
    df = settled(df)
    counted = c("fate").isin(*COUNTED) | ((c("fate") == "inconsistently_clipped") & ev.both_spliced())
    votes = df.where(counted & (c("unique_reads") > 0))
    same = votes.groupBy(*KEY).agg(F.sum("unique_reads").alias("__same"))
    flip = lambda x: F.when(c(x) == DOWN, F.lit(UP)).otherwise(F.lit(DOWN))
    back = votes.where(~ev.is_read_through()).select(*PAIR, flip("dir1").alias("dir1"), flip("dir2").alias("dir2"), c("bp1").alias("__b1"), c("bp2").alias("__b2"), ev.both_spliced().alias("__bs"), c("unique_reads").alias("__u"))
    always = back.where("__bs").groupBy(*KEY).agg(F.sum("__u").alias("__always"))
    some = back.where("not __bs").groupBy(*KEY, "__b1", "__b2").agg(F.sum("__u").alias("__u"))
    asks = df.where(ev.both_spliced()).select(*KEY, "bp1", "bp2").distinct()
    fits = ((c("dir1") == DOWN) != (c("bp1") > c("__b1"))) & ((c("dir2") == DOWN) != (c("bp2") > c("__b2")))
    opposite = asks.join(some, list(KEY)).where(fits).groupBy(*KEY, "bp1", "bp2").agg(F.sum("__u").alias("__opposite"))
    out = df.join(same, list(KEY), "left").join(always, list(KEY), "left").join(opposite, [*KEY, "bp1", "bp2"], "left")
    total = F.coalesce("__same", F.lit(0)) + F.when(ev.both_spliced(), F.coalesce("__always", F.lit(0)) + F.coalesce("__opposite", F.lit(0))).otherwise(0)
    return out.withColumn("pair_reads", total).drop("__same", "__always", "__opposite")


def recover_spliced(df: DataFrame, most: int = 200) -> DataFrame:
    """Recovers events spliced on both sides whose pair has at least 2 reads, with a threshold that keeps their number moderate."""
    df = settled(pair_support(df))  # the threshold and the result both read it
    eligible = ev.both_spliced() & ~ev.same_gene() & ~ev.overlaps_both_genes() & ~ev.is_read_through() & c("fate").isin(*FROM_LOW_SUPPORT) & (c("pair_reads") >= 2)
    least = recovery_threshold(df.where(eligible).groupBy(ev.support().alias("reads")).agg(F.count("*").alias("n")), most)
    proximal = (ev.same_contig() & (F.abs(ev.distance()) < 1_000_000)).cast("int")
    return recover(df, FROM_LOW_SUPPORT, eligible & (ev.support() >= least + proximal)).drop("pair_reads")


def intronic() -> Column:
    """exonic_reads: unfiltered supporting reads with an exonic segment."""
    return (c("exonic_reads") == 0) & ~c("viral1") & ~c("viral2")


def no_genomic_support() -> Column:
    return (c("confidence") == 0) & c("gbp1").isNull() & ~c("viral1") & ~c("viral2")


#: Fates from which events with a structural variant recover.
FROM_GENOMIC = ("end_to_end", "intronic", "mismappers", "no_coverage", "in_vitro", "relative_support")


def recover_genomic(df: DataFrame) -> DataFrame:
    return recover(df, FROM_GENOMIC, c("gbp1").isNotNull())


def short_anchor(least: int = 23) -> Column:
    length = lambda i: F.abs(c(f"bp{i}") - c(f"anchor{i}"))
    return ~(c("spliced1") & c("spliced2")) & ((length(1) < least) | (length(2) < least))


def end_to_end() -> Column:
    """Weak support and both genes joined at their 3' ends."""
    spared = c("viral1") | c("viral2") | (~ev.is_read_through() & ~ev.same_gene() & (c("spliced1") | c("spliced2")))
    weak = (c("disc") + c("split1") == 0) | (c("disc") + c("split2") == 0) | (ev.split_reads() == 0) | (ev.overlaps_both_genes() & ((c("split1") == 0) | (c("split2") == 0)))
    tail = lambda i: c(f"g{i}_dummy") | ~ev.five_prime(i)
    near = ev.same_contig() & (ev.distance() < 1_000_000)
    exonic = c("exonic1") & c("exonic2") & (c("g1_intronic_fraction") > 0.66) & (c("g2_intronic_fraction") > 0.66)
    return ~spared & weak & tail(1) & tail(2) & ((c("disc") < 10) | near | exonic)


def marginal_read_through(edge: float = 0.99, share: float = 0.07) -> Column:
    """Breakpoints in the outermost hundredth of donor and acceptor, with little support for the coverage."""
    part = lambda n, d: n / F.greatest(d, F.lit(1))
    l1, l2 = c("g1_end") - c("g1_start"), c("g2_end") - c("g2_start")
    real1, real2 = ~c("g1_dummy"), ~c("g2_dummy")
    case = (
        F.when(real1 & c("g1_strand"), F.struct(part(c("bp1") - c("g1_start"), l1).alias("d"), F.lit(1.0).alias("a")))
        .when(real2 & ~c("g2_strand"), F.struct(part(c("g2_end") - c("bp2"), l2).alias("d"), F.lit(1.0).alias("a")))
        .when(real1 & ~c("g1_strand"), F.struct(F.lit(1.0).alias("d"), part(c("bp1") - c("g1_start"), l1).alias("a")))
        .when(real2 & c("g2_strand"), F.struct(F.lit(1.0).alias("d"), part(c("g2_end") - c("bp2"), l2).alias("a")))
    )
    return ev.is_read_through() & (case["d"] > edge) & (case["a"] > edge) & (ev.support() < share * F.greatest("cov1", "cov2"))


def in_vitro(threshold: int | Column) -> Column:
    """Reverse-transcription artefacts. x1, x2: chimeric reads of the most expressed gene at each breakpoint; clipped1, clipped2: pairs clipped at them; neighbours: like events of the pair."""
    side = lambda i: F.when(~c(f"exonic{i}"), 0.5).when(~c(f"spliced{i}"), 1.0).otherwise(0.0)
    rt = side(1) + side(2)
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    split = ev.split_reads() + F.least("clipped1", "clipped2")
    x = c("x1") + c("x2")
    sound = lambda i: c(f"spliced{i}") | ~c(f"exonic{i}")
    covered = (ev.support() >= 10) & (4 * ev.support() >= F.greatest("cov1", "cov2")) & (c("cov1") > ev.support()) & (c("cov2") > ev.support())
    kept = covered & (c("spliced1") | c("spliced2")) & sound(1) & sound(2)
    high1, high2 = c("x1") > t, c("x2") > t
    any_ = (rt > 1) | ((rt > 0) & (high1 | high2)) | (c("x1") > 2 * t) | (c("x2") > 2 * t) | (high1 & high2) | (c("neighbours") > 8) | (ev.support() <= 1)
    return (split <= 2 + 0.0001 * x) & ((2 * split <= c("disc")) | (split <= 2)) & (x > t) & ~kept & any_


def filter_in_vitro(df: DataFrame, threshold: int | Column) -> DataFrame:
    """Also renames the fate of spliced events that were discarded for low support."""
    open_ = (c("fate") == NONE) | ((c("spliced1") | c("spliced2")) & c("fate").isin("relative_support", "min_support", "homopolymer"))
    return df.withColumn("fate", F.when(open_ & F.coalesce(in_vitro(threshold), F.lit(False)), F.lit("in_vitro")).otherwise(c("fate")))


def tandem_duplications(df: DataFrame, longest: int = 100, least: int = 10, share: float = 0.07, enough: int = 300) -> DataFrame:
    """Recovers internal tandem duplications in one coding exon: all_split reads of any spared fate, allele fraction after duplicates.

    The reads that other steps discarded (spared_split1, spared_split2) are live again and count as split reads from here on.
    """
    ok = ev.is_tandem_duplication(longest) & c("same_coding_exon") & (c("all_split") >= least)
    vaf = c("all_split") / F.greatest(F.greatest("cov1", "cov2") * (1 - c("duplicate_rate")), F.lit(1.0))
    from_ = ("relative_support", "intragenic_exonic", "hairpin", "inconsistently_clipped", "mismatches")
    back = c("fate").isin(*from_) & F.coalesce(ok & ((vaf > share) | (c("all_split") >= enough)), F.lit(False))
    out = df.withColumn("__back", back)
    more = {f"split{i}": F.when(c("__back"), c(f"split{i}") + c(f"spared_split{i}")).otherwise(c(f"split{i}")).cast(df.schema[f"split{i}"].dataType) for i in (1, 2)}
    return out.withColumns(more).withColumn("fate", F.when(c("__back"), F.lit(NONE)).otherwise(c("fate"))).drop("__back")


def needs_coverage() -> Column:
    """Weak events that stay only with normal fragments about their breakpoints."""
    strong = ~ev.is_read_through() & (((c("split1") + c("split2") > 0) & (c("split1") + c("disc") > 0) & (c("split2") + c("disc") > 0)) | c("spliced1") | c("spliced2"))
    spliced_through = ev.is_read_through() & c("spliced1") & c("spliced2")
    return ~strong & ~spliced_through


def no_coverage() -> Column:
    """side_covered1, side_covered2: a normal fragment starts or ends near the breakpoint; terminal1, terminal2: the gene's outer exon."""
    bare = (~c("terminal1") & ~c("side_covered1")) | (~c("terminal2") & ~c("side_covered2"))
    return needs_coverage() & bare


def filter_no_coverage(df: DataFrame, edges: DataFrame, exons: DataFrame, near: int = 200) -> DataFrame:
    """The step, with both of its inputs looked up for the events that ask for them. edges: stats.fragment_edges().

    Each side looks up both; events and edges are computed once.
    """
    from . import stats

    df, edges = settled(df), settled(edges)
    asks = df.where((c("fate") == NONE) & needs_coverage()).select("event_id", "gene1", "gene2", "contig1", "contig2", "bp1", "bp2", "dir1", "dir2", "anchor1", "anchor2", "split1", "split2")
    told = stats.terminal_exons(stats.covered_sides(asks, edges, near), exons).select("event_id", "side_covered1", "side_covered2", "terminal1", "terminal2")
    d = discard(df.drop("side_covered1", "side_covered2", "terminal1", "terminal2").join(told, "event_id", "left"), "no_coverage", no_coverage())
    return d.drop("side_covered1", "side_covered2", "terminal1", "terminal2")


def homologs(df: DataFrame, shared: DataFrame, fraction: float = 0.3, k: int = 8) -> DataFrame:
    """shared (gene1, gene2, hits, length): stepped k-mers of the smaller gene that the bigger one has. Discards events of homologous genes."""
    pairs = shared.where(c("hits") * k >= c("length") * fraction).select(*PAIR, F.lit(True).alias("__h"))
    return discard(df.join(pairs, list(PAIR), "left"), "homologs", c("__h")).drop("__h")


def mismappers(df: DataFrame, flagged: DataFrame, fraction: float = 0.8) -> DataFrame:
    """flagged (event_id, bad, total): realigned reads. An event goes once they are at least floor(fraction * total) and not none."""
    return discard(df.join(flagged, "event_id", "left"), "mismappers", (c("total") > 0) & (c("bad") >= F.greatest(F.floor(c("total") * fraction), F.lit(1)))).drop("bad", "total")


def assign_confidence(df: DataFrame) -> DataFrame:
    """Adds confidence: 0 low, 1 medium, 2 high.

    Overlapping deletions of a read-through's gene with other partners are found by semi-joins on the
    gene, with the overlap as residual; events spliced elsewhere by extremes of the gene pair.
    """
    live = (c("fate") == NONE) & (ev.split_reads() > 0) & ev.deletion_like()
    near = df.where(live).select(c("gene1").alias("n1"), c("gene2").alias("n2"), c("bp1").alias("nb1"), c("bp2").alias("nb2"))
    asks = df.where((c("fate") == NONE) & ev.is_read_through()).select("event_id", *PAIR, "bp1", "bp2")
    over = (c("nb2") > c("bp1")) & (c("nb1") < c("bp2")) & ((c("nb1") != c("bp1")) | (c("nb2") != c("bp2")))
    left = asks.join(near, (c("gene1") == c("n1")) & (c("gene2") != c("n2")) & over, "left_semi").select("event_id")
    right = asks.join(near, (c("gene2") == c("n2")) & (c("gene1") != c("n1")) & over, "left_semi").select("event_id")
    deletions = left.union(right).distinct().withColumn("__del", F.lit(True))
    spliced = df.where(c("spliced1") & c("spliced2")).groupBy(*PAIR).agg(F.min("bp1").alias("__lo1"), F.max("bp1").alias("__hi1"), F.min("bp2").alias("__lo2"), F.max("bp2").alias("__hi2"))
    d = df.join(deletions, "event_id", "left").join(spliced, list(PAIR), "left")
    # an event more than 2 away on either axis exists if and only if an extreme one is
    others = F.coalesce((c("bp1") - c("__lo1") > 2) | (c("__hi1") - c("bp1") > 2) | (c("bp2") - c("__lo2") > 2) | (c("__hi2") - c("bp2") > 2), F.lit(False))
    s, n = ev.split_reads(), ev.support()
    share = c("listed") / F.greatest(F.lit(1), c("cov1"), c("cov2"))
    kinds = (c("split1") > 0).cast("int") + (c("split2") > 0).cast("int") + (c("disc") > 0).cast("int")
    inner = F.when(s == 0, 0).when(~c("exonic1") & ~c("exonic2"), F.when((c("split1") > 0) & (c("split2") > 0), 2).otherwise(1)).when(~c("exonic1") | ~c("exonic2"), F.when((c("split1") > 3) & (c("split2") > 3), 2).otherwise(1)).otherwise(0)
    through = F.when((kinds >= 2) & (n >= 10), F.when((s >= 10) & (share > 0.07), 2).otherwise(1)).when(c("__del"), 1).otherwise(0)
    level = F.when((c("evalue") > 0.3) | (n < 2), 0).when(ev.is_read_through(), through).when(ev.overlaps_both_genes() | ev.same_gene(), inner).otherwise(2)
    steps = [
        lambda x: F.when((x == 0) & ev.same_gene() & c("exonic1") & c("exonic2") & ~c("spliced1") & ~c("spliced2") & (ev.distance() < 100) & (c("split1") > 0) & (c("split2") > 0) & (s >= 10) & (share > 0.15) & (c("dir1") == UP) & (c("dir2") == DOWN), 1).otherwise(x),
        lambda x: F.when((x < 2) & c("spliced1") & c("spliced2") & ~ev.is_read_through() & ~ev.same_gene() & others, x + 1).otherwise(x),
        lambda x: F.when(~ev.same_gene() & (x > 0) & ~c("spliced1") & ~c("spliced2"), x - 1).otherwise(x),
        lambda x: F.when((c("split1") > 20) & (c("split2") > 20) & (n > 60), 2).otherwise(x),
        lambda x: F.when(x == 0, x).when((s == 0) | (c("split1") + c("disc") == 0) | (c("split2") + c("disc") == 0), x - 1).when(20 * s < c("disc"), x - 1).when((c("evalue") > 0.2) | (share < 0.01), 1).otherwise(x),
        lambda x: F.when(
            (x < 2) & c("gbp1").isNotNull()
            & (((c("evalue") < 0.3) & (n >= 2)) | (c("spliced1") & c("spliced2") & ~ev.same_gene()) | (F.abs(c("bp1") - c("gbp1")) + F.abs(c("bp2") - c("gbp2")) < 20_000) | ~ev.same_contig() | ((F.abs(ev.distance()) > 1_000_000) & ~ev.same_gene())),
            x + 1,
        ).otherwise(x),
    ]
    d = d.withColumn("confidence", level)
    for step in steps:  # one column a step: nested expressions would double at each
        d = d.withColumn("confidence", step(c("confidence")))
    return d.withColumn("confidence", F.when(c("fate") != NONE, 0).otherwise(c("confidence")).cast("int")).drop("__del", "__lo1", "__hi1", "__lo2", "__hi2")


def output_order(df: DataFrame) -> DataFrame:
    """Adds place: events of a gene pair stand together, pairs in the order of their best event.

    The order is confidence, support, e-value, genes, breakpoints. place is 1 for the first; numbering is one task's work over the passing events, which are few.
    """
    key = lambda p: [c(f"{p}confidence").desc(), c(f"{p}support").desc(), c(f"{p}evalue").asc(), c("gene1"), c("gene2")]
    d = df.withColumn("support", ev.support())
    w = Window.partitionBy(*PAIR).orderBy(c("confidence").desc(), c("support").desc(), c("evalue"), "bp1", "bp2", "event_id")
    d = d.withColumn("__best", F.first(F.struct("confidence", "support", "evalue")).over(w))
    order = Window.orderBy(*key("__best."), *key("")[:3], "bp1", "bp2", "event_id")
    return d.withColumn("place", F.row_number().over(order).cast("bigint")).drop("__best")


def fates_column(evidence: DataFrame) -> DataFrame:
    """evidence (event_id, event_fate, read_fate) -> event_id, filters: name(count) of each read fate, and the event's own name, in name order."""
    counts = evidence.where(c("read_fate") != NONE).groupBy("event_id", c("read_fate").alias("name")).agg(F.count("*").alias("n"))
    own = evidence.where(c("event_fate") != NONE).select("event_id", c("event_fate").alias("name")).distinct().withColumn("n", F.lit(0).cast("bigint"))
    named = counts.unionByName(own).groupBy("event_id", "name").agg(F.sum("n").alias("n"))
    text = F.when(c("n") > 0, F.concat("name", F.lit("("), c("n").cast("string"), F.lit(")"))).otherwise(c("name"))
    parts = named.withColumn("text", text).groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("name", "text"))).alias("p"))
    listed = parts.select("event_id", F.array_join(F.col("p.text"), ",").alias("filters"))
    return evidence.select("event_id").distinct().join(listed, "event_id", "left").withColumn("filters", F.coalesce("filters", F.lit(".")))


def event_predicates() -> Sequence[tuple[str, Column]]:
    """Stateless steps that follow each other, for discard_all()."""
    return [("non_coding_neighbors", non_coding_neighbors()), ("min_support", min_support()), ("relative_support", relative_support())]
