"""Statistics of reads and events."""

from __future__ import annotations

from collections.abc import Sequence
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import events as ev
from .fate import NONE

c = F.col
WINDOW = 20


def coverage(fragments: DataFrame, width: int = WINDOW, least: int = 10, most: int = 65_535) -> DataFrame:
    """fragments (fragment, contig, s, e) with one row an aligned stretch, e inclusive -> contig, win, depth.

    A fragment counts once in a window that its stretches cover by at least half at one go; depth saturates.
    """
    spread = fragments.withColumn("win", F.explode(F.sequence(F.floor(c("s") / width), F.floor(c("e") / width))))
    covered = F.least(c("e"), c("win") * width + width - 1) - F.greatest(c("s"), c("win") * width) + 1
    return spread.where(covered >= least).select("fragment", "contig", "win").distinct().groupBy("contig", "win").agg(F.least(F.count("*"), F.lit(most)).alias("depth"))


def depth_at(points: DataFrame, cov: DataFrame, contig: str, pos: str, direction: str, name: str, width: int = WINDOW) -> DataFrame:
    """Adds the depth in the window before (upstream) or after (downstream) a position; 0 where there is none."""
    win = F.floor(c(pos) / width) + F.when(c(direction) == ev.UP, -1).otherwise(1)
    d = cov.select(c("contig").alias("__c"), c("win").alias("__w"), c("depth").alias(name))
    out = points.withColumn("__win", win).join(d, (c(contig) == c("__c")) & (c("__win") == c("__w")), "left")
    return out.withColumn(name, F.coalesce(name, F.lit(0))).drop("__c", "__w", "__win")


def starts_near(points: DataFrame, starts: DataFrame, contig: str, low: str, high: str, name: str, width: int = WINDOW) -> DataFrame:
    """Adds whether a fragment starts in a window of (low / width, high / width]; windows are exploded, so it is an equi-join."""
    wins = F.sequence(F.floor(c(low) / width) + 1, F.greatest(F.floor(c(high) / width), F.floor(c(low) / width) + 1))
    asks = points.where(F.floor(c(high) / width) > F.floor(c(low) / width)).select("point_id", contig, F.explode(wins).alias("win"))
    hit = asks.join(starts.select(c("contig").alias(contig), "win").distinct(), [contig, "win"], "left_semi").select("point_id").distinct()
    return points.join(hit.withColumn(name, F.lit(True)), "point_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def fragment_edges(seg: DataFrame, extracted: DataFrame | None = None, width: int = WINDOW) -> DataFrame:
    """contig, kind (start or end), win: windows in which a proper fragment, or a single-ended read, starts or ends.

    A pair starts with its forward mate and ends with its reverse one. extracted (read_key): fragments
    that were taken for chimeric though they are proper; discordant mates and supplementary segments
    don't count, while clipped ends do, as they do in the reference.
    """
    d = seg.where(~c("supplementary") & (~c("paired") | c("proper")))
    if extracted is not None:
        d = d.join(extracted.select("read_key").distinct(), "read_key", "left_anti")
    edge = lambda kind, pos: F.struct(F.lit(kind).alias("kind"), F.floor(c(pos) / width).alias("win"))
    first, last = F.when(~c("paired") | c("strand"), edge("start", "start")), F.when(~c("paired") | ~c("strand"), edge("end", "end"))
    return d.select("contig", F.explode(F.filter(F.array(first, last), lambda x: x.isNotNull())).alias("e")).select("contig", "e.*").distinct()


def covered_sides(events: DataFrame, edges: DataFrame, near: int = 200, width: int = WINDOW, bin_: int = 512) -> DataFrame:
    """Adds side_covered1, side_covered2: whether a fragment of the retained side starts (upstream) or ends (downstream) near the breakpoint.

    Upstream windows after that of the breakpoint up to that of the anchor count, or near bases on;
    downstream those from there up to the breakpoint's, which is left out. Without split reads near
    bases on the other side count too. Windows and events meet in bins of windows.
    """
    slack = F.when(ev.split_reads() == 0, near).otherwise(0)
    asks = events
    for i in (1, 2):
        bp, anchor, up = c(f"bp{i}"), c(f"anchor{i}"), c(f"dir{i}") == ev.UP
        low = F.when(up, bp - slack).otherwise(F.least(bp - near, anchor))
        high = F.when(up, F.greatest(bp + near, anchor)).otherwise(bp + slack)
        d = asks.select("event_id", c(f"contig{i}").alias("contig"), F.when(up, F.lit("start")).otherwise(F.lit("end")).alias("kind"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high"), up.alias("up"))
        d = d.withColumns({"low": F.expr(f"low div {width}") + c("up").cast("int"), "high": F.expr(f"high div {width}") - (~c("up")).cast("int")}).where("low <= high")
        d = d.withColumn("bin", F.explode(F.sequence(F.floor(c("low") / bin_), F.floor(c("high") / bin_))))
        e = edges.withColumn("bin", F.floor(c("win") / bin_))
        hit = d.join(e, ["contig", "kind", "bin"]).where(c("win").between(c("low"), c("high"))).select("event_id").distinct().withColumn(f"side_covered{i}", F.lit(True))
        events = events.join(hit, "event_id", "left").withColumn(f"side_covered{i}", F.coalesce(f"side_covered{i}", F.lit(False)))
    return events


def terminal_exons(events: DataFrame, exons: DataFrame) -> DataFrame:
    """Adds terminal1, terminal2: whether a transcript's first or last exon of the gene holds the breakpoint. Only such exons are joined, by gene."""
    outer = exons.where("prev_end is null or next_start is null").select("gene", "start", "end").distinct()
    asks = events
    for i in (1, 2):
        hit = asks.select("event_id", c(f"gene{i}").alias("gene"), c(f"bp{i}").alias("at")).join(outer, "gene").where(c("at").between(c("start"), c("end")))
        hit = hit.select("event_id").distinct().withColumn(f"terminal{i}", F.lit(True))
        events = events.join(hit, "event_id", "left").withColumn(f"terminal{i}", F.coalesce(f"terminal{i}", F.lit(False)))
    return events


def iterative_trim(df: DataFrame, value: str, sigmas: float = 3.0) -> tuple[float, float, int]:
    """Mean, sample deviation and count once nothing lies outside mean +- sigmas * deviation. A round is one aggregate; three numbers come to the driver.

    Rounds go on until none drops a row; each but the last drops one at least, so they end.
    """
    low, high = None, None
    n = None
    while True:
        kept = df if low is None else df.where(c(value).between(low, high))
        m, s, k = kept.agg(F.avg(value), F.stddev_samp(value), F.count(value)).first()
        if not k or k == n or s is None:
            return m, s, k
        n = k
        low, high = max(low, m - sigmas * s) if low is not None else m - sigmas * s, min(high, m + sigmas * s) if high is not None else m + sigmas * s


def order_statistic(counts: DataFrame, value: str, quantile: float) -> DataFrame:
    """One row: the exact value at index floor(quantile * n) of the sorted values.

    Values are counted first, so the ordering task sees distinct values only.
    """
    hist = counts.groupBy(value).agg(F.count("*").alias("k"))
    w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("upto", F.sum("k").over(w)).withColumn("n", F.sum("k").over(Window.partitionBy(F.lit(0))))
    at = F.least(F.floor(c("n") * F.lit(quantile)), c("n") - 1)
    return cum.where(c("upto") > at).agg(F.min(value).alias("threshold"))


def gene_read_counts(evidence: DataFrame, gene: str = "gene") -> DataFrame:
    return evidence.groupBy(gene).agg(F.count("*").alias("reads"))


def partner_counts(df: DataFrame) -> DataFrame:
    """gene, partners: partners of unfiltered events between genes, once per breakpoint pair, without those that have more partners themselves."""
    live = df.where((c("fate") == NONE) & ~ev.same_gene())
    both = live.select(c("gene1").alias("gene"), c("gene2").alias("other"), "bp1", "bp2").unionByName(live.select(c("gene2").alias("gene"), c("gene1").alias("other"), "bp1", "bp2"))
    first = both.groupBy("gene", "bp1", "bp2").agg(F.min("other").alias("other"))
    n = first.groupBy("gene").agg(F.countDistinct("other").alias("n"))
    pairs = first.select("gene", "other").distinct().join(n, "gene").join(n.select(c("gene").alias("other"), c("n").alias("m")), "other")
    return pairs.where(c("n") >= c("m")).groupBy("gene").agg(F.count("*").alias("partners"))


#: Shares of event classes where there are too few events to count.
DEFAULT_SHARES = {"spliced": 10.0, "exonic": 65.0, "intronic": 10.0, "mixed": 15.0, "dup": 1.0, "inv": 1.0, "same": 0.0, "different": 100.0, "read_through": 0.0}


def evalue(df: DataFrame, mapped: int, shares: dict[str, float] | None = None) -> Column:
    """Expected random events like this one. p1, p2: partners of the genes; l1, l2: exonic lengths; spliced_distance: of intragenic events. Distances count for events with supporting reads only.

    shares: numbers of spliced, exonic, intronic and mixed events; of duplications and inversions; of
    same-gene and other events; read_through is their fraction. Defaults stand for too few events.
    """
    x = DEFAULT_SHARES | (shares or {})
    s = ev.support()
    chance = lambda i: F.lit(10_000.0) / c(f"l{i}") * F.greatest(c(f"p{i}") - 1, F.lit(1))
    depth = F.when(s < 2, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), F.lit(mapped / 2e7) * F.pow(F.lit(0.02), s - 2)))
    base = F.greatest(chance(1), chance(2)) * depth
    same_dir = c("dir1") == c("dir2")
    down_up, up_down = ev.deletion_like(), (c("dir1") == ev.UP) & (c("dir2") == ev.DOWN)
    d = F.greatest(c("spliced_distance"), F.lit(1)).cast("double")
    inner = base * (2.0 / (x["dup"] + x["inv"])) * F.when(up_down, x["dup"]).when(same_dir, x["inv"]).otherwise(1.0)
    near = F.when(d < 1000, F.pow(F.greatest(F.lit(400.0), d) / 1000, -2.0)).otherwise(1.0) * F.when(d < 400, F.pow(d / 400, -4.58)).otherwise(1.0)
    inner = inner * F.when(s >= 1, F.pow(s - 0.42, -2.11) * 10**-1.11 * near).otherwise(1.0)
    inner = inner * max(1.0, x["same"] / 0.25 / x["different"])
    dist = F.greatest(ev.distance(), F.lit(1)) / 400_000
    far = F.when(ev.is_read_through(), F.pow(dist, -0.63)).when(ev.same_contig() & (ev.distance() < 400_000), F.pow(dist, -1.53)).otherwise(1.0)
    outer = base * F.when(s >= 1, F.pow(s - 0.73, -2.28) * 10**-1.75 * far).otherwise(1.0)
    total = x["spliced"] + x["exonic"] + x["intronic"] + x["mixed"]
    place = (
        F.when(c("spliced1") | c("spliced2"), x["spliced"])
        .when(c("exonic1") & c("exonic2"), max(x["spliced"], x["exonic"]))
        .when(~c("exonic1") & ~c("exonic2"), max(x["spliced"], x["intronic"]))
        .otherwise(max(x["spliced"], x["mixed"]))
    )
    f = x["read_through"]
    rt = F.when(ev.is_read_through() & F.lit(f > 0.25), 1 + ((f - 0.25) * 20) ** 2).otherwise(1.0)
    return F.when(ev.is_intragenic(), inner).otherwise(outer) * place * (4.0 / total) * rt


def event_shares(df: DataFrame) -> dict[str, float]:
    """The shares that evalue() asks for, counted over all events; too few of a class leave its defaults. One row comes to the driver."""
    live = c("fate") == NONE
    distal = live & (~ev.same_contig() | (ev.distance() > 500_000)) & (ev.support() >= 2) & (ev.split_reads() > 0) & ~c("g1_dummy") & ~c("g2_dummy")
    one = c("spliced1") | c("spliced2")
    inner = live & ev.same_gene() & (ev.split_reads() >= 2)
    kinds = {
        "spliced": distal & one, "exonic": distal & ~one & c("exonic1") & c("exonic2"), "intronic": distal & ~one & ~c("exonic1") & ~c("exonic2"), "mixed": distal & ~one & (c("exonic1") != c("exonic2")),
        "dup": inner & (c("dir1") == ev.UP) & (c("dir2") == ev.DOWN), "inv": inner & (c("dir1") == c("dir2")),
        "same": c("spliced1") & c("spliced2") & ev.same_gene(), "different": c("spliced1") & c("spliced2") & ~ev.same_gene(),
    }
    n = df.agg(*(F.count(F.when(p, 1)).alias(k) for k, p in kinds.items())).first().asDict()
    of = df.where(~c("g1_dummy") & ~c("g2_dummy") & (ev.split_reads() > 0)).select(F.explode(F.array("gene1", "gene2")).alias("gene"), ev.is_read_through().alias("through"))
    genes = of.groupBy("gene").agg(F.max("through").alias("through")).agg(F.count("*").alias("n"), F.count(F.when(c("through"), 1)).alias("k")).first()
    out: dict[str, float] = {"read_through": genes.k / genes.n if genes.n else 0.0}
    places = [n[k] for k in ("spliced", "exonic", "intronic", "mixed")]
    if sum(places) >= 100 and all(places):
        out |= dict(zip(("spliced", "exonic", "intronic", "mixed"), map(float, places)))
    for pair in (("dup", "inv"), ("same", "different")):
        if sum(n[k] for k in pair) >= 100:
            out |= {k: float(n[k]) for k in pair}
    return out


def strandedness(split: DataFrame, sites: DataFrame, least: int = 100, threshold: float = 0.95) -> str:
    """yes, reverse or no: whether spliced split reads lie on their gene's strand.

    split: split reads (m2_contig, m2_strand, m2_start, m2_end, m2_genes, sp_contig, sp_strand, sp_start,
    m1_strand, m1_first, m2_first, and gene_strand of the only gene). sites: intervals.boundary_sites().
    Reads count if both parts lie on one contig and strand within 400,000, in one gene, at a splice
    site of it; under least of them decide nothing. All reads are counted. Two numbers come to the driver.
    """
    near = (c("m2_contig") == c("sp_contig")) & (c("m2_strand") == c("sp_strand")) & (F.abs(c("m2_start") - c("sp_start")) < 400_000) & (F.size("m2_genes") == 1)
    d = split.where(near).withColumns({"gene": F.element_at("m2_genes", 1), "direction": F.when(c("m2_strand"), F.lit(ev.UP)).otherwise(F.lit(ev.DOWN)), "pos": F.when(c("m2_strand"), c("m2_start")).otherwise(c("m2_end"))})
    agrees = (c("m2_first") & (c("m2_strand") == c("gene_strand"))) | (c("m1_first") & (c("m1_strand") == c("gene_strand")))
    n, k = d.join(sites, ["gene", "direction", "pos"], "left_semi").agg(F.count("*"), F.count(F.when(agrees, 1))).first()
    if n < least:
        return "no"
    return "reverse" if k < (1 - threshold) * n else "yes" if k > threshold * n else "no"


def strand_vote(evidence: DataFrame) -> DataFrame:
    """evidence (event_id, role, forward (null: ambiguous), read_fate) -> event_id, strand, ambiguous: the majority of all reads but hairpin pairs; a tie is ambiguous."""
    votes = evidence.where(~((c("role") == "discordant") & (c("read_fate") == "hairpin")))
    n = votes.groupBy("event_id").agg(F.sum(F.when(c("forward"), 1).otherwise(0)).alias("plus"), F.sum(F.when(~c("forward"), 1).otherwise(0)).alias("minus"))
    return n.select("event_id", (c("plus") > c("minus")).alias("strand"), (c("plus") == c("minus")).alias("ambiguous"))


def transcript_start() -> Column:
    """Which gene is 5': 1, 2, or 0 if ambiguous. strand1, strand2: predicted strands; ambiguous: they aren't known."""
    known = ~c("ambiguous")
    agrees = lambda i: c(f"spliced{i}") | (known & ~c(f"g{i}_dummy") & (c(f"strand{i}") == c(f"g{i}_strand")))
    outward = lambda i: (c(f"strand{i}") & (c(f"dir{i}") == ev.DOWN)) | (~c(f"strand{i}") & (c(f"dir{i}") == ev.UP))
    through = ev.is_read_through() & (ev.split_reads() == 0)
    return (
        F.when(agrees(1), F.when(ev.five_prime(1), 1).otherwise(2))
        .when(agrees(2), F.when(ev.five_prime(2), 2).otherwise(1))
        .when(known, F.when(outward(1) & ~outward(2), 1).when(~outward(1) & outward(2), 2).otherwise(0))
        .when(~c("exonic1") & ~c("exonic2"), 0)
        .when(~c("exonic1") & c("exonic2"), F.when(ev.five_prime(2), 2).when(through, 1).otherwise(0))
        .when(c("exonic1") & ~c("exonic2"), F.when(ev.five_prime(1), 1).when(through, 1).otherwise(0))
        .when((~c("g1_dummy") & c("g1_strand") & (c("dir1") == ev.DOWN)) | (~c("g1_strand") & (c("dir1") == ev.UP)), 1)
        .when((~c("g2_dummy") & c("g2_strand") & (c("dir2") == ev.DOWN)) | (~c("g2_strand") & (c("dir2") == ev.UP)), 2)
        .otherwise(0)
    )


def viral_expression(reads: DataFrame, lengths: DataFrame) -> DataFrame:
    """reads (contig), lengths (contig, length) -> contig, length, reads, expression; contigs without reads have 0."""
    n = reads.groupBy("contig").agg(F.count("*").alias("reads"))
    out = lengths.join(n, "contig", "left").withColumn("reads", F.coalesce("reads", F.lit(0)))
    return out.withColumn("expression", c("reads") / c("length"))


def viral_threshold(expression: DataFrame, top: int = 5, related: DataFrame | None = None) -> DataFrame:
    """One row: the expression of the last of the top contigs, by expression then id, both falling; a contig related to the one before it isn't counted.

    related (contig, other): pairs of related strains.
    """
    w = Window.orderBy(c("expression").desc(), c("contig").desc())
    r = expression.where("expression > 0").select("contig", "expression", F.row_number().over(w).alias("n"), F.lag("contig").over(w).alias("other"))
    if related is None:
        r = r.withColumn("__rel", F.lit(False))
    else:
        r = r.join(related.select("contig", "other", F.lit(True).alias("__rel")), ["contig", "other"], "left")
    counted = F.sum(F.when(F.coalesce("__rel", F.lit(False)), 0).otherwise(1)).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumn("k", counted).where(c("k") <= top).agg(F.coalesce(F.min("expression"), F.lit(0.0)).alias("threshold"))


def weak_viruses(expression: DataFrame, threshold: float, sites: DataFrame, share: float = 0.33, spared: int = 50) -> DataFrame:
    """contig of those viruses whose reads go: expression (contig, expression; all contigs) of 0 or under the threshold.

    Spared are viruses at least share of whose integration sites are intergenic (sites: contig, gene,
    is_dummy) and whose expression is not under that of the spared-th contig from the low end.
    """
    n = expression.count()
    falling = Window.orderBy(c("expression").desc(), c("contig").desc())
    floor_ = expression.withColumn("n", F.row_number().over(falling)).where(c("n") == n - min(spared, n) + 1).agg(F.max("expression")).first()[0] if n else None
    part = sites.distinct().groupBy("contig").agg(F.avg(c("is_dummy").cast("double")).alias("part"))
    d = expression.join(part, "contig", "left")
    kept = (F.coalesce("part", F.lit(0.0)) >= share) & (c("expression") > 0) & (c("expression") >= F.lit(floor_))
    return d.where(((c("expression") == 0) | (c("expression") < threshold)) & ~F.coalesce(kept, F.lit(False))).select("contig")


def low_coverage_contigs(cov: DataFrame, lengths: DataFrame, share: float = 0.05, least_bases: int = 100, width: int = WINDOW) -> DataFrame:
    """Contigs whose windows deeper than share of the contig's mean are too few: under share of all, or no more than least_bases."""
    total = lengths.withColumn("windows", F.floor(c("length") / width) + 1)
    mean = cov.groupBy("contig").agg(F.sum("depth").alias("sum")).join(total, "contig").withColumn("mean", c("sum") / c("windows"))
    deep = cov.join(mean, "contig").where(c("depth") > c("mean") * share).groupBy("contig", "windows").agg(F.count("*").alias("deep"))
    return deep.where((c("deep") < share * c("windows")) | (c("deep") * width <= least_bases)).select("contig", "deep")


def containment(kmers: DataFrame, pairs: DataFrame | None = None, on: Sequence[str] = ("kmer",)) -> DataFrame:
    """kmers (id, kmer), distinct or not -> a, b, shared, fraction: shared k-mers of two ids over those of the smaller one; pairs without any don't appear."""
    d = kmers.distinct()
    n = d.groupBy("id").agg(F.count("*").alias("n"))
    x, y = d.withColumnRenamed("id", "a"), d.withColumnRenamed("id", "b")
    both = x.join(y, list(on)).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    if pairs is not None:
        both = both.join(pairs, ["a", "b"], "left_semi")
    both = both.join(n.withColumnsRenamed({"id": "a", "n": "na"}), "a").join(n.withColumnsRenamed({"id": "b", "n": "nb"}), "b")
    return both.select("a", "b", "shared", (c("shared") / F.least("na", "nb")).alias("fraction"))


def quantile_index(n: int, q: float) -> int:
    return min(n - 1, floor(q * n))
