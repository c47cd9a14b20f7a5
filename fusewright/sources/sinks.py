"""Result tables, exports and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
#: The columns of the result table.
COLUMNS = (
    "#gene1 gene2 strand1(gene/fusion) strand2(gene/fusion) breakpoint1 breakpoint2 site1 site2 type split_reads1 split_reads2 discordant_mates coverage1 coverage2 confidence reading_frame tags "
    "retained_protein_domains closest_genomic_breakpoint1 closest_genomic_breakpoint2 gene_id1 gene_id2 transcript_id1 transcript_id2 direction1 direction2 filters fusion_transcript peptide_sequence read_identifiers"
).split()
#: Columns that come in pairs, and swap when the second gene is 5'.
PAIRED = ("gene", "name", "strand", "strand_label", "contig", "bp", "site", "split", "cov", "gbp", "gene_id", "transcript_id", "dir", "domains")


def five_prime_first(events: DataFrame, second: Column) -> DataFrame:
    """Swaps the sides of events whose second gene is 5'; columns of sides that are there end in 1 and 2."""
    have = [p for p in PAIRED if f"{p}1" in events.columns]
    new = {}
    for p in have:
        new[f"{p}1"] = F.when(second, c(f"{p}2")).otherwise(c(f"{p}1"))
        new[f"{p}2"] = F.when(second, c(f"{p}1")).otherwise(c(f"{p}2"))
    return events.withColumns(new)


def dot(x: Column) -> Column:
    return F.coalesce(F.nullif(x.cast("string"), F.lit("")), F.lit("."))


def result_table(events: DataFrame) -> DataFrame:
    """The 30 columns as strings; positions become 1-based; what isn't known is a dot. Input names are those of functions.events with names and labels added."""
    have = set(events.columns)
    get = lambda x: dot(c(x)) if x in have else F.lit(".")
    place = lambda i: F.concat(c(f"contig{i}").cast("string"), F.lit(":"), (c(f"bp{i}") + 1).cast("string"))
    near = lambda i: F.when(c(f"gbp{i}").isNotNull(), F.concat(c(f"contig{i}").cast("string"), F.lit(":"), (c(f"gbp{i}") + 1).cast("string"), F.lit("("), F.abs(c(f"gbp{i}") - c(f"bp{i}")).cast("string"), F.lit(")"))).otherwise(F.lit("."))
    domains = F.concat(get("domains1"), F.lit("|"), get("domains2"))
    cols = [
        get("name1"), get("name2"), get("strand_label1"), get("strand_label2"), place(1), place(2), get("site1"), get("site2"), get("type"), get("split1"), get("split2"), get("disc"), get("cov1"), get("cov2"),
        get("confidence_label"), get("reading_frame"), get("tags"), F.when(domains == ".|.", F.lit(".")).otherwise(domains), near(1), near(2), get("gene_id1"), get("gene_id2"), get("transcript_id1"), get("transcript_id2"),
        get("dir1"), get("dir2"), get("filters"), get("fusion_transcript"), get("peptide_sequence"), get("read_identifiers"),
    ]
    return events.select(*[x.alias(n) for x, n in zip(cols, COLUMNS)])


def write_tsv(df: DataFrame, path: str) -> None:
    """One file where rows are few and their order matters; sort before."""
    line = F.array_join(F.array(*[F.coalesce(df[f"`{x}`"].cast("string"), F.lit("")) for x in df.columns]), "\t")
    head = df.sparkSession.createDataFrame([("\t".join(df.columns),)], "value string")
    head.coalesce(1).union(df.coalesce(1).select(line.alias("value"))).coalesce(1).write.mode("overwrite").text(path)


def vcf_records(table: DataFrame) -> DataFrame:
    """Two mated breakend records an event of the result table, with qualities by confidence and the untemplated bases of the transcript."""
    t = table.withColumn("__id", F.xxhash64("breakpoint1", "breakpoint2", "direction1", "direction2"))
    quality = F.when(c("confidence") == "high", "5").when(c("confidence") == "medium", "2").otherwise("0.5")
    between = F.upper(F.coalesce(F.nullif(F.regexp_extract("fusion_transcript", r"\|([^|]*)\|", 1), F.lit("")), F.lit("")))

    def record(i: int, j: int) -> Column:
        up, mate_up = c(f"direction{i}") == "upstream", c(f"direction{j}") == "upstream"
        bracket = F.when(mate_up, F.lit("[")).otherwise(F.lit("]"))
        mate = F.concat(bracket, c(f"breakpoint{j}"), bracket)
        alt = F.when(up, F.concat(mate, between, F.lit("N"))).otherwise(F.concat(F.lit("N"), between, mate))
        info = F.concat(F.lit("SVTYPE=BND;MATEID="), c("__id").cast("string"), F.lit("b" if i == 1 else "a"), F.lit(";GENE_NAME="), c("`#gene1`" if i == 1 else "gene2"), F.lit(";GENE_ID="), c(f"gene_id{i}"))
        contig, pos = F.regexp_extract(f"breakpoint{i}", "^(.*):", 1), F.regexp_extract(f"breakpoint{i}", r":(\d+)$", 1)
        return F.struct(
            contig.alias("CHROM"), pos.cast("int").alias("POS"), F.concat(c("__id").cast("string"), F.lit("a" if i == 1 else "b")).alias("ID"), F.lit("N").alias("REF"), alt.alias("ALT"), quality.alias("QUAL"),
            F.when(c("filters") == ".", F.lit("PASS")).otherwise(F.regexp_replace(F.regexp_replace("filters", r"\(\d+\)", ""), ",", ";")).alias("FILTER"), info.alias("INFO"),
        )

    return t.select(F.explode(F.array(record(1, 2), record(2, 1))).alias("r")).select("r.*")


def supporting_records(records: DataFrame, table: DataFrame, around: int = 1_000_000) -> DataFrame:
    """Records of the reads that an event names, within a distance of either breakpoint; event numbers the event."""
    place = lambda i: [F.regexp_extract(f"breakpoint{i}", "^(.*):", 1).alias("__c"), F.regexp_extract(f"breakpoint{i}", r":(\d+)$", 1).cast("int").alias("__p")]
    named = table.withColumn("event", F.xxhash64("breakpoint1", "breakpoint2", "direction1", "direction2"))
    both = [named.select("event", F.explode(F.split("read_identifiers", ",")).alias("qname"), *place(i)) for i in (1, 2)]
    asks = both[0].unionByName(both[1]).distinct()
    near = (c("contig") == c("__c")) & (F.abs(c("pos") - c("__p")) <= around)
    return records.join(asks, "qname").where(near).drop("__c", "__p").distinct()


def virus_quantities(cov: DataFrame, reads: DataFrame, lengths: DataFrame, total: int, least_bases: int = 100, least_share: float = 0.05) -> DataFrame:
    """VIRUS, READS, RPKM, COVERED_BASES, LENGTH, SHARE by falling RPKM. cov: per base (contig, pos); strains under the limits go."""
    n = reads.groupBy("contig").agg(F.count("*").alias("reads"))
    b = cov.groupBy("contig").agg(F.count("*").alias("bases"))
    d = lengths.join(n, "contig").join(b, "contig").withColumn("rpkm", c("reads") * 1e9 / c("length") / F.lit(max(total, 1))).withColumn("share", c("bases") / c("length"))
    return d.where((c("bases") >= least_bases) & (c("share") > least_share)).select(c("contig").alias("VIRUS"), c("reads").alias("READS"), c("rpkm").alias("RPKM"), c("bases").alias("COVERED_BASES"), c("length").alias("LENGTH"), c("share").alias("SHARE")).orderBy(c("RPKM").desc(), "VIRUS")


def without_related(quantities: DataFrame, related: DataFrame) -> DataFrame:
    """Drops strains that share k-mers (a, b) with a strain of higher RPKM."""
    q = quantities.select(c("VIRUS").alias("a"), c("RPKM").alias("ra"))
    r = quantities.select(c("VIRUS").alias("b"), c("RPKM").alias("rb"))
    both = related.select("a", "b").union(related.select(c("b"), c("a"))).join(q, "a").join(r, "b")
    worse = both.where((c("rb") > c("ra")) | ((c("rb") == c("ra")) & (c("b") < c("a")))).select(c("a").alias("VIRUS")).distinct()
    return quantities.join(worse, "VIRUS", "left_anti")


def counted(df: DataFrame, step: str) -> DataFrame:
    """Observes how many rows are left after a step, without a pass of its own."""
    from pyspark.sql import Observation

    obs = Observation(step)
    out = df.observe(obs, F.count("*").alias("rows"), F.count(F.when(c("fate") == "none", 1)).alias("live"))
    out.observation = obs
    return out
