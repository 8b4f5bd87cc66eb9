"""Alignments: flags, qualities, tags, and reads by where they lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.identity import has_flags
from strandmill.functions.sequence import tag_value
from strandmill.operators import intervals, kernels
from strandmill.storage import written

UNMAPPED, NOT_PRIMARY = 4, 2308
FEW = 200_000  # regions to broadcast


def reference_length(cigar: str = "cigar") -> Column:
    """Bases of the reference that an alignment spans."""
    ops = F.regexp_extract_all(F.col(cigar), F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return F.aggregate(ops, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def mapq_summary(df: DataFrame, thresholds: list[int], by: list[str] | None = None) -> DataFrame:
    """by, total and the number of primary alignments of at least each quality."""
    primary = df.where(~has_flags("flag", NOT_PRIMARY))
    return primary.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("mapq") >= q).alias(f"mapq_{q}") for q in thresholds))


def touching_reads(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Distinct qnames of mapped alignments that overlap a region (contig, start, stop)."""
    mapped = df.where(~has_flags("flag", UNMAPPED)).select("qname", F.col("rname").alias("contig"), F.col("pos").alias("start"), F.col("stop"))
    return intervals.overlap_join(mapped, intervals.merge_intervals(regions.select("contig", "start", "stop"), ["contig"])).select("qname").distinct()


def tag_summary(df: DataFrame, regions: DataFrame, tags: dict[str, str]) -> DataFrame:
    """group ('inside' or 'outside'), and n, mean and sd of each tag over all mapped alignments of the reads of which any, or
    none, overlaps a region. tags: name of the result to prefix of the tag; or to a column, if df has one by that name."""
    inside = touching_reads(df, regions).withColumn("_in", F.lit(True))
    rows = df.where(~has_flags("flag", UNMAPPED)).join(inside, "qname", "left")
    group = F.when(F.col("_in"), "inside").otherwise("outside").alias("group")
    out = []
    for name, tag in tags.items():
        v = F.col(tag).cast("double") if tag in df.columns else tag_value("tags", tag)
        n = F.count(v)
        out += [n.alias(f"{name}_n"), F.avg(v).alias(f"{name}_mean"), F.when(n > 1, F.stddev_pop(v)).alias(f"{name}_sd")]
    return rows.groupBy(group).agg(*out)


def _with_regions(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """rows with the regions that they touch (_iv); those that touch none are left out."""
    rows = rows.withColumns({"_h1": F.xxhash64(*rows.columns), "_h2": F.xxhash64(F.lit(1), *rows.columns)})
    slim = rows.select(F.col("rname").alias("contig"), F.col("pos").alias("start"), F.col("_end").alias("stop"), "_h1", "_h2").distinct()
    met = intervals.overlap_join(slim, merged).groupBy("_h1", "_h2").agg(F.sort_array(F.collect_set(F.struct(F.col("r_start").alias("start"), F.col("r_stop").alias("stop")))).alias("_iv"))
    return rows.join(met, ["_h1", "_h2"]).drop("_h1", "_h2")


def filter_by_quality(df: DataFrame, regions: DataFrame, least: float, mapq: int = 0, flags: int = NOT_PRIMARY, every: bool = False) -> DataFrame:
    """Alignments whose mean base quality in some touched region (every: in all) is at least least, with these means.

    df: rname, pos, cigar, flag, mapq, quality (array of numbers). Regions are merged; alignments that touch none are left out.
    Each bin of a contig has the regions that an alignment which begins there can touch, as one array that is broadcast, so qualities stay
    where they are. Alignments longer than a bin, or all if there are over FEW regions, meet them without the sequences; a hash of the row
    brings an alignment its own regions.
    """
    merged, _ = written(intervals.merge_intervals(regions.select("contig", "start", "stop"), ["contig"]), "regions")
    rows = df.where(~has_flags("flag", flags) & (F.col("mapq") >= mapq)).withColumn("_end", F.col("pos") + reference_length())
    width = intervals.WIDTH if merged.count() <= FEW else -1
    short = F.col("_end") - F.col("pos") <= width
    met = _with_regions(rows.where(~short), merged)
    if width > 0:
        first, last = F.floor(F.col("start") / width) - 1, F.floor((F.col("stop") - 1) / width)  # one that begins in the bin before reaches in
        held = merged.withColumn("_bin", F.explode(F.sequence(first, F.greatest(first + 1, last)))).groupBy(F.col("contig").alias("rname"), "_bin")
        held = F.broadcast(held.agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_held")))
        own = F.filter("_held", lambda r: (F.col("pos") < r["stop"]) & (F.col("_end") > r["start"]))
        near = rows.where(short).withColumn("_bin", F.floor(F.col("pos") / width)).join(held, ["rname", "_bin"])
        met = near.withColumn("_iv", own).where(F.size("_iv") > 0).select(*met.columns).unionByName(met)
    rows = met.withColumn("means", kernels.mean_quality("cigar", "quality", "pos", "_iv")).drop("_iv", "_end")
    good = F.forall("means", lambda m: m >= least) if every else F.exists("means", lambda m: m >= least)
    return rows.where((F.size("means") > 0) & good)


def flip_strand(df: DataFrame, name: str) -> DataFrame:
    """PAF rows with the sequence name turned round, where it is query or target."""
    toggled = F.when(F.col("strand") == "+", "-").otherwise("+")
    for side in ("q", "t"):
        own = F.col(f"{side}_name") == name
        start, end, size = F.col(f"{side}_start"), F.col(f"{side}_end"), F.col(f"{side}_len")
        df = df.withColumns({f"{side}_start": F.when(own, size - end).otherwise(start), f"{side}_end": F.when(own, size - start).otherwise(end), "strand": F.when(own, toggled).otherwise(F.col("strand"))})
    return df


def long_alignments(df: DataFrame, least: int = 10_000) -> DataFrame:
    return df.where(F.col("t_end") - F.col("t_start") > least)
