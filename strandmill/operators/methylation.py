"""m6A calls on single molecules: rates inside and outside of variant repeats, by position, and in motifs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import sequence
from strandmill.operators import kernels, positions


def call_positions(text: str, strand: str, trim_ends: int = 1) -> Column:
    """Positions from a comma-separated list, one less on the minus strand."""
    calls = sequence.int_list(text, trim_ends)
    return F.transform(calls, lambda p: p - F.when(F.col(strand) == "-", 1).otherwise(0))


def variant_rates(df: DataFrame, seq: str, calls: str, spans: str) -> DataFrame:
    """df with inside_rate and outside_rate: calls over target bases within the spans that hold a target base, and elsewhere.

    The target is the base at the first call within the sequence; the first and last span don't count. Null where there is
    no target base.
    """
    size = F.length(seq)
    inside = F.array_sort(F.array_distinct(F.filter(calls, lambda p: (p > 0) & (p < size))))
    rows = df.withColumn("_calls", inside).withColumn("_base", F.when(F.size("_calls") > 0, F.substr(F.col(seq), F.col("_calls")[0] + 1, F.lit(1))))
    used = F.filter(F.slice(F.col(spans), 2, F.greatest(F.size(spans) - 2, F.lit(0))), lambda x: F.contains(F.substr(F.col(seq), x["start"] + 1, x["length"]), F.col("_base")))
    rows = rows.withColumn("_used", used)
    total = sequence_count(F.col(seq), F.col("_base"))
    own = F.aggregate("_used", F.lit(0), lambda a, x: a + sequence_count(F.substr(F.col(seq), x["start"] + 1, x["length"]), F.col("_base")))
    hit = F.size(F.filter("_calls", lambda p: F.exists("_used", lambda x: (p >= x["start"]) & (p < x["start"] + x["length"]))))
    rows = rows.withColumns({"_own": own, "_total": total, "_hit": hit})
    return rows.withColumns({"inside_rate": F.when(F.col("_own") > 0, F.col("_hit") / F.col("_own")), "outside_rate": F.when(F.col("_total") > F.col("_own"), (F.size("_calls") - F.col("_hit")) / (F.col("_total") - F.col("_own")))}).drop("_calls", "_base", "_used", "_own", "_total", "_hit")


def sequence_count(text: Column, base: Column) -> Column:
    """How often a base occurs."""
    return F.length(text) - F.length(F.replace(text, base, F.lit("")))


def call_vector(calls: str, size: Column) -> Column:
    """0 and 1 for each position of the sequence, put together from the gaps between the calls."""
    at = F.array_sort(F.array_distinct(F.filter(calls, lambda p: (p >= 0) & (p < size))))
    before = F.concat(F.array(F.lit(-1)), at)
    pieces = F.flatten(F.zip_with(F.slice(before, 1, F.size(at)), at, lambda a, b: F.concat(F.array_repeat(F.lit(0), b - a - 1), F.array(F.lit(1)))))
    return F.concat(pieces, F.array_repeat(F.lit(0), (size - 1 - F.element_at(before, -1)).cast("int")))


def gated_vectors(df: DataFrame, calls: str, telomere: str, subtelomere: str, spans: str, least: int = 5) -> DataFrame:
    """df with telomere_calls and subtelomere_calls, a byte of 0 or 1 for each position, and load, the bases in spans of at least that length.

    calls are positions from the boundary on: from 0 to the length telomere in the telomere, and from -subtelomere up to 0 before it,
    which are shifted by that length. Which molecules are gated in is identity.molecule_gates.
    """
    at, before = F.col(calls).cast("array<int>"), F.col(subtelomere).cast("int")
    vectors = {"telomere_calls": kernels.call_vectors(at, F.col(telomere).cast("int"), F.lit(0)), "subtelomere_calls": kernels.call_vectors(at, before, before)}
    return df.withColumns(vectors | {"load": sequence.span_load(spans, least)})


def of_label(df: DataFrame, chrom: str, name: str, arm: str | None = None, assignment: str = "assignment") -> DataFrame:
    """Molecules whose contig SAMPLE#HAP#... is of the sample and haplotype name ('SAMPLE#HAP'), on that arm if one is given."""
    own = F.concat_ws("#", F.slice(F.split(F.col(chrom), "#"), 1, 2)) == name
    return df.where(own & F.col(assignment).endswith(arm) if arm else own)


def target_base(seq: str, calls: str) -> Column:
    """The base at the molecule's first call within the sequence; null where there is no call in it."""
    first = F.array_min(F.filter(calls, lambda p: p >= 0))
    return F.nullif(F.substr(F.col(seq), first + 1, F.lit(1)), F.lit(""))


def positional_rate(df: DataFrame, keys: list[str], seq: str, calls: str, base: str | None = None) -> DataFrame:
    """keys, pos, calls, targets over all molecules: each position's calls on the target base, and its target bases.

    The target is each molecule's own, the base at its first call, and molecules without calls don't count; or base, for all alike.
    """
    rows = df.withColumn("_target", F.lit(base) if base else target_base(seq, calls)).where("_target IS NOT NULL")
    counts = positions.call_counts("_seq", "_calls", "_target")
    slim = rows.select(*keys, F.col(seq).alias("_seq"), F.col(calls).cast("array<int>").alias("_calls"), "_target")

    def places(first: int, sums: np.ndarray) -> list[pa.Array]:
        at = np.flatnonzero(sums[:, 1])
        return [pa.array((first + at).astype(np.int32)), pa.array(sums[at, 0]), pa.array(sums[at, 1])]

    return positions.folded(slim, keys, ["_seq", "_calls", "_target"], counts, 2, places, "pos int, calls bigint, targets bigint")


def binned_rate(df: DataFrame, keys: list[str], sample: str, seq: str, calls: str, width: int = 50, base: str | None = None) -> DataFrame:
    """keys, bin, rate: each sample's mean over its molecules of calls by target bases in bins, and of these the median.

    The target is each molecule's own, the base at its first call, and molecules without calls don't count; or base, for all alike.
    A molecule's bins are made within its row, so nothing tells molecules apart but their rows.
    """
    rows = df.withColumn("_target", F.lit(base) if base else target_base(seq, calls)).where("_target IS NOT NULL")
    made = kernels.bin_rates_udf(width)(seq, F.col(calls).cast("array<int>"), "_target")
    molecule = rows.select(*keys, sample, F.explode(made).alias("e")).select(*keys, sample, "e.*")
    return molecule.groupBy(*keys, sample, "bin").agg(F.avg("rate").alias("_m")).groupBy(*keys, "bin").agg(F.median("_m").alias("rate"))


def binned_variant_rates(df: DataFrame, keys: list[str], sample: str, seq: str, calls: str, spans: str, width: int = 50) -> DataFrame:
    """keys, bin, inside_rate, outside_rate: binned rates within the spans that hold a molecule's own target base, and elsewhere.

    The first and last span don't count, nor does a call at position 0; all other calls of a bin are divided by its target
    bases, as in variant_rates. Bins without a target base on a side are left out of that side's means.
    """
    rows = df.withColumn("_calls", F.filter(calls, lambda p: p > 0).cast("array<int>")).withColumn("_target", target_base(seq, "_calls")).where("_target IS NOT NULL")
    made = kernels.bin_rates_by_side_udf(width)(seq, "_calls", "_target", spans)
    molecule = rows.select(*keys, sample, F.explode(made).alias("e")).select(*keys, sample, "e.*")
    rates = ("inside_rate", "outside_rate")
    means = molecule.groupBy(*keys, sample, "bin").agg(*(F.avg(n).alias(n) for n in rates))
    return means.groupBy(*keys, "bin").agg(*(F.median(n).alias(n) for n in rates))


def subtelomere_calls(calls: str, query: str, telomere: str) -> Column:
    """Calls below 0 as positions in the query's part before the telomere, whose last base is at -1."""
    size = F.col(query) - F.col(telomere)
    return F.filter(F.transform(F.filter(calls, lambda p: p < 0), lambda p: p + size), lambda p: p >= 0)


def motif_counts(df: DataFrame, sample: str, seq: str, calls: str, motifs: list[str]) -> DataFrame:
    """sample, motif, meth, total: places of each motif, and those with a call in them; absent motifs with 0."""
    hits = [F.struct(F.lit(m).alias("motif"), sequence.motif_hits(seq, m).alias("at")) for m in motifs]
    rows = df.select(sample, calls, F.explode(F.array(*hits)).alias("h"))
    known = F.filter(F.coalesce(calls, F.array()).cast("array<int>"), lambda p: p.isNotNull())
    starts = F.flatten(F.transform(known, lambda p: F.sequence(p - F.length("h.motif") + 1, p)))  # where a place with this call in it may begin
    meth = F.size(F.array_intersect(F.col("h.at").cast("array<int>"), starts))  # by a hash set, not each call for each place
    return rows.groupBy(sample, F.col("h.motif").alias("motif")).agg(F.sum(meth).alias("meth"), F.sum(F.size("h.at")).alias("total"))


def motif_ratios(telomere: DataFrame, genome: DataFrame, sample: str, canonical: str = "TTAGGG") -> DataFrame:
    """sample, motif, ratio, normalised: the telomere's rate over the genome's (motif, meth_count, total_count), and that over
    the sample's ratio for the canonical motif."""
    rate = F.try_divide(F.col("meth"), F.col("total"))
    base = F.try_divide(F.col("meth_count"), F.col("total_count"))
    ratios = telomere.join(genome, "motif").select(sample, "motif", F.try_divide(rate, base).alias("ratio"))
    own = ratios.where(F.col("motif") == canonical).select(sample, F.col("ratio").alias("_c"))
    return ratios.join(own, sample, "left").select(sample, "motif", "ratio", F.try_divide(F.col("ratio"), F.col("_c")).alias("normalised"))
