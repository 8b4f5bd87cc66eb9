"""Identity columns: arms, labels, samples, and the gates on molecules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARM_POSITION = 100_000
C = Column | str


def _c(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def arm(position: C) -> Column:
    return F.when(_c(position) > ARM_POSITION, "q").otherwise("p")


def assignment(chromosome: C, position: C) -> Column:
    """Chromosome and arm; null for an unknown chromosome."""
    return F.concat(_c(chromosome), arm(position))


def normalised(name: Column, position: Column) -> Column:
    """chr1-22, X, Y or M by prefix, and the arm: the name's own p or q, else by position; null if it doesn't match."""
    stem = F.regexp_replace(name, "_.*$", "")
    chrom = F.regexp_extract(stem, r"^(chr(?:1[0-9]|2[0-2]|[1-9]|X|Y|M))", 1)
    own = F.regexp_extract(stem, r"([pq])$", 1)
    return F.when(chrom != "", F.concat(chrom, F.when(own != "", own).otherwise(arm(position))))


def label(chrom: C) -> Column:
    """SAMPLE_HAP of SAMPLE#HAP#CONTIG; 'unknown' for null."""
    parts = F.split(_c(chrom), "#")
    return F.coalesce(F.when(F.size(parts) >= 2, F.concat_ws("_", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))), F.lit("unknown"))


def contig_parts(chrom: C) -> list[Column]:
    """individual, hap and contig of INDIVIDUAL#HAP#CONTIG."""
    parts = F.split(_c(chrom), "#", 3)
    return [F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(("individual", "hap", "contig"))]


def arm_number(name: C) -> Column:
    """1 to 22, X 23, Y 24, M 25; 99 for others."""
    n = F.regexp_extract(_c(name), r"^chr([0-9]+|X|Y|M)", 1)
    return F.when(n == "X", 23).when(n == "Y", 24).when(n == "M", 25).when(n == "", 99).otherwise(n.try_cast("int"))


def arm_key(name: C) -> list[Column]:
    """Sort columns in natural order of the arms, p before q."""
    return [arm_number(name), _c(name).endswith("q"), _c(name)]


def enough_calls(calls: C, length: C, share: float = 0.001) -> Column:
    """At least max(1, ceil(share * length)) calls; an empty list counts as one call."""
    n = F.size(F.split(F.trim(F.coalesce(_c(calls), F.lit("")), F.lit(",")), ","))
    return n >= F.greatest(F.lit(1), F.ceil(_c(length) * F.lit(share)))


def molecule_gates(query: C, m6a: C, nucleosomes: C, telomere: C) -> Column:
    """Long, well-methylated molecules with a telomere of usual size; m6a and nucleosomes are numbers of calls."""
    return (_c(query) >= 15_000) & (_c(m6a) >= 100) & (_c(m6a) / _c(query) >= 0.005) & (_c(nucleosomes) >= 10) & _c(telomere).between(1_500, 20_000)


def finite(c: C) -> Column:
    """Neither null nor NaN nor infinite."""
    return _c(c).isNotNull() & ~F.isnan(_c(c)) & (F.abs(_c(c)) != float("inf"))


def has_flags(flag: C, mask: int) -> Column:
    return _c(flag).bitwiseAND(mask) != 0


def any_prefix(name: C, prefixes: list[str]) -> Column:
    """Whether the name begins with one of them; chr13 also takes chr13p and chr13q."""
    return F.exists(F.array(*map(F.lit, prefixes)), lambda p: _c(name).startswith(p))
