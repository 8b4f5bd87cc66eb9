"""Schemas of the input files, by position or by name."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "array<string>": T.ArrayType(T.StringType())}


def _struct(spec: str) -> T.StructType:
    """A schema of 'name kind, name kind', made without a session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (field.split() for field in spec.split(","))])


#: Columns of a centred-read file that are used, by their position in it.
CENTERED_READS = {
    0: ("chrom", "string"), 1: ("centering_position", "long"), 2: ("strand", "string"), 3: ("subset_sequence", "string"),
    4: ("reference_start", "long"), 5: ("reference_end", "long"), 6: ("query_name", "string"), 7: ("RG", "string"),
    8: ("HP", "string"), 9: ("centered_query_start", "long"), 10: ("centered_query_end", "long"), 11: ("query_length", "long"),
    14: ("mc_pos", "string"), 15: ("mc_score", "string"), 21: ("query_sequence", "string"),
}
CENTERED_WIDTH = 22

ALIAS = _struct("id string, chrom string, contig string")
TELOMERES = _struct("contig string, start long, stop long, direction string")
SATELLITES = _struct("contig string, start long, stop long, sat_name string")
MOTIFS = _struct("contig string, start long, end long, misc string, score double, direction string, misc2 string, misc3 string, misc4 string, descriptor string")
BED_NAMES = _struct("chrom string, start long, end long, name string")
ANCESTRY = _struct("chrom string, start long, end long, name string, confidence double")
FOOTPRINTS = _struct("chrom string, start long, end long, n_spanning_fibers long, footprint_codes string, fiber_names string")
MOTIF_COUNTS = _struct("motif string, meth_count long, total_count long")
ALIGNMENT = _struct("qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags array<string>")
PAF = _struct("q_name string, q_len long, q_start long, q_end long, strand string, t_name string, t_len long, t_start long, t_end long, n_match long, n_align long, mapq int, tags array<string>")
