"""Sequence functions, as column expressions without Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLUS, MINUS = "CCCTAA", "TTAGGG"
LONGEST_SPAN = 300
C = Column | str


def _c(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(s: C) -> Column:
    """Letters keep their case, but that N becomes n and n becomes N."""
    return F.translate(F.reverse(_c(s)), "ACGTacgtnN", "TGCAtgcaNn")


def rotations(motif: str) -> list[str]:
    return [motif[k:] + motif[:k] for k in range(len(motif))]


def is_rotation(a: C, b: C) -> Column:
    """Whether b is a cyclic permutation of a."""
    return (F.length(_c(a)) == F.length(_c(b))) & F.contains(F.concat(_c(a), _c(a)), _c(b))


def overlapping(s: C, motifs: list[str]) -> Column:
    """Places where one of the motifs begins, in either case."""
    return F.regexp_count(_c(s), F.lit(f"(?i)(?=(?:{'|'.join(motifs)}))"))


def char_count(s: C, char: str) -> Column:
    return F.length(_c(s)) - F.length(F.replace(_c(s), F.lit(char), F.lit("")))


def repeat_motif(s: C) -> Column:
    """The hexamer of the strand with more rotations of it, the plus strand in a tie; null if there are none."""
    plus, minus = overlapping(s, rotations(PLUS)), overlapping(s, rotations(MINUS))
    return F.when(F.greatest(plus, minus) > 0, F.when(plus >= minus, PLUS).otherwise(MINUS))


def telomere(seq: C, end: C, least: int = 100) -> Column:
    """The last end bases, all if there are fewer; empty if the sequence is null or end is under least."""
    q, s = _c(end), _c(seq)
    return F.when(s.isNotNull() & (q >= least), F.right(s, F.least(q, F.length(s)).cast("int"))).otherwise("")


def variant_spans(s: C, longest: int | None = LONGEST_SPAN, motif: C | None = None) -> Column:
    """(start, length) of the runs that the repeat hexamer doesn't cover, those over longest left out.

    The hexamer can't overlap itself, so the runs are the pieces between its places. Without any rotation of it, or of the
    other strand's, there are none.
    """
    motif = repeat_motif(s) if motif is None else _c(motif)
    sizes = F.transform(F.split(F.upper(_c(s)), F.coalesce(motif, F.lit("$^")), -1), lambda p: F.length(p))
    empty = F.array().cast("array<struct<start:int,length:int>>")
    at = F.struct(F.lit(0).alias("next"), empty.alias("out"))
    runs = F.aggregate(
        sizes, at,
        lambda a, n: F.struct((a["next"] + n + 6).alias("next"), F.when(n > 0, F.concat(a["out"], F.array(F.struct(a["next"].alias("start"), n.alias("length"))))).otherwise(a["out"]).alias("out")),
        lambda a: a["out"],
    )
    runs = F.when(motif.isNotNull(), runs).otherwise(empty)
    return runs if longest is None else F.filter(runs, lambda x: x["length"] <= longest)


def span_load(spans: C, least: int = 1) -> Column:
    """Bases in spans of at least that length."""
    return F.aggregate(_c(spans), F.lit(0).cast("long"), lambda a, x: a + F.when(x["length"] >= least, x["length"]).otherwise(0))


def kmers(s: C, k: int, stride: int = 1) -> Column:
    """The k-mers that begin every stride letters; a shorter rest is left out."""
    last = F.length(_c(s)) - k
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(_c(s), i + 1, F.lit(k)))


def plain(kmer: C) -> Column:
    """Only A, C, G, T."""
    return _c(kmer).rlike("^[ACGT]+$")


def canonical_key(kmer: C) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(_c(kmer), reverse_complement(kmer))


def hash_scalar(key: C) -> Column:
    """A number in [0, 1] by CRC-32."""
    return F.crc32(_c(key).cast("binary")) / F.lit(4294967295.0)


def merged_fragments(s: C, k: int = 6) -> Column:
    """The text in pieces of k letters from its start, equal neighbours as one: an array of (start, length, fragment)."""
    s = F.coalesce(_c(s), F.lit(""))
    pieces = F.regexp_extract_all(s, F.lit(f"(?s).{{1,{k}}}"), F.lit(0))  # in one pass; substr would begin anew for each piece

    def runs(p: Column) -> Column:
        begin = F.filter(F.transform(p, lambda x, i: F.when((i == 0) | (x != F.get(p, i - 1)), i)), lambda i: i.isNotNull())
        size = (F.size(p) - 1) * k + F.length(F.element_at(p, -1))
        return F.transform(F.array(begin), lambda b: F.transform(b, lambda i, n: F.struct(
            (i * k).cast("int").alias("start"), (F.coalesce(F.get(b, n + 1) * k, size) - i * k).cast("int").alias("length"), F.get(p, i).alias("fragment"))))[0]

    return F.transform(F.array(pieces), runs)[0]  # bound once, not made again for each piece


def phase_disruption(s: C) -> Column:
    """(start, length) of the runs of letters that aren't covered by all six rotations of the strand's hexamer, nor by the hexamer.

    Six windows in a row that are rotations hold the hexamer itself, so these are the runs that the hexamer doesn't cover.
    """
    return variant_spans(s, longest=None)


def int_list(text: C, trim_ends: int = 0) -> Column:
    """Integers of a comma-separated list, without trim_ends at either end. Brackets and spaces are ignored, as are items
    that are no numbers; null, '', nan and none give an empty list."""
    bare = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"[\[\]()\s]", "")
    items = F.filter(F.transform(F.split(bare, ","), lambda x: x.try_cast("double").try_cast("int")), lambda x: x.isNotNull())
    return items if not trim_ends else F.slice(items, trim_ends + 1, F.greatest(F.size(items) - 2 * trim_ends, F.lit(0)))


def bound_flags(codes: C) -> Column:
    """Of comma-separated footprint codes, whether both of the lowest bits are set."""
    return F.transform(F.split(_c(codes), ","), lambda c: c.cast("int").bitwiseAND(3) == 3)


def tag_value(tags: C, name: str) -> Column:
    """The value of a SAM tag such as NM:i:; null without it."""
    return F.substr(F.get(F.filter(_c(tags), lambda t: t.startswith(name)), F.lit(0)), F.lit(len(name) + 1)).try_cast("double")


def motif_hits(s: C, motif: str) -> Column:
    """Start of each place of the motif, left to right, without overlaps."""
    sizes = F.transform(F.split(_c(s), motif, -1), lambda p: F.length(p))
    at = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("out"))
    return F.when(
        F.size(sizes) > 1,
        F.aggregate(F.slice(sizes, 1, F.size(sizes) - 1), at, lambda a, n: F.struct((a["next"] + n + len(motif)).alias("next"), F.concat(a["out"], F.array(a["next"] + n)).alias("out")), lambda a: a["out"]),
    ).otherwise(F.array().cast("array<int>"))


def masked_text(s: C, spans: C) -> Column:
    """The sequence with its spans set in ** marks."""
    last = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        _c(spans), last,
        lambda a, x: F.struct((x["start"] + x["length"]).alias("at"), F.concat(a["out"], F.substr(_c(s), a["at"] + 1, x["start"] - a["at"]), F.lit("**"), F.substr(_c(s), x["start"] + 1, x["length"]), F.lit("**")).alias("out")),
        lambda a: F.concat(a["out"], F.substr(_c(s), a["at"] + 1)),
    )
