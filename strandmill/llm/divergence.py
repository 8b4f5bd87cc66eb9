"""Which sources of a language write differently, and by which terms, from frequencies of a single pass over the texts.

Map tasks index their texts in memory: for each language and term, how often each source has it and in how many documents. When
the memory set aside is full, the block is spilled as runs in the order of terms, one for each hash shard. The runs go through
the shuffle, which is the shared storage that survives a lost executor. A shard's task merges its runs by a heap and sums
what belongs to the same term. In a language, two sources differ by a sum over all kept terms: what terms that
neither has would give, plus corrections for those that one of them has (by how often it has them, so many terms share one), plus
corrections for those that both have, summed while the terms stream by.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.bpe import pack, unpack
from strandmill.llm.shared import batches, keep, string_buffers

MEMORY = 64 << 20  # bytes of a block's index
SLICE = 8 << 20
LEAST_DOCS, TOP = 10, 10
TERMS, PAIRS = 20_000, 1 << 20  # terms that a merge gives at once, pairs that a task holds
BROADCAST_GROUPS = 100_000

_TERM = np.zeros(256, bool)
_TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True  # [^\x00-\x40\x5B-\x60\x7B-\x7F] in UTF-8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts, only A-Z lower-cased, and the number of each one's text."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:]
    starts = np.flatnonzero(start)
    kept = np.flatnonzero(inside)
    ends = np.append(np.searchsorted(kept, starts), len(kept)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(_LOWER[data[kept]]))])
    return found, np.searchsorted(offsets, starts, side="right") - 1


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different keys in order, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


class _Block:
    """Postings in memory: of each group (language, source) and term, occurrences and documents."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[bytes, int] = {b"": 0}  # the empty term counts the documents of a group
        self.postings: list[tuple[np.ndarray, ...]] = []
        self.entries = self.bytes = 0

    def add(self, langs: list[str], sources: list[str], data: np.ndarray, offsets: np.ndarray) -> None:
        groups = np.fromiter((self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources)), np.int64, len(langs))
        found, doc = terms(data, offsets)
        coded = found.dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        key, count = _summed(doc * max(len(words), 1) + codes, np.ones(len(codes), np.int64))  # one for each document and term
        before = len(self.terms)
        own = np.fromiter((self.terms.setdefault(w, len(self.terms)) for w in words), np.int64, len(words))
        self.bytes += sum(map(len, words)) + 120 * (len(self.terms) - before)
        doc, code = np.divmod(key, max(len(words), 1))
        self._post(np.concatenate((groups[doc], groups)), np.concatenate((own[code], np.zeros(len(groups), np.int64))), np.concatenate((count, np.ones(len(groups), np.int64))))

    def _post(self, group: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        key, count, docs = _summed((group << 32) | term, count, np.ones(len(group), np.int64))
        self.postings.append((key, count, docs))
        self.entries += len(key)
        if len(self.postings) > 8:
            self.postings = [_summed(*map(np.concatenate, zip(*self.postings)))]
            self.entries = len(self.postings[0][0])

    def size(self) -> int:
        return self.bytes + 24 * self.entries

    def runs(self, shards: int) -> Iterator[pa.RecordBatch]:
        """A row for each shard that has terms: these in order of language and UTF-8, with their postings."""
        if not self.groups:
            return
        key, count, docs = _summed(*map(np.concatenate, zip(*self.postings)))
        group, term = key >> 32, key & 0xFFFFFFFF
        names, words = list(self.groups), list(self.terms)
        langs, sources = (sorted({n[i] for n in names}, key=str.encode) for i in (0, 1))
        of_lang, of_source = ({n: k for k, n in enumerate(x)} for x in (langs, sources))
        lang = np.array([of_lang[n[0]] for n in names])[group]
        source = np.array([of_source[n[1]] for n in names])[group]
        place = np.empty(len(words), np.int64)
        place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((source, place[term], lang))
        lang, term, source, count, docs = (x[order] for x in (lang, term, source, count, docs))
        new = np.concatenate(([True], (lang[1:] != lang[:-1]) | (term[1:] != term[:-1])))
        first = np.flatnonzero(new)
        own_lang, own = lang[first].tolist(), [words[t] for t in term[first].tolist()]
        seeds = [zlib.crc32(name.encode() + b"\0") for name in langs]
        shard = np.fromiter((zlib.crc32(w, seeds[k]) % shards for k, w in zip(own_lang, own)), np.int64, len(own))
        by_shard = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[by_shard], np.arange(shards + 1))
        sizes = np.diff(np.append(first, len(term)))
        out = []
        for s in range(shards):
            mine = by_shard[edges[s] : edges[s + 1]]
            if len(mine):
                n = sizes[mine]
                at = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                raw = [own[k] for k in mine.tolist()]
                parts = (lang[first[mine]].astype(np.int32), np.fromiter(map(len, raw), np.int32, len(raw)), np.frombuffer(b"".join(raw), np.uint8), n.astype(np.int32), source[at].astype(np.int32), count[at], docs[at])
                out.append((s, langs, sources, *map(pack, parts)))
        kinds = [pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.binary()] * len(PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["shard", "langs", "sources", *PARTS])


PARTS = {"lang": np.int32, "lengths": np.int32, "data": np.uint8, "postings": np.int32, "source": np.int32, "counts": np.int64, "docs": np.int64}
RUNS = "shard int, langs array<string>, sources array<string>, " + ", ".join(f"{p} binary" for p in PARTS)


def _index(shards: int, memory: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches(rows, SLICE):
            block.add(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), *string_buffers(batch.column("text")))
            if block.size() > memory:
                yield from block.runs(shards)
                block = _Block()
        yield from block.runs(shards)

    return run


class _Run:
    """A run of a shard, its terms in order."""

    def __init__(self, row: dict):
        self.langs, self.sources = [x.encode() for x in row["langs"]], row["sources"]
        self.part = {p: unpack(row[p], kind) for p, kind in PARTS.items()}
        self.ends = np.concatenate(([0], np.cumsum(self.part["postings"], dtype=np.int64)))

    def keys(self, number: int) -> Iterator[tuple[bytes, bytes, int, int]]:
        data, end = self.part["data"].tobytes(), 0
        for k, (lang, length) in enumerate(zip(self.part["lang"].tolist(), self.part["lengths"].tolist())):
            yield self.langs[lang], data[end : end + length], number, k
            end += length


def _frequencies(least: int):
    """Merges the runs of a shard by a heap: rows of the terms in at least so many documents, and of the empty term."""

    def rows_of(runs: list[_Run], names: list[tuple[bytes, bytes]], at: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        place, count, docs, source, code = [], [], [], [], {}
        for number, run in enumerate(runs):
            mine = at[number]
            if mine:
                term, k = (np.array(x, np.int64) for x in zip(*mine))
                n = run.ends[k + 1] - run.ends[k]
                take = np.repeat(run.ends[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                codes = np.array([code.setdefault(s, len(code)) for s in run.sources], np.int64)
                place.append(np.repeat(term, n))
                count.append(run.part["counts"][take])
                docs.append(run.part["docs"][take])
                source.append(codes[run.part["source"][take]])
        place, count, docs, source = map(np.concatenate, (place, count, docs, source))
        order = sorted(code, key=str.encode)
        rank = np.empty(len(order), np.int64)
        rank[[code[s] for s in order]] = np.arange(len(order))
        key, count, docs = _summed(place * len(order) + rank[source], count, docs)
        place, source = np.divmod(key, len(order))
        in_docs = np.bincount(place, docs, len(names)).astype(np.int64)
        kept = (in_docs >= least) | np.fromiter((not t for _, t in names), bool, len(names))
        sizes = np.where(kept, np.bincount(place, minlength=len(names)), 0)
        stays = kept[place]
        ends = np.concatenate(([0], np.cumsum(sizes[kept]))).astype(np.int32)
        shown = [n for n, k in zip(names, kept) if k]
        columns = [pa.array([x.decode() for x in c], pa.string()) for c in (zip(*shown) if shown else ((), ()))]
        names_of = pa.DictionaryArray.from_arrays(pa.array(source[stays], pa.int32()), pa.array(order, pa.string())).cast(pa.string())
        lists = [pa.ListArray.from_arrays(pa.array(ends), v) for v in (names_of, pa.array(count[stays]))]
        return pa.RecordBatch.from_arrays([*columns, *lists], names=["lang", "term", "sources", "counts"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = [_Run(row) for batch in rows for row in batch.to_pylist()]
        names, at = [], [[] for _ in runs]
        for name, same in groupby(heapq.merge(*(r.keys(k) for k, r in enumerate(runs))), key=lambda x: x[:2]):
            for _, _, number, k in same:
                at[number].append((len(names), k))
            names.append(name)
            if len(names) == TERMS:
                yield rows_of(runs, names, at)
                names, at = [], [[] for _ in runs]
        if names:
            yield rows_of(runs, names, at)

    return run


def frequencies(docs: DataFrame, least: int = LEAST_DOCS, memory: int = MEMORY) -> DataFrame:
    """lang, term, sources, counts of docs (text, lang, source): the terms in at least so many documents of a language.

    Null text, lang and source count as ''. The row of the empty term has the documents of each source, so that sources
    without terms are known. Repeated rows are documents like others; further columns are not read; an empty table gives none.
    """
    slim = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    tasks = slim.rdd.getNumPartitions()
    shards = min(max(tasks, 16), max(2048, 8 * math.isqrt(tasks)))  # a run has a row for each, so they grow slower than tasks
    runs = slim.mapInArrow(_index(shards, memory), RUNS).repartitionById(shards, F.col("shard"))
    return runs.mapInArrow(_frequencies(least), "lang string, term string, sources array<string>, counts array<long>")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * count / total) for 0 <= count <= total, exact up to 9 * 10^15: by long division, three digits at a time."""
    out, rest = F.lit(0).cast("long"), count
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + _div(rest, total), rest % total
    return out + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are at most 10^9 + 1."""
    return _div((p - q) * (p - q), p + q)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def totals(freq: DataFrame) -> DataFrame:
    """lang, source, n, v, lang_n of frequencies: occurrences of kept terms in each group, the language's kept terms, and its occurrences."""
    entries = freq.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("e")).select("lang", "term", F.col("e.sources").alias("source"), F.col("e.counts").alias("count"))
    groups = entries.groupBy("lang", "source").agg(F.sum(F.when(F.col("term") == "", 0).otherwise(F.col("count"))).alias("n"))
    langs = freq.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("v"))
    return groups.join(langs, "lang").withColumn("lang_n", F.sum("n").over(Window.partitionBy("lang")))


def _both(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, term, source, p, p0), a term's next to each other and in order of source, to the corrections of pairs.

    lang, a, b, value: sums over the terms that both a and b have of f(p, q) - f(p, q0) - f(p0, q) + f0; a pair may
    come several times.
    """
    code: dict[tuple[str, str], int] = {}
    sums: list[tuple[np.ndarray, np.ndarray]] = []
    held, left = 0, None

    def emitted() -> pa.RecordBatch:
        names = list(code)
        key, value = _summed(*map(np.concatenate, zip(*sums)))
        a, b = (key >> 32).tolist(), (key & 0xFFFFFFFF).tolist()
        columns = [pa.array([names[i][0] for i in a]), pa.array([names[i][1] for i in a]), pa.array([names[i][1] for i in b]), pa.array(value)]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])

    def add(source: np.ndarray, p: np.ndarray, p0: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """Terms x sources of each; pairs of the columns i and j."""
        nonlocal held, sums
        value = _distance(p[:, i], p[:, j]) - _distance(p[:, i], p0[:, j]) - _distance(p0[:, i], p[:, j]) + _distance(p0[:, i], p0[:, j])
        sums.append(_summed(((source[:, i] << 32) | source[:, j]).ravel(), value.ravel()))
        held += len(sums[-1][0])
        if held > PAIRS:
            sums = [_summed(*map(np.concatenate, zip(*sums)))]
            held = len(sums[0][0])

    def terms_of(table: pa.Table) -> None:
        lang, source = table.column("lang").to_pylist(), table.column("source").to_pylist()
        codes = np.fromiter((code.setdefault(x, len(code)) for x in zip(lang, source)), np.int64, len(lang))
        p, p0 = (table.column(c).to_numpy() for c in ("p", "p0"))
        first = _edges(table)
        sizes = np.diff(np.append(first, len(codes)))
        for k in np.unique(sizes[sizes > 1]).tolist():  # terms that equally many sources have are taken together
            at = first[sizes == k][:, None] + np.arange(k)
            step = max(PAIRS // (k * k), 1)
            for begin in range(0, k - 1, max(PAIRS // k, 1)):
                i, j = np.nonzero(np.arange(k) > np.arange(begin, min(begin + max(PAIRS // k, 1), k - 1))[:, None])
                for t in range(0, len(at), step):
                    some = at[t : t + step]
                    add(codes[some], p[some], p0[some], i + begin, j)

    for batch in rows:
        table = pa.Table.from_batches([batch])
        if left is not None:
            table = pa.concat_tables([left, table]).combine_chunks()
        last = _edges(table)[-1] if len(table) else 0
        left, whole = table.slice(last), table.slice(0, last)
        if len(whole):
            terms_of(whole)
            if held > PAIRS // 2:
                yield emitted()
                sums, held, code = [], 0, {}
    if left is not None and len(left):
        terms_of(left)
    if sums:
        yield emitted()


def _edges(table: pa.Table) -> np.ndarray:
    """Where the terms begin of rows of which a term's lie next to each other."""
    if not len(table):
        return np.zeros(0, np.int64)
    codes = [table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term")]
    codes = [(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).indices.to_numpy() for c in codes]
    return np.flatnonzero(np.concatenate(([True], (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1]))))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, memory: int = MEMORY) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of docs (text, lang, source) is from the others of its language.

    Part `pair`: each other source, value as summed over all kept terms, all ranks. Part `term`: the first ranks of the terms
    that the source has more often than its language. Rank by falling value, then the item in UTF-8. Rows as in frequencies().
    A language without kept terms gives pairs of value 0; one with a single source gives none.
    """
    freq = keep(frequencies(docs, least, memory), "frequencies")
    groups = keep(totals(freq), "divergence-groups")
    few = groups.count() <= BROADCAST_GROUPS
    small = F.broadcast if few else lambda df: df
    known = groups.where("v > 0")
    size = F.col("n") + 2 * F.col("v")
    with_zero = known.withColumn("p0", share(F.lit(2).cast("long"), size))
    each = freq.where("term != ''").select("lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("lang_count"), F.explode(F.arrays_zip("sources", "counts")).alias("e"))
    each = each.select("lang", "term", "lang_count", F.col("e.sources").alias("source"), F.col("e.counts").alias("count")).join(small(with_zero), ["lang", "source"])
    each = each.withColumn("p", share(F.col("count") + 2, size))

    q = share(F.col("lang_count") + 2, F.col("lang_n") + 2 * F.col("v"))
    high = each.withColumn("q", q).where("count > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))

    near = each.select("lang", "term", "source", "p", "p0")
    near = (near if few else near.repartition("lang", "term")).sortWithinPartitions("lang", "term", "source")
    both = near.mapInArrow(_both, "lang string, a string, b string, value long")
    often = each.groupBy("lang", "source", "count").agg(F.count(F.lit(1)).alias("m"), F.first("p").alias("p"), F.first("p0").alias("p0"))
    other = groups.select("lang", F.col("source").alias("b"), share(F.lit(2).cast("long"), F.when(F.col("v") > 0, size)).alias("q0"), "v")
    one = often.join(small(other), "lang").where("source != b")
    one = one.select("lang", F.col("source").alias("a"), "b", (F.col("m") * (distance(F.col("p"), F.col("q0")) - distance(F.col("p0"), F.col("q0")))).alias("value"))
    none = groups.select("lang", F.col("source").alias("a"), share(F.lit(2).cast("long"), F.when(F.col("v") > 0, size)).alias("p0")).join(small(other), "lang").where("a != b")
    none = none.select("lang", "a", "b", F.coalesce(F.col("v") * distance(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    halves = both.unionByName(one.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    swapped = halves.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    pairs = none.unionByName(halves).unionByName(swapped).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [df.withColumn("rank", F.row_number().over(order)) for df in (pairs, high)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM docs),
kept AS (SELECT lang, t, count(*) AS c FROM words GROUP BY lang, t HAVING count(DISTINCT id) >= 10),
langs AS (SELECT lang, count(*) AS v, CAST(sum(c) AS BIGINT) AS n FROM kept GROUP BY lang),
occ AS (SELECT lang, source, t, count(*) AS c FROM words SEMI JOIN kept USING (lang, t) GROUP BY lang, source, t),
sizes AS (SELECT lang, source, CAST(sum(c) AS BIGINT) AS n FROM occ GROUP BY lang, source),
groups AS (SELECT DISTINCT lang, source FROM docs),
shares AS (
  SELECT g.lang, g.source, k.t, coalesce(o.c, 0) AS c, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(o.c, 0) + 2) // (coalesce(s.n, 0) + 2 * l.v) AS BIGINT) AS p,
         CAST(1 + CAST(1000000000 AS HUGEINT) * (k.c + 2) // (l.n + 2 * l.v) AS BIGINT) AS q
  FROM groups g JOIN langs l ON g.lang = l.lang JOIN kept k ON k.lang = g.lang
  LEFT JOIN occ o ON o.lang = g.lang AND o.source = g.source AND o.t = k.t LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source),
sums AS (SELECT a.lang, a.source AS x, b.source AS y, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
         FROM shares a JOIN shares b ON a.lang = b.lang AND a.t = b.t AND a.source < b.source GROUP BY ALL),
parts AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source != h.source
  LEFT JOIN sums s ON s.lang = g.lang AND s.x = least(g.source, h.source) AND s.y = greatest(g.source, h.source)
  UNION ALL SELECT lang, source, 'term', t, (p - q) * (p - q) // (p + q) FROM shares WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10"""
