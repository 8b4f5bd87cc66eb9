"""Toxicity by a convolutional text classifier.

A word's embedding is the sum of those of the word and of its runs of a few letters, which are shared by a hash.
Filters of several widths run over the words of a text, the greatest value of each filter is kept, and a logistic layer
makes a score of them. All begins at random and is trained in numpy, in one task on a bounded sample of labelled documents, until the
loss of texts not learned from settles. If there are more labelled documents than that, rounds over all of them follow: tasks go on
from the same model, each with its share of the documents, and the mean of what they change is the next round's model. Scores are
then bent so that, for each language that the text itself suggests, the threshold that was best for the texts not learned from lies at 0.3.
"""

from __future__ import annotations

import copy
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm import words as W
from strandmill.llm.language import held_out, letters_of
from strandmill.llm.shared import batches, drop, in_docs, keep, string_buffers, uniform

BUCKETS = 1 << 17
WIDTH, FILTERS, SPANS, GRAMS = 16, 12, (1, 2, 3), (3, 4, 5)
SAMPLE, SAMPLE_BYTES, LONGEST = (2400, 1200), 64 << 20, 1 << 20  # clean and toxic documents to begin with, their bytes in all and of one
ROUNDS, SEEN, PART, FINE = (2, 12), 80_000, 1024, 32  # rounds over all documents, documents they see in all, embeddings in a row of changes, steps of a unit of log odds
EPOCHS, SETTLED, SETTLES, RATE, MINI, DROP = 30, 2, 5e-4, 0.05, 32, 0.2
CUT, LEAST, HELD = 0.3, 8, 0.3
BATCH, RUN, CHUNK = 8 << 20, 8_000, 5_000  # bytes of a batch, words of a run and different words at a time, few enough for a cache
_OFFSET = {w: sum(SPANS[: SPANS.index(w)]) for w in SPANS}  # of a span's first matrix


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words as letters alone, the place among them of every word, and the first word of each text."""
    starts, _, first = W.words(data, offsets)
    if not len(starts):
        return [], np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    codes, words = W.coded(data, starts)
    place: dict[str, int] = {}  # words that differ in other signs alone are one
    own = np.fromiter((place.setdefault(letters_of(w), len(place)) for w in words), np.int32, len(words))
    return list(place), own[codes], first


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The embeddings that each word is made of, those of all words in a row, and where each word's begin and end."""
    found, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for a in range(0, len(words), CHUNK):
        raw = [b"<%b>" % w.encode() for w in words[a : a + CHUNK]]
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        left = np.repeat(np.cumsum(size), size) - np.arange(len(data))  # bytes from here to the word's end
        word = np.repeat(np.arange(len(raw), dtype=np.int32), size)
        some, owner = [np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) % BUCKETS], [np.arange(len(raw), dtype=np.int32)]
        for n in GRAMS:
            at = np.flatnonzero(left >= n)
            h = np.full(len(at), n, np.uint64)
            for k in range(n):
                h = (h ^ data[at + k]) * np.uint64(0x100000001B3)
            some.append((W.mixed(h) % np.uint64(BUCKETS)).astype(np.int64))
            owner.append(word[at])
        owner = np.concatenate(owner)
        found.append(np.concatenate(some).astype(np.int32)[np.argsort(owner, kind="stable")])
        sizes.append(np.bincount(owner, minlength=len(raw)))
    return np.concatenate(found), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


class Network:
    """Embeddings, filters and the last layer, at random."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.3, (BUCKETS, WIDTH)).astype(np.float32)
        self.filters = rng.normal(0, WIDTH**-0.5, (WIDTH, sum(SPANS) * FILTERS)).astype(np.float32)
        self.shift = np.zeros(len(SPANS) * FILTERS, np.float32)
        self.last = rng.normal(0, 0.3, len(SPANS) * FILTERS).astype(np.float32)
        self.bias = np.float32(0)

    def vectors(self, found: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The embeddings of words given by features(), the sums over the roots of their numbers."""
        if len(begin) == 1:
            return np.zeros((0, WIDTH), np.float32)
        out = np.empty((len(begin) - 1, WIDTH), self.embed.dtype)
        for a in range(0, len(out), CHUNK):
            own = begin[a : a + CHUNK + 1]
            out[a : a + CHUNK] = np.add.reduceat(self.embed.take(found[own[0] : own[-1]], axis=0), own[:-1] - own[0], axis=0)
        return out / np.sqrt(np.diff(begin))[:, None].astype(np.float32)

    def pool(self, parts: np.ndarray, codes: np.ndarray, first: np.ndarray, where: bool = False):
        """The greatest value of each filter over each text, at least 0; if asked for, also the place where it is, or -1.

        parts: what each word adds to each filter at each of its places; words past a text's end add nothing.
        """
        n = len(first) - 1
        best = np.zeros((n, len(SPANS) * FILTERS), np.float32)
        place = np.full(best.shape, -1, np.int64)
        some = np.flatnonzero(np.diff(first))
        if not len(some):
            return (best, place) if where else best
        begin, end = first[:-1][some], first[1:][some]
        every = parts.take(codes, axis=0)
        value = np.empty((len(codes), best.shape[1]), parts.dtype)
        for k, span in enumerate(SPANS):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            value[:, own] = every[:, _OFFSET[span] * FILTERS : (_OFFSET[span] + 1) * FILTERS]
            for step in range(1, span):
                col = (_OFFSET[span] + step) * FILTERS
                more = every[:, col : col + FILTERS]
                for ahead in range(step):  # the text before has no part in a text's first words
                    more[(begin + ahead)[begin + ahead < end]] = 0
                value[: len(codes) - step, own] += more[step:]
        value += self.shift
        top = np.maximum.reduceat(value, begin, axis=0)
        best[some] = np.maximum(top, 0)
        if where:
            for row, t in enumerate(some):
                place[t] = np.where(top[row] > 0, first[t] + value[first[t] : first[t + 1]].argmax(axis=0), -1)
        return (best, place) if where else best

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(pooled @ self.last + self.bias)))


def gradients(net: Network, found: np.ndarray, begin: np.ndarray, codes: np.ndarray, first: np.ndarray, toxic: np.ndarray, weight: np.ndarray, mask: np.ndarray | float = 1.0) -> tuple[dict, np.ndarray, np.ndarray]:
    """Of the weighted mean log loss of some texts: the gradients of the small parts, and the rows of the embeddings with theirs.

    mask is what the pooled values are multiplied by. The greatest value passes its gradient to the words it came from.
    """
    vectors = net.vectors(found, begin)
    pooled, place = net.pool(vectors @ net.filters, codes, first, where=True)
    error = ((net.score(pooled * mask) - toxic) * weight / len(toxic)).astype(np.float32)
    back = error[:, None] * net.last * mask * (place >= 0)
    wide = net.filters.shape[1]
    cells, values = [], []
    row, col = np.nonzero(place >= 0)
    at, ends = place[row, col], first[1:][row]
    span = np.repeat(SPANS, FILTERS)[col]
    offset = np.repeat([_OFFSET[s] for s in SPANS], FILTERS)[col]
    for step in range(max(SPANS)):
        fits = (step < span) & (at + step < ends)
        cells.append(codes[at[fits] + step] * wide + (offset[fits] + step) * FILTERS + col[fits] % FILTERS)
        values.append(back[row[fits], col[fits]])
    d_parts = np.bincount(np.concatenate(cells), np.concatenate(values), len(vectors) * wide).reshape(len(vectors), wide).astype(np.float32)
    rows = np.flatnonzero(d_parts.any(axis=1))
    d_words = d_parts[rows] @ net.filters.T / np.sqrt(np.diff(begin)[rows])[:, None]
    size = np.diff(begin)[rows]
    flat = found[np.repeat(begin[rows] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
    order = np.argsort(flat, kind="stable")
    near, at = np.unique(flat[order], return_index=True)
    d_embed = np.add.reduceat(d_words.take(np.repeat(np.arange(len(size)), size)[order], axis=0), at, axis=0) if len(at) else np.zeros((0, WIDTH))
    small = {"filters": vectors[rows].T @ d_parts[rows], "shift": back.sum(axis=0), "last": (error[:, None] * pooled * mask).sum(axis=0), "bias": error.sum()}
    return small, near, d_embed


class Texts:
    """Texts given by their words' places among the different ones, with the features of these."""

    def __init__(self, words: list[str], codes: np.ndarray, first: np.ndarray):
        self.words, self.codes, self.first = words, codes, first
        self.found, self.begin = features(words)

    def some(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Features of the words of some texts, where each word's begin and end, the places of the texts' words among
        them, and where each text's begin and end."""
        own = np.concatenate([np.zeros(0, self.codes.dtype), *(self.codes[self.first[t] : self.first[t + 1]] for t in texts)])
        used, codes = np.unique(own, return_inverse=True)
        size = np.diff(self.begin)[used]
        begin = np.concatenate(([0], np.cumsum(size)))
        found = self.found[np.repeat(self.begin[used] - begin[:-1], size) + np.arange(begin[-1])]
        return found, begin, codes, np.concatenate(([0], np.cumsum(np.diff(self.first)[texts])))

    def scores(self, net: Network, texts: np.ndarray) -> np.ndarray:
        out = [np.zeros(0)]
        for part in np.array_split(texts, max(1, len(texts) // 50)):
            found, begin, codes, first = self.some(part)
            out.append(net.score(net.pool(net.vectors(found, begin) @ net.filters, codes, first)))
        return np.concatenate(out)


def loss(score: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    p = np.clip(np.where(toxic > 0, score, 1 - score), 1e-6, 1)
    return float(-(weight * np.log(p)).sum() / max(weight.sum(), 1e-9))


def balanced(toxic: np.ndarray) -> np.ndarray:
    """Weights that give both classes half of the sum each."""
    return np.where(toxic > 0, 0.5 / max(toxic.mean(), 1e-3), 0.5 / max(1 - toxic.mean(), 1e-3)) if len(toxic) else toxic


SMALL = ("filters", "shift", "last", "bias")


def descend(net: Network, square: dict, texts: Texts, toxic: np.ndarray, weight: np.ndarray, order: np.ndarray, rng: np.random.Generator) -> None:
    """Adagrad's steps over the texts of order; square has the sums of squares of gradients."""
    for a in range(0, len(order), MINI):
        batch = order[a : a + MINI]
        found, begin, codes, first = texts.some(batch)
        if not len(codes):
            continue
        mask = ((rng.random((len(batch), len(net.last))) >= DROP) / (1 - DROP)).astype(np.float32)
        steps, near, d = gradients(net, found, begin, codes, first, toxic[batch], weight[batch], mask)
        for name, g in steps.items():
            square[name] = square[name] + g * g
            setattr(net, name, (getattr(net, name) - RATE * g / np.sqrt(square[name])).astype(np.float32))
        square["embed"][near] += d * d
        net.embed[near] -= RATE * d / np.sqrt(square["embed"][near])


def fit(texts: Texts, toxic: np.ndarray, learn: np.ndarray, check: np.ndarray, epochs: int = EPOCHS) -> tuple[Network, list[float]]:
    """A network trained by Adagrad on the texts of learn, as it was when the loss of those of check was least; and these losses.

    Training ends when SETTLED epochs have not brought that loss down by 2 % of its least and SETTLES, or after epochs.
    """
    net, rng = Network(), np.random.default_rng(6)
    square = {k: np.full_like(getattr(net, k), 1e-4) for k in ("embed", "filters", "shift", "last")} | {"bias": 1e-4}
    weight = balanced(toxic)
    losses, best, idle = [], None, 0
    for _ in range(epochs):
        descend(net, square, texts, toxic, weight, rng.permutation(learn), rng)
        losses.append(loss(texts.scores(net, check), toxic[check], weight[check]))
        idle = 0 if best is None or losses[-1] < 0.98 * best[0] - SETTLES else idle + 1
        if best is None or losses[-1] < best[0]:
            best = losses[-1], {k: np.copy(getattr(net, k)) for k in square}, {k: np.copy(v) for k, v in square.items()}
        if idle >= SETTLED:
            break
    for name, value in (best[1] if best else {}).items():
        setattr(net, name, value)
    net.square = best[2] if best else square
    return net, losses


def language_weights(words: list[str], codes: np.ndarray, first: np.ndarray, langs: np.ndarray, most: int = 200) -> tuple[list[str], dict[str, np.ndarray]]:
    """For the most frequent words of each language of the sample, how much they speak for each language."""
    names = sorted({x for x in langs if x is not None})
    counts = np.full((len(words), len(names)), 0.5)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for k, name in enumerate(names):
        counts[:, k] += np.bincount(codes[langs[text] == name], minlength=len(words)) if len(codes) else 0
    log = np.log(counts / counts.sum(axis=0))
    some = {int(i) for k in range(len(names)) for i in np.argsort(-counts[:, k], kind="stable")[:most]}
    return names, {words[i]: (log[i] - log[i].mean()).astype(np.float32) for i in some if words[i]}


def guess(words: list[str], codes: np.ndarray, first: np.ndarray, speaks: dict[str, np.ndarray], n: int) -> np.ndarray:
    """The language that the words of each text speak for; n where none does."""
    if not n:
        return np.zeros(len(first) - 1, np.int64)
    nothing = np.zeros(n, np.float32)
    table = np.array([speaks.get(w, nothing) for w in words]).reshape(len(words), n)
    votes = np.stack([in_docs(table[codes, k].astype(np.float64), first) for k in range(n)], axis=1)
    return np.where(np.abs(votes).sum(axis=1) > 0, votes.argmax(axis=1), n)


def best_cut(score: np.ndarray, toxic: np.ndarray, otherwise: float) -> float:
    """Half-way between the scores where F0.5 is greatest. With under LEAST texts of a class that says nothing: then otherwise, or
    the highest score of a clean text if that is higher, so that clean texts are left alone."""
    return best_cut_of(score, score, toxic, np.ones(len(score)), np.arange(len(score)), otherwise)


def best_cut_of(low: np.ndarray, high: np.ndarray, toxic: np.ndarray, n: np.ndarray, step: np.ndarray, otherwise: float) -> float:
    """best_cut() of groups of n texts of one class each, with scores from low to high; no cut divides a step."""
    toxic = toxic * n
    if min(toxic.sum(), n.sum() - toxic.sum()) < LEAST:
        return max([otherwise, *high[toxic <= 0]])
    _, at = np.unique(step, return_inverse=True)
    least, most = np.full(at.max() + 1, np.inf), np.full(at.max() + 1, -np.inf)
    np.minimum.at(least, at, low)
    np.maximum.at(most, at, high)
    order = np.argsort(-least, kind="stable")
    hits, all_to = np.cumsum(np.bincount(at, toxic)[order]), np.cumsum(np.bincount(at, n)[order])
    k = int((1.25 * hits / (all_to + 0.25 * toxic.sum())).argmax())
    under = most[order[k + 1]] if k + 1 < len(order) else 0.0
    return float(np.clip((least[order[k]] + under) / 2, 1e-3, 1 - 1e-3))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, lang and toxic of all labelled documents that aren't held out.

    An id that repeats in labels is toxic if any of its rows is; of documents that repeat an id one is taken.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    met = docs.join(known.where(~held_out(F.col("doc_id"))), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text"), "lang")).alias("d"))
    return met.select("doc_id", "d.text", "d.lang", "toxic").sortWithinPartitions("doc_id")


def sampled(every: DataFrame, found: dict[int, int], sample: tuple[int, int] = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """About sample documents of each class, of which labelled() has found. Texts of over LONGEST bytes are left out, and if the
    sample's texts have over most_bytes in all, a part of them is taken."""
    share = F.when(F.col("toxic") == 1, sample[1] / found[1]).otherwise(sample[0] / found[0])
    some = every.where((uniform("doc_id", seed=9) < share) & (F.col("text").isNull() | (F.octet_length("text") <= LONGEST)))
    size = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return some.where(uniform("doc_id", seed=10) < most_bytes / max(size, 1))


def class_counts(every: DataFrame) -> dict[int, int]:
    return {r["toxic"]: r["n"] for r in every.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> pa.Table | None:
    """The rows of sampled(), in order; None if a class has none."""
    every = labelled(docs, labels)
    found = class_counts(every)
    return sampled(every, found, sample, most_bytes).toArrow().sort_by("doc_id").combine_chunks() if found.get(0) and found.get(1) else None


def train(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> dict | None:
    """The model, from all labelled documents that aren't held out; None if there are none of one class.

    A share of HELD of them isn't learned from: it says when to stop, and where each language's threshold lies. Up to sample documents
    one task learns from all of them; else it learns from a sample, and rounds over all documents go on from there.
    """
    every = keep(labelled(docs, labels), "toxicity-labelled")
    found = class_counts(every)
    if not found.get(0) or not found.get(1):
        return None
    size, longest = every.agg(F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first()
    if found[0] <= sample[0] and found[1] <= sample[1] and (size or 0) <= SAMPLE_BYTES and (longest or 0) <= LONGEST:
        model = begun(every)
    else:
        apart = uniform("doc_id", seed=11) < HELD
        learn, check = every.where(~apart), every.where(apart)
        own = class_counts(learn)
        model = begun(sampled(learn, own, sample)) if own.get(0) and own.get(1) else None
        model = model and rounds(learn, check, own, model)
    drop(every)
    if model:
        model["net"].square = None
    return model


def begun(rows: DataFrame) -> dict | None:
    """trained() in one task. Should the executor be lost, another task begins anew."""

    def run(batches_of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches_of if b.num_rows]
        if some:
            model = trained(pa.Table.from_batches(some).sort_by("doc_id").combine_chunks())
            square = model["net"].square
            model["net"].square = square | {"embed": square["embed"].mean(axis=1)}
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = rows.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(found[0]["model"])) if found else None


def rounds(learn: DataFrame, check: DataFrame, found: dict[int, int], model: dict) -> dict:
    """The model after rounds over all documents of learn, of which found has the numbers by class: that of the round with the least
    loss over all of check, with the words' languages by all of learn and the thresholds by all of check.

    Rounds end when one hasn't brought the loss down by 2 % and SETTLES, or when they have seen SEEN documents; ROUNDS are the least
    number in this second case, and the greatest. Each sees every document of learn.
    """
    names, speaks = spoken_words(learn)
    net, best = model["net"], None
    for k in range(min(max(-(-SEEN // sum(found.values())), ROUNDS[0]), ROUNDS[1])):
        net = next_round(learn, found, net, k)
        groups = weighed(check, net, names, speaks)
        total = groups.group_by("toxic").aggregate([("n", "sum"), ("loss", "sum")]).to_pylist()
        now = float(np.mean([g["loss_sum"] / g["n_sum"] for g in total])) if total else 0.0  # as balanced() weighs
        model["losses"].append(now)
        settled = best is not None and now >= 0.98 * best[0] - SETTLES
        if best is None or now < best[0]:
            best = now, net, groups
        if settled:
            break
    _, net, groups = best
    spoken, columns = groups.column("spoken").to_numpy(), [groups.column(c).to_numpy() for c in ("low", "high", "toxic", "n", "step")]
    overall = best_cut_of(*columns, 0.5)
    cuts = [best_cut_of(*(c[spoken == k] for c in columns), overall) for k in range(len(names))] + [overall]
    return {"net": net, "names": names, "speaks": speaks, "cuts": np.clip(cuts, 0.05, 0.999), "losses": model["losses"]}


def next_round(learn: DataFrame, found: dict[int, int], net: Network, number: int) -> Network:
    """The network after each task has gone on from net over its rows of learn: an embedding is changed by the mean of the tasks that
    changed it, the other parts by the mean over documents. Rows of changes are summed by runs of PART embeddings."""
    weight = {k: 0.5 / max(found[k] / sum(found.values()), 1e-3) for k in (0, 1)}
    began = learn.sparkSession.sparkContext.broadcast(net)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = began.value
        own, seen, rng = copy.deepcopy(base), 0, np.random.default_rng([number, TaskContext.get().partitionId()])
        square = own.square | {"embed": np.repeat(own.square["embed"][:, None], WIDTH, axis=1)}
        for batch in batches(rows, BATCH):
            toxic = batch.column("toxic").to_numpy().astype(np.float64)
            texts = Texts(*text_words(*string_buffers(batch.column("text"))))
            descend(own, square, texts, toxic, np.where(toxic > 0, weight[1], weight[0]), rng.permutation(len(toxic)), rng)
            seen += len(toxic)
        if not seen:
            return
        change, more = own.embed - base.embed, square["embed"].mean(axis=1) - base.square["embed"]
        touched = change.any(axis=1)
        out = {-1: (float(seen), {k: (getattr(own, k) * seen, square[k] * seen) for k in SMALL})}
        for a in range(0, BUCKETS, PART):
            part = slice(a, a + PART)
            if touched[part].any():
                out[a] = touched[part].astype(np.float32), {"embed": (change[part], more[part] * touched[part])}
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([pickle.dumps(v) for v in out.values()], pa.binary())], names=["part", "change"])

    def summed(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0, {}
        for batch in rows:
            for change in batch.column("change"):
                n, more = pickle.loads(change.as_py())
                total = total + n
                for name, two in more.items():
                    sums[name] = tuple(a + b for a, b in zip(sums[name], two)) if name in sums else two
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([pickle.dumps((total, sums))], pa.binary())], names=["part", "change"])

    changes = learn.select("toxic", "text").mapInArrow(run, "part int, change binary").groupBy("part").applyInArrow(summed, "part int, change binary")
    after = copy.deepcopy(net)
    for row in changes.toLocalIterator():
        n, sums = pickle.loads(bytes(row["change"]))
        if row["part"] < 0:
            for name, (value, square) in sums.items():
                setattr(after, name, np.float32(value / n))
                after.square[name] = square / n
        else:
            part, many = slice(row["part"], row["part"] + PART), np.maximum(n, 1)
            change, more = sums["embed"]
            after.embed[part] += change / many[:, None]
            after.square["embed"][part] += more / many
    began.destroy()
    return after


def spoken_words(learn: DataFrame, most: int = 200) -> tuple[list[str], dict[str, np.ndarray]]:
    """language_weights() of all documents of learn."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, BATCH):
            words, codes, first = text_words(*string_buffers(batch.column("text")))
            langs = np.array(batch.column("lang").to_pylist(), object)
            text, letters = np.repeat(np.arange(batch.num_rows), np.diff(first)), pa.array(words, pa.string())
            for name in sorted({x for x in langs if x is not None}):
                n = np.bincount(codes[langs[text] == name], minlength=len(words))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), letters.take(pa.array(some)), pa.array(n[some].astype(np.int64))], names=["lang", "word", "n"])

    counts = learn.select("text", "lang").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = keep(counts, "toxicity-words")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    names, different = sorted({r["lang"] for r in learn.where("lang IS NOT NULL").select("lang").distinct().collect()}), counts.select("word").distinct().count()
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counts.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).where("word <> ''").select("word").distinct()
    speaks: dict[str, np.ndarray] = {}
    for r in counts.join(F.broadcast(top), "word").collect():
        speaks.setdefault(r["word"], np.full(len(names), 0.5))[names.index(r["lang"])] += r["n"]
    drop(counts)
    every = np.array([totals.get(name, 0) + 0.5 * different for name in names])
    logs = {word: np.log(n / every) for word, n in speaks.items()}
    return names, {word: (x - x.mean()).astype(np.float32) for word, x in logs.items()}


def weighed(check: DataFrame, net: Network, names: list[str], speaks: dict[str, np.ndarray]) -> pa.Table:
    """Documents of check by the language that they speak, class and score in steps of log odds: their number n, least and
    greatest score and the sum of their log losses. As many rows at most as there are such steps."""
    given = check.sparkSession.sparkContext.broadcast((net, names, speaks))
    edge = 16 * FINE

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, names, speaks = given.value
        for batch in batches(rows, BATCH):
            score, spoken = raw_scores(batch, net, speaks, len(names))
            toxic = batch.column("toxic").to_numpy().astype(np.int64)
            bounded = np.clip(score, 1e-12, 1 - 1e-12)
            step = np.clip(np.floor(np.log(bounded / (1 - bounded)) * FINE), -edge, edge).astype(np.int64)
            lost = -np.log(np.clip(np.where(toxic > 0, score, 1 - score), 1e-6, 1))
            columns = {"spoken": spoken.astype(np.int64), "toxic": toxic, "step": step, "low": score, "high": score, "loss": lost, "n": np.ones(len(score), np.int64)}
            groups = pa.table(columns).group_by(["spoken", "toxic", "step"]).aggregate([("n", "sum"), ("low", "min"), ("high", "max"), ("loss", "sum")])
            groups = groups.select(["spoken", "toxic", "step", "n_sum", "low_min", "high_max", "loss_sum"])
            yield from groups.rename_columns(["spoken", "toxic", "step", "n", "low", "high", "loss"]).to_batches()

    groups = check.select("toxic", "text").mapInArrow(run, "spoken long, toxic long, step long, n long, low double, high double, loss double")
    groups = groups.groupBy("spoken", "toxic", "step").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("loss").alias("loss"))
    found = groups.toArrow().sort_by([("spoken", "ascending"), ("toxic", "ascending"), ("step", "ascending")])
    given.destroy()
    return found


def trained(rows: pa.Table) -> dict:
    """The model that the rows of a sample (doc_id, text, lang, toxic), in order, give."""
    texts = Texts(*text_words(*string_buffers(rows.column("text").combine_chunks())))
    toxic = rows.column("toxic").to_numpy().astype(np.float64)
    langs = np.array(rows.column("lang").to_pylist(), object)
    order = np.argsort([zlib.crc32(b"%d" % i) for i in rows.column("doc_id").to_pylist()], kind="stable")
    del rows
    place = np.empty(len(toxic), np.int64)
    for one in (toxic > 0, toxic <= 0):  # the same share of each class
        own = order[one[order]]
        place[own] = np.arange(len(own))
    check = np.flatnonzero(place % 10 < 10 * HELD)
    learn = np.setdiff1d(np.arange(len(toxic)), check)
    net, losses = fit(texts, toxic, learn, check)
    names, speaks = language_weights(texts.words, texts.codes, texts.first, langs)
    spoken = guess(texts.words, texts.codes, texts.first, speaks, len(names))[check]
    score, toxic = texts.scores(net, check), toxic[check]
    overall = best_cut(score, toxic, 0.5)
    cuts = [best_cut(score[spoken == k], toxic[spoken == k], overall) for k in range(len(names))] + [overall]
    return {"net": net, "names": names, "speaks": speaks, "cuts": np.clip(cuts, 0.05, 0.999), "losses": losses}


def bent(score: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Scores with cut moved to CUT; order and both ends stay."""
    return np.where(score < cut, CUT * score / cut, CUT + (1 - CUT) * (score - cut) / (1 - cut))


def raw_scores(batch: pa.RecordBatch, net: Network, speaks: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the network's score and the language that its words speak for, of n."""
    score = np.zeros(batch.num_rows)
    words, codes, first = text_words(*string_buffers(batch.column("text")))
    spoken = guess(words, codes, first, speaks, n)
    parts, a = net.vectors(*features(words)) @ net.filters, 0
    while a < batch.num_rows:  # runs of about RUN words
        b = min(max(int(np.searchsorted(first, first[a] + RUN, side="right")) - 1, a + 1), batch.num_rows)
        score[a:b] = net.score(net.pool(parts, codes[first[a] : first[b]], first[a : b + 1] - first[a]))
        a = b
    return score, spoken


def _scores(batch: pa.RecordBatch, model: dict | None) -> np.ndarray:
    if not model:
        return np.zeros(batch.num_rows)
    score, spoken = raw_scores(batch, model["net"], model["speaks"], len(model["names"]))
    return bent(score, model["cuts"][spoken])


def score_documents(docs: DataFrame, model: dict | None) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    Null counts as empty and gets the score of a text without words. Without a model all scores are 0. Null and
    repeated ids are rows like others; further columns are not read.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, BATCH):
            score = _scores(batch, model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id").cast("long")).alias("held_out"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, BATCH):
            yield batch.filter(pa.array(_scores(batch, model) < CUT))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
