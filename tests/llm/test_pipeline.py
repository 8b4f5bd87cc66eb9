"""run() and its stages against plain versions, on a table with rows without ids, repeated ids and clashing column names."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandmill.llm import toxicity, vocabulary
from tests.llm.test_operators import brute_targets, low, shingles

ODD = [
    (None, "alone without an id"), (None, "alone without an id"), (None, "ALONE  without an id"), (1, "one two three"), (1, "four five six seven"), (0, "one two three"), (9001, None), (9002, ""),
    (9003, " \n"), (None, None), (9004, "a b c d e f g h i j k l m n o p q r s t u v w"), (9005, "A b c d e f g h i j k l m n o p q r s t u v w"),
    (9005, "a b c d e f g h i j k l m n o p q r s t u v x"), (None, "z b c d e f g h i j k l m n o p q r s t u v w"), (9006, "long " * 3000), (9007, "x" * 5000),
]


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """Documents of the smallest table and odd rows, in a folder as the tables lie in."""
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"_uid": F.lit("clash"), "copies": F.lit(7), "node": F.lit(1), "digest": F.lit("d")})
    odd = spark.createDataFrame([(i, t, "en", f"odd{k % 2}" if k % 5 else None, 1, "clash", 7, 1, "d") for k, (i, t) in enumerate(ODD)], docs.schema)
    docs.unionByName(odd).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def taken(docs):
    return Counter((r.doc_id, r.text, r.source) for r in docs.collect())


def plain_near_copies(rows):
    """Of rows (id, text), those that stay: of each linked group the one with the smallest id, null last."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(find(k), []).append((i is None, i or 0, t))
    return groups.values()


def test_stages_equal_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, found = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        path = f"{folder}/{name.replace(' ', '-')}.parquet"
        stage(spark, before, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns or name.startswith("bpe")
        rows, found[name] = taken(before), docs
        if name == "toxicity":
            model = toxicity.train(before, spark.read.parquet(f"{folder}/labels.parquet"))
            scored = toxicity.score_documents(before.withColumn("doc_id", F.monotonically_increasing_id()), model).select("predicted").collect()
            assert taken(docs).total() == sum(r.predicted == 0 for r in scored) and not taken(docs) - rows
            assert taken(docs).total() > 0.8 * rows.total()
        if name == "exact dedup":
            groups = {}
            for (i, t, _), n in rows.items():
                groups.setdefault(low(t), []).append(i)
            want = sorted((str(max((i for i in ids if i is not None), default=None)), t) for t, ids in groups.items())
            assert sorted((str(i), low(t)) for i, t, _ in taken(docs).elements()) == want and not taken(docs) - rows
        if name == "n-gram jaccard join":
            got = [(i is None, i or 0, t) for i, t, _ in taken(docs).elements()]
            groups = list(plain_near_copies([(i, t) for i, t, _ in rows.elements()]))
            assert len(got) == len(groups) and not taken(docs) - rows
            for group in groups:
                assert sum(g in got for g in group) == 1 and min(x[:2] for x in group) in [x[:2] for x in got if x in group]
        if name == "mixing sources":
            words = lambda t: len((t or "").encode().split())
            sizes, mixed = {}, {}
            for (_, t, s), n in rows.items():
                sizes[s] = sizes.get(s, 0) + n * words(t)
            for (_, t, s), n in taken(docs).items():
                mixed[s] = mixed.get(s, 0) + n * words(t)
            targets = brute_targets(sizes)
            assert set(taken(docs)) <= set(rows)
            for s, target in targets.items():
                rate = target / sizes[s] if sizes[s] else 0
                own = [(k, n) for k, n in rows.items() if k[2] == s]
                assert abs(mixed.get(s, 0) - target) <= max(words(k[1]) for k, _ in own)
                for k, n in own:
                    low_copies, high_copies = (math.floor(rate), math.ceil(rate)) if words(k[1]) else (0, 0)
                    assert n * low_copies <= taken(docs)[k] <= n * high_copies
        if name.startswith("bpe"):
            library = vocabulary.load(vocabulary.default_path()).tokenizer
            want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows.elements())
            assert Counter((r.doc_id, tuple(r.ids)) for r in docs.collect()) == want
            assert docs.where("n_tokens <> size(ids)").count() == 0


def test_run_accounts_for_rows_without_ids(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    library = vocabulary.load(vocabulary.default_path()).tokenizer
    ids = {(r.doc_id, tuple(r.ids)) for r in out.collect()}
    assert {i for i, _ in ids if i is not None} <= {r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    encode = lambda t: tuple(library.encode(t, add_special_tokens=False).ids)
    # ids 1: both texts are documents of their own; one copy of the text without an id stays
    assert not {(0, encode("one two three")), (1, encode("one two three"))} <= ids
    assert len([x for x in ids if x[0] is None and x[1] in (encode("alone without an id"), encode("ALONE  without an id"))]) <= 1


def test_pipeline_of_an_empty_table(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
