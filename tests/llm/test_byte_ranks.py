import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from strandmill.llm import byte_ranks

ODD = [
    None, "", " ", "  a  b ", "it's we'll THEY'RE 'sx", "naïve café ½ ② Ⅷ", "日本語のテキスト 한국어 العربية", "👩‍👩‍👧‍👦 é ​﻿", "a\x00b\r\n\t　  x", "<|endoftext|>",
    "....----====~~~~ aaaaaaa", "x" * 3000, "😀" * 500, "same", "same",
]


@pytest.fixture(scope="module")
def library():
    with open(byte_ranks.default_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k if k != 3 else None, t, "z") for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def test_round_trip_equals_the_library_on_every_document(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {r.doc_id: r for r in byte_ranks.op11_byte_ranks(spark, sf_dir).collect()}
    assert len(found) == docs.count()
    for row in docs.collect():
        ids = library.encode_ordinary(row.text or "")
        r = found[row.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()


def test_odd_texts_nulls_repeated_rows_and_clashing_columns(odd, library):
    found = sorted(([*r.ids] for r in byte_ranks.encode(odd).collect()), key=repr)
    assert found == sorted((library.encode_ordinary(t or "") for t in ODD), key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_ranks.encode(none).collect() == byte_ranks.round_trip(none).collect() == byte_ranks.encode_spans(none).collect() == []
    assert byte_ranks.decode(byte_ranks.encode(none)).collect() == []


def test_merges_equal_the_library_on_adversarial_words(library):
    whole = tiktoken.Encoding("one", pat_str=r"(?s).+", mergeable_ranks=library._mergeable_ranks, special_tokens={})
    model, rng = byte_ranks.load(byte_ranks.default_path()), random.Random(3)
    tokens = [t for t in model.ranks if t.isascii() and len(t) > 1]
    words = ["".join(rng.choice("ae-.0 nr"[: rng.randint(1, 8)]) for _ in range(rng.randint(1, 30))).encode() for _ in range(5000)]
    words += [(rng.choice(tokens) * 3)[rng.randint(0, 2) :] for _ in range(5000)]
    expected = [whole.encode_ordinary(w.decode()) for w in words]
    assert model.encode_words(words) == expected
    assert [model.joined(w) for w in words] == expected  # what strings with ties are merged by


def test_ties_are_merged_leftmost_first(tmp_path):
    tokens = [bytes([b]) for b in range(256)] + [b"ba", b"xab", b"ab", b"xa", b"aba"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
    model, ranks = byte_ranks.Ranks(str(path)), {t: k for k, t in enumerate(tokens)}
    whole = tiktoken.Encoding("one", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    words = ["".join(rng.choice("abx") for _ in range(rng.randint(1, 12))).encode() for _ in range(3000)]
    assert model.encode_words(words) == [whole.encode_ordinary(w.decode()) for w in words]


def test_a_file_without_all_bytes_is_refused(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="no rank for the bytes"):
        byte_ranks.Ranks(str(path))


def test_offsets_in_bytes_and_characters(odd, library):
    found = {tuple(t.id for t in r.tokens): r.tokens for r in byte_ranks.encode_spans(odd).collect()}
    for text in filter(None, ODD):
        raw, tokens = text.encode(), found[tuple(library.encode_ordinary(text))]
        assert [raw[t.byte_start : t.byte_end] for t in tokens] == [library.decode_single_token_bytes(t.id) for t in tokens]
        for t in tokens:
            first = len(raw[: t.byte_start + 1].decode("utf-8", "ignore")) if raw[t.byte_start] < 0x80 else sum((b & 0xC0) != 0x80 for b in raw[: t.byte_start + 1])
            assert (t.char_start, t.char_end) == (first - 1, sum((b & 0xC0) != 0x80 for b in raw[: t.byte_end]))


def test_decoding_handles_split_characters(spark, library):
    ids = library.encode_ordinary("a 👩‍👩‍👧 ع 日本")
    rows = [(1, ids), (2, ids[:-1]), (3, None), (4, []), (5, [ids[0], 10**9, -1, ids[1]]), (6, ids[3:4])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<long>")
    whole = {r.doc_id: r for r in byte_ranks.decode(df).collect()}
    parts = {r.doc_id: r.parts for r in byte_ranks.decode_streamed(df).collect()}
    for doc_id, some in rows:
        raw = b"".join(library.decode_single_token_bytes(i) for i in some or [] if 0 <= i < 50256)
        assert bytes(whole[doc_id].data) == raw
        assert whole[doc_id].text == raw.decode("utf-8", "replace") == "".join(parts[doc_id])
    assert len(parts[1]) == len(ids) + 1 and "�" not in "".join(parts[1])


def test_a_very_long_text(spark, library):
    text = "the quick brown fox, été " * 200_000 + "z" * 300_000
    (row,) = byte_ranks.round_trip(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.n_tokens == len(library.encode_ordinary(text))
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
