import random

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import tokens as T


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


LIB = library()
OWN = T.transducer(T.vocabulary())


def same(text):
    return OWN.encode(text) == LIB.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_ids_and_round_trip(text):
    assert same(text) and "".join(OWN.decode(OWN.encode(text))) == text


def test_mixed_pieces():
    r = random.Random(3)
    bits = ["a", "the", "ing", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "é", "日", "👩‍💻", "1", "23", "'s", "'LL", "_", "<|endoftext|>", "́", "﻿", "İ", "²"]
    assert all(same("".join(r.choice(bits) for _ in range(r.randint(0, 40)))) for _ in range(3000))


def test_very_long_words():
    r = random.Random(1)
    for text in ("a" * 50_000, " " * 20_000, "".join(r.choice("abcdefgh") for _ in range(60_000)), "é" * 9_000):
        assert same(text)


def test_caches_do_not_change_results(monkeypatch):
    monkeypatch.setattr(T, "MAX_WORDS", 2)
    monkeypatch.setattr(T, "MAX_STEPS", 10)
    fresh = T.Transducer(T.read_ranks(T.vocabulary()))
    text = "Several different words, again and again; several different words."
    assert fresh.encode(text) == LIB.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40))
def test_utf8_automaton(data):
    m = T.Utf8Stream()
    assert "".join(m.feed(bytes([b])) for b in data) + m.end() == data.decode("utf-8", "replace")


def test_documents(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, "", "y"), (3, None, "z"), (1, "Hello world", "x")], "doc_id long, text string, ids string")
    got = T.encode_documents(df).collect()
    ids = LIB.encode("Hello world", add_special_tokens=False).ids
    assert sorted((r.doc_id, r.ids) for r in got) == [(1, ids), (1, ids), (2, []), (3, [])]
    assert {(r.doc_id, r.text) for r in T.decode_documents(T.encode_documents(df)).collect()} == {(1, "Hello world"), (2, ""), (3, "")}
    assert {(r.doc_id, r.ids, r.n_tokens) for r in T.count_tokens(df, "ids").collect()} == {(1, "x", len(ids)), (2, "y", 0), (3, "z", 0)}
    assert {(r.doc_id, r.n_ids, r.same) for r in T.round_trip(df).collect()} == {(1, len(ids), True), (2, 0, True), (3, 0, True)}
    assert T.encode_documents(df.where("false")).count() == 0
