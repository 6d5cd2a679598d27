"""Packing, token counts and token files against the libraries."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kickframe.llm import packing, queries, token_counts, token_files
from kickframe.llm.encoder import encoder
from tests.llm import plain
from tests.llm.conftest import SF

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
TEXT = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab  \n\t'sdlr1_é▁<|>𝄞")), max_size=60)


def check_pieces(rows, docs):
    """The pieces of each document tile its ids; sequences tile their pieces from 0, none above 1024, few padded."""
    want = {}
    for i, text in docs:
        want.setdefault(i, []).append(plain.ids_of(text, BYTES, 0))
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        assert r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 1024
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert by.keys() == want.keys()
    for i, texts in want.items():
        expected = sorted((p, n, plain.crc(ids[p : p + n]), len(ids)) for ids in texts for p, n in packing.cuts(len(ids)))
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by[i]) == expected


def test_packing_query(spark, documents):
    check_pieces(queries.op2_packing(spark, SF).collect(), documents)


def test_packing_of_odd_rows(odd, none, tmp_path):
    pieces = packing.pack(odd, public_tokenizers.path(BYTES), 0)
    check_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).collect(), odd.select("doc_id", "text").collect())
    assert packing.pack(none, public_tokenizers.path(BYTES), 0).count() == 0
    packing.write_buckets(pieces, str(tmp_path / "b"))
    assert pieces.sparkSession.read.parquet(str(tmp_path / "b")).count() == pieces.count()


@given(st.integers(1, 5000), st.integers(0, 11))
def test_cuts(n, power):
    parts = packing.cuts(n, 1 << power)
    assert [a for a, _ in parts] == list(np.cumsum([0, *(b for _, b in parts)])[:-1]) and sum(b for _, b in parts) == n
    assert all(b & (b - 1) == 0 and b <= 1 << power for _, b in parts)
    assert len(parts) == n // (1 << power) + bin(n % (1 << power)).count("1")


@settings(deadline=None, max_examples=300)
@given(TEXT)
def test_encoder_is_the_library(text):
    for name in (BYTES, WORDS):
        assert encoder(public_tokenizers.path(name)).ids(text).tolist() == plain.tokenizer(name).encode(text, add_special_tokens=False).ids


@settings(deadline=None, max_examples=300)
@given(TEXT)
def test_counter_is_the_library(text):
    assert token_counts.counter(public_tokenizers.path("piece_bpe_32k.model")).count(text) == len(plain.pieces().encode(text))


def test_special_strings():
    for text in ("a <|endoftext|> b", "<|startoftext|>x", "<s> </s> <unk>", "<0x0A> ▁▁ x", "  a  ", "\n\n a", "x\x00y", "１２ ﬁ", "á á"):
        for name in (BYTES, WORDS):
            assert encoder(public_tokenizers.path(name)).ids(text).tolist() == plain.tokenizer(name).encode(text, add_special_tokens=False).ids
        assert token_counts.counter(public_tokenizers.path("piece_bpe_32k.model")).count(text) == len(plain.pieces().encode(text))


def test_counts_query(spark, documents, same):
    same(queries.op5_token_counts(spark, SF), [plain.count_row(*d) for d in documents])


def test_counts_of_odd_rows(odd, none, same):
    model = public_tokenizers.path("piece_bpe_32k.model")
    same(token_counts.count_tokens(odd, model), [plain.count_row(*r)[:3] for r in odd.select("doc_id", "text").collect()])
    assert token_counts.count_tokens(none, model).count() == 0


def test_token_files_query(spark, documents, same):
    same(queries.op10_token_files(spark, SF), plain.token_file_rows(documents))


def test_token_files_of_odd_rows(spark, odd, none, tmp_path):
    token_files.write(odd, str(tmp_path / "f"), public_tokenizers.path(WORDS), 2, shard_ids=500)
    got = sorted((tuple(r) for r in token_files.read(spark, str(tmp_path / "f")).collect()), key=lambda r: r[1])
    want = sorted(((i, plain.ids_of(t, WORDS, 2)) for i, t in odd.select("doc_id", "text").collect()), key=repr)
    assert sorted(((i, np.frombuffer(b, "<u4").tolist()) for i, _, _, b in got), key=repr) == want
    assert [s for _, s, _, _ in got] == list(np.cumsum([0, *(n for _, _, n, _ in got)])[:-1])
    ids = [i for i, *_ in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    flat = np.concatenate([np.frombuffer(b, "<u4") for *_, b in got])
    for a, b in ((0, len(flat)), (0, 1), (len(flat) - 1, len(flat)), (400, 90_000)):
        parts = sorted((r.start, bytes(r.ids)) for r in token_files.read_range(spark, str(tmp_path / "f"), a, b).collect())
        assert np.frombuffer(b"".join(x for _, x in parts), "<u4").tolist() == flat[a:b].tolist() and parts[0][0] == a
    token_files.write(none, str(tmp_path / "g"), public_tokenizers.path(WORDS), 2)
    assert token_files.read(spark, str(tmp_path / "g")).count() == 0


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=200), min_size=1, max_size=6), st.data())
def test_grammar_round_trip(docs, data):
    shard = token_files.Shard(token_files.to_bytes([np.array(d, np.uint32) for d in docs], 7))
    flat = [x for d in docs for x in d]
    assert shard.ids(0, len(flat)).tolist() == flat and shard.counts.tolist() == [len(d) for d in docs]
    a = data.draw(st.integers(0, len(flat)))
    b = data.draw(st.integers(a, len(flat)))
    assert shard.ids(a, b).tolist() == flat[a:b]
    assert [shard.document(k).tolist() for k in range(len(docs))] == docs


@settings(deadline=None)
@given(st.lists(st.integers(0, 4), max_size=600), st.integers(1, 5), st.integers(2, 9))
def test_grammar_ends_when_no_pair_is_frequent(ids, pairs, least):
    rules, lengths, stream = token_files.compress(np.array(ids, np.uint32), 5, pairs, least)
    assert token_files.expand(stream, rules, 5).tolist() == ids
    assert [len(token_files.expand(np.array([5 + k], np.uint32), rules, 5)) for k in range(len(rules))] == lengths.tolist()
    pairs_left = list(zip(stream[:-1].tolist(), stream[1:].tolist(), strict=True))
    assert all(pairs_left.count(p) < least for p in set(pairs_left))
    assert len({tuple(r) for r in rules.tolist()}) == len(rules)


def test_grammar_of_a_period_and_of_more_rounds_than_a_few():
    period = np.tile(np.arange(70, dtype=np.uint32), 4000)
    rules, _, stream = token_files.compress(period, 70, pairs=1)
    assert len(stream) < 200 and token_files.expand(stream, rules, 70).tolist() == period.tolist()


def test_a_shard_is_read_by_itself():
    docs = [np.arange(k, dtype=np.uint32) % 5 for k in (3, 1, 5000)]
    shard = token_files.Shard(token_files.to_bytes(docs, 9, [None, -4, 7], 3, 1 << 40))
    assert (shard.names, shard.part, shard.place) == ([None, -4, 7], 3, 1 << 40)
    assert shard.ids(2000, 2003).tolist() == np.concatenate(docs)[2000:2003].tolist()


def test_grammar_makes_repetition_small_and_finds_damage():
    raw = token_files.to_bytes([np.tile(np.arange(50, dtype=np.uint32), 2000)], 100)
    assert len(raw) < 40_000
    with pytest.raises(ValueError, match="not a whole shard"):
        token_files.Shard(raw[:-9] + b"\x01" + raw[-8:])
