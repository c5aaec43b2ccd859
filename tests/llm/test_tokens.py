"""Operators 2, 3 and 9 against the tokenizer libraries."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rallyline.llm import bpe, counts, packing, queries

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_round_trip_of_odd_texts(table_of, odd, library):
    found = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(table_of(odd)).collect())
    wanted = []
    for doc_id, text in odd:
        ids = ids_of(library, text)
        wanted.append((doc_id or 0, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert found == sorted(wanted)


def test_encode_and_decode(table_of, odd, library):
    encoded = bpe.encode(table_of(odd))
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in encoded.collect()) == sorted((i or 0, ids_of(library, t)) for i, t in odd)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in bpe.decode(encoded).collect()) == sorted((i or 0, t or "") for i, t in odd)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    library, pieces = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert np.frombuffer(bpe.byte_bpe(BYTES).encode([text])[0], "<u4").tolist() == ids_of(library, text)
    assert counts.piece_counter(PIECES).count([text]) == [len(pieces.encode(text))]


def test_invalid_bytes_decode_as_the_library_does(library):
    own = bpe.byte_bpe(BYTES)
    for ids in ([165], [165, 50256, 254], [*range(0, 256)], [10253, 165, 10253]):
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_both_tree_forms_agree(words):
    own = bpe.ByteBPE(BYTES)
    for word in [w.encode() for w in words[:300]]:
        assert own._merge_rows([word], 64)[0] == own._merge_one(word, 64)


def test_token_counts(table_of, odd, pieces):
    found = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in counts.token_counts(table_of(odd)).collect())
    wanted = []
    for doc_id, text in odd:
        n = len(pieces.encode(text or ""))
        wanted.append((doc_id or 0, len((text or "").encode()), n, n > 4096))
    assert found == sorted(wanted)


def check_packed(rows, texts, library):
    """Each id in one piece, sequences gapless and full, checksums right; texts by doc_id."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        ids, at = np.array([*ids_of(library, texts[doc_id]), 1], "<u4"), 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0


def test_packing(table_of, odd, library, words):
    rows = [(i, t) for i, t in odd if i is not None and i != 4] + [(100 + i, " ".join(words[i : i + 7 * (i % 40)])) for i in range(200)]
    check_packed(packing.pack(table_of(rows)).collect(), dict(rows), library)


def test_packing_of_repeated_rows_and_null_ids(table_of):
    found = packing.pack(table_of([(1, "a b"), (1, "a b"), (None, None)])).collect()
    assert sum(r["length"] for r in found) == 3 + 3 + 1


def packed(sizes, tiers=packing.Tiers()):
    packer = packing.Packer(tiers, 0)
    for doc_id, n in enumerate(sizes):
        packer.add(doc_id, bytes(4 * int(n)))
    packer.finish()
    return packer.out


def test_long_windows_take_shorter_pieces():
    rows = packed((7, 3, 2, 4), packing.Tiers(lengths=(4, 8), step_tokens=16))
    assert sorted(sum(r[2] for r in rows if r[5] == s) for s in {r[5] for r in rows}) == [8, 8]
    assert rows[0][0] == 0 and sorted(r[2] for r in rows if r[5] == rows[0][5]) in ([1, 7], [2, 6])


def test_a_gap_is_filled_by_pieces_of_just_its_length():
    free = np.zeros(101, np.int64)
    free[[10, 20, 30, 40]] = 1
    assert sorted(packing.fitting(70, free)) == [30, 40] and free.sum() == 2
    assert packing.fitting(15, free) is None and free.sum() == 2
    assert sorted(packing.fitting(30, free)) == [10, 20] and free.sum() == 0


@pytest.mark.parametrize("skew", [4.0, 5.0, 6.0])
def test_every_tier_is_packed_and_documents_that_fit_stay_whole(skew):
    """Of lognormal lengths each tier keeps a third of its own tokens or more, and hardly a document that fits a window
    is cut."""
    sizes = np.clip(np.random.default_rng(3).lognormal(skew, 1.2, 20_000).astype(int), 1, 30_000)
    rows = packed(sizes)
    tokens, times = Counter(), Counter(r[0] for r in rows)
    for r in rows:
        tokens[r[7]] += r[2]
    assert sum(tokens.values()) == sizes.sum()
    for tier, least, most in ((256, 1, 128), (512, 129, 256), (1024, 257, 512), (2048, 513, 30_000)):
        assert tokens[tier] > sizes[(sizes >= least) & (sizes <= most)].sum() / 3
    assert sum(n for t, n in tokens.items() if t < 256) < 256
    assert np.mean([times[i] > 1 for i in np.flatnonzero(sizes <= 2048)]) < 0.005


def test_a_long_document_leaves_only_its_end_in_memory():
    packer = packing.Packer(packing.Tiers(), 0)
    for doc_id in range(50):
        packer.add(doc_id, bytes(4 * (2048 * 100 + 10)))
    held = [p for lot in (*packer.pool.whole, *packer.pool.cut) for p in lot]
    assert len(held) == 50 and all(len(p.ids) == 40 for p in held)


def test_step_groups_hold_the_same_tokens_over_all_tasks(table_of, words):
    rows = [(i, " ".join(words[i : i + 1 + i % 90])) for i in range(900)]
    found = packing.pack(table_of(rows, 5), tiers=packing.Tiers((32, 64, 128), 1024)).collect()
    assert len({r["sequence_id"] >> 32 for r in found}) == 5
    tokens, lengths = Counter(), defaultdict(set)
    for r in found:
        tokens[r["step_group"]] += r["length"]
        lengths[r["step_group"]].add(r["tier"])
    assert sorted(tokens) == list(range(len(tokens)))
    assert all(tokens[g] == 1024 for g in range(len(tokens) - 1))
    assert sum(len(t) > 1 for t in lengths.values()) <= 8
    by_sequence = defaultdict(set)
    for r in found:
        by_sequence[r["sequence_id"]].add(r["step_group"])
    assert all(len(g) == 1 for g in by_sequence.values())


def test_empty_tables(table_of):
    none = table_of([])
    assert [f(none).count() for f in (bpe.round_trip, bpe.encode, counts.token_counts, packing.pack)] == [0] * 4


def test_queries(spark, sf_dir, library, pieces):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = {r["doc_id"]: r for r in queries.op2_bpe_round_trip(spark, sf_dir).collect()}
    for i, r in found.items():
        ids = ids_of(library, docs[i])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(docs[i]))
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op3_token_counts(spark, sf_dir).collect()} == {i: len(pieces.encode(t)) for i, t in docs.items()}
    check_packed(queries.op9_packing(spark, sf_dir).collect(), docs, library)
