"""Ogg, pieces and token counts against the libraries, brute force and edge rows."""

import hashlib
import zlib

import pytest

from skeinlake.llm import ogg, pieces, token_counts
from skeinlake.llm.common import read_table, table_path

EDGE = [(1_000_001, None), (1_000_002, ""), (1_000_003, " "), (1_000_004, "a  b "), (1_000_005, "  lead\n\n tail  "), (1_000_006, "▁mark ▁▁x"), (1_000_007, "<|endoftext|>a<|endoftext|><|endoftext|>"), (1_000_008, "é日本𝄞‍\x01"), (1_000_009, "don't <s> <unk> <0x0A>"), (1_000_009, "don't <s> <unk> <0x0A>"), (None, "tie"), (1_000_010, "x" * 70_000), (1_000_011, "w ord " * 20_000), (1_000_012, " nb　 sp ")]


@pytest.fixture(scope="session")
def corpus(spark, sf_dir, docs_of):
    return read_table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(docs_of(EDGE).select("doc_id", "text"))


def test_token_counts_match_library(corpus, docs_of):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(table_path("byte_bpe_50k.json"))
    rows = [(r.doc_id, r.text or "") for r in corpus.collect()]
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(corpus).collect())
    want = sorted((i if i is not None else -1, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 512) for i, t in rows)
    assert got == want
    assert token_counts.token_counts(docs_of([])).count() == 0


def test_pieces_match_library(corpus, docs_of):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=table_path("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in corpus.collect():
        ids = library.encode(r.text or "")
        want.append((r.doc_id if r.doc_id is not None else -1, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    got = [(r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(corpus).collect()]
    assert sorted(got) == sorted(want)
    assert pieces.digests(docs_of([])).count() == 0
    back = pieces.decode(pieces.encode(docs_of([(1, "Ein Satz."), (2, None)])))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == [(1, "Ein Satz."), (2, "")]


def slow_crc(data: bytes) -> int:
    out = 0
    for byte in data:
        out ^= byte << 24
        for _ in range(8):
            out = (out << 1 ^ 0x04C11DB7 if out & 0x80000000 else out << 1) & 0xFFFFFFFF
    return out


def test_ogg_round_trip_and_damage(corpus, docs_of):
    assert ogg.checksum(b"OggS and more") == slow_crc(b"OggS and more")
    rows = {r.doc_id: r for r in ogg.features(ogg.store_texts(corpus)).collect()}
    for r in corpus.collect():
        payload, x = ogg.padded((r.text or "").encode()), rows[r.doc_id]
        assert len(payload) % 64 == 0 and payload
        assert (x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert x.damaged_pages == 0 and "agrees=1" in x.feature and abs(x.seconds - len(payload) / 8000) < 1e-9
    media = ogg.store(bytes(range(256)) * 400)
    streams, damaged = ogg.demultiplex(media)
    assert damaged == 0 and [s.codec for s in streams.values()] == ["pcm8", "note"] and all(s.closed for s in streams.values())
    second = media.find(b"OggS", len(media) // 2)
    broken = media[:second] + b"XggS" + media[second + 4 :]
    streams, damaged = ogg.demultiplex(broken)
    sound = next(iter(streams.values()))
    assert damaged == 1 and sound.lost <= 1 and 0 < sum(map(len, sound.packets[1:])) < 256 * 400
    assert ogg.demultiplex(b"") == ({}, 0) and ogg.demultiplex(b"junk")[1] == 1
    long = [(b"h", 0), (b"z" * 255, 255), (b"", 255), (b"q" * 150_000, 150_255)]
    streams, _ = ogg.demultiplex(b"".join(ogg.paginate(5, long, per_page=1)))
    assert streams[5].packets == [p for p, _ in long] and streams[5].lost == 0
    out = ogg.streams(docs_of([(1, "x")]).selectExpr("doc_id", "cast(null as binary) media"))
    assert out.count() == 0
