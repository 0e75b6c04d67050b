from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
import tiktoken
from tokenizers import Tokenizer

from groundwell.llm import op2_tokens as op2
from groundwell.llm import op5_bpe as op5
from groundwell.llm import textkit as K
from groundwell.llm.storage import fresh_path

JSON = public_tokenizers.path(op2.TOKENIZER_FILE)
RANKS = public_tokenizers.path(op5.RANKS_FILE)
ALPHABET = ["'", "'s", "'ll", "l", "re", "v", "e", " ", "  ", "\n", "\t", "1", "22", "é", "漢字", "😀", "-", "==", " ", " ", "A", "don't", "'t", "ß", "٣", "́", "\x1c", "\x85", "\r\n", "<|endoftext|>"]


def fuzz(n: int) -> list[str]:
    rng = random.Random(1)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", "a", "'", " ", "a" * 3000, "漢" * 2000, " " * 5000, "aAbB" * 400]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def block_ids(coder, texts: list[str]) -> list[list[int]]:
    out = []
    data, offs = K.text_bytes(pa.array(texts))
    for a, b in K.doc_blocks(offs, 50_000):
        ids, first, _, _ = coder.block(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        out.extend(ids[first[k] : first[k + 1]].tolist() for k in range(b - a))
    return out


def document_ids(texts: list[str]) -> list[list[int]]:
    out = []
    data, offs = K.text_bytes(pa.array(texts))
    for a, b in K.doc_blocks(offs, 50_000):
        ids, first = op2.coder(JSON).documents(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        out.extend(ids[first[k] : first[k + 1]].tolist() for k in range(b - a))
    return out


def test_ids_are_the_libraries_ids_on_awkward_texts(library, reference):
    texts = fuzz(4000)
    assert block_ids(op5.coder(RANKS), texts) == [reference.encode_ordinary(t) for t in texts]
    assert document_ids(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert document_ids(["a<|endoftext|>b"]) == [[64, 50256, 65]]


def test_merging_side_by_side_is_merging_one_by_one():
    rng = random.Random(2)
    pieces = list({bytes(rng.choice(b"abcdeiou ") for _ in range(rng.randint(1, 40))) for _ in range(500)} | {b"a" * 300, b"ab" * 200})
    ranks = op5.ranks(RANKS)
    assert [list(x) for x in ranks.many(pieces)] == [[ranks.rank[p]] if p in ranks.rank else ranks.one(p) for p in pieces]


def test_encode_decode_and_offsets(docs, texts, reference):
    encoded = op5.encode(docs, RANKS).cache()
    for r in encoded.collect():
        text = texts[r.doc_id] or ""
        assert r.ids == reference.encode_ordinary(text)
        raw = text.encode()
        cuts = [*r.piece_offsets, len(raw)]
        firsts = [*r.piece_tokens, len(r.ids)]
        for k in range(len(r.piece_offsets)):  # any piece decodes by itself
            assert op5.decode_ids(r.ids[firsts[k] : firsts[k + 1]], RANKS) == raw[cuts[k] : cuts[k + 1]]
    assert {r.doc_id: bytes(r.text).decode() for r in op5.decode(encoded, RANKS).collect()} == {d: t or "" for d, t in texts.items()}


def expected(texts: dict, library) -> dict:
    out, start = {}, 0
    for d in sorted(texts):
        ids = np.array([*library.encode(texts[d] or "", add_special_tokens=False).ids, 0], "<u4")
        out[d] = (start, ids.tobytes())
        start += len(ids)
    return out


@pytest.mark.parametrize("frame", [64, op2.FRAME_BYTES])
def test_files_round_trip_and_single_documents(spark, docs, texts, library, frame, monkeypatch):
    monkeypatch.setattr(op2, "FRAME_BYTES", frame)
    folder = fresh_path(spark, "test-tokens")
    files = op2.write_token_files(docs, folder, JSON)
    want = expected(texts, library)
    assert {r.doc_id: (r.start, bytes(r.ids)) for r in op2.read_token_files(spark, folder, files).collect()} == want
    some = [3, 7, 50, 10_000]
    assert {r.doc_id: (r.start, bytes(r.ids)) for r in op2.read_token_files(spark, folder, files, some).collect()} == {d: want[d] for d in some if d in want}


def test_damage_is_found_and_only_wanted_frames_are_read(spark, docs):
    folder = fresh_path(spark, "test-tokens")
    files = op2.write_token_files(docs.coalesce(1), folder, JSON)
    fs, path = pafs.FileSystem.from_uri(folder)
    name = f"{path}/{files[0]['file']}"
    with fs.open_input_file(name) as file:
        raw = bytearray(file.read())

    class Spy:
        def __init__(self, data: bytes) -> None:
            self.data, self.at, self.got = data, 0, 0

        def seek(self, at: int) -> None:
            self.at = at

        def read(self, n: int) -> bytes:
            self.got += n
            return bytes(self.data[self.at : self.at + n])

    reader = op2.FrameReader(Spy(raw), len(raw))
    one = int(reader.entries["doc_id"][0])
    assert [len(e) for e, _ in reader.documents(np.array([one]))] == [1]
    raw[10] ^= 0xFF
    with pytest.raises(Exception):
        list(op2.FrameReader(Spy(raw), len(raw)).documents())


def test_odd_ids_and_empty_tables(spark, odd_docs, no_docs):
    folder = fresh_path(spark, "test-tokens")
    files = op2.write_token_files(odd_docs, folder, JSON)
    assert sorted(r.doc_id for r in op2.read_token_files(spark, folder, files).collect()) == [1, 1, 2, 3, 3]
    files = op2.write_token_files(odd_docs, fresh_path(spark, "test-tokens"), JSON, file_bytes=64)
    assert len(files) > 1 and [f["start"] for f in files] == sorted(f["start"] for f in files)
    assert op2.write_token_files(no_docs, fresh_path(spark, "test-tokens"), JSON) == []
    assert sorted(r.doc_id for r in op5.encode(odd_docs, RANKS).collect()) == [1, 1, 2, 3, 3]
    assert op5.encode(no_docs, RANKS).count() == 0


def test_queries(spark, sf, library, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {d: (s, len(ids) // 4, zlib.crc32(ids)) for d, (s, ids) in expected(texts, library).items()}
    assert {r[0]: tuple(r[1:4]) for r in op2.query(spark, sf).collect()} == want
    ids = {d: np.array(reference.encode_ordinary(t or ""), "<u4") for d, t in texts.items()}
    want = {d: (len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256((texts[d] or "").encode()).hexdigest()) for d, x in ids.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op5.query(spark, sf).collect()} == want


def test_repeated_ids_have_one_order(spark, library):
    rows = [(5, f"text {k} " * 3) for k in range(40)] + [(k, f"<|endoftext|> {k}") for k in range(10)]
    found = []
    for n in (1, 7):
        folder = fresh_path(spark, "test-tokens")
        files = op2.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), folder, JSON)
        found.append(sorted((r.start, r.doc_id, bytes(r.ids)) for r in op2.read_token_files(spark, folder, files).collect()))
    assert found[0] == found[1]
    assert [d for _, d, _ in found[0]] == sorted(d for d, _ in rows)
    assert sorted(x for _, _, x in found[0]) == sorted(np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for _, t in rows)
