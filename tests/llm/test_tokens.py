import base64
import hashlib
import random
import shutil
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from collisions import thue_morse
from tidemark.llm import bpe, packing, token_files
from tidemark.llm.support import new_folder, text_bytes
from tidemark.llm.tokens import PieceEncoder, piece_encoder, pretoken_starts

RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
BITS = [*"abst ,.''''sdmlrev 12\n\t  é中!\x85 ", "'s", "'re", " '", "ll", "  \n"]


def texts(n, longest=60, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randrange(longest))) for _ in range(n)]


SCHEMA = "doc_id long, text string, ids string, row long"


def frame(spark, some):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in some], SCHEMA)


def encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def hf():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


def test_pretokens_are_the_pattern():
    some = texts(3000)
    data, offsets = text_bytes(pa.array(some))
    start, first = pretoken_starts(data, offsets)
    raw, find = data.tobytes(), regex.compile(P.PATTERN).findall
    for i, t in enumerate(some):
        at = [*start[first[i] : first[i + 1]].tolist(), int(offsets[i + 1])]
        assert [raw[a:b].decode() for a, b in zip(at, at[1:])] == find(t)


@pytest.mark.parametrize("n", [1024, 2048, 65_536, 70_000])
def test_words_that_polynomial_hashes_confuse(spark, n):
    one, two = thue_morse(n)
    some, model = [one, two, f"{two} {one}"], hf()
    ids, sizes = PieceEncoder(JSON).encode(*text_bytes(pa.array(some)))
    want = [model.encode(t, add_special_tokens=False).ids for t in some]
    assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(x) for x in want]
    if n == 1024:
        docs = frame(spark, list(enumerate(some)))
        folder = new_folder(spark, "t")
        token_files.write(docs, folder, JSON, end_id=2)
        got = {x.doc_id: np.frombuffer(x.ids, "<u4").tolist() for x in token_files.read(spark, folder).collect()}
        assert got == {i: [*x, 2] for i, x in enumerate(want)}
        pieces = {x.doc_id: x.ids_crc32 for x in packing.cut_documents(docs, JSON, 0, 2048).collect()}
        assert pieces == {i: zlib.crc32(np.array([*x, 0], "<u4").tobytes()) for i, x in enumerate(want)}


@pytest.mark.parametrize("block", [1, 7, 50])
def test_long_texts_are_encoded_in_parts(block):
    encoder, model = PieceEncoder(JSON, block=block), hf()
    for t in [*texts(300, 200, seed=8), "a" * 500, " " * 500, "é" * 300, "ab cd " * 50]:
        ids, sizes = encoder.encode(*text_bytes(pa.array([t])))
        want = model.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want and sizes.tolist() == [len(want)]


def test_piece_encoder_forgets_and_agrees():
    some, model = texts(500), hf()
    encoder = PieceEncoder(JSON, keep=20)
    for _ in range(2):
        ids, n = encoder.encode(*text_bytes(pa.array(some)))
        want = [x.ids for x in model.encode_batch(some, add_special_tokens=False)]
        assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (200, 20), (32768, 1024)])
def test_chunked_encoding_is_whole_encoding(spark, chunk, overlap):
    some = [*texts(60, 900), "", None, "a" * 500, " " * 400 + "b", "x'" * 300, "word " * 100]
    rows = list(enumerate(some)) + [(3, some[3])]
    got = sorted(map(tuple, bpe.digest(bpe.encode_whole(frame(spark, rows), RANKS, P.PATTERN, chunk=chunk, overlap=overlap), RANKS).collect()))
    e, want = encoding(), []
    for i, t in rows:
        ids = e.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_blocks_round_trip():
    r = np.random.default_rng(1)
    for ids in (np.zeros(0), np.array([7]), np.full(300, 5), r.integers(0, 50257, 1000), np.where(r.random(5000) < 0.03, 2**32 - 1, r.integers(0, 9, 5000))):
        ids = ids.astype(np.uint32)
        assert (token_files.unpack_blocks(token_files.pack_blocks(ids), len(ids)) == ids).all()


def test_files_hold_ids_in_order(spark):
    rows = [(i * 7 % 101, t) for i, t in enumerate([*texts(100, 200), None])]
    folder = new_folder(spark, "t")
    token_files.write(frame(spark, rows), folder, JSON, 2, segment_ids=300)
    got = [tuple(x) for x in token_files.read(spark, folder).orderBy("doc_id").collect()]
    model, at, want = hf(), 0, []
    for i, t in sorted(rows):
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want.append((i, at, len(ids) // 4, zlib.crc32(ids), bytearray(ids)))
        at += len(ids) // 4
    assert got == want


def test_files_of_no_documents(spark):
    folder = new_folder(spark, "t")
    token_files.write(frame(spark, []), folder, JSON, 2)
    assert token_files.read(spark, folder).count() == 0


def least_bins(items, capacity):
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in {x: k for k, x in enumerate(rooms)}.items():
            if r[0] >= items[i]:
                rooms[r[1]] -= items[i]
                go(i + 1, rooms)
                rooms[r[1]] += items[i]
        go(i + 1, [*rooms, capacity - items[i]])

    items.sort(reverse=True)
    go(0, [])
    return best[0]


def test_reduction_loses_no_optimum():
    r, triples = random.Random(2), 0
    for _ in range(1500):
        capacity = r.choice([10, 17, 31])
        items = [r.randrange(1 + capacity // 5, capacity + 1) if r.random() < 0.8 else r.randrange(1, capacity) for _ in range(r.randrange(1, 10))]
        counts = [items.count(x) for x in range(capacity + 1)]
        fixed = packing.reduce_instance(counts, capacity)
        triples += sum(len(held) == 3 for _, held in fixed)
        left = [x for x in range(capacity + 1) for _ in range(counts[x])]
        assert all(sum(held) <= capacity for _, held in fixed)
        assert sum(n for n, _ in fixed) + (least_bins(left, capacity) if left else 0) == least_bins(items, capacity)
    assert triples > 20


def test_packing_is_gapless_and_whole(spark):
    rows = [*enumerate(texts(200, 120, 9)), (500, None), (501, ""), (502, "abc " * 90), (502, "abc " * 90)]
    pieces = packing.cut_documents(frame(spark, rows), JSON, 0, 64, ids=True)
    got = packing.pack(pieces, 64, order=("doc_id", "piece")).collect()
    model = hf()
    for i in {x for x, _ in rows} - {502}:
        mine = sorted((x.piece, x.start, bytes(x.ids), x.length) for x in got if x.doc_id == i)
        ids = np.array([*model.encode(dict(rows)[i] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert b"".join(x[2] for x in mine) == ids
        assert [x[0] for x in mine] == list(range(len(mine))) and all(x[3] == 64 for x in mine[1:])
    assert len([x for x in got if x.doc_id == 502]) % 2 == 0
    bins = {}
    for x in got:
        assert x.ids_crc32 == zlib.crc32(bytes(x.ids)) and len(x.ids) == 4 * x.length
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    total = sum(x.length for x in got)
    assert len(bins) <= -(-total // 64) + 2


def test_packing_nothing(spark):
    pieces = packing.cut_documents(frame(spark, []), JSON, 0, 64)
    assert packing.pack(pieces, 64).count() == 0


def test_workers_give_the_store_back(spark, tmp_path):
    """Python workers outlive a stage, and what they keep counts against the stages behind it."""
    path = shutil.copy(JSON, tmp_path)
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(400)], "doc_id long, text string").repartition(8)
    assert packing.cut_documents(docs, path, end_id=0, capacity=2048).count() == 400

    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(piece_encoder(path).place)], pa.int64())})

    assert {x.n for x in spark.range(0, 32, 1, 32).mapInArrow(kept, "n long").collect()} == {0}
