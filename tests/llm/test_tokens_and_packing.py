"""Byte-level BPE, token files and packing against the libraries themselves."""

import base64
import hashlib
import io
import os
import subprocess
import sys
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")

from packlake.llm import common, packing, token_files, tokens  # noqa: E402

JSON, RANKS = tokens.tokenizer_path("byte_bpe_50k.json"), tokens.tokenizer_path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "a", "  two  spaces ", "Don't stop, it's they'll 123 4,5!", "tab\t x\r\n y\n\nz", "naïve Straße ñandú 日本語 🙂🙂 á", "x" * 5000, "the of and " * 2000, "  edge　 x", "ends with space ", "<|endoftext|> x", "hello <|endoftext|> world", "a<|endoftext|>b <|endoftext|", "<|endoftext|>",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaa bbbbbbbbb", "\x01mark", "ﬁ ① ² Ⅷ x_y", "the of and " * 2000,
]
SCHEMA = "doc_id long, text string, n_tokens string, ids string"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], SCHEMA)


def reference():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_encoding_equals_the_ranks(spark):
    e = reference()
    got = {r["doc_id"]: r for r in tokens.round_trip(frame(spark), RANKS).collect()}
    for i, t in enumerate(TEXTS):
        ids = e.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(
    st.lists(
        st.lists(
            st.one_of(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>"]), st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,aesltT1é日 　"), st.characters(exclude_categories=["Cs"])), max_size=30)), max_size=4
        ).map("".join),
        min_size=1,
        max_size=4,
    )
)
def test_pieces_give_the_ids_of_whole_texts(texts):
    lib, bpe, ranks, e = library(), tokens.load(JSON), tokens.load(RANKS), reference()
    for t, got, other in zip(texts, bpe.encode_batch(pa.array(texts)), ranks.encode_batch(pa.array(texts))):
        assert got.tolist() == lib(t)
        assert other.tolist() == e.encode_ordinary(t)


def test_cache_turns_over(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN", 50)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 200)
    bpe, lib = tokens.Bpe(JSON), library()
    texts = [f"word{i} other{i % 7} and, {'so' * (i % 5)} on" for i in range(300)]
    assert [x.tolist() for x in bpe.encode_batch(pa.array(texts))] == [lib(t) for t in texts]


def test_pieces_in_use_stay_known(monkeypatch):
    """Each second slice has the same words; between them come enough others for the cache to turn over."""
    monkeypatch.setattr(tokens, "KNOWN", 200)
    bpe, lib, sent = tokens.Bpe(JSON), library(), []
    learn = bpe._ids
    monkeypatch.setattr(bpe, "_ids", lambda texts: sent.extend(texts) or learn(texts))
    common_words = " ".join(f"often{i}" for i in range(50))
    for k in range(20):
        for text in (f"a {common_words}", f"a {' '.join(f'once{k}x{i}' for i in range(60))}"):
            assert next(bpe.encode_batch(pa.array([text]))).tolist() == lib(text)
    assert sum(t.split().count("often7") for t in sent) == 1 and len(bpe.known) <= 200


def test_lookup_costs_by_what_is_looked_up():
    def seconds(bpe):
        took = []
        for _ in range(20):
            start = time.process_time()
            next(bpe.encode_batch(pa.array(["word1 word2, word3"])))
            took.append(time.process_time() - start)
        return min(took)

    few, many = tokens.Bpe(JSON), tokens.Bpe(JSON)
    for _ in many.encode_batch(pa.array([" ".join(f"word{i}" for i in range(k, k + 10_000)) for k in range(0, 300_000, 10_000)])):
        pass
    assert seconds(many) < 10 * max(seconds(few), 0.0005)


def test_pieces_of_equal_hashes(monkeypatch):
    lib, texts = library(), [t or "" for t in TEXTS] * 2
    for same in (lambda pieces: np.full(len(pieces), 7, np.uint64), lambda pieces: np.arange(len(pieces), dtype=np.uint64) % 3):
        with monkeypatch.context() as m:
            m.setattr(tokens, "hashes_of", same)
            bpe = tokens.Bpe(JSON)
            for _ in range(2):
                assert [x.tolist() for x in bpe.encode_batch(pa.array(texts))] == [lib(t) for t in texts]


def test_hashes_follow_the_strings():
    rng = np.random.default_rng(2)
    texts = ["", "a", "\0", "a\0", "\0" * 8, "\0" * 9, *("".join(map(chr, rng.integers(32, 400, n))) for n in range(1, 200)), "x" * 70, "x" * 71]
    whole = tokens.hashes_of(pa.array(texts, pa.large_string()))
    assert len(set(whole.tolist())) == len(texts)
    part = pa.array(["before", *texts, "after"], pa.large_string()).slice(1, len(texts))
    assert (tokens.hashes_of(part) == whole).all() and not len(tokens.hashes_of(part.slice(0, 0)))


HELD = """
import re
import numpy as np, pyarrow as pa
from packlake.llm import tokens

held = lambda name: int(re.search(name + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10
bpe = tokens.load(tokens.tokenizer_path("byte_bpe_50k.json"))
letters = np.random.default_rng(5).integers(97, 123, 9 << 20, np.uint8)
letters[7::8] = 32
data = letters.tobytes().decode()
texts = pa.array([data[i : i + 4999] for i in range(0, len(data), 5000)])
before = held("VmRSS")
for _ in bpe.encode_batch(texts):
    pass
print(held("VmHWM") - before, held("VmRSS") - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/status"), reason="needs /proc")
def test_memory_of_encoding_is_bounded():
    """A million pieces that all are new: an executor holds a worker for each core."""
    run = subprocess.run([sys.executable, "-c", HELD], cwd=ROOT, capture_output=True, text=True, check=True)
    most, after = map(int, run.stdout.split())
    assert most < 350 and after < 100


def test_offsets_and_split_characters(spark):
    row = {r["doc_id"]: r for r in tokens.encode(frame(spark), RANKS, offsets=True).collect()}[7]
    text, bpe = TEXTS[7], tokens.load(RANKS)
    assert all(text[a:b] in text and a <= b for a, b in zip(row["starts"], row["ends"])) and row["ends"][-1] == len(text)
    assert "".join(bpe.decode_stream(row["ids"])) == text
    decoded = {r["doc_id"]: r["bytes"] for r in tokens.decode(tokens.encode(frame(spark), RANKS), RANKS).collect()}
    assert all(bytes(decoded[i]) == (t or "").encode() for i, t in enumerate(TEXTS))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 40), max_size=3000))
def test_rans_round_trip(values):
    ids = np.array(values, "<u4")
    data = token_files.file_bytes(ids, [None, 5], np.array([0, len(ids)]))
    file = token_files.TokenFile(io.BytesIO(data))
    assert (file.read(0, len(ids)) == ids).all()
    assert [(d, n, x.tolist()) for d, n, x in file.documents()] == [(None, 0, []), (5, 0, values)]


def test_blocks_are_independent_and_checked():
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.3, 700_000).clip(0, 50_000).astype("<u4")
    data = bytearray(token_files.file_bytes(ids, [1], np.array([len(ids)])))
    file = token_files.TokenFile(io.BytesIO(bytes(data)))
    assert len(file.blocks) == 3 and (file.read(262_100, 400_000) == ids[262_100:662_100]).all()
    assert len(data) < 4 * len(ids) / 2
    data[int(file.blocks[1][0]) + 9000] ^= 1
    hurt = token_files.TokenFile(io.BytesIO(bytes(data)))
    assert (hurt.block(0) == ids[:262_144]).all()
    with pytest.raises(ValueError):
        hurt.block(1)


def test_token_files_return_every_document(spark):
    out, lib = common.shared_dir(spark, "t"), library()
    manifest = token_files.write(frame(spark), out, JSON, file_tokens=3000)
    got = {r["doc_id"]: r for r in token_files.read(spark, out, manifest).collect()}
    start = 0
    for i, t in enumerate(TEXTS):
        ids = np.array([*lib(t), 0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    fs, root = common.open_fs(out)
    from pyarrow.fs import FileSelector

    written = {i.base_name for i in fs.get_file_info(FileSelector(root))}
    assert written == {r["file"] for r in manifest.collect()}


def test_token_files_of_nulls_and_nothing(spark):
    out = common.shared_dir(spark, "t")
    docs = spark.createDataFrame([(None, "b"), (3, "x"), (3, "a"), (3, "a")], "doc_id long, text string")
    got = token_files.read(spark, out, token_files.write(docs, out, JSON)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 3, 3, 3] and [r["start"] for r in got] == [0, 2, 4, 6]
    out = common.shared_dir(spark, "t")
    assert token_files.read(spark, out, token_files.write(docs.limit(0), out, JSON)).count() == 0


def check_packing(rows, texts, capacity):
    lib, bins = library(), {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    for i, t in enumerate(texts):
        ids, at = np.array([*lib(t), 0], "<u4"), 0
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        for k, r in enumerate(own):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == capacity)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and (len(ids) > capacity or len(own) == 1)
    return len(bins)


def test_packing_on_islands(spark):
    rng = np.random.default_rng(3)
    texts = TEXTS + [" ".join(["the"] * int(n)) for n in rng.integers(1, 120, 400)]
    total = sum(len(library()(t)) + 1 for t in texts)
    rows = packing.pack_documents(frame(spark, texts), JSON, capacity=128, island=60).collect()
    n = check_packing(rows, texts, 128)
    assert -(-total // 128) <= n <= -(-total // 128) * 1.05
    rows = packing.pack_documents(frame(spark, texts), JSON, capacity=128).collect()
    assert check_packing(rows, texts, 128) <= -(-total // 128) * 1.02


def test_packing_of_nothing_and_repeats(spark):
    assert packing.pack_documents(frame(spark).limit(0), JSON).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    rows = packing.pack_documents(docs, JSON).collect()
    assert len(rows) == 3 and len({r["sequence_id"] for r in rows}) == 1 and sorted(r["offset"] for r in rows) == [0, *np.cumsum([r["length"] for r in sorted(rows, key=lambda r: r["offset"])])[:-1].tolist()]


def test_genetic_search_is_no_worse_than_best_fit():
    rng = np.random.default_rng(5)
    for low, high, n in ((200, 1500, 1500), (1, 2048, 1500), (600, 700, 300), (1025, 1026, 50)):
        lengths = rng.integers(low, high, n)
        first = packing.tidy(packing.best_fit(lengths, np.argsort(-lengths, kind="stable"), np.full(n, -1), np.zeros(0, np.int64), 2048))
        best = packing.evolve(lengths, None, [(1024, 1024), (2000, 48)], 2048, np.random.default_rng(1))
        assert np.bincount(best, lengths).max() <= 2048 and len(best) == n
        assert best.max() <= first.max()


def triplets(rng, count, capacity):
    """Lengths of which three fill a bin exactly, in a way that best-fit misses."""
    out = []
    while len(out) < 3 * count:
        a = int(rng.integers(int(0.38 * capacity), int(0.49 * capacity)))
        b = int(rng.integers(int(0.25 * capacity), (capacity - a) // 2 + 1))
        if capacity - a - b > 0.25 * capacity:
            out += [a, b, capacity - a - b]
    return rng.permutation(np.array(out))


@pytest.mark.parametrize("make", [lambda r: triplets(r, 40, 2048), lambda r: r.integers(513, 1024, 200)])
def test_crossover_beats_both_seeds(make):
    for seed in (0, 2):
        lengths, told = make(np.random.default_rng(seed)), Counter()
        n = len(lengths)
        first = packing.tidy(packing.best_fit(lengths, np.argsort(-lengths, kind="stable"), np.full(n, -1), np.zeros(0, np.int64), 2048)).max()
        second = packing.tidy(packing.exact_fill(lengths, 2048, np.random.default_rng(1))).max()
        best = packing.evolve(lengths, None, [], 2048, np.random.default_rng(1), told=told)
        assert np.bincount(best, lengths).max() <= 2048 and best.max() < min(first, second) and told["crossovers"] > 0


def test_elite_bins_migrate(spark):
    rng, schema = np.random.default_rng(4), f"{packing.STATE}"
    lengths = triplets(rng, 60, 2048).tolist()
    rows = [(i, i, 0, 0, n, 0, i % 2, None, False, None) for i, n in enumerate(lengths)]
    state = packing._epoch(spark.createDataFrame(rows, schema), 0, 0, 2, False, 2048, 7)
    moved = [(r["island"], tuple(r["pattern"])) for r in state.where("uid is null").collect()]
    assert {i for i, _ in moved} == {0, 1} and all(sum(p) == 2048 and len(p) > 1 for _, p in moved)
    own = np.array([n for i, n in enumerate(lengths) if i % 2 == 0])
    told = Counter()
    best = packing.evolve(own, None, [p for i, p in moved if i == 0] + [tuple(int(x) for x in own[:1])], 2048, rng, told=told)
    assert told["migrations"] == 1 and np.bincount(best, own).max() <= 2048
    after = packing._epoch(state, 0, 1, 2, True, 2048, 7).where("uid is not null").collect()
    assert sorted(r["uid"] for r in after) == list(range(len(lengths)))
    built = packing.settle(np.array([1000, 1048, 900, 5]), np.array([0, 1, 2, 2]), [(1048, 1000), (7, 2041)], 2048, rng)
    assert built[0] == built[1]
