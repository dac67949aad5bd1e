import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import awkward, crowded, frame, plain
from tokenizers import Tokenizer

from lodestone.llm import bpe, id_files
from lodestone.session import scratch_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.merges.ranks, special_tokens={}
    )


def test_replay_equals_the_library(coder, reference):
    rng = np.random.default_rng(5)
    letters = [chr(c) for c in [*range(0x250), 0x85, 0xA0, 0x2028, 0x3000, 0x4E2D, 0x1F600, 0x301, 0x661]]
    texts = ["".join(rng.choice(letters, rng.integers(60))) for _ in range(1500)]
    texts += ["a" * k for k in range(80)] + ["aab" * k for k in range(40)] + [" " * k + "x" for k in range(30)]
    ids, bounds = coder.encode(texts)
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == reference.encode_ordinary(text)


def test_single_pieces_equal_the_replay(coder):
    pieces = [b"strengthening", b"aaaaaaa", "größer".encode(), b"\x00\xff\xfe", b"q"]
    ids, counts = coder.merges.replay(pieces)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for piece, part in zip(pieces, parts):
        own = coder.merges.ranks.get(piece)
        assert part.tolist() == ([own] if own is not None else coder.merges.one(piece))


def test_replay_falls_back_where_a_lower_rank_arises():
    ranks = {bytes([b]): 1000 + b for b in range(256)}
    # "abc" ranks before "bc", which only arises once "b" and "c" have merged
    ranks |= {b"abc": 1, b"bc": 5, b"bcb": 6}
    merges = bpe.Merges(ranks)
    for piece in (b"abcabcx", b"abcbcx", b"bcbcabcb", b"aabcbcbcx"):
        ids, _ = merges.replay([piece])
        assert ids.tolist() == merges.one(piece)


def test_round_trip_of_awkward_rows(spark, reference):
    found = bpe.digests(bpe.round_trip(crowded(frame(spark)), RANKS, public_tokenizers.PATTERN)).collect()
    wanted = []
    for doc_id, text, *_ in awkward():
        ids = reference.encode_ordinary(text or "")
        joined = ",".join(map(str, ids)).encode()
        plain_text = (text or "").encode()
        wanted.append((doc_id, len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(plain_text).hexdigest()))
    assert plain(found) == plain(wanted)
    two = bpe.decode(bpe.encode(frame(spark), RANKS, public_tokenizers.PATTERN), RANKS)
    assert plain(bpe.digests(two).collect()) == plain(wanted)
    assert bpe.round_trip(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_pack_and_unpack():
    rng = np.random.default_rng(1)
    for size in (0, 1, 3, 4, 1001):
        values = (rng.integers(0, 2**32, size, dtype=np.uint64) >> rng.integers(0, 32, size, dtype=np.uint64)).astype(np.uint32)
        control, data = id_files.pack(values)
        assert len(control) == -(-size // 4)
        assert id_files.unpack(control, data, size).tolist() == values.tolist()


def test_words_equal_the_library():
    library = Tokenizer.from_file(WORDS)
    coder = id_files.WordCoder(WORDS)
    texts = [t for _, t, *_ in awkward() if t and len(t) < 10_000]
    texts += [f"ab{chr(c)}cd {chr(c)}Ef{chr(c)}́ x" for c in [*range(1, 0x300), 0x1680, 0x2003, 0x202F, 0x3000, 0x200B]]
    texts += [w + p for w in ("Straße", "ÉCOLE", "Œuvre", "µm") for p in ("", ".", "...", "!?", "'s", "—", "a1")]
    texts += ["a <|endoftext|> b", "A<|ENDOFTEXT|>b", "x<|startoftext|><|endoftext|>y z", "<|endoftext|", "q\u3000<|endoftext|>.", "<|endoftext|>"]
    ids, bounds = coder.encode(texts)
    for k, found in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == found.ids


def test_files_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(id_files, "BLOCK_IDS", 50)
    library = Tokenizer.from_file(WORDS)
    found = id_files.write_texts(crowded(frame(spark)), WORDS, 1, scratch_path(spark, "files")).collect()
    rows = sorted(((d, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for d, t, *_ in awkward()), key=lambda r: (r[0] is not None, r[0] or 0))
    start, wanted = 0, []
    for doc_id, ids in rows:
        wanted.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert plain((r.doc_id, r.start, len(r.ids) // 4, zlib.crc32(r.ids)) for r in found) == plain(wanted)
    assert id_files.write_texts(frame(spark, []), WORDS, 1, scratch_path(spark, "files")).count() == 0
