import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from hyperslice.llm import byte_bpe, token_counts

from .conftest import TEXTS


def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def fuzz(n, seed=5):
    r = random.Random(seed)
    parts = list("aé'sdtmlvr  \n\t1٣.!<|>\u00a0\u2003漢🙂\x1c\x85'") + ["'s", "'ll", "'ve", "  ", "<|endoftext|>"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(n)]


def test_encoding_equals_the_library():
    texts = [t or "" for t in TEXTS] + fuzz(3000)
    codec, library = byte_bpe.Codec(), reference()
    ids, offsets = codec.encode(texts)
    for t, i, o in zip(texts, ids, offsets, strict=True):
        assert np.frombuffer(i, "<u4").tolist() == library.encode_ordinary(t)
        assert o[0] == 0 and (np.diff(o) > 0).all() and o[-1] == len(t.encode())
    assert codec.decode(ids, [int(o[-1]) for o in offsets]) == codec.decode(ids, [None] * len(ids)) == [t.encode() for t in texts]
    for wrong in ([1], [50_000_000]):
        with pytest.raises(ValueError):
            codec.decode([np.array(wrong, "<u4").tobytes()], [7])


def test_every_character_class_equals_the_library():
    """All code points, white space too, each between letters, numbers, blanks and marks."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}a 1{c}1 {c} .{c}.{c}" for c in points[i : i + 256]) for i in range(0, len(points), 256)]
    codec, library = byte_bpe.Codec(), reference()
    for i in range(0, len(texts), 64):
        ids, _ = codec.encode(texts[i : i + 64])
        assert all(np.frombuffer(x, "<u4").tolist() == library.encode_ordinary(t) for t, x in zip(texts[i : i + 64], ids, strict=True))


def test_round_trip_of_awkward_rows(spark, awkward, nothing):
    library = reference()
    found = byte_bpe.round_trip(awkward, ["doc_id", "key"]).collect()
    assert len(found) == awkward.count() and {r.key for r in found} == {"k"}
    expected = sorted(hashlib.sha256(np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes()).hexdigest() for r in awkward.collect())
    assert sorted(r.ids_sha256 for r in found) == expected
    assert sorted(r.decoded_sha256 for r in found) == sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in awkward.collect())
    assert byte_bpe.round_trip(nothing, ["doc_id"]).count() == 0


def test_encode_and_decode_operators(spark, awkward):
    encoded = byte_bpe.encode(awkward, ["doc_id"])
    texts = sorted((r.text or "").encode() for r in awkward.collect())
    assert sorted(bytes(r.decoded) for r in byte_bpe.decode(encoded, ["doc_id"]).collect()) == texts
    assert sorted(bytes(r.decoded) for r in byte_bpe.decode(encoded, ["doc_id"], offsets=None).collect()) == texts
    bare = encoded.selectExpr("doc_id", "cast(null AS array<bigint>) AS ids", "offsets")
    assert {bytes(r.decoded) for r in byte_bpe.decode(bare, ["doc_id"]).collect()} == {b""}
    for call in (byte_bpe.encode, byte_bpe.round_trip, token_counts.count_tokens):
        with pytest.raises(ValueError):
            call(awkward.selectExpr("text", "doc_id AS IDS", "doc_id AS n_tokens"), ["IDS", "n_tokens"])


def test_counts_equal_the_library(spark, awkward, nothing):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t or "" for t in TEXTS] + fuzz(3000, 6)
    expected = [len(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Counter("byte_bpe_50k.json").count(texts) == expected
    by_text = dict(zip(texts, expected, strict=True))
    found = token_counts.count_tokens(awkward, ["doc_id", "text"]).collect()
    assert len(found) == awkward.count()
    assert all(r.n_tokens == by_text[r.text or ""] and r.n_bytes == len((r.text or "").encode()) for r in found)
    assert token_counts.count_tokens(nothing, ["doc_id"]).count() == 0


def test_batches_hold_all_texts_in_order():
    texts = ["a" * n for n in (5, 90, 3, 3, 200, 1)]
    parts = list(token_counts.by_bytes(texts, 100))
    assert sum(parts, []) == texts and all(sum(map(len, p)) <= 100 or len(p) == 1 for p in parts)
    assert list(token_counts.by_bytes(["漢" * 20, "漢" * 20, "a" * 40], 100)) == [["漢" * 20], ["漢" * 20, "a" * 40]]
