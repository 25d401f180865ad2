import base64
import hashlib
import random
import struct

import public_tokenizers as public
import pytest
import tiktoken

from lorekeep.llm import bpe

PATH = public.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(open(PATH, "rb").read())
PLAIN = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def brute(piece, ranks):
    parts = [bytes([b]) for b in piece]
    if piece in ranks:
        return [ranks[piece]]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merge_with_ties_and_holes():
    rng = random.Random(4)
    ranks = {bytes([b]): b for b in range(256)}
    for _ in range(60):
        ranks.setdefault(bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))), len(ranks))
    for _ in range(400):
        piece = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 40)))
        assert bpe.merge(piece, ranks) == brute(piece, ranks)


def test_documents(spark, monkeypatch):
    rng = random.Random(5)
    texts = [None, "", " ", "\n\n  x", "it's <|endoftext|> 12345 éèü 漢字 🙂", "a" * 5000, "".join(map(chr, range(1, 1500)))]
    texts += ["".join(rng.choice("ab cé\n1!Ω'st") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    texts += [texts[-1]]
    docs = spark.createDataFrame([(i if i != 9 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    encoded = bpe.encode(docs, PATH, public.PATTERN)
    rows = bpe.digests(bpe.decode(encoded, PATH)).collect()
    want = []
    for i, t in enumerate(texts):
        ids = PLAIN.encode_ordinary(t or "")
        want.append((i if i != 9 else None, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    for least in (bpe.TASK_BYTES, 2_000):  # the second empties its memory again and again
        monkeypatch.setattr(bpe, "TASK_BYTES", least)
        again = bpe.round_trip(docs.repartition(3), PATH, public.PATTERN)
        assert sorted(map(tuple, again.drop("token_ids").collect()), key=str) == sorted(want, key=str)
        assert {(r.doc_id, hashlib.sha256(r.token_ids).hexdigest()) for r in again.collect()} == {(w[0], w[2]) for w in want}
    assert bpe.round_trip(docs.where("false"), PATH, public.PATTERN).count() == 0
    assert encoded.where("false").count() == bpe.encode(docs.where("false"), PATH, public.PATTERN).count() == 0


def test_decoding_of_nothing(spark):
    rows = spark.createDataFrame([(1, 0, None), (2, 0, bytearray())], "doc_id long, n_tokens long, token_ids binary")
    assert [r.decoded for r in bpe.decode(rows, PATH).collect()] == [b"", b""]


def test_ranks_file(tmp_path):
    assert bpe.read_ranks(base64.b64encode(b"ab") + b" 7\n\n") == {b"ab": 7}
    with pytest.raises(ValueError):
        bpe.read_ranks(b"only-one-field\n")
