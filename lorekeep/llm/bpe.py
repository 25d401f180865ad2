"""Byte-level BPE: encoding by a segment tree of pair ranks, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = 1 << 62
#: Pieces that a Python worker remembers, and the longest of them in characters.
MEMORY, LONGEST = 700_000, 64
#: Bytes of the pieces that one task of ``round_trip`` remembers, and what an entry takes besides its text and ids.
TASK_BYTES, ENTRY_BYTES = 48 << 20, 160
#: Bytes of text or ids that are gathered for one output batch.
BATCH = 4 << 20


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file: on each line a token in base64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece. The tree's leaf i has the rank of the live token at byte i joined to its right
    neighbour; the smallest rank merges first, the leftmost among equals. A merge changes three leaves."""
    if piece in ranks:
        return [ranks[piece]]
    n, rank_of = len(piece), ranks.get
    size = 1 << max(0, n - 2).bit_length()
    after, before = list(range(1, n + 2)), list(range(-1, n))
    tree = [NONE] * size + [rank_of(piece[i : i + 2], NONE) for i in range(n - 1)] + [NONE] * (size - n + 1)
    for at in range(size - 1, 0, -1):
        left, right = tree[2 * at], tree[2 * at + 1]
        tree[at] = left if left <= right else right
    while (low := tree[1]) < NONE:
        at = 1
        while at < size:
            at *= 2
            if tree[at] != low:
                at += 1
        i = at - size
        gone, prior = after[i], before[i]
        end = after[i] = after[gone]
        before[end] = i
        changed = [(i, rank_of(piece[i : after[end]], NONE) if end < n else NONE)]
        if gone < n - 1:
            changed.append((gone, NONE))
        if prior >= 0:
            changed.append((prior, rank_of(piece[prior:end], NONE)))
        for leaf, rank in changed:
            at = size + leaf
            while tree[at] != rank:
                tree[at] = rank
                at >>= 1
                if not at:
                    break
                left, right = tree[2 * at], tree[2 * at + 1]
                rank = left if left <= right else right
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class _Pieces(dict):
    """Encoded pieces as little-endian 32-bit ids; emptied when full."""

    def __init__(self, data: bytes) -> None:
        self.ranks = read_ranks(data)

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = ids
        return ids


class _TaskPieces(_Pieces):
    """Encoded pieces of one task, emptied when they take ``TASK_BYTES``."""

    held = 0

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        ids = np.array(merge(data, self.ranks), "<u4").tobytes()
        if len(piece) <= LONGEST:
            self.held += len(data) + len(ids) + ENTRY_BYTES
            if self.held > TASK_BYTES:
                self.clear()
                self.held = 0
            self[piece] = ids
        return ids


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, token_ids: little-endian unsigned 32-bit integers) for each row of ``docs``.

    Each match of ``pattern`` is encoded by itself; text that it does not match has no tokens; strings of
    special tokens are ordinary text. A null text is an empty one and has no tokens. Repeated rows and
    null ids keep their rows; other columns are ignored. ``vocabulary`` is the path of a rank file on the
    driver; its bytes (under 1 MB for 50,000 tokens) are broadcast.
    """
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast({"file": file.read()})
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, token_ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        # A broadcast stays in a Python worker from task to task, and with it the pieces encoded there.
        pieces = shared.value.setdefault("pieces", None) or _Pieces(shared.value["file"])
        shared.value["pieces"] = pieces
        split, look = regex.compile(pattern).findall, pieces.__getitem__
        for batch in batches:
            done, start, held = [], 0, 0
            for at, text in enumerate(batch.column(1)):
                ids = b"".join(map(look, split(text.as_py() or "")))
                done.append(ids)
                held += len(ids)
                if held >= BATCH or at == batch.num_rows - 1:
                    sizes = pa.array([len(x) // 4 for x in done], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0)[start : at + 1], sizes, pa.array(done, pa.binary())], names=[id_col, "n_tokens", "token_ids"])
                    done, start, held = [], at + 1, 0

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """``encoded`` with the column decoded: the bytes of its token_ids (null: none)."""
    with open(vocabulary, "rb") as file:
        shared = encoded.sparkSession.sparkContext.broadcast(file.read())
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = {rank: token for token, rank in read_ranks(shared.value).items()}.__getitem__
        for batch in batches:
            done, start, held = [], 0, 0
            for at, ids in enumerate(batch.column(2)):
                done.append(b"".join(map(look, np.frombuffer(ids.as_py() or b"", "<u4").tolist())))
                held += len(done[-1])
                if held >= BATCH or at == batch.num_rows - 1:
                    same = [batch.column(i)[start : at + 1] for i in range(3)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(done, pa.binary())], names=[id_col, "n_tokens", "token_ids", "decoded"])
                    done, start, held = [], at + 1, 0

    schema = f"`{id_col}` {kind}, n_tokens long, token_ids binary, decoded binary"
    return encoded.select(id_col, "n_tokens", "token_ids").mapInArrow(run, schema)


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    ids, text = F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    return decoded.select(id_col, "n_tokens", ids, text)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, token_ids, ids_sha256, decoded_sha256) of each row: encoded as ``encode`` does, decoded again and digested in
    one Arrow function, so that a core runs one Python worker and decoded text does not come back.

    What a task remembers is bounded in bytes and freed with the task. Nulls, empty texts and repeated rows as in ``encode``.
    """
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    names = [id_col, "n_tokens", "token_ids", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pieces = _TaskPieces(shared.value)
        token_of = {rank: token for token, rank in pieces.ranks.items()}.__getitem__
        split, look = regex.compile(pattern).findall, pieces.__getitem__
        for batch in batches:
            rows, start, held = [], 0, 0
            for at, text in enumerate(batch.column(1)):
                ids = b"".join(map(look, split(text.as_py() or "")))
                decoded = hashlib.sha256()
                for begin in range(0, len(ids), BATCH):
                    decoded.update(b"".join(map(token_of, np.frombuffer(ids[begin : begin + BATCH], "<u4").tolist())))
                rows.append((len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), decoded.hexdigest()))
                held += len(ids)
                if held >= BATCH or at == batch.num_rows - 1:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.string(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[start : at + 1], *columns], names=names)
                    rows, start, held = [], at + 1, 0

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, token_ids binary, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
