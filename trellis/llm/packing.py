"""Best-fit packing of tokenised documents under several capacities.

Texts are tokenised where they are read; only piece lengths and checksums are
shuffled. Pieces are dealt by hash into groups of about GROUP_DOCUMENTS
documents and each group is packed by vector best-fit decreasing: a bin has
residual capacities of tokens, documents and attention cost (the sum of squared
lengths); a piece goes to the bin, among those with room under every constraint,
that has the largest weighted dot product with the piece or the smallest
residual norm after taking it. A group loses at most part of a few bins, so the
number of sequences stays near the least possible at every size.
"""

from __future__ import annotations

import json
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import id_text, read

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SEQUENCE_TOKENS = 2048
END_ID = 0
GROUP_DOCUMENTS = 16_384

#: Fixed value: the byte-level split pattern of the tokenizer file's format.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most, and the weights of the three dimensions."""

    tokens: int = SEQUENCE_TOKENS
    documents: int = SEQUENCE_TOKENS
    attention: int = SEQUENCE_TOKENS * SEQUENCE_TOKENS
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def load_encoding(path: str = TOKENIZER) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers file as a rank encoding: merges are in
    the order of their results' ids, so an id is its token's rank."""
    spec = json.load(open(path))
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    results = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    if any(b <= a for a, b in zip(results, results[1:])):
        raise ValueError(f"{path}: merges are not in the order of their ids")
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
           size: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every whole text's ids with
    ``end_id`` behind them. Only what is longer than ``size`` is cut; all pieces
    but the first are full."""
    def run(batches):
        enc = load_encoding(tokenizer)
        special = set(enc.special_tokens_set)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(enc.encode_to_numpy(text, allowed_special=special), end_id).astype("<u4")
                first = len(ids) % size or size
                start, end, k = 0, min(first, len(ids)), 0
                while start < len(ids):
                    rows.append((doc_id, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start, end, k = end, end + size, k + 1
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                 *(pa.array(c, pa.int64()) for c in cols[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_text(docs, id_col, text_col).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every length: vector best-fit decreasing.

    Every length must fit an empty bin. Ties go to the older bin, and among
    equal lengths to the earlier one.
    """
    need = np.stack([lengths / cap.tokens, np.full(len(lengths), 1 / cap.documents),
                     lengths.astype(float) ** 2 / cap.attention], axis=1)
    limit = 1 + 1e-9
    if len(need) and need.max() > limit:
        raise ValueError("a piece is larger than an empty sequence")
    weights = np.array(cap.weights)
    order = np.argsort(-need.max(axis=1), kind="stable")
    least = need.min(axis=0) if len(need) else None
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used = np.zeros(len(lengths) + 1, np.int64)
    room = np.empty((256, 3))  # of the open bins, in the order they were opened
    ids = np.empty(256, np.int64)
    n_open = n_bins = 0
    for i in order:
        d = need[i]
        at = -1
        if n_open:
            left = room[:n_open] - d
            fits = np.flatnonzero(left.min(axis=1) >= -1e-9)
            if len(fits):
                if cap.rule == "dot":
                    at = fits[np.argmax(room[fits] @ (weights * d))]
                else:
                    at = fits[np.argmin((left[fits] ** 2) @ weights)]
        if at < 0:
            if n_open == len(ids):
                room, ids = np.concatenate([room, room]), np.concatenate([ids, ids])
            at, ids[n_open], room[n_open] = n_open, n_bins, 1.0
            n_open, n_bins = n_open + 1, n_bins + 1
        b = ids[at]
        bins[i], offsets[i] = b, used[b]
        used[b] += lengths[i]
        room[at] -= d
        if (room[at] - least).min() < -1e-9:  # nothing fits any more: close it
            room[at:n_open - 1], ids[at:n_open - 1] = room[at + 1:n_open].copy(), ids[at + 1:n_open].copy()
            n_open -= 1
    return bins, offsets


def pack(items: DataFrame, groups: int, cap: Capacity = Capacity()) -> DataFrame:
    """Add (sequence_id, offset) to pieces dealt into ``groups`` by hash."""
    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        kept, full = [], 0
        for batch in batches:
            whole = np.asarray(batch.column(3)) == cap.tokens
            n = int(whole.sum())
            if n and cap.tokens * cap.tokens <= cap.attention:
                # a full piece is a sequence of its own; these go straight on
                seq = np.arange(n, dtype=np.int64) + base + (1 << 39) + full
                full += n
                own = batch.filter(pa.array(whole))
                yield _placed(own, seq, np.zeros(n, np.int64))
                batch = batch.filter(pa.array(~whole))
            if batch.num_rows:
                kept.append(batch)
        if kept:
            rows = pa.Table.from_batches(kept).sort_by([("doc_id", "ascending"), ("piece", "ascending")])
            rows = rows.combine_chunks().to_batches()[0]
            bins, offsets = best_fit(np.asarray(rows.column(3)), cap)
            yield _placed(rows, bins + base, offsets)

    return (items.repartition(groups, F.xxhash64("doc_id", "piece", "ids_crc32"))
            .mapInArrow(run, PIECES + ", sequence_id long, offset long"))


def _placed(batch: pa.RecordBatch, seq: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq, pa.int64()), pa.array(offsets, pa.int64())],
                                      names=[*batch.schema.names, "sequence_id", "offset"])


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   tokenizer: str = TOKENIZER, cap: Capacity = Capacity(),
                   group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """Pack all rows of ``docs``: (doc_id, piece, start, length, ids_crc32,
    sequence_id, offset).

    A null or empty text is one piece of the end id alone. Repeated rows are
    packed each. The special tokens' strings in a text become their ids, as the
    tokenizers library does by default. An empty table gives an empty result.
    """
    groups = max(1, math.ceil(docs.count() / group_documents))
    return pack(pieces(docs, id_col, text_col, tokenizer, cap.tokens), groups, cap)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
