"""Word BPE: contiguous rank arrays, with decoding.

Each short word is one row of a matrix of part ids, beside it the ranks of its
adjacent pairs. All rows are scanned for their minimum rank together; the pair's
boundary is deleted by shifting the row, and the ranks on both sides of it are
looked up anew, until no row has a pair that merges. Words are encoded once per
task cache; a text's ids and decoded string are put together from its words'.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import struct
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from trellis.llm.common import id_text, read
from trellis.llm.packing import byte_letters

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Words of more bytes than this are merged one by one over a heap of pairs.
SHORT_WORD = 64
#: Distinct chunks a worker keeps encoded; the cache starts anew beyond it.
CACHE_WORDS = 400_000
NO_RANK = np.int64(1) << 40

#: Fixed values of the tokenizer file's format: the word pattern (its last class
#: leaves white space out). U+001C-1F are no white space there, unlike in str.split.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r\x85\p{Z}\p{L}\p{N}]+")
SEPARATORS = regex.compile(r"[\x1c-\x1f]")


class WordBpe:
    """Encoder and decoder of one tokenizers file with word-end tokens."""

    def __init__(self, path: str = TOKENIZER):
        spec = json.load(open(path))
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(t) for t in self.special)) if self.special else None
        vocab = model["vocab"]
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        end = model["end_of_word_suffix"]
        letters = {b: c for c, b in byte_letters().items()}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int64)
        keys, merged = [], []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            keys.append(vocab[a] << 20 | vocab[b])
            merged.append(vocab[a + b])
        keys = np.array(keys, np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank = keys[order], order.astype(np.int64)
        self.merged = np.array(merged, np.int64)  # by rank
        # of chunks between white space: ids as bytes, decoded text
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, str] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of adjacent pairs; NO_RANK where a pair does not merge or an id is -1."""
        keys = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        good = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(good, self.pair_rank[at], NO_RANK)

    def encode_short(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of one length in bytes, all rows at once."""
        n, width = len(words), len(words[0])
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(n, width)
        parts = self.inner[raw]
        parts[:, -1] = self.last[raw[:, -1]]
        ranks = np.full((n, width), NO_RANK)
        if width > 1:
            ranks[:, :-1] = self.ranks(parts[:, :-1], parts[:, 1:])
        size = np.full(n, width)
        rows = np.arange(n)
        while len(rows):
            sub = ranks[rows]
            at = sub.argmin(axis=1)
            low = sub[np.arange(len(rows)), at]
            go = low < NO_RANK
            rows, at, low = rows[go], at[go], low[go]
            if not len(rows):
                break
            # delete the boundary behind part ``at``: what lies right of it moves left
            cols = np.arange(width)
            take = np.minimum(cols + (cols > at[:, None]), width - 1)
            own = np.take_along_axis(parts[rows], take, 1)
            own_ranks = np.take_along_axis(ranks[rows], np.minimum(cols + (cols >= at[:, None]), width - 1), 1)
            own[:, -1] = -1
            own_ranks[:, -1] = NO_RANK
            k = np.arange(len(rows))
            own[k, at] = self.merged[low]
            right = np.minimum(at + 1, width - 1)
            own_ranks[k, at] = np.where(at + 1 < width, self.ranks(own[k, at], own[k, right]), NO_RANK)
            left = np.maximum(at - 1, 0)
            own_ranks[k, left] = np.where(at > 0, self.ranks(own[k, left], own[k, at]), own_ranks[k, left])
            parts[rows], ranks[rows] = own, own_ranks
            size[rows] -= 1
        return [parts[i, :size[i]] for i in range(n)]

    def encode_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word: pairs by (rank, place) from a heap, parts in a linked list."""
        raw = np.frombuffer(word, np.uint8)
        ids = self.inner[raw]
        ids[-1] = self.last[raw[-1]]
        n = len(ids)
        first = self.ranks(ids[:-1], ids[1:])
        heap = [(int(r), i, int(ids[i]), int(ids[i + 1])) for i, r in enumerate(first) if r < NO_RANK]
        heapq.heapify(heap)
        ids = ids.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of: dict[tuple[int, int], int] = {}

        def push(i: int, j: int) -> None:
            pair = (ids[i], ids[j])
            if pair not in rank_of:
                rank_of[pair] = int(self.ranks(np.array([pair[0]]), np.array([pair[1]]))[0])
            if rank_of[pair] < NO_RANK:
                heapq.heappush(heap, (rank_of[pair], i, *pair))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                push(i, after[j])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([x for x in ids if x >= 0], np.int64)

    def learn(self, chunks: set[str]) -> None:
        """Encode new chunks: all of their distinct words, by length."""
        words_of = {c: WORD.findall(c) for c in chunks}
        by_length: dict[int, list[str]] = {}
        for w in {w for ws in words_of.values() for w in ws}:
            by_length.setdefault(len(w.encode()), []).append(w)
        ids_of: dict[str, list[int]] = {}
        for width, own in by_length.items():
            if width > SHORT_WORD:
                found = [self.encode_long(w.encode()) for w in own]
            else:
                found = [x for i in range(0, len(own), 20_000)
                         for x in self.encode_short([w.encode() for w in own[i:i + 20_000]])]
            ids_of.update(zip(own, (x.tolist() for x in found)))
        name = self.names.__getitem__
        for c, ws in words_of.items():
            ids = ids_of[ws[0]] if len(ws) == 1 else [i for w in ws for i in ids_of[w]]
            self.ids_of[c] = struct.pack(f"<{len(ids)}I", *ids)
            self.text_of[c] = " ".join(map(name, ids))

    def chunks(self, text: str) -> list[str]:
        """Normalised chunks between white space, of a text without special tokens.
        No word spans white space, so chunks are encoded one by one."""
        if not text.isascii():
            # letters are lowered one by one: a final capital sigma has no form of its own
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if SEPARATORS.search(text):
            return WORD.findall(text)
        return text.split()

    def sections(self, text: str) -> list[str | int]:
        """Ordinary stretches of a text and, between them, special ids."""
        if self.cut is None or "<" not in text:
            return [text]
        out: list[str | int] = []
        at = 0
        for m in self.cut.finditer(text):
            out += [text[at:m.start()], self.special[m.group()]]
            at = m.end()
        return [*out, text[at:]]

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        split = [[s if isinstance(s, int) else self.chunks(s) for s in self.sections(t)] for t in texts]
        own = set().union(*(s for parts in split for s in parts if not isinstance(s, int)))
        new = own - self.ids_of.keys()
        if len(self.ids_of) + len(new) > CACHE_WORDS:
            self.ids_of.clear()
            self.text_of.clear()
            new = own
        self.learn(new)
        out = []
        for parts in split:
            ids, texts_ = [], []
            for s in parts:
                if isinstance(s, int):
                    ids.append(struct.pack("<I", s))
                    texts_.append(self.names[s])
                elif s:
                    ids.append(b"".join(map(self.ids_of.__getitem__, s)))
                    texts_.append(" ".join(map(self.text_of.__getitem__, s)))
            out.append((b"".join(ids), " ".join(texts_)))
        return out

    def decode(self, ids: bytes) -> str:
        """Token strings joined by spaces (the file names no decoder)."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           tokenizer: str = TOKENIZER, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids array<long>, decoded) of every whole text, or with
    ``digests`` (doc_id, n_tokens, ids_sha256, decoded_sha256).

    A null text counts as empty and has no ids; repeated rows give repeated
    results; an empty table gives an empty result.
    """
    schema = "doc_id long, n_tokens long, " + (
        "ids_sha256 string, decoded_sha256 string" if digests else "ids array<long>, decoded string")

    def run(batches):
        bpe = WordBpe(tokenizer)
        gc.disable()  # the caches hold no cycles, and looking for them takes half the time
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = bpe.encode_batch(part.column(1).to_pylist())
                n = pa.array([len(r[0]) // 4 for r in rows], pa.int64())
                if digests:
                    a = pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string())
                    b = pa.array([hashlib.sha256(r[1].encode()).hexdigest() for r in rows], pa.string())
                else:
                    a = pa.array([np.frombuffer(r[0], "<u4") for r in rows], pa.list_(pa.int64()))
                    b = pa.array([r[1] for r in rows], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), n, a, b],
                                                 names=[x.split()[0] for x in schema.split(", ")])

    return id_text(docs, id_col, text_col).mapInArrow(run, schema)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), digests=True)
