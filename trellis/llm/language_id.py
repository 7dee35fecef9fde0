"""Language ID by compression: one zstandard raw-content dictionary set per language.

A text's cost under a language is the number of bytes its pieces take when each
is compressed with that language's dictionaries; the smallest cost wins. Narrow
margins are rejected. The dictionaries come from a bounded sample of whole
labelled texts; they have a fixed size whatever the size of the table.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from trellis.llm.common import crc_mod, id_text, read

#: Labelled whole texts per language that fill the dictionaries, at most; only
#: texts of up to SAMPLE_CHARS characters are picked, so the sample is bounded.
SAMPLE_TEXTS = 600
SAMPLE_CHARS = 4000
#: Dictionaries per language and bytes in each.
DICTIONARIES = 2
DICTIONARY_BYTES = 131_072
LEVEL = 3
#: Texts are compressed in pieces, so that a long text's own history does not
#: outweigh the dictionary; every piece counts.
PIECE_BYTES = 4096
#: Relative gap of the two smallest costs below which a text is rejected. Texts in
#: no learned language have small gaps; few in a learned one do (see the README).
MARGIN = 0.02
UNKNOWN = "und"

_NO_LETTERS = re.compile(r"[\W\d_]+")
#: Number characters that are neither digits nor letters; few texts hold any.
_NUMBERS = frozenset(c for c in map(chr, range(0x20000)) if c.isnumeric() and not c.isalpha())


def normalise(text: str) -> bytes:
    """Lower-case letters; every run of anything else is one space."""
    text = text.lower()
    if not text.isascii() and not _NUMBERS.isdisjoint(text):
        text = "".join(" " if c in _NUMBERS else c for c in text)
    return _NO_LETTERS.sub(" ", text).strip().encode()


def learn(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
          sample_texts: int = SAMPLE_TEXTS) -> dict[str, list[bytes]]:
    """Dictionary contents per language from the labelled ``rows``.

    Rows with a null label or text give nothing. The sample is the
    ``sample_texts`` rows of each language that come first by hash of id and
    text; it is picked by a per-language row limit that Spark applies before
    the shuffle, so a language with most of the rows is no burden.
    """
    src = rows.select(F.col(f"`{lang_col}`").cast("string").alias("lang"),
                      F.col(f"`{text_col}`").cast("string").alias("text"),
                      F.col(f"`{id_col}`").cast("string").alias("key"))
    src = src.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
                    & (F.length("text") <= SAMPLE_CHARS)).withColumn("h", F.xxhash64("key", "text"))
    order = Window.partitionBy("lang").orderBy("h")
    ids = (src.select("lang", "h").withColumn("n", F.row_number().over(order))
           .where(F.col("n") <= sample_texts).select("lang", "h", "n"))
    # at most ``sample_texts`` pairs of numbers for each language
    picked = src.join(F.broadcast(ids), ["lang", "h"])
    texts: dict[str, list[bytes]] = defaultdict(list)
    for lang, text, _ in sorted(picked.select("lang", "text", "n").toLocalIterator(),
                                key=lambda r: (r[0], r[2])):
        if part := normalise(text):
            texts[lang].append(part)
    return {lang: _fill(parts) for lang, parts in texts.items()}


def _fill(parts: list[bytes]) -> list[bytes]:
    """Deal whole texts into DICTIONARIES contents of DICTIONARY_BYTES; few texts
    repeat, so that every language's dictionaries are equally many."""
    out = []
    for k in range(DICTIONARIES):
        own = parts[k::DICTIONARIES] or parts
        content = b""
        for part in own:
            if len(content) >= DICTIONARY_BYTES:
                break
            content += part + b"\n"
        out.append(content[:DICTIONARY_BYTES])
    return out


class Classifier:
    """Costs of a text under every learned language."""

    def __init__(self, contents: dict[str, list[bytes]]):
        self.compressors: dict[str, list[zstandard.ZstdCompressor]] = {}
        for lang in sorted(contents):
            self.compressors[lang] = []
            for content in contents[lang]:
                data = zstandard.ZstdCompressionDict(content.ljust(8, b" "),
                                                     dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                data.precompute_compress(level=LEVEL)
                self.compressors[lang].append(zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=data, write_content_size=False,
                    write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None, margin: float = MARGIN) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        data = normalise(text) if text else b""
        if not data or not self.compressors:
            return UNKNOWN, 0.0, True
        pieces = [data[i:i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        costs = {lang: sum(len(c.compress(p)) for c in cs for p in pieces)
                 for lang, cs in self.compressors.items()}
        ranked = sorted(costs, key=lambda x: (costs[x], x))
        best = costs[ranked[0]]
        # a likelihood per language that falls with its extra share of bytes
        weights = [math.exp(-50.0 * (costs[x] - best) / best) for x in ranked]
        rejected = len(ranked) > 1 and costs[ranked[1]] - best < margin * best
        return ranked[0], 1.0 / sum(weights), rejected


def classify(docs: DataFrame, contents: dict[str, list[bytes]], id_col: str = "doc_id",
             text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of ``docs``.

    A null text, or one without a letter, is ``und`` with score 0 and rejected;
    so is every text when no language was learned. Ties go to the first
    language by name and are rejected. Repeated rows give repeated results; an
    empty table gives an empty result.
    """
    def run(batches):
        model = Classifier(contents)
        for batch in batches:
            rows = [model.predict(t, margin) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.string()),
                 pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"])

    return id_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, contents: dict[str, list[bytes]], text_col: str = "text",
             margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text is not rejected."""
    at = docs.columns.index(text_col)

    def run(batches):
        model = Classifier(contents)
        for batch in batches:
            yield batch.filter(pa.array([not model.predict(t, margin)[2] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_rows() -> Column:
    """Rows that may be learned from: crc32(doc_id as text) mod 3 is not 1."""
    return F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(True))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    contents = learn(docs.where(training_rows()))
    out = classify(docs, contents)
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
