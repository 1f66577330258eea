"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of passages of training texts, each of which has an equal
share of its bytes. A text is encoded block by block with
every dictionary; the language whose encoding is smallest wins. ``margin`` is how much larger the second smallest is,
as a share of it, and a narrow margin rejects the document.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and is rejected; very long texts are
encoded whole, in blocks; of equal sizes the language with more training rows wins (margin 0, rejected); repeated
rows each get their result; an empty table gives an empty table; without any training row all is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hairpin.llm.batches import arrow_rows, held_out, map_texts, slices

#: Bytes of each language's dictionary, and characters of one training text that go into it at most.
DICTIONARY_BYTES = 32 << 10
SHARE_CHARS = 1024
#: Distinct training texts of a language in the bounded sample: those with the lowest hashes, or all.
SAMPLE_TEXTS = 200
#: Bytes encoded at once, so that what a text says of itself doesn't outweigh the dictionaries.
BLOCK_BYTES = 1024
#: Small tables and short matches: words are short, and a table is copied for each block.
COMPRESSION = dict(window_log=15, hash_log=14, chain_log=14, search_log=4, min_match=3, target_length=24, strategy=zstandard.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0)
#: Below this margin the document is rejected.
MIN_MARGIN = 0.005
FOLDS, FOLD = 5, 0
_LETTER = regex.compile(r"\p{L}")
_NOISE = regex.compile(r"[^\p{L}]+")


def _plain(text: str) -> str:
    """Letters in lower case, with one space for each run of anything else."""
    return _NOISE.sub(" ", text).strip().lower()


def dictionary(passages: list[str]) -> bytes:
    """Plain passages in DICTIONARY_BYTES, shared out equally; what a short one leaves goes to the longer ones. Cut between characters."""
    plain = sorted((t.encode() for t in map(_plain, passages) if t), key=lambda t: (len(t), t))
    room, kept = DICTIONARY_BYTES, []
    for i, t in enumerate(plain):
        t = t[: max(0, room // (len(plain) - i) - 1)].decode(errors="ignore").encode()
        kept.append(t)
        room -= len(t) + 1
    raw = b" ".join(kept)
    # the least size of a dictionary
    return raw if len(raw) >= 8 else (raw + b" ") * 8


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionaries of each language, the commonest first, from a bounded sample of ``docs``."""
    # a text without a letter has nothing to learn from
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    usable = usable.withColumn("h", F.xxhash64("text"))
    # copies of one text meet before the shuffle and count once
    sizes = usable.groupBy("lang", "h").agg(F.count("*").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).collect()
    counts, distinct = {r["lang"]: r["n"] for r in sizes}, {r["lang"]: r["texts"] for r in sizes}
    plain = F.trim(F.regexp_replace("text", r"[^\p{L}]+", " "))
    # texts can share their head, so a passage is cut from a hashed place
    start = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length(plain) - SHARE_CHARS, F.lit(0)) + 1) + 1
    passage = plain.substr(start.cast("int"), F.lit(SHARE_CHARS))
    found: dict[str, list[str]] = {}
    # a share of somewhat more than the wanted texts, and a larger one where too few hashes fell under it
    wanted = SAMPLE_TEXTS * 3 // 2
    while missing := [k for k in distinct if k not in found]:
        bound = {k: min((1 << 63) - 1, (wanted << 64) // distinct[k] - (1 << 63)) for k in missing}
        limit = F.element_at(F.create_map(*[F.lit(x) for kv in bound.items() for x in kv]), F.col("lang"))
        rows = usable.where(F.col("h") <= limit).groupBy("lang", "h").agg(F.min(passage).alias("text")).collect()
        for k in missing:
            texts = sorted((r["h"], r["text"]) for r in rows if r["lang"] == k)[:SAMPLE_TEXTS]
            if len(texts) >= min(SAMPLE_TEXTS, distinct[k]):
                found[k] = [t for _, t in texts]
        wanted *= 2
    return {k: dictionary(found[k]) for k in sorted(counts, key=lambda k: (-counts[k], k))}


class Encoder:
    """Sizes of texts under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs, self.by = list(dictionaries), []
        params = zstandard.ZstdCompressionParameters(**COMPRESSION)
        for raw in dictionaries.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, text: str) -> np.ndarray:
        raw = _plain(text).encode()
        blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        return np.array([sum(len(z.compress(b)) for b in blocks) for z in self.by])

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score 0 to 1, margin, accepted)."""
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0, 0.0, False
        size = self.sizes(text)
        order = np.argsort(size, kind="stable")
        best = float(size[order[0]])
        second = float(size[order[1]]) if len(order) > 1 else 2 * best
        margin = (second - best) / best
        return self.langs[order[0]], float(1 - np.exp(-20 * margin)), margin, bool(margin >= MIN_MARGIN)


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred string, score double, margin double and accepted boolean; these replace columns so named."""
    arrow_rows(docs.sparkSession)
    names = ("lang_pred", "score", "margin", "accepted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(dictionaries)
        for part, _ in slices(batches):
            found = [encoder.predict(t) for t in part.column("text").to_pylist()]
            cols = list(zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())],
                names=["row", *names],
            )

    return map_texts(docs, text, "lang_pred string, score double, margin double, accepted boolean", run)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learns from the rows whose fold isn't held out and predicts all rows from their text."""
    learned = train(docs.where(~held_out(doc_id, FOLDS, FOLD)), text, lang)
    return predict(docs.withColumn("held_out", held_out(doc_id, FOLDS, FOLD)), learned, text)
