"""BPE encoding and decoding by prefix-sharing trie traversal.

Texts are normalised and cut into words as the tokenizer file says (canonical composition, lower case, white space
dropped; a file that says otherwise is refused); the words a worker has not met yet go through a trie in sorted order, where the encodings of shared prefixes
are computed once (``bpe``). Ids are looked up again for decoding: the tokens as written, with a space between them.

Defined cases: a null or empty text has no ids and decodes to an empty text; strings of special tokens in a text become
their ids; a text with code points that this Python does not know goes to the library itself; texts are taken whole; ids
of documents may be null or repeated, each row is encoded; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.llm import bpe, pretoken
from wardspark.llm.arrays import Recent, stretches
from wardspark.llm.stage import texts
from wardspark.llm.tokencount import library

#: Encodings of so many words are kept by a worker.
KEPT = 100_000
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def lower(text: str) -> str:
    """Each character by itself; only the capital sigma depends on its neighbours otherwise."""
    return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()


class Encoder:
    def __init__(self, path: str):
        self.path, self.bpe = path, bpe.loaded(path, "word")
        self.kept = Recent(KEPT)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.bpe.special, key=len, reverse=True))) + ")")
        self.marks = {"\0" + t: (bpe.packed([i]), t) for t, i in self.bpe.special.items()}

    def words(self, text: str) -> list[str] | None:
        """Words and special tokens, the latter with a mark before them; null if the library should take the text."""
        if not text.isascii() and (pretoken.classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)] == pretoken.UNKNOWN).any():
            return None
        parts = self.special.split(text) if "<|" in text else [text]
        found: list[str] = []
        for k, p in enumerate(parts):
            if k % 2:
                found.append("\0" + p)
            else:
                found += _WORDS.findall(lower(p if unicodedata.is_normalized("NFC", p) else unicodedata.normalize("NFC", p)))
        return found

    def texts(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids (little-endian, 32 bits each) and decoded texts."""
        cut = [self.words(t) for t in texts]
        new = self.kept.missing(list({w for c in cut if c for w in c} - self.marks.keys()))
        kept = self.kept.young
        kept.update(self.marks)
        raw = {w.encode().decode("latin-1"): w for w in new}
        shown = self.bpe.shown
        for r, ids in self.bpe.encode_words(list(raw)).items():
            kept[raw[r]] = bpe.packed(ids), " ".join([shown[i] for i in ids])
        out, back = [], []
        for t, c in zip(texts, cut, strict=True):
            if c is None:
                ids = library(self.path).encode(t, add_special_tokens=False).ids
                out.append(bpe.packed(ids))
                back.append(" ".join([shown[i] for i in ids]))
            else:
                found = [kept[w] for w in c]
                out.append(b"".join([x[0] for x in found]))
                back.append(" ".join([x[1] for x in found]))
        return out, back


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for b in stretches(batch, 1, 1 << 19):
                ids, back = e.texts([t or "" for t in b.column(1).to_pylist()])
                n = pa.array([len(i) // 4 for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(ids, pa.binary()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return texts(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
