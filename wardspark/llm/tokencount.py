"""Token counts by a compiled finite-state tokenizer.

Pre-tokens are found by a finite automaton whose stretch maps are composed by a prefix scan (``pretoken``). The vocabulary
is compiled into a deterministic transducer whose transitions carry the number of tokens by which the encoding grows
(``transducer``); the bytes of many texts run through it in chunks side by side, whose maps of states and counts are
composed by a scan. A text's count is the sum of what was emitted along it.

Defined cases: a null or empty text has no tokens; strings of special tokens in a text count as the library takes them,
one each; a text with code points that this Python does not know is counted by the library itself; texts are taken whole;
ids may be null or repeated, each row gets its own count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardspark.llm import bpe, pretoken
from wardspark.llm.arrays import stretches
from wardspark.llm.stage import texts
from wardspark.llm.transducer import Transducer

#: Bytes of text that run through the transducer together.
STRETCH = 1 << 21


@lru_cache(maxsize=4)
def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class Counter:
    def __init__(self, path: str):
        self.path = path
        model = bpe.loaded(path, "byte")
        self.transducer = Transducer(model)
        self.special = re.compile("|".join(map(re.escape, sorted(model.special, key=len, reverse=True)))) if model.special else None

    def placed(self, joined: str, start: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of texts that are each ended by a line feed (places in ends), where pre-tokens (start) and these line
        feeds begin among them, and which of those the line feeds are."""
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        width = 1 + (cps > 0x7F).astype(np.int8) + (cps > 0x7FF) + (cps > 0xFFFF)
        at = np.r_[0, np.cumsum(width, dtype=np.int64)]
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        mark = np.zeros(len(data), bool)
        mark[at[start]] = mark[at[ends]] = True
        begins = np.flatnonzero(mark)
        return data, begins, np.searchsorted(begins, at[ends])

    def texts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        pieces, owner = texts, np.arange(len(texts))
        if self.special and any(self.special.search(t) for t in texts):
            cut = [self.special.split(t) for t in texts]
            pieces, owner = [p for c in cut for p in c], np.repeat(owner, [len(c) for c in cut])
            total += np.array([len(c) - 1 for c in cut])
        joined, start, _, _, odd = pretoken.pretokens(pieces)
        odd_texts = np.unique(owner[odd])
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data, begins, ends = self.placed(joined, start, np.cumsum(size + 1) - 1)
        upto = self.transducer.counts(data, begins)[ends]  # the line feed behind each piece is a token of its own
        np.add.at(total, owner, np.diff(upto, prepend=-1) - 1)
        for k in odd_texts:
            total[k] = len(library(self.path).encode(texts[k], add_special_tokens=False).ids)
        return total


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for b in stretches(batch, 1, STRETCH):
                texts = [t or "" for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(c.texts(texts))], ["doc_id", "n_bytes", "n_tokens"])

    d = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return texts(d).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").select("*", (F.col("n_tokens") > limit).alias("over_limit"))
