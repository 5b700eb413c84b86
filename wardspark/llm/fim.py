"""Fill-in-middle transformation by succinct rank and select.

A text is cut into units, runs of ASCII letters or single other characters, by a bit vector over its bytes that has a one
where a unit begins. The vectors of a stretch of texts lie in packed words one behind the other, with a directory of the
ones before each block of words (``Bits``). The ones of a text (its total popcount) are its n units; two ranks drawn from
its id are turned into byte cuts by ``select``, and a second vector, of the bytes where characters begin, gives lengths in
characters by ``rank``. No list of units is ever made: a text takes two bits a byte besides itself.

Three parts come out as one text, prefix first (``psm``) or suffix first (``spm``), each behind its mark. A text that is
empty or holds a mark stays as it is (``plain``), so ``restore`` is exact.

Defined cases: a null text is empty; a null id counts as an empty one in the draw; repeated rows and ids are cut each by
itself, the same id and text always alike; texts are taken whole, however long; an empty table gives no rows; other
columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.llm.arrays import stretches
from wardspark.llm.stage import texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


class Bits:
    """Bits in packed words, with the number of ones before each block of eight words."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros((len(bits) // 512 + 1) * 8, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.blocks = self.words.reshape(-1, 8)
        self.directory = np.r_[0, np.cumsum(np.bitwise_count(self.blocks).sum(1, dtype=np.int64))]

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block, word = at >> 9, at >> 6 & 7
        ones = np.bitwise_count(self.blocks[block]).astype(np.int64)
        before = np.where(np.arange(8) < word[:, None], ones, 0).sum(1)
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.directory[block] + before + np.bitwise_count(self.words[at >> 6] & low)

    def select(self, number: np.ndarray) -> np.ndarray:
        """Places of these ones, counted from 0."""
        block = np.searchsorted(self.directory, number, side="right") - 1
        left = number - self.directory[block]
        upto = np.cumsum(np.bitwise_count(self.blocks[block]), axis=1, dtype=np.int64)
        word = (upto <= left[:, None]).sum(1)
        left = left - np.where(word > 0, np.take_along_axis(upto, np.maximum(word - 1, 0)[:, None], 1)[:, 0], 0)
        inside = np.unpackbits(self.blocks[block, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return (block << 9) + (word << 6) + (np.cumsum(inside, axis=1) <= left[:, None]).sum(1)


class Units:
    """Where units and characters begin in a stretch of texts."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        body = column.buffers()[2]
        data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and body.size else np.zeros(0, np.uint8)
        self.data, self.offsets = data, offsets - offsets[0]
        character, letter = (data & 0xC0) != 0x80, LETTER[data]
        unit = character.copy()
        unit[1:] &= ~(letter[1:] & letter[:-1])
        unit[self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]] = True
        self.units, self.characters = (Bits(np.append(x, True)) for x in (unit, character))  # a last one where the texts end
        self.first = self.units.rank(self.offsets)

    def totals(self) -> np.ndarray:
        return np.diff(self.first)

    def cuts(self, number: np.ndarray) -> np.ndarray:
        """The byte at which each text's unit of this number begins; for the number of all its units, its end."""
        return self.units.select(self.first[:-1] + number)


def _draw(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: str = "1", plain: int = 10, suffix_first: int = 20) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output. Of 100 texts ``plain`` stay as they are,
    and of 100 others ``suffix_first`` have the suffix first; what becomes of a text is drawn from seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), digest.alias("digest"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (_draw(F.col("digest"), 3) % 100 >= 100 - plain), "plain").when(_draw(F.col("digest"), 4) % 100 < suffix_first, "spm").otherwise("psm")
    d = d.select("doc_id", "text", form.alias("form"), _draw(F.col("digest"), 1).alias("h1"), _draw(F.col("digest"), 2).alias("h2"))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in stretches(batch, 1):
                u = Units(b.column(1))
                n = u.totals()
                one, two = (b.column(k).to_numpy() % (n + 1) for k in (3, 4))
                a, z = u.cuts(np.minimum(one, two)), u.cuts(np.maximum(one, two))
                at = [u.characters.rank(x) for x in (u.offsets[:-1], a, z)]
                out, data = [], u.data.tobytes()
                forms = b.column(2).to_pylist()
                for form, start, i, j, end in zip(forms, u.offsets[:-1].tolist(), a.tolist(), z.tolist(), u.offsets[1:].tolist(), strict=True):
                    if form == "plain":
                        out.append(data[start:end])
                    elif form == "psm":
                        out.append(b"".join((p, data[start:i], s, data[j:end], m, data[i:j])))
                    else:
                        out.append(b"".join((s, data[j:end], p, data[start:i], m, data[i:j])))
                whole = np.array([f == "plain" for f in forms], bool)
                chars = [pa.array(at[k + 1] - at[k], pa.int64(), mask=whole) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), b.column(2), *chars, pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return texts(d).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    part = F.split(output, "<[PSM]>")
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))
