"""Fill-in-middle transformation of whole texts, cut at code points found with SWAR words.

The texts of a slice lie in one buffer of little-endian ``uint64`` words, each text from a word of
its own on, followed by at least one zero byte. A byte begins a code point unless it is of the form
``10xxxxxx``; a byte *ends* one if the next byte begins one. Both are found for eight bytes at once:

1. the bytes that begin a unit are marked at bit 0 of their byte by ``(~w >> 7 | w >> 6) & 0x01..01``;
2. the marks move one byte down, the lowest one of the next word moving into the highest byte;
3. ``bitwise_count`` gives the marks of each word, their running sum the units up to each word;
4. the end of unit k is in the first word whose running sum reaches k (one binary search for all cuts);
5. inside that word, ``marks * 0x01..01`` holds the count of marks up to each byte; bytes whose count
   is below the wanted one are counted by their high bits, which is the place of the byte.

So no text is decoded and no code point is looked at alone. Form and cuts depend on the seed and the
document's id only (:func:`draw`), so any run and any executor makes the same output.

Defined results: null text counts as empty, an empty text stays plain, as does one that holds a
sentinel; a null id draws as the empty string does; repeated rows give equal rows each; very long
texts are handled whole, in a slice of their own; an empty table gives no rows; other columns are
ignored. Row-local, no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pressroom.llm.common import U64, flat_bytes, text_slices

# The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ONES, HIGHS = U64(0x0101010101010101), U64(0x8080808080808080)


class Units:
    """The code points of many UTF-8 texts, for cutting at unit counts."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        sizes = np.diff(off)
        n_words = sizes // 8 + 1  # a byte after the text at least
        self.first = np.append(0, np.cumsum(n_words))
        buffer = np.zeros(int(self.first[-1]) * 8, np.uint8)
        for at, a, b in zip((self.first[:-1] * 8).tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
            buffer[at: at + b - a] = data[a:b]
        words = buffer.view("<u8")
        begins = ((~words >> U64(7)) | (words >> U64(6))) & ONES
        ends = begins >> U64(8)
        ends[:-1] |= (begins[1:] & U64(1)) << U64(56)
        # the zero bytes after a text end nothing: keep the marks of the last word's own bytes
        last = self.first[1:] - 1
        ends[last] &= (U64(1) << ((sizes % 8) * 8).astype(U64)) - U64(1)
        self.marks = ends
        self.sums = np.append(0, np.cumsum(np.bitwise_count(ends), dtype=np.int64))
        self.counts = self.sums[self.first[1:]] - self.sums[self.first[:-1]]

    def byte_of(self, units: np.ndarray) -> np.ndarray:
        """For each text the byte place behind its first ``units[i]`` code points."""
        wanted = self.sums[self.first[:-1]] + units
        word = np.maximum(np.searchsorted(self.sums, wanted, "left") - 1, 0)
        rank = (wanted - self.sums[word]).astype(U64)  # 1 .. 8 inside the word, where units > 0
        counts = self.marks[word] * ONES
        below = ~((counts | HIGHS) - rank * ONES) & HIGHS
        place = (word - self.first[:-1]) * 8 + np.bitwise_count(below) + 1
        return np.where(units > 0, place, 0)


def draw(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document, the first 8-digit groups of a hex digest."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i: i + 4], "big") for i in (0, 4, 8, 12))


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document. ``plain_from``: of
    100, the draws from here on leave the text plain; ``spm_below``: of 100, the draws below give
    the order suffix, prefix, middle instead of prefix, suffix, middle."""
    schema = StructType([docs.schema["doc_id"], StructField("n", LongType()), StructField("form", StringType()),
                         StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                yield transform(part)

    def transform(part: pa.RecordBatch) -> pa.RecordBatch:
        column = part.column("text")
        column = pc.fill_null(column.cast(pa.large_string()), "")
        data, off = flat_bytes(column)
        units = Units(data, off)
        n = units.counts
        marked = np.zeros(len(n), bool)
        for sentinel in (PREFIX, SUFFIX, MIDDLE):
            marked |= pc.match_substring(column, sentinel).to_numpy(zero_copy_only=False)
        h = np.array([draw(i, seed) for i in part.column("doc_id").to_pylist()], np.int64).reshape(-1, 4)
        plain = (n == 0) | marked | (h[:, 2] % 100 >= plain_from)
        spm = ~plain & (h[:, 3] % 100 < spm_below)
        cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
        a, b = units.byte_of(cuts[:, 0]), units.byte_of(cuts[:, 1])
        out = []
        for i, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            text = data[lo:hi].tobytes()
            if not plain[i]:
                prefix, middle, suffix = text[: a[i]], text[a[i]: b[i]], text[b[i]:]
                first, second = (SUFFIX, suffix), (PREFIX, prefix)
                if not spm[i]:
                    first, second = second, first
                text = b"".join((first[0].encode(), first[1], second[0].encode(), second[1], MIDDLE.encode(), middle))
            out.append(text)
        form = np.where(plain, "plain", np.where(spm, "spm", "psm")).astype(object)
        columns = [part.column("doc_id"), pa.array(n), pa.array(form, pa.string()), pa.array(cuts[:, 0], mask=plain),
                   pa.array(cuts[:, 1] - cuts[:, 0], mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(slices, schema)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from. No sentinel can begin in one of the parts, so the
    first two found after the leading one are the markers."""
    body = F.substring(output, 4, 2**31 - 1)
    psm, spm = F.split(body, f"{SUFFIX}|{MIDDLE}", -1), F.split(body, f"{PREFIX}|{MIDDLE}", -1)
    return (F.when(form == "plain", output)
             .when(form == "psm", F.concat(F.get(psm, 0), F.get(psm, 2), F.get(psm, 1)))
             .otherwise(F.concat(F.get(spm, 1), F.get(spm, 2), F.get(spm, 0))))
