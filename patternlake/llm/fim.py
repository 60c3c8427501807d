"""Fill-in-middle: texts cut at line ends into prefix, middle and suffix, written in one of two orders, and put together again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk, besides the one that it shares with the chunk before.
CHUNK = 4096
NEWLINE = 10


class Cutter:
    """Places of line starts in many texts that lie one after the other in one buffer.

    The buffer is taken apart into chunks of ``size`` bytes, none over two texts, each of which reads the last byte of the chunk before as well: a unit begins
    where a text does or where the byte before is a newline, so a look at two neighbouring bytes decides, and each chunk counts its own starts (and code points)
    without the others. Prefix sums over the counts say which chunk owns the start of a given rank; only that chunk is scanned again.
    """

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int = CHUNK):
        self.begin, self.end = begin, end
        self.starts = np.zeros(len(data), bool)
        self.starts[1:] = data[:-1] == NEWLINE
        self.starts[begin[end > begin]] = True
        self.leads = (data & 0xC0) != 0x80  # bytes that begin a code point
        per = -(-(end - begin) // size)
        doc = np.repeat(np.arange(len(begin)), per)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        self.low = begin[doc] + at * size
        self.high = np.minimum(self.low + size, end[doc])
        self.units = self._counts(self.starts)
        self.chars = self._counts(self.leads)
        first = np.cumsum(per) - per
        self.unit_sum, self.char_sum = np.concatenate([[0], np.cumsum(self.units)]), np.concatenate([[0], np.cumsum(self.chars)])
        self.unit_base, self.char_base = self.unit_sum[first], self.char_sum[first]
        self.n = self.unit_sum[first + per] - self.unit_base
        self.n_chars = self.char_sum[first + per] - self.char_base

    def _counts(self, mark: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mark, self.low, dtype=np.int64) if len(self.low) else np.zeros(0, np.int64)

    def cut(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte, code points before it) of where unit ``rank`` of each text begins; of its end for a rank that is the number of units."""
        byte, chars = self.end.copy(), self.n_chars.copy()
        inner = np.flatnonzero(rank < self.n)
        want = self.unit_base[inner] + rank[inner]
        owner = np.searchsorted(self.unit_sum, want, side="right") - 1
        for d, c, left in zip(inner.tolist(), owner.tolist(), (want - self.unit_sum[owner]).tolist()):
            low = int(self.low[c])
            at = low + int(np.flatnonzero(self.starts[low : self.high[c]])[left])
            byte[d], chars[d] = at, self.char_sum[c] - self.char_base[d] + int(self.leads[low:at].sum())
        return byte, chars


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begin, end) of a column of strings, null as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    whole = column.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]] if whole is not None else np.zeros(0, np.uint8)
    return data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0]


def arrange(docs: DataFrame, fim_percent: int = 100, spm_percent: int = 50, seed: int = 7, chunk: int = CHUNK) -> DataFrame:
    """Rearrange every whole text of ``docs`` (doc_id, text); null counts as empty, a null id hashes as the empty string.

    A text has n lines, newline included; the last may lack one. Cuts, form and order come from the SHA-256 of ``seed:doc_id``, so a row's result depends on nothing but itself.
    Returns doc_id, n, form (``plain``, ``psm`` or ``spm``), prefix_chars and middle_chars (code points; null if plain) and output. Texts that are empty or hold a
    marker stay plain. Repeated rows each return; other columns are ignored. No shuffle: a task goes through its batches and holds one at a time.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    marks = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches):
        for b in batches:
            data, begin, end = _texts(b.column(1))
            h1, h2, h3, h4 = (b.column(k).to_numpy() for k in (2, 3, 4, 5))
            c = Cutter(data, begin, end, chunk)
            one, two = h1 % (c.n + 1), h2 % (c.n + 1)
            (cut1, chars1), (cut2, chars2) = c.cut(np.minimum(one, two)), c.cut(np.maximum(one, two))
            forms, outputs = [], []
            for k in range(len(begin)):
                text = data[begin[k] : end[k]].tobytes()
                if not text or h3[k] % 100 >= fim_percent or any(m in text for m in marks):
                    forms.append("plain")
                    outputs.append(text)
                    continue
                i, j = int(cut1[k] - begin[k]), int(cut2[k] - begin[k])
                prefix, middle, suffix = text[:i], text[i:j], text[j:]
                spm = h4[k] % 100 < spm_percent
                forms.append("spm" if spm else "psm")
                p, s, m = marks
                outputs.append(b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle)))
            plain = np.array([f == "plain" for f in forms], bool)
            counts = [pa.array(c.n, pa.int64()), pa.array(forms, pa.string()), pa.array(chars1, pa.int64(), mask=plain), pa.array(chars2 - chars1, pa.int64(), mask=plain)]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(outputs, pa.string())], names)

    return docs.select("doc_id", "text", *hashes).mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that ``arrange`` had taken apart. Its markers are the only ones: a text that held one is plain, and none arises where pieces meet."""
    parts = F.split(output, "<[PSM]>", -1)
    psm, spm = (F.concat(*[F.get(parts, F.lit(k)) for k in order]) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
