"""Fill-in-the-middle: texts cut at two places and put in another order around the marks <P>, <S> and <M>.

A slice of a batch is one array of bytes. A scan marks where its units begin (a run of A-Z and a-z, or any other code
point) and finds the two cuts of each text. Every byte of one part of a text moves by the same distance, so a
difference array, with one step where a part begins, has the distances as its cumulative sum, and one numpy scatter
writes all outputs of the slice; the marks go to the places between. Restoring reads the marks in the output alone and
gathers by the inverse distances. Scan, scatter and gather go over windows of WINDOW bytes, so besides texts and
outputs themselves a task holds a few arrays of a window, whatever the length of a text.

The cuts follow from the id: the first four groups of eight digits of the hex sha256 of `1:` and the decimal id, a null
id being no digits. A null text is empty. An empty text, one that holds a mark, and a tenth of the others stay plain.
Equal rows give equal results, an empty table none, and other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 1 << 20
SLICE = 1 << 23
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ["plain", "psm", "spm"]
MARKS = {name: np.frombuffer(f"<{name}>".encode(), np.uint8) for name in "PSM"}
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def counts_before(flags: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many flags are set before each of the ascending places."""
    out, total, k = np.empty(len(places), np.int64), 0, 0
    for lo in range(0, len(flags) + 1, WINDOW):
        run = np.concatenate([[0], np.cumsum(flags[lo:lo + WINDOW])])
        end = int(np.searchsorted(places, lo + WINDOW))
        out[k:end] = total + run[places[k:end] - lo]
        total, k = total + int(run[-1]), end
    return out


def places_of(flags: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Place of the set flag of each ascending rank, from 0; the length of flags beyond the last one."""
    out, total, k = np.full(len(ranks), len(flags), np.int64), 0, 0
    for lo in range(0, len(flags), WINDOW):
        at = np.flatnonzero(flags[lo:lo + WINDOW])
        end = int(np.searchsorted(ranks, total + len(at)))
        out[k:end] = lo + at[ranks[k:end] - total]
        total, k = total + len(at), end
    return out


def displacements(size: int, breaks: np.ndarray, levels: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Windows of byte places plus their distances: levels[i] holds from breaks[i] on. Yields (first place, places)."""
    steps = np.diff(levels, prepend=0)
    carry, k = 0, 0
    for lo in range(0, size, WINDOW):
        hi = min(size, lo + WINDOW)
        end = int(np.searchsorted(breaks, hi))
        change = np.zeros(hi - lo, np.int64)
        np.add.at(change, breaks[k:end] - lo, steps[k:end])
        shift = np.cumsum(change) + carry
        carry, k = int(shift[-1]), end
        yield lo, np.arange(lo, hi) + shift


def mark_places(data: np.ndarray) -> np.ndarray:
    """Places of all marks in the bytes."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    found = [lo + np.flatnonzero((part[:-2] == ord("<")) & (part[2:] == ord(">")) & np.isin(part[1:-1], [*b"PSM"]))
             for lo in range(0, len(data) - 2, WINDOW) if len(part := data[lo:lo + WINDOW + 2])]
    return np.concatenate(found)


def rows_of(places: np.ndarray, width: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose next `width` bytes lie in one text, and the number of that text."""
    row = np.searchsorted(offsets, places, side="right") - 1
    inside = places + width <= offsets[row + 1] if len(places) else np.zeros(0, bool)
    return places[inside], row[inside]


def transform(data: np.ndarray, offsets: np.ndarray, h: np.ndarray) -> dict[str, np.ndarray]:
    """Units, forms, part lengths in code points, and the bytes and offsets of the outputs of all texts of a slice.

    h: one row of four numbers for each text, which choose its cuts and form.
    """
    starts, ends, rows = offsets[:-1], offsets[1:], len(offsets) - 1
    lower = (data | 0x20) - np.uint8(ord("a"))
    letter = lower < 26
    first = (data & 0xC0) != 0x80
    unit = first.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    unit[starts[starts < ends]] = True
    before = counts_before(unit, offsets)
    n = np.diff(before)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    cut = places_of(unit, (before[:-1, None] + cuts).ravel()).reshape(rows, 2)
    middle, suffix = np.minimum(cut[:, 0], ends), np.minimum(cut[:, 1], ends)
    form = np.where(h[:, 3] % 100 < 20, SPM, PSM)
    _, marked = rows_of(mark_places(data), 3, offsets)
    form[(n == 0) | (h[:, 2] % 100 >= 90)] = PLAIN
    form[marked] = PLAIN
    size_p, size_m, size_s = middle - starts, suffix - middle, ends - suffix
    out = np.concatenate([[0], np.cumsum(ends - starts + 9 * (form != PLAIN))])
    base, psm, spm = out[:-1], form == PSM, form == SPM
    to_p = base + np.select([psm, spm], [3, 6 + size_s])
    to_m = base + np.where(form == PLAIN, size_p, 9 + size_p + size_s)
    to_s = base + np.select([psm, spm], [6 + size_p, 3], size_p + size_m)
    target = np.empty(out[-1], np.uint8)
    breaks = np.column_stack([starts, middle, suffix])
    for lo, places in displacements(len(data), breaks.ravel(), (np.column_stack([to_p, to_m, to_s]) - breaks).ravel()):
        target[places] = data[lo:lo + len(places)]
    moved = form != PLAIN
    for name, to in zip("PMS", (to_p, to_m, to_s)):
        target[(to[moved] - 3)[:, None] + np.arange(3)] = MARKS[name]
    points = np.diff(counts_before(first, np.column_stack([breaks, ends]).ravel()).reshape(rows, 4), axis=1)
    return {"n": n, "form": form, "prefix": points[:, 0], "middle": points[:, 1], "data": target, "offsets": out}


def restore(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts, from outputs and forms alone."""
    marks, row = rows_of(mark_places(data), 3, offsets)
    marks = marks[form[row] != PLAIN]
    moved = form != PLAIN
    if len(marks) != 3 * moved.sum():
        raise ValueError("an output does not hold its three marks once each")
    a, b, c = (np.zeros(len(form), np.int64) for _ in range(3))
    a[moved], b[moved], c[moved] = marks.reshape(-1, 3).T
    starts, ends = offsets[:-1], offsets[1:]
    psm = form == PSM
    one, two, last = (a + 3, b - a - 3), (b + 3, c - b - 3), (np.where(moved, c + 3, ends), np.where(moved, ends - c - 3, 0))
    from_p, size_p = (np.where(moved, np.where(psm, x, y), z) for x, y, z in zip(one, two, (starts, ends - starts)))
    from_s, size_s = (np.where(moved, np.where(psm, y, x), z) for x, y, z in zip(one, two, (ends, 0)))
    out = np.concatenate([[0], np.cumsum(size_p + last[1] + size_s)])
    breaks = np.column_stack([out[:-1], out[:-1] + size_p, out[:-1] + size_p + last[1]])
    text = np.empty(out[-1], np.uint8)
    for lo, places in displacements(len(text), breaks.ravel(), (np.column_stack([from_p, last[0], from_s]) - breaks).ravel()):
        text[lo:lo + len(places)] = data[places]
    return text, out


def _bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an array without nulls, and the offsets of its texts in them."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def _texts(data: np.ndarray, offsets: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def slices(texts: pa.StringArray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have `limit` bytes together, or one row."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield at, end
        at = end


def digits(doc_id: Column) -> list[Column]:
    """The four numbers that choose a document's cuts and form."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def infill(docs: DataFrame, restored: bool = False) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of each document; if asked, the text `restored`
    from output and form."""
    schema = RESULT + (", restored string" if restored else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for at, end in slices(texts):
                part = batch.slice(at, end - at)
                h = np.column_stack([part.column(f"h{k}").to_numpy() for k in range(1, 5)])
                got = transform(*_bytes(texts.slice(at, end - at)), h)
                plain = got["form"] == PLAIN
                columns = [part.column("doc_id"), pa.array(got["n"]), pa.array(np.array(FORMS, object)[got["form"]], pa.string()),
                           pa.array(got["prefix"], mask=plain), pa.array(got["middle"], mask=plain), _texts(got["data"], got["offsets"])]
                if restored:
                    columns.append(_texts(*restore(got["data"], got["offsets"], got["form"])))
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return wanted.select("doc_id", "text", *digits(F.col("doc_id"))).mapInArrow(run, schema)


def restore_texts(df: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """All columns of df with `restored`, the text of each output and form. A null output or form gives null."""

    @F.arrow_udf("string")
    def back(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        known = pc.and_(pc.is_valid(outputs), pc.is_valid(forms))
        texts, kinds = pc.fill_null(outputs, ""), np.array([FORMS.index(f) if v else PLAIN for f, v in zip(forms.to_pylist(), known.to_pylist())], int)
        done = [_texts(*restore(*_bytes(texts.slice(at, end - at)), kinds[at:end])) for at, end in slices(texts)]
        return pc.if_else(known, pa.concat_arrays(done) if done else texts, None)

    return df.withColumn("restored", back(F.col(output), F.col(form)))
