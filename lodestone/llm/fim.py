"""Fill-in-middle: texts cut at chosen tokens and put together again with the middle last."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: What stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Documents whose pieces a worker holds at a time, within shared.SLICE_BYTES of text.
SLICE = 1000


def token_ends(codes: np.ndarray) -> np.ndarray:
    """Where the tokens of a text, given by its code points, begin and end: 0, the end of each token. A token is a word with the
    white space before it, or the white space at the end; so one ends wherever a word meets white space, and at the end."""
    if not len(codes):
        return np.zeros(1, np.int64)
    white = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
    return np.concatenate([[0], np.flatnonzero(white[1:] & ~white[:-1]) + 1, [len(codes)]])


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2^32 that depend on seed and id only; a null id counts as an empty one."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(text: str, h: list[int], rate: int, spm: int, markers: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """Tokens, form, characters of prefix and middle, and the text in that form."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = token_ends(codes)
    n = len(ends) - 1
    if not text or h[2] % 100 >= rate or any(m in text for m in markers):
        return n, "plain", None, None, text
    i, j = sorted(int(ends[x % (n + 1)]) for x in h[:2])
    prefix, middle, suffix = (codes[a:b].tobytes().decode("utf-32-le") for a, b in ((0, i), (i, j), (j, len(codes))))
    p, s, m = markers
    if h[3] % 100 < spm:
        return n, "spm", i, j - i, "".join([s, suffix, p, prefix, m, middle])
    return n, "psm", i, j - i, "".join([p, prefix, s, suffix, m, middle])


def _checked(markers: tuple[str, str, str]) -> None:
    for m in markers:
        if not m or any(m[0] in other[1:] for other in markers) or any(m is not other and other.startswith(m) for other in markers):
            raise ValueError("a marker's first character must stand nowhere else in a marker, and no marker may begin another")


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, markers: tuple[str, str, str] = MARKERS, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with n (tokens), form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and output.

    rate of a hundred documents are cut, spm of a hundred of those have the suffix first; both and the cuts follow from
    seed and id, so reruns agree. Each text becomes an array of code points; ends of tokens are where neighbouring classes
    differ. Defined results: a null text counts as empty; empty texts and ones that hold a marker stay plain, so output can
    always be undone; a null id counts as an empty one; rows that share an id are cut at the same shares of their tokens; an
    empty table gives an empty result; columns with the new names are replaced, others stay. A text is never cut short; a
    worker holds one slice of texts at a time. Bytes that aren't UTF-8 become U+FFFD.
    """
    _checked(markers)
    new = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}
    kept = docs.drop(*(c for c in new if c not in (id_col, text_col)))
    names = [c for c in kept.columns if (keep_text or c != text_col) and c not in new]

    given = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with shared.worker("fim"):
            for batch in batches:
                batch = batch.rename_columns(given)
                for part in shared.parts(batch, text_col, SLICE):
                    texts = [(b or b"").decode("utf-8", "replace") for b in part.column(text_col).cast(pa.binary()).to_pylist()]
                    rows = [cut(t, draws(seed, i), rate, spm, markers) for t, i in zip(texts, part.column(id_col).to_pylist(), strict=True)]
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                    made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *made], names=[*names, *new])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in names), *(f"`{n}` {t}" for n, t in new.items())])
    return kept.toDF(*(f"c{i}" for i in range(len(given)))).mapInArrow(run, schema)  # names may hold dots


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that transform() made output and form of. Markers can't arise where pieces meet, as their first character
    stands nowhere else in them, so output has just the three that were put there."""
    _checked(markers)
    parts = F.split(output, "|".join(map(re.escape, markers)), -1)
    join = lambda *at: F.concat(*(F.element_at(parts, i) for i in at))
    return F.when(form == "psm", join(2, 4, 3)).when(form == "spm", join(3, 4, 2)).otherwise(output)
