"""Fill-in-middle forms of texts (operator 11).

A Split pre-tokenizer of the tokenizers library, with isolated matches of a regular expression, gives the code-point
offsets of a text's units, without any training. The offset array has two levels: one pattern matches BLOCK code
points at once and gives every BLOCK-th offset; the other matches single code points and gives the offsets inside the
blocks that are asked for. Their lengths give n, and the offsets of two ranks cut prefix, middle and suffix.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import free

#: Code points in a block, and those that the pre-tokenizer is given at once (a multiple of BLOCK), so that memory stays bounded on long texts.
BLOCK, SLAB = 32, 1 << 15


class Sentinels(NamedTuple):
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


@lru_cache(maxsize=1)
def _splits():
    from tokenizers import Regex, pre_tokenizers

    return (pre_tokenizers.Split(Regex(f"(?m:.{{1,{BLOCK}}})"), "isolated"), pre_tokenizers.Split(Regex("(?m:.)"), "isolated"))


class Offsets:
    """Code-point offsets of the units of a text, by rank; n is their number."""

    def __init__(self, text: str):
        blocks, _ = _splits()
        self.text = text
        self.starts = [at + a for at in range(0, len(text), SLAB) for _, (a, _) in blocks.pre_tokenize_str(text[at : at + SLAB])]
        self.n = BLOCK * (len(self.starts) - 1) + len(self._inside(-1)) if self.starts else 0

    def _inside(self, block: int) -> list[int]:
        at = self.starts[block]
        return [at + a for _, (a, _) in _splits()[1].pre_tokenize_str(self.text[at : at + BLOCK])]

    def __getitem__(self, rank: int) -> int:
        return len(self.text) if rank == self.n else self._inside(rank // BLOCK)[rank % BLOCK]


def draws(key: str, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a key: the first groups of eight hex digits of the SHA-256 of `seed:key`."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def transform(text: str, key: str, seed: int, plain: int, spm: int, marks: Sentinels) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix length, middle length, output) of one text."""
    cuts = Offsets(text)
    h1, h2, h3, h4 = draws(key, seed)
    if not text or any(m in text for m in marks) or h3 % 100 >= 100 - plain:
        return cuts.n, "plain", None, None, text
    a, b = sorted((h1 % (cuts.n + 1), h2 % (cuts.n + 1)))
    i, j = cuts[a], cuts[b]
    head, mid, tail = text[:i], text[i:j], text[j:]
    if h4 % 100 < spm:
        return cuts.n, "spm", a, b - a, f"{marks.suffix}{tail}{marks.prefix}{head}{marks.middle}{mid}"
    return cuts.n, "psm", a, b - a, f"{marks.prefix}{head}{marks.suffix}{tail}{marks.middle}{mid}"


_FIM = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
FIM = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: int = 1, plain: int = 10, spm: int = 20, marks: Sentinels = Sentinels(), out: str = "fim") -> DataFrame:
    """docs with a struct (FIM) named out, or out and underscores where docs has that column (see common.free).

    plain percent of the texts stay as they are, so do empty ones and those that hold a sentinel; of the others spm
    percent begin with the suffix. A null text counts as empty, a null id as an empty key. Every row is decided by its
    own id and text: repeated rows give repeated results, equal ids draw alike, and no row is moved to another task.
    """
    name = free(docs, out)
    at, key = docs.columns.index(text_col), docs.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, text_col, 1 << 22):
                keys = ["" if k is None else str(k) for k in part.column(key).to_pylist()]
                rows = [transform(t.as_py() or "", k, seed, plain, spm, marks) for k, t in zip(keys, part.column(at), strict=True)]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                made = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FIM, strict=True)], fields=list(_FIM))
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DataType.fromDDL(FIM))]))


def parts(output: Column, form: Column, marks: Sentinels = Sentinels()) -> Column:
    """The three pieces of an output in the order in which they stand, null for the plain form. A text holds no sentinel unless it is plain, so the first ones found are the real ones."""

    def cut(first: str, second: str, third: str) -> Column:
        return F.split(F.substr(output, F.lit(len(first) + 1)), f"{re.escape(second)}|{re.escape(third)}", 3)

    return F.when(form == "psm", cut(marks.prefix, marks.suffix, marks.middle)).when(form == "spm", cut(marks.suffix, marks.prefix, marks.middle))


def restored(pieces: Column, output: Column, form: Column) -> Column:
    """The exact text, from parts() of an output, in built-in functions."""
    return F.when(form == "psm", F.concat(pieces[0], pieces[2], pieces[1])).when(form == "spm", F.concat(pieces[1], pieces[2], pieces[0])).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """The columns of the op11 query: lengths, form and the digests of the output and of the text that is rebuilt from it."""
    made = fill_in_middle(docs.select("doc_id", "text")).select("doc_id", "fim.*")
    cut = made.withColumn("pieces", parts(F.col("output"), F.col("form")))
    text = restored(F.col("pieces"), F.col("output"), F.col("form"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(text.cast("binary"), 256).alias("restored_sha256"),
    )
