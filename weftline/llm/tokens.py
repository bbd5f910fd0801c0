"""Sizes of texts in tokens of a public tokenizer.

The vocabulary file (ranks of a byte-level BPE) is read once by the driver and
broadcast; it has a fixed size, and executors need no copy of their own.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.session import ship

#: Folder and file of the vocabulary; both may be given by the caller.
FOLDER = os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
MAX_VOCABULARY_BYTES = 16 << 20
#: The split before the merges that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_READY: dict[int, object] = {}


def encoder(data: bytes):
    """The tokenizer of a rank file, built once a process."""
    key = hash(data)
    if key not in _READY:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        _READY[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _READY[key]


def count_tokens(enc, text: str, piece: int = 1 << 20) -> int:
    """Tokens of a text.  A very long text is counted in parts cut at line feeds, where the split cuts as well."""
    if len(text) <= piece:
        return len(enc.encode_ordinary(text))
    total, a = 0, 0
    while a < len(text):
        b = min(len(text), a + piece)
        if b < len(text):
            cut = text.rfind("\n", a, b)
            while cut > a and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace()):  # a run of blanks is one split
                cut = text.rfind("\n", a, cut)
            b = cut if cut > a else b
        total += len(enc.encode_ordinary(text[a:b]))
        a = b
    return total


def vocabulary(path: str | None = None) -> bytes:
    """The bytes of the rank file; its size is checked before it is broadcast."""
    path = path or os.path.join(FOLDER, VOCABULARY)
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than a vocabulary")
    with open(path, "rb") as f:
        return f.read()


def token_sizes(documents: DataFrame, *columns: str, path: str | None = None) -> DataFrame:
    """doc_id, the further columns, and tokens: the size of ``text`` (0 for null or empty)."""
    spark = ship(documents.sparkSession)
    shared = spark.sparkContext.broadcast(vocabulary(path))
    kept = documents.select("doc_id", *columns, "text")
    names = ["doc_id", *columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in batches:
            n = [count_tokens(enc, x) if x else 0 for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(n, pa.int64())], names=[*names, "tokens"])

    return kept.mapInArrow(run, schema)
