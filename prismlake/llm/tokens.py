"""Token counts of texts under a byte-level BPE vocabulary whose file is a parameter.

The vocabulary's pattern never lets a token cross from a non-blank into the following blank, so a text may be counted
chunk by chunk between single blanks, and each distinct chunk is encoded once per worker. The sum equals the count of
encoding the whole text at once; texts with other white space are cut only where a single blank stands between two
non-blanks. Null and empty texts have 0 tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 400_000
_UNSAFE = 1 << 40


def load(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter(dict):
    """chunk -> tokens of the chunk behind `lead`; chunks that can't be counted alone have _UNSAFE."""

    def __init__(self, encode, lead: str):
        self.encode, self.lead = encode, lead

    def __missing__(self, chunk: str) -> int:
        if len(self) > CACHE:
            self.clear()
        n = _UNSAFE if not chunk or chunk[0].isspace() or chunk[-1].isspace() else len(self.encode(self.lead + chunk))
        self[chunk] = n
        return n


def counter(path: str):
    import re

    encode = load(path).encode_ordinary
    first, rest = Counter(encode, ""), Counter(encode, " ")
    cut = re.compile(r"(?<=\S) (?=\S)")

    def count(text: str | None) -> int:
        if not text:
            return 0
        parts = text.split(" ")
        n = first[parts[0]] + sum(map(rest.__getitem__, parts[1:]))
        if n >= _UNSAFE:
            parts = cut.split(text)
            n = len(encode(parts[0])) + sum(len(encode(" " + p)) if p[-1:].isspace() or p[:1].isspace() or not p else rest[p] for p in parts[1:])
        return n

    return count


def with_tokens(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """docs without the text and with its number of tokens."""
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(vocabulary)
        for pdf in batches:
            out = pdf[keep].copy()
            out[name] = [count(t) for t in pdf[text]]
            yield out

    schema = docs.select(*keep, F.lit(0).cast("long").alias(name)).schema
    return docs.mapInPandas(run, schema)
