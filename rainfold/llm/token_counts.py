"""Token counts of whole texts by a whole-token shortcut.

Before a job starts, `proven_tokens` encodes each string of the vocabulary alone and keeps those that come back as one
token. A text is split into pre-tokens by the vocabulary's own pattern; pre-tokens in that table count one each, and only
the rest is merged (by the tokenizer's library, each distinct one once a task as long as the memory of counts holds it).
Texts are split at the special strings first, as the library does by default; each of those counts one.

The table has at most as many entries as the vocabulary, a fixed size. Null and empty texts have no tokens; repeated rows give a
row each, an empty table none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rainfold.llm.common import batch_of, fields, slices, with_input

VOCABULARY = "byte_bpe_50k.json"
#: Distinct merged pre-tokens a task remembers before it starts anew.
REMEMBERED = 400_000
#: Characters that pattern libraries of different Unicode versions class differently (found by asking the two libraries
#: about every character; planes without a difference are left out). A text that holds one goes to the tokenizer's library.
UNSURE = regex.compile("[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7f1\uab6c\uab6d\U00010000-\U0001efff\U00020000-\U0010ffff]")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    got = Tokenizer.from_file(path)
    got.no_truncation()
    got.no_padding()
    return got


def byte_alphabet() -> dict[str, int]:
    """Byte of each letter that byte-level vocabularies are written in: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def proven_tokens(path: str) -> frozenset[str]:
    """Strings of the vocabulary that the library encodes alone as one token. Fragments of characters are no strings."""
    library, letters = tokenizer(path), byte_alphabet()
    special = {t.content for t in library.get_added_tokens_decoder().values()}
    strings = []
    for token in library.get_vocab(with_added_tokens=False):
        try:
            strings.append(bytes(letters[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    coded = library.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, coded, strict=True) if len(e.ids) == 1 and s not in special)


class Counter:
    """Counts tokens of texts; made once a task."""

    def __init__(self, path: str, proven: frozenset[str]):
        self.library, self.proven = tokenizer(path), proven
        self.special = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.at_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.known: dict[str, int] = dict.fromkeys(proven, 1)

    def __call__(self, texts: Sequence[str]) -> list[int]:
        if len(self.known) > REMEMBERED + len(self.proven):
            self.known = dict.fromkeys(self.proven, 1)
        out, parts = [0] * len(texts), []
        for i, text in enumerate(texts):
            if not text.isascii() and UNSURE.search(text):
                out[i] = len(self.library.encode(text, add_special_tokens=False).ids)
                continue
            if self.at_special and self.at_special.search(text):
                out[i] = len(self.at_special.findall(text))
                parts += [(i, self.split(p)) for p in self.at_special.split(text) if p]
            else:
                parts.append((i, self.split(text)))
        rest = list({t for _, found in parts for t in found if t not in self.known})
        for a in range(0, len(rest), 4096):
            some = rest[a : a + 4096]
            self.known.update(zip(some, (len(e.ids) for e in self.library.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        for i, found in parts:
            out[i] += sum(map(self.known.__getitem__, found))
        return out


def count_tokens(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), path: str | None = None) -> DataFrame:
    """keep + (n_tokens BIGINT): tokens of every whole text."""
    path = path or public_tokenizers.path(VOCABULARY)
    proven = df.sparkSession.sparkContext.broadcast(proven_tokens(path))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(path, proven.value)
        for b in slices(batches, [name]):
            yield batch_of(b, keep, n_tokens=pa.array(count([t or "" for t in b.column(name).to_pylist()]), pa.int64()))

    made, name = with_input(df, keep, text, "text__")
    return made.mapInArrow(kernel, ", ".join(filter(None, [fields(df, keep), "n_tokens bigint"])))


def token_count_report(docs: DataFrame, limit: int = 512) -> DataFrame:
    """The contract columns of op8."""
    sized = docs.select("doc_id", F.coalesce(F.octet_length(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return count_tokens(sized, "text", ["doc_id", "n_bytes"]).withColumn("over_limit", F.col("n_tokens") > limit)
