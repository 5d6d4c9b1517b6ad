"""Token counts by the whole-token shortcut.

A vocabulary string that the tokenizer, given it alone, encodes as exactly one token is proven to count 1 wherever the
pre-tokenizer yields it: this tokenizer merges within a pre-token only, and a pre-token taken alone is split off as itself.
These strings are found once, on the driver, by encoding the whole vocabulary, and sent to the tasks. Texts are normalised and cut into
pre-tokens here; pre-tokens in the proven set count 1, others are merged by the library and remembered. Texts with characters
outside the ranges in which the normaliser is the plain lower-casing done here go to the library whole.

Rules for odd input: a null or empty text has 0 bytes and 0 tokens; strings of special tokens inside a text count one token each,
as the library's default has it; repeated rows give repeated rows; a null doc_id stays null.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches

#: Characters that need no normalisation beyond lower-casing; U+0130 lower-cases to a decomposed pair and is left out.
_PLAIN = [chr(c) for c in range(0x300) if c != 0x130] + [chr(c) for r in ((0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20C0)) for c in range(*r)]


def _cls(test) -> str:
    return "".join(re.escape(c) for c in _PLAIN if test(c))


_SPACES = "".join(re.escape(c) for c in "\t\n\v\f\r \x85\xa0")
_LETTERS = _cls(lambda c: unicodedata.category(c)[0] == "L")
_NUMBERS = _cls(lambda c: unicodedata.category(c)[0] == "N")
_OTHER_RANGE = re.compile("[^" + _cls(lambda c: True) + "]")
#: Fixed value: the tokenizer's own split pattern, with its classes written out for the plain range.
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")


class PieceCounts(dict):
    """pre-token -> tokens; the proven strings stay, what was merged is forgotten when there are ``most`` of it."""

    def __init__(self, tokenizer, proven: dict[str, int], most: int = 400_000):
        super().__init__(proven)
        self.tokenizer, self.proven, self.most = tokenizer, proven, most + len(proven)

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
                self.update(self.proven)
            self[piece] = n
        return n


def _byte_chars() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, others follow U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def proven_whole(tokenizer) -> dict[str, int]:
    """Vocabulary strings that, encoded alone, are one token and one pre-token."""
    specials = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    as_byte = _byte_chars()
    candidates = []
    for piece in tokenizer.get_vocab(with_added_tokens=False):
        if piece.endswith("</w>") and piece not in specials:
            text = bytes(as_byte[c] for c in piece[:-4]).decode("utf-8", "ignore")
            if text and not _OTHER_RANGE.search(text) and text == text.lower() and _SPLIT.findall(text) == [text]:
                candidates.append(text)
    codes = tokenizer.encode_batch(candidates, add_special_tokens=False)
    return {text: 1 for text, e in zip(candidates, codes) if len(e.ids) == 1}


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _counter(path: str, proven: dict[str, int]):
    tokenizer = _tokenizer(path)
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    pieces_ = PieceCounts(tokenizer, proven)
    at_special = re.compile("|".join(map(re.escape, specials))) if specials else None

    def count(text: str) -> int:
        if not text:
            return 0
        if not text.isascii() and _OTHER_RANGE.search(text):
            return len(tokenizer.encode(text, add_special_tokens=False).ids)
        n, parts = 0, [text]
        if at_special and "<|" in text:
            parts = at_special.split(text)
            n = len(parts) - 1
        for p in parts:
            n += sum(map(pieces_.__getitem__, _SPLIT.findall(p.lower())))
        return n

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; no shuffle.

    ``tokenizer_path`` must be readable on the driver and on every executor, as an installed package's file is. Which strings are whole
    tokens is proven once, on the driver, and sent along: as many as the vocabulary has at most.
    """
    proven = docs.sparkSession.sparkContext.broadcast(proven_whole(_tokenizer(tokenizer_path)))

    def run(batches):
        count = _counter(tokenizer_path, proven.value)
        for b in pieces(batches, 500):
            texts = b.column(1).to_pylist()
            n = pa.array([count(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n, b.column(2)], ["doc_id", "n_tokens", "n_bytes"])

    text = F.coalesce(F.col("text"), F.lit(""))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = small_batches(docs).select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, n_bytes long"
    )
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
