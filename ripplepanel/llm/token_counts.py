"""Token counts per document, from one count per distinct pre-token.

Byte-pair merges never cross the pre-tokens that the tokenizer cuts a text into, so a document's count is
the sum of its pre-tokens' counts. A task takes its documents in blocks. For each block it builds the table of
per-document pre-token frequencies, counts the pieces of each pre-token that its table of counts does not hold yet,
joins the two tables by number, and adds up per document. The table of counts goes from block to block and is
emptied beyond ``KNOWN`` pre-tokens, so memory stays bounded and rows never leave their task. Ids are not kept. A
text that holds an added token's string (one id, as the library does by default) is cut there first.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplepanel.llm.common import chunks, texts

#: The byte-level pattern (fixed value of this kind of tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Outside of these the regex module and the tokenizer know different Unicode versions; such texts are cut by the tokenizer.
AGREED = r"[^\x00-՗‐-⁞₠-₿　-〩一-龥가-힣]"
KNOWN, ENCODE = 600_000, 2_000


class PieceCounter:
    """Cuts texts into pre-tokens as a byte-level tokenizer file says, and counts the pieces of pre-tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("a byte-level tokenizer without normalizer and prefix space is needed")
        odd = [t for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"]]
        if odd:
            raise ValueError(f"added tokens that take in their neighbourhood: {odd}")
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.cut, self.strange = regex.compile(PATTERN).findall, regex.compile(AGREED).search
        self.pieces: dict[str, int] = {}

    def plain(self, text: str) -> list[str]:
        if text.isascii() or not self.strange(text):
            return self.cut(text)
        spans = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in spans]

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """The pre-tokens with their frequency, and how many added tokens stand between them."""
        if self.added is None or not self.added.search(text):
            return Counter(self.plain(text)), 0
        parts = self.added.split(text)
        return Counter(p for part in parts if part for p in self.plain(part)), len(parts) - 1

    def learn(self, pre_tokens: list[str]) -> None:
        """Count the pieces of distinct pre-tokens that are not known yet."""
        for i in range(0, len(pre_tokens), ENCODE):
            few = pre_tokens[i : i + ENCODE]
            found = self.tokenizer.encode_batch(few, add_special_tokens=False)
            self.pieces.update(zip(few, map(len, found), strict=True))

    def count(self, block: list[str]) -> np.ndarray:
        """Tokens of each text of a block."""
        per_text = [self.frequencies(t) for t in block]
        if len(self.pieces) > KNOWN:
            self.pieces.clear()
        self.learn(list(set().union(*(f for f, _ in per_text)) - self.pieces.keys()))
        at = np.repeat(np.arange(len(block)), [len(f) for f, _ in per_text])
        freq = np.fromiter((n for f, _ in per_text for n in f.values()), np.int64, len(at))
        pieces = np.fromiter((self.pieces[p] for f, _ in per_text for p in f), np.int64, len(at))
        sums = np.zeros(len(block), np.int64)
        np.add.at(sums, at, freq * pieces)
        return sums + np.array([extra for _, extra in per_text], np.int64)


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens`` for every row of ``docs``, from its whole text.

    A null or empty text has 0 tokens. Rows that repeat a key, with the same text or another, keep a row
    each; so does a null key. An empty table gives an empty table. Other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(path)
        for batch in batches:
            for block in chunks(batch):
                counts = counter.count(block.column("text").to_pylist())
                sizes = pa.compute.binary_length(block.column("text")).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([block.column("row_key"), sizes, pa.array(counts)], ["row_key", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).alias("row_key"), F.col(text).alias("text"))
    kind = rows.schema["row_key"].dataType.simpleString()
    return texts(rows, keys=("row_key",)).mapInArrow(
        run, f"row_key {kind}, n_bytes long, n_tokens long").withColumnRenamed("row_key", key)
