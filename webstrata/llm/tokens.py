"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at blanks (no token spans one), each piece is normalised and cut into pre-tokens as the vocabulary file
says, and every pre-token starts as one symbol a byte. A heap holds the adjacent pairs by merge rank; the lowest is
popped, its right symbol is unlinked, and the two pairs that arise are pushed. The count is the symbols at the start
less the merges made; no identifier is ever looked up. Pieces repeat, so their counts are kept in a bounded memo.

Null text counts as empty (0 bytes, 0 tokens); an empty table gives an empty result; repeated rows give one row each;
columns beyond the identifier and the text are ignored. Strings of special tokens inside a text count one token each,
as the library's default has it.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, as_bytes, bounded_batches, claim

#: Unicode's White_Space, as the vocabulary's patterns mean it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairMerger:
    """Counts the tokens of one piece of text (bytes without blanks)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.ranks = {(a, b): n for n, (a, b) in enumerate(spec["model"]["merges"])}
        self.letters = byte_letters()
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        split = next(s["pattern"]["Regex"] for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split")
        self.pattern = regex.compile(split.replace(r"[^\s", f"[^{SPACE}"))

    def merged(self, symbols: list[str]) -> int:
        """The number of symbols that stay once no adjacent pair can merge."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # a neighbour has merged since this pair was pushed
            symbols[i], symbols[j] = left + right, ""
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return n - merges

    def plain(self, text: str) -> int:
        text = unicodedata.normalize("NFC", text)
        text = text.lower() if text.isascii() else "".join(c.lower() for c in text)
        total = 0
        for word in self.pattern.findall(text):
            symbols = [self.letters[b] for b in word.encode()]
            symbols[-1] += self.suffix
            total += self.merged(symbols)
        return total

    def __call__(self, piece: bytes) -> int:
        text = piece.decode("utf-8", "replace")
        if self.special is None or "<" not in text:
            return self.plain(text)
        marks = len(self.special.findall(text))
        return marks + sum(self.plain(x) for x in self.special.split(text) if x)


@lru_cache(maxsize=2)
def counter(path: str) -> Memo:
    return Memo(PairMerger(path))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens and over_limit (n_tokens > limit). No shuffle; memory is bounded by an Arrow batch and the memo."""
    path = vocabulary or vocabulary_path()
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = counter(path)
        claim(seen)
        for batch in batches:
            texts = [t or b"" for t in as_bytes(batch.column(1))]
            n = pa.array([sum(map(seen.__getitem__, t.split())) for t in texts], pa.int64())
            yield pa.record_batch([batch.column(0), pa.array(map(len, texts), pa.int64()), n], names=[id_col, "n_bytes", "n_tokens"])

    rows = docs.select(id_col, F.col(text_col).cast("string"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
