"""Byte-pair encoding by a given vocabulary, and back: ids of texts, and the window of ids that a text model takes."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids that a text model takes, the first and the last among them.
CONTEXT = 77
#: Words whose ids a task remembers.
REMEMBERED = 1 << 18
#: How byte-level vocabularies write bytes, printable ones as themselves; what they take for a word; its end.
PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
START, END = "<|startoftext|>", "<|endoftext|>"


class BytePairs:
    """A vocabulary of words: ids by token, the rank of each merge, and the ids of a text's start and end.

    Vocabularies are read, never learned. A text is lower-cased, its blanks count as one, and its words are cut into bytes
    that merge by rank, the lowest first and from the left.
    """

    def __init__(self, ids: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        self.ids, self.ranks, self.special = ids, {tuple(m): k for k, m in enumerate(merges)}, special
        others = iter(range(256, 512))
        self.shown = {b: chr(b) if b in PRINTABLE else chr(next(others)) for b in range(256)}
        self.byte = {c: b for b, c in self.shown.items()}
        self.tokens = {k: t for t, k in ids.items()}
        self.word = regex.compile(WORD, regex.IGNORECASE)
        self.known: dict[str, list[int]] = {}

    @classmethod
    def from_file(cls, path: str) -> BytePairs:
        """A vocabulary in the JSON form of public tokenizers."""
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model = said["model"]
        if model.get("end_of_word_suffix") != WORD_END:
            raise ValueError(f"the vocabulary at {path} has no word ends")
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        return cls(model["vocab"], pairs, {t["content"]: t["id"] for t in said["added_tokens"]})

    def _merged(self, word: str) -> list[str]:
        """The tokens of a word: a heap has all mergeable neighbours by rank and place; those that are gone are passed over."""
        part = [self.shown[b] for b in word.encode()]
        part[-1] += WORD_END
        after, before = [*range(1, len(part)), -1], [*range(-1, len(part) - 1)]
        heap = [(self.ranks[p], k) for k, p in enumerate(zip(part, part[1:], strict=False)) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            n = after[k]
            if n < 0 or not part[k] or self.ranks.get((part[k], part[n])) != rank:
                continue
            part[k], part[n] = part[k] + part[n], ""
            after[k] = after[n]
            if after[k] >= 0:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (r := self.ranks.get((part[a], part[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [p for p in part if p]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for word in self.word.findall(" ".join(text.split()).lower()):
            ids = self.known.get(word)
            if ids is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                ids = self.known[word] = [self.ids[t] for t in self._merged(word)]
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The words of ids, a blank after each; start and end say nothing, bytes that are no UTF-8 become U+FFFD, and unknown ids raise KeyError."""
        marks = set(self.special.values())
        text = "".join(self.tokens[k] for k in ids if k not in marks)
        words = text.split(WORD_END)
        plain = lambda w: bytes(self.byte[c] for c in w).decode("utf-8", errors="replace")
        return " ".join(map(plain, words[:-1])) + (" " if len(words) > 1 and words[-1] else "") + plain(words[-1])

    def window(self, text: str, context: int = CONTEXT, cut: bool = False) -> list[int]:
        """Start, ids, end, and zeros up to `context`; a text of more ids raises ValueError, or is cut."""
        ids = self.encode(text)
        if len(ids) + 2 > context:
            if not cut:
                raise ValueError(f"a text of {len(ids)} ids is too long for a context of {context}")
            ids = ids[: context - 2]
        return [self.special[START], *ids, self.special[END], *[0] * (context - 2 - len(ids))]


def byte_pair_ids(rows: DataFrame, vocabulary: str, text_col: str = "text", context: int | None = None, cut: bool = False, out_col: str = "ids") -> DataFrame:
    """rows with `ids`, array<int>: the ids of each text, whole, or as a window of `context`. A null text is empty.

    The driver reads the vocabulary and sends it to the tasks, which work out the ids of a word once.
    """
    shared = rows.sparkSession.sparkContext.broadcast(BytePairs.from_file(vocabulary))
    kept = [c for c in rows.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = shared.value
        for batch in batches:
            texts = (t.as_py() or "" for t in batch.column(batch.num_columns - 1))
            found = [pairs.encode(t) if context is None else pairs.window(t, context, cut) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.int32()))], [*kept, out_col])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"{schema}, `{out_col}` array<int>")


def byte_pair_texts(rows: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with `decoded`, the words of their ids; null where there are none."""
    shared = rows.sparkSession.sparkContext.broadcast(BytePairs.from_file(vocabulary))
    kept = [c for c in rows.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if i is None else shared.value.decode(i) for i in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], [*kept, out_col])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, F.col(ids_col).alias("_ids")).mapInArrow(run, f"{schema}, `{out_col}` string")
