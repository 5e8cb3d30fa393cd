"""Token counts by byte-pair merging with a heap and a linked list; no token is ever made, only merges are counted."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loculus.llm.common import light, read_table
from loculus.llm.tokens import plain_strings, tokenizer_path

MODEL, LIMIT, KEPT_CHUNKS, KEPT_CHARS = "piece_bpe_32k.model", 4096, 400_000, 64
#: What stands for a space in pieces.
SPACE = "▁"


class PieceCounts:
    """Counts the tokens of texts by the pieces of a model file of merges.

    A character that is a piece counts one; any other counts its UTF-8 bytes where the model falls back to bytes, else one with its
    like beside it. What two neighbours count is one once they merge. Where no piece has a space behind another character, nothing
    merges across the start of a run of spaces, and what lies between two such starts is counted once and kept; where no piece has a
    line feed beside another character, lines are parted likewise. The memory of counts is bounded; beyond it chunks are counted anew.
    """

    def __init__(self, path: str, kept: int = KEPT_CHUNKS):
        from sentencepiece import SentencePieceProcessor

        self.model, self.kept, self.known = SentencePieceProcessor(model_file=path), kept, {}
        m = self.model
        numbers = range(m.get_piece_size())
        if any(map(m.is_unused, numbers)):
            raise ValueError(f"{path} has pieces that are marked as unused")
        self.bytes = any(map(m.is_byte, numbers))
        plain = [i for i in numbers if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        scores = np.array([m.get_score(i) for i in plain])
        pieces = [m.id_to_piece(i) for i in plain]
        #: Merged piece -> rank: the best score is 0, equal scores have one rank.
        self.rank = dict(zip(pieces, np.unique(-scores, return_inverse=True)[1].tolist()))
        self.single = {p: 1 for p in pieces if len(p) == 1}
        longer = [p for p in pieces if len(p) > 1]
        probe = " a  b\n c "
        escapes = m.normalize(probe) == SPACE + probe.replace(" ", SPACE) and m.normalize("") == "" and m.normalize("ﬁ\x00é") == SPACE + "ﬁ\x00é"
        inner = any(b == SPACE != a for p in longer for a, b in zip(p, p[1:]))
        self.by_chunks = self.bytes and escapes and not inner and not any("\n" in p for p in longer)

    def count(self, chunk: str) -> int:
        """The tokens of a text as the model's normaliser leaves it: its symbols less its merges."""
        rank, text = self.rank, list(chunk)
        weight = [self.single.get(c) or (len(c.encode("utf-8", "surrogatepass")) if self.bytes else 0) for c in text]
        total, n = sum(weight), len(text)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, k, 2) for k in range(n - 1) if (r := rank.get(text[k] + text[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, left, size = heapq.heappop(heap)
            right = after[left]
            if right < 0 or not text[left] or len(text[left]) + len(text[right]) != size:
                continue  # one of the two has merged meanwhile
            total += 1 - weight[left] - weight[right]
            text[left] += text[right]
            weight[left], text[right], end = 1, "", after[right]
            after[left] = end
            if end >= 0:
                before[end] = left
                if (r := rank.get(text[left] + text[end])) is not None:
                    heapq.heappush(heap, (r, left, len(text[left]) + len(text[end])))
            if (start := before[left]) >= 0 and (r := rank.get(text[start] + text[left])) is not None:
                heapq.heappush(heap, (r, start, len(text[start]) + len(text[left])))
        if self.bytes:
            return total
        unknown = [t and t not in rank for t in text if t]  # neighbours of no piece are one token together
        return sum(not u for u in unknown) + sum(u and not v for u, v in zip(unknown, [False, *unknown]))

    def count_many(self, texts: pa.Array) -> np.ndarray:
        """The tokens of each text (null: of an empty one)."""
        texts = pc.fill_null(plain_strings(texts), "")
        if not self.by_chunks:
            return np.array([self.count(self.model.normalize(t)) for t in texts.to_pylist()], np.int64)
        lines = pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False).astype(np.int64)
        filled = pc.greater(pc.binary_length(texts), 0)
        texts = pc.if_else(filled, pc.binary_join_element_wise(SPACE, pc.replace_substring(texts, " ", SPACE), ""), "")
        lists = pc.split_pattern(pc.replace_substring_regex(texts, f"({SPACE}+)", "\n\\1"), "\n")
        chunks = lists.flatten().dictionary_encode()
        kinds, known = chunks.dictionary.to_pylist(), self.known
        counts = np.empty(len(kinds), np.int64)
        for k, chunk in enumerate(kinds):
            n = known.get(chunk)
            if n is None:
                n = self.count(chunk)
                if len(chunk) <= KEPT_CHARS:
                    if len(known) >= self.kept:
                        known.clear()
                    known[chunk] = n
            counts[k] = n
        ends = np.r_[0, np.cumsum(counts[chunks.indices.to_numpy()], dtype=np.int64)]
        bounds = np.asarray(lists.offsets)
        return np.diff(ends[bounds - bounds[0]]) + lines


_KNOWN: dict[str, PieceCounts] = {}


def piece_counts(path: str) -> PieceCounts:
    """One for each file in a process: a Python worker runs many tasks, and its memory of chunks serves all of them."""
    if path not in _KNOWN:
        _KNOWN[path] = PieceCounts(path)
    return _KNOWN[path]


def token_counts(docs: DataFrame, model: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts the tokens of every row's whole text: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    model: a model file of the sentencepiece library that merges pairs. Neither begin, end nor other special tokens count, and
    their strings in a text are ordinary text. A null text counts as an empty one: no bytes, no tokens. Null and repeated ids and
    repeated rows stay rows of their own. An empty table gives an empty result. Other columns are left behind. Nothing is shuffled.
    """
    path = model or tokenizer_path(MODEL)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_counts(path)
        for b in batches:
            got = pieces.count_many(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(got), pa.array(got > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("_text"), F.octet_length(text).cast("long").alias("_bytes"))
    return rows.mapInArrow(light(count), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
