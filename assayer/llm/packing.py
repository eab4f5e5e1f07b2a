"""Best-fit packing by sums of squares.

Texts become token pieces of at most one sequence. A piece goes where the sum
over all gaps g of (open sequences with gap g) squared becomes smallest: that
keeps gaps of every size in stock, so later pieces find one that fits exactly.
Pieces are taken from the longest to the shortest.

Only numbers are packed: tokens are counted and check-summed where the text is
scanned. Pieces are dealt by a hash over groups of about ``group`` pieces, each
packed in one task, so a group wastes at most its last sequences, a share that
stays the same at any size.

Defined cases: a null or empty text is one piece with the closing id only;
repeated rows are packed each; a null ``doc_id`` is kept; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import settle

SEQUENCE, CLOSING_ID = 2048, 0
GROUP = 50_000
#: Different words, and parts of words, a worker learns before it forgets those it has not met since the last time.
REMEMBERED = 300_000

#: Signs that begin no contraction or special token.
_SIGNS = b".,;:!?%$&#*"
#: Letters whose lower case depends on no neighbour and that combine with none.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: The characters that stand for bytes in the vocabulary, where they are not those of the same number.
_BYTES = {byte: 256 + n for n, byte in enumerate([*range(33), *range(127, 161), 173])}

_PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long, nth long"


class _Known(dict):
    """Ids by word: one that is not here is taken from those before the last ``forget``, or made."""

    def __init__(self, make: Callable[[bytes], bytes]):
        self.make, self.older = make, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.make(word)
        self[word] = ids
        return ids

    def forget(self, most: int) -> None:
        """Beyond ``most`` words, only those met again are kept."""
        if len(self) > most:
            self.older = dict(self)
            self.clear()


class WordIds:
    """Ids of words, as little-endian bytes.

    White space is a hard border for the tokenizer, so a text's ids are those of
    its words one after the other. A tokenizer that lowers case and parts letters
    from signs has the ids of "Word," in those of "word" and ",".
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        # A task has one core; threads of its own would only cost memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        self.words, self.parts = _Known(self._word), _Known(self._part)
        rules = json.loads(self.tokenizer.to_str())
        before = json.dumps(rules.get("pre_tokenizer"))
        self.split = '"Lowercase"' in json.dumps(rules.get("normalizer")) and r"[^\\s\\p{L}\\p{N}]+" in before
        # Letters that are one piece already go straight to the merges, where that gives the same.
        self.merges = self.tokenizer.model.tokenize
        probes = ("a", "the", "word", "zqxj", "tionheand", "\u00e9t\u00e9", "\u00c0\u00df\u00ff", "\u00f1\u00d6qx")
        self.direct = self.split and all(self._merged(w) == self._encoded(w) for w in probes)

    def _merged(self, letters: str) -> bytes:
        low = letters.lower()
        if not low.isascii():
            low = low.encode().decode("latin-1").translate(_BYTES)
        return array("I", [token.id for token in self.merges(low)]).tobytes()

    def _encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _word(self, word: bytes) -> bytes:
        stem, signs = self._cut(word)
        return self.parts[stem] + self.parts[signs] if signs else self.parts[stem]

    def _part(self, part: bytes) -> bytes:
        text = part.decode("utf-8", "replace")
        return self._merged(text) if self.direct and _LETTERS.fullmatch(text) else self._encoded(text)

    def _cut(self, word: bytes) -> tuple[bytes, bytes]:
        """Letters in lower case and the signs after them, or the word as it is."""
        stem = word.rstrip(_SIGNS) if self.split else b""
        if stem.isalpha():  # ASCII letters only
            return stem.lower(), word[len(stem) :]
        if len(stem) < len(word) and stem.decode("utf-8", "replace").isalpha():
            return stem, word[len(stem) :]
        return word, b""

    def encode(self, words: list[bytes]) -> bytes:
        self.words.forget(self.remembered)
        self.parts.forget(self.remembered)
        return b"".join(map(self.words.__getitem__, words))


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, closing_id: int = CLOSING_ID) -> DataFrame:
    """Pieces of every document with the checksum of their ids; ``nth`` counts them within a task."""
    closing = array("I", [closing_id]).tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, nth = WordIds(tokenizer), 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = known.encode((text or b"").split()) + closing
                for piece, at in enumerate(range(0, len(ids), 4 * sequence)):
                    part = ids[at : at + 4 * sequence]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), nth))
                    nth += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "nth"])

    # As a string: pandas has no whole numbers beside nulls.
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.encode("text", "UTF-8").alias("text"))
    return texts.mapInPandas(cut, _PIECES).withColumn("doc_id", F.col("doc_id").cast("long"))


def pack(lengths: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) of every length, in the order given."""
    gaps = np.zeros(sequence + 1, np.int64)  # open sequences by gap
    open_by_gap: list[list[int]] = [[] for _ in range(sequence + 1)]
    number, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k, size in enumerate(lengths.tolist()):
        # Moving a sequence from gap g to g - size changes the sum of squares by twice this, plus two.
        rest = gaps[: sequence - size].copy()
        rest[:1] = -1  # a full sequence is closed: nothing is added there
        change = rest - gaps[size:sequence]
        change[gaps[size:sequence] == 0] = np.iinfo(np.int64).max
        best = int(np.argmin(change)) if len(change) else -1
        fresh = int(gaps[sequence - size]) if size < sequence else -1
        if best >= 0 and change[best] <= fresh:
            gap = size + best
            into = open_by_gap[gap].pop()
            gaps[gap] -= 1
        else:
            gap, into = sequence, made
            made += 1
        number[k], offset[k] = into, sequence - gap
        if gap > size:
            gaps[gap - size] += 1
            open_by_gap[gap - size].append(into)
    return number, offset


def pack_longest_first(lengths: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """``pack`` with the longest first; the short tail also in mixed order, whichever needs fewer sequences.

    In mixed order short pieces of all lengths are still there when the last gaps are filled.
    """
    falling, best = np.argsort(-lengths, kind="stable"), None
    for share in (0.0, 0.1, 0.2):
        tail = np.flatnonzero(lengths[falling] <= share * sequence)
        order = falling.copy()
        order[tail] = falling[np.random.default_rng(0).permutation(tail)]
        number, offset = np.empty_like(lengths), np.empty_like(lengths)
        number[order], offset[order] = pack(lengths[order], sequence)
        if best is None or number.max(initial=-1) < best[0].max(initial=-1):
            best = number, offset
    return best


def packed(rows: DataFrame, sequence: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to pieces."""
    rows = settle(rows, "pieces")
    groups = max(1, -(-rows.count() // group))
    dealt = rows.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "nth"), F.lit(groups)))

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "piece", "nth"], kind="stable")
        number, offset = pack_longest_first(part["length"].to_numpy(), sequence)
        part["sequence_id"] = part["part"].to_numpy() * (1 << 32) + number
        part["offset"] = offset
        return part.drop(columns=["part", "nth"])

    placed = dealt.groupBy("part").applyInPandas(
        fill,
        "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
    return placed.withColumn("doc_id", F.col("doc_id").cast("long"))
