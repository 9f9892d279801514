"""Token counts of documents under a given tokenizer, without keeping the tokens.

Arrow hands a task whole texts. They are worked on in parts of about ``PART_BYTES``: short texts
together, a long one cut where the tokenizer can never join what stands on both sides: before a
blank, before an ASCII digit, and between an ASCII letter or digit and a punctuation mark. A part
is taken apart at blanks in the same way, equal pieces are encoded once, in batches of about
``BATCH_BYTES``, and only the number of tokens of a piece is kept. The count of a
text is the sum over its pieces. Memory follows the part and the longest run without a safe cut,
not the text.

The rules hold for tokenizers that drop blanks and cut words into runs of letters, single digits
and runs of other marks, and whose special tokens hold neither blanks nor digits; ``check_cuts`` refuses others.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakeweave.llm.textbytes import SPACE, Texts, slices

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
# Bytes of text that are worked on at a time, bytes encoded in one call, and pieces whose count a task remembers.
PART_BYTES = 1 << 20
BATCH_BYTES = 1 << 18
REMEMBERED = 1 << 20

# Fixed value: how the vocabulary's own rule cuts a text.
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_ALNUM = _DIGIT.copy()
_ALNUM[ord("A") : ord("Z") + 1] = _ALNUM[ord("a") : ord("z") + 1] = True
# '|' stands inside of special tokens, next to letters.
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "|"]] = True
_COLUMNS = "doc_id long, n_bytes long, n_tokens long"


def read_tokenizer(spark: SparkSession, path: str) -> Tokenizer:
    """The tokenizer of a file that Spark can read, without truncation and padding."""
    found = Tokenizer.from_str(spark.read.text(path, wholetext=True).first()["value"])
    found.no_truncation()
    found.no_padding()
    return found


def check_cuts(tokenizer: Tokenizer) -> None:
    """Raise unless texts can be cut as this module does without changing their tokens."""
    rules = json.loads(tokenizer.to_str())
    steps = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
    first = steps[0] if steps else {}
    whole = [first.get(key) for key in ("type", "pattern", "behavior", "invert")]
    if whole != ["Split", {"Regex": WORD_RULE}, "Removed", True]:
        raise ValueError("the tokenizer does not cut texts at blanks and digits")
    for token in rules["added_tokens"]:
        outer = re.fullmatch(r"[^\s0-9]+", token["content"]) and not re.search(r"[A-Za-z][!-/:-@\[-`{}~]", token["content"])
        if not outer or token["lstrip"] or token["rstrip"] or token["single_word"]:
            raise ValueError(f"the special token {token['content']!r} may lie across a cut")


def safe_cuts(buf: np.ndarray, part: int) -> list[int]:
    """Where a text of UTF-8 bytes is cut into parts, 0 and its length included.

    A part ends at the last safe cut within ``part`` bytes; if there is none, at the next one.
    """
    cuts, n = [0], len(buf)
    while n - cuts[-1] > part:
        at, step = cuts[-1], part
        while True:
            # Positions at + 1 to at + step; a cut before position p.
            low, high = at + 1, min(at + step, n - 1) + 1
            here, before = buf[low:high], buf[low - 1 : high - 1]
            safe = np.flatnonzero(SPACE[here] | _DIGIT[here] | (_MARK[here] & _ALNUM[before]))
            if len(safe):
                # Of a first look the last, of later ones, which go beyond the part, the first.
                cuts.append(low + int(safe[-1 if at == cuts[-1] else 0]))
                break
            if high >= n:
                return [*cuts, n]
            at = high - 1
    return [*cuts, n]


def parts(column: pa.Array | pa.ChunkedArray, part: int) -> Iterator[tuple[int, Texts]]:
    """The texts of an Arrow column in slices, each with the row it begins at; a long text comes in several."""
    for row, texts in slices(column):
        if texts.size > 1 or len(texts.buf) <= part:
            yield row, texts
            continue
        cuts = safe_cuts(texts.buf, part)
        for low, high in zip(cuts, cuts[1:], strict=False):
            yield row, Texts(texts.buf[low:high], np.array([0, high - low]), False)


class Counts:
    """Numbers of tokens; those of equal pieces are found once."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer = tokenizer
        self.forget()

    def forget(self) -> None:
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def encoded(self, pieces: Sequence[str]) -> list[int]:
        """Number of tokens of every piece."""
        return list(map(len, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)))

    def of_new(self, texts: Texts, words: np.ndarray) -> np.ndarray:
        """Number of tokens of the given words, in batches of about the same number of bytes."""
        starts, ends = texts.starts[words], texts.ends[words]
        upto = np.cumsum(ends - starts)
        bounds = np.searchsorted(upto, np.arange(BATCH_BYTES, upto[-1] + BATCH_BYTES, BATCH_BYTES), "left") + 1
        out, at = [], 0
        for bound in np.unique(np.minimum(bounds, len(words))).tolist():
            out += self.encoded([texts.raw[a:b].tobytes().decode() for a, b in zip(starts[at:bound], ends[at:bound], strict=True)])
            at = bound
        return np.array(out, np.int64)

    def of(self, texts: Texts) -> np.ndarray:
        """Number of tokens of every text."""
        if not len(texts.starts):
            return np.zeros(texts.size, np.int64)
        with np.errstate(over="ignore"):
            kinds, example, which = np.unique(texts.word_hashes(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, kinds)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == kinds[known]
        counts = np.zeros(len(kinds), np.int64)
        counts[known] = self.values[at[known]]
        if not known.all():
            new = ~known
            counts[new] = self.of_new(texts, example[new])
            self.keys, self.values = np.insert(self.keys, at[new], kinds[new]), np.insert(self.values, at[new], counts[new])
            if len(self.keys) > REMEMBERED:
                self.forget()
        total = np.concatenate(([0], np.cumsum(counts[which])))
        return total[texts.first_word[1:]] - total[texts.first_word[:-1]]


def _counted(tokenizer, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task has one core; threads of the tokenizer would take those of its neighbours.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counts = Counts(tokenizer.value)
        for batch in batches:
            tokens, size = np.zeros((2, batch.num_rows), np.int64)
            for row, texts in parts(batch.column(1), part):
                tokens[row : row + texts.size] += counts.of(texts)
                size[row : row + texts.size] += np.diff(texts.offsets)
            columns = [batch.column(0), pa.array(size), pa.array(tokens)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT, part: int = PART_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    ``docs`` has ``doc_id`` and ``text``; other columns are not read. ``vocabulary`` is the path of a
    tokenizer file, read by Spark. Tokens are those of the library's ``encode`` of the whole text without begin
    and end; special tokens written out in a text count as it counts them, as one. ``n_bytes`` is the
    length in UTF-8, and ``over_limit`` tells of more than ``limit`` tokens.

    Null and empty texts have none of either. Rows come back as often as they went in, whatever their ``doc_id``; an empty
    table gives an empty result. Nothing is shuffled: Spark cuts the scan into tasks of equal bytes.
    """
    tokenizer = read_tokenizer(docs.sparkSession, vocabulary)
    check_cuts(tokenizer)
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_counted(sent, part), _COLUMNS).withColumn("over_limit", F.col("n_tokens") > limit)
