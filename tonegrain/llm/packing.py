"""Packing by power-of-two decomposition.

A text becomes token ids and one end id. The ids are cut, in order, into pieces whose
lengths are powers of two: as many full ones of ``MAX_LEN`` as fit, then the binary
digits of the rest, largest first. A piece is a sequence of its own, so no sequence
crosses documents and nothing is padded; sequences of equal length are batched from one
bucket. Packing needs no shuffle: it is one pass over the texts.

Ids come from a ``tokenizers`` file. The vocabularies used here drop white space and never
join across it, so words are encoded once, many at a time, and kept in a bounded
table; :func:`splits_at_space` checks a tokenizer file for that. Special strings in a
text are ordinary text.

Defined results: a null or empty text is the end id alone, one piece of length 1;
repeated rows are packed each on their own; null ids are carried through; other
columns are ignored whatever their names are; an empty table gives no piece.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegrain.llm.common import blob

MAX_LEN = 4096
END_ID = 2
#: Words kept encoded per Python worker.
KNOWN_WORDS = 300_000

def _byte_names() -> list[str]:
    """The character each byte has in a byte-level vocabulary: itself if it prints, else the next from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


_BYTE_NAMES = _byte_names()
#: Lower-case letters of Latin-1, which are their own normal form, then ASCII punctuation.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)").fullmatch

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)


def splits_at_space(path: str) -> bool:
    """Whether the file lower-cases, drops white space and splits words from punctuation.

    Then words, and runs of letters and of punctuation in them, encode on their own.
    """
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    steps = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
    lower = any(s["type"] == "Lowercase" for s in (rules["normalizer"] or {}).get("normalizers", []))
    runs = any(
        s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] and s["pattern"]["Regex"].endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        for s in steps
    )
    return lower and runs and any(s["type"] == "ByteLevel" for s in steps)


class Encoder:
    """Token ids of UTF-8 texts as little-endian 32-bit integers."""

    def __init__(self, path: str, by_word: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.by_word = by_word
        self.known: dict[bytes, bytes] = {}

    def _whole(self, text: bytes) -> bytes:
        encoded = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False)
        return np.array(encoded.ids, "<u4").tobytes()

    def _learn(self, words: list[bytes]) -> None:
        """Encode new words: plain ones by the vocabulary's model, the others as one text."""
        others, known, piece = [], self.known, self._piece
        for word in words:
            plain = _PLAIN(word.decode("utf-8", "replace"))
            if plain is None:
                others.append(word)
                continue
            letters, rest = plain.groups()
            if rest:
                known[word] = piece(letters) + piece(rest)
            else:
                piece(letters)
        if others:
            self._learn_text(others)

    def _piece(self, text: str) -> bytes:
        """Ids of one run of letters or of punctuation, which the tokenizer never splits or joins."""
        key = text.encode()
        if key not in self.known:
            name = text if text.isascii() else "".join([_BYTE_NAMES[b] for b in key])
            self.known[key] = b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(name)])
        return self.known[key]

    def _learn_text(self, words: list[bytes]) -> None:
        """Encode words as one text; a token belongs to the word its span lies in."""
        texts = [w.decode("utf-8", "replace") for w in words]
        encoded = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(encoded.ids, "<u4")
        starts = np.array([s for s, _ in encoded.offsets], np.int64)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        cuts = np.searchsorted(starts, np.append(begins, begins[-1] + len(texts[-1]) + 1))
        for word, a, b in zip(words, cuts[:-1], cuts[1:], strict=True):
            self.known[word] = ids[a:b].tobytes()

    def __call__(self, text: bytes) -> bytes:
        if not self.by_word:
            return self._whole(text)
        # The vocabulary is lower case; lowering A-Z first lets words share an entry.
        words = text.lower().split()
        out = []
        for i in range(0, len(words), KNOWN_WORDS // 4):
            part = words[i : i + KNOWN_WORDS // 4]
            new = [w for w in dict.fromkeys(part) if w not in self.known]
            if new:
                if len(self.known) + len(new) > KNOWN_WORDS:
                    self.known.clear()
                    new = list(dict.fromkeys(part))
                self._learn(new)
            out.extend(map(self.known.__getitem__, part))
        return b"".join(out)


def lengths(n: int, most: int = MAX_LEN) -> list[int]:
    """Powers of two, largest first, that add up to ``n``."""
    full, rest = divmod(n, most)
    return [most] * full + [1 << b for b in range(most.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """Pieces of every row of ``docs(doc_id, text)``; ``ids`` are little-endian 32-bit integers.

    ``tokenizer`` names a file that every executor can open. A sequence is the piece
    itself; its id holds the task's number and a count.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    by_word = splits_at_space(tokenizer)
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema(
        [pa.field(f.split()[0], pa.binary() if f.endswith("binary") else pa.int64()) for f in PIECES.split(", ")]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequence = Encoder(tokenizer, by_word), TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(*batch.columns, strict=True):
                ids = encode(text.as_py()) + end
                start, total = 0, len(ids) // 4
                for n in lengths(total, max_len):
                    rows.append((doc_id.as_py(), start, n, ids[4 * start : 4 * (start + n)], total, sequence, 0))
                    start, sequence = start + n, sequence + 1
                    held += 4 * n
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), blob("text").alias("text")).mapInArrow(cut, PIECES)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces as Parquet, one folder per length, for batching sequences of one length."""
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
