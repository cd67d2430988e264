"""Public tokenizers in tasks: ids of whole texts and the bytes of every id.

Vocabulary files are read where a task runs; their paths must be readable there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Runs of white space that a backtracking pre-tokenizer cannot take.
LONG_RUN = re.compile(r"\s{4096}")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Bytes that print stand for themselves, the others for 256 and up, in order.
    """
    prints = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """A byte-level BPE vocabulary file of the tokenizers library.

    Ids come from tiktoken, built from the file's own entries, as that costs a third of the
    time; tests hold them equal to those of the tokenizers library, which takes the texts
    with very long runs of white space, and all texts if ids are not in order of merging.
    Strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        model = json.load(open(path, encoding="utf-8"))["model"]
        letters = byte_letters()
        self.bytes_of = [b""] * (1 + max(model["vocab"].values()))
        for entry, i in model["vocab"].items():
            self.bytes_of[i] = bytes(letters[c] for c in entry)
        merged = [model["vocab"]["".join(m)] for m in model["merges"]]
        self.fast = None
        if merged == sorted(merged):
            self.fast = tiktoken.Encoding("own", pat_str=pattern, special_tokens={},
                                          mergeable_ranks={b: i for i, b in enumerate(self.bytes_of) if b})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or LONG_RUN.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


class Pieces:
    """A sentencepiece model; it puts a space before each text."""

    #: Characters of a long text that are encoded at once, see ``_cuts``.
    AT_ONCE = 1 << 20

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes_of = []
        inside = False
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            inside |= "▁" in piece.lstrip("▁")
            byte = self.model.is_byte(i)
            self.bytes_of.append(bytes([int(piece[3:5], 16)]) if byte else piece.replace("▁", " ").encode())
        self.cut = not inside

    def _cuts(self, text: str) -> list[str]:
        """A long text cut at single spaces; no piece holds a space after a letter, so none spans a cut."""
        parts, at = [], 0
        while self.cut and len(text) - at > self.AT_ONCE:
            space = re.compile(r"(?<=[^\s▁])\x20(?=[^\s▁])").search(text, at + self.AT_ONCE)
            if space is None:
                break
            parts.append(text[at:space.start()])
            at = space.end()
        return [*parts, text[at:]]

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([np.array(self.model.encode(p, num_threads=1), np.uint32) for p in self._cuts(text)])


def parts_of(batches: Iterator[pa.RecordBatch], text: int, rows: int = 512, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows and about ``size`` bytes of the text column; a longer text comes alone."""
    for batch in batches:
        lengths = np.diff(np.frombuffer(batch.column(text).buffers()[1], np.int32 if pa.types.is_string(batch.column(text).type)
                                        else np.int64)[batch.column(text).offset:][:batch.num_rows + 1])
        start, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if i > start and (i - start >= rows or held + n > size):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
