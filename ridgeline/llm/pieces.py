"""SentencePiece encoding and decoding through a table of distinct marked words.

The model's normaliser is the identity, one marker is put before the text and blanks become
markers.  No piece continues past the end of a word (checked when the model is loaded: a marker
never follows another character inside a piece), so a merge never crosses from a word to the
next marker.  The text therefore falls into chunks, a run of markers and the characters up to the
next marker, that are segmented independently.  Each distinct chunk of a batch is encoded and decoded by
the library once; ids and texts are joined back in order of position.

The table lives in the task: it holds at most ``remember`` chunks plus those of one batch, and it
is emptied when full, which changes no result.  Nothing is shuffled.
Null counts as empty; an empty text has only the begin and end ids.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from ridgeline.llm.common import per_document, texts

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class ChunkTable:
    """Chunk to packed ids and decoded text, filled on demand."""

    def __init__(self, path: str, remember: int = 400_000):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = [p for p in map(self.model.id_to_piece, range(self.model.get_piece_size())) if re.search(f"[^{MARK}]{MARK}", p)]
        if crossing or self.model.encode(f" a{MARK}  ﬁ", out_type=str) != self.model.encode(f"{MARK}a   ﬁ", out_type=str):
            raise ValueError(f"{path}: pieces cross white space or texts are normalised; whole texts must be encoded")
        self.remember = remember
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, str] = {}

    def add(self, chunks: set[str]) -> None:
        if len(self.ids) > self.remember:
            self.ids.clear()
            self.texts.clear()
            new = list(chunks)
        else:
            new = [c for c in chunks if c not in self.ids]
        if not new:
            return
        encoded = self.model.encode([c[1:].replace(MARK, " ") for c in new], num_threads=1)  # the library puts the first marker
        encoded = [ids or [self.model.piece_to_id(MARK)] for ids in encoded]  # a lone marker is an empty text to the library
        for at in range(0, len(new), 256):
            part, ids = new[at : at + 256], encoded[at : at + 256]
            plain = [c.replace(MARK, " ") for c in part]
            if " " + self.model.decode([i for one in ids for i in one]) != "".join(plain):  # one call where decoding gives back the text
                plain = [" " + self.model.decode(one) for one in ids]  # decoding drops one marker at the very start
            self.ids.update(zip(part, (np.asarray(one, "<u4").tobytes() for one in ids)))
            self.texts.update(zip(part, plain))

    def run(self, text: str) -> tuple[bytes, str]:
        """Packed ids with begin and end, and the decoded text."""
        chunks = CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []
        self.add(set(chunks))
        ids, texts_ = self.ids, self.texts
        packed = b"".join([self.first, *[ids[c] for c in chunks], self.last])
        return packed, "".join([texts_[c] for c in chunks])[1:]

    @property
    def first(self) -> bytes:
        return np.array([self.model.bos_id()], "<u4").tobytes()

    @property
    def last(self) -> bytes:
        return np.array([self.model.eos_id()], "<u4").tobytes()


def encode(docs: DataFrame, path: str, *, remember: int = 400_000) -> DataFrame:
    """``doc_id, ids, decoded``: little-endian 32-bit ids as bytes, and the text they decode to."""

    def make():
        chunks = ChunkTable(path, remember)
        return lambda text: chunks.run(text.decode("utf-8", "replace"))

    return per_document(texts(docs), "ids binary, decoded string", make)


def digests(docs: DataFrame, path: str, *, remember: int = 400_000) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the ids and texts of ``encode``."""

    def make():
        chunks = ChunkTable(path, remember)

        def work(text: bytes) -> tuple[int, str, str]:
            packed, decoded = chunks.run(text.decode("utf-8", "replace"))
            return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

        return work

    return per_document(texts(docs), "n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)
