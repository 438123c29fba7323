"""BPE encoding by content-defined chunks, and decoding.

A rolling hash over 16 characters cuts texts where its low bits are zero, so a passage is cut alike wherever it
stands, and the chunks of a passage that documents share are found again. A worker keeps chunks' ids in a memo of
bounded size, so such a chunk is encoded once per worker and not once per document. Chunks end anywhere, also
within a word: of each chunk the ids between its first and its last safe cut (see bpe.py) are kept, its core.

Where two chunks join, the text between their cores is encoded anew by the library, together with the last piece of
the core before and the first piece of the core after. The join is repaired once the ids of these two pieces come
out as they stand in the cores; where they don't, the stretch is widened to both cores, and then to the whole text,
which agrees with itself. Joins are kept in a memo too.

Texts never leave their task: nothing is shuffled, and a task holds one slice of a batch and the memos.

Defined results: a null or empty text has no ids and decodes to an empty text; equal rows give equal rows; an
empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evimap.llm.bpe import _ODD_SPACE, Encoder, decoder, encoder
from evimap.llm.common import mix, slices

#: Chunks are cut where this many low bits of the hash are zero, and not within LEAST characters of the last cut.
BITS, LEAST = 8, 48
#: Characters of chunks that a worker's memo may hold; a full memo is emptied. It bounds memory only.
MEMO_CHARS = 16_000_000


def cuts(text: str) -> list[int]:
    """Places where the text is cut, its ends included."""
    n = len(text)
    if n <= LEAST:
        return [0, n]
    h = mix(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)).astype(np.uint32)
    for k in (1, 2, 4, 8):  # after these the hash covers 16 characters
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    out = [0]
    for at in (np.flatnonzero((h >> np.uint32(32 - BITS)) == 0) + 1).tolist():
        if at - out[-1] >= LEAST and at < n:
            out.append(at)
    return [*out, n]


def core(chunk: str, enc: Encoder) -> tuple[int, int]:
    """First and last safe cut within a chunk; both 0 if there are fewer than two."""
    if _ODD_SPACE.search(chunk):
        at, places = 0, []
        for piece in enc.cuts(chunk)[:-1]:
            places.append(at := at + len(piece))
        return (places[0], places[-1]) if len(places) > 1 else (0, 0)
    first = _next_cut(chunk)
    last = _last_cut(chunk)
    return (first, last) if 0 < first < last else (0, 0)


def _next_cut(chunk: str) -> int:
    at = 1
    while True:
        found = [i for i in (chunk.find(" ", at), chunk.find("\n", at)) if i >= 0]
        if not found:
            return 0
        at = min(found)
        if not chunk[at - 1].isspace():
            return at
        at += 1


def _last_cut(chunk: str) -> int:
    end = len(chunk)
    while end > 1:
        at = max(chunk.rfind(" ", 1, end), chunk.rfind("\n", 1, end))
        if at < 0:
            return 0
        if not chunk[at - 1].isspace():
            return at
        end = at
    return 0


class Core:
    """A chunk's text between its safe cuts, its ids, and its first and last piece with theirs."""

    __slots__ = ("head", "tail", "text", "ids", "first", "last")

    def __init__(self, chunk: str, span: tuple[int, int], ids: bytes, enc: Encoder):
        a, b = span
        self.head, self.tail, self.text, self.ids = chunk[:a], chunk[b:], chunk[a:b], ids
        self.first = self.last = None
        if self.text:
            pieces = enc.cuts(self.text)
            self.first, self.last = ((x, enc.pieces[x]) for x in (pieces[0], pieces[-1]))


class ChunkEncoder:
    """Ids of texts by way of memos of chunks and of joins."""

    def __init__(self, path: str):
        self.enc = encoder(path)
        self.memo: dict[str, Core] = {}
        #: Stretches around joins with their ids.
        self.joins: dict[str, bytes] = {}
        self.held = self.encoded = self.reused = self.repaired = self.widened = 0

    def learn(self, chunks: list[str]) -> None:
        """Encode the chunks that the memo lacks, all at once."""
        new = list(dict.fromkeys(c for c in chunks if c not in self.memo))
        self.encoded += len(new)
        self.reused += len(chunks) - len(new)
        spans = [core(c, self.enc) for c in new]
        ids, offsets = self.enc.column(pa.array([c[a:b] for c, (a, b) in zip(new, spans, strict=True)], pa.string()))
        for i, (chunk, span) in enumerate(zip(new, spans, strict=True)):
            self.memo[chunk] = Core(chunk, span, ids[offsets[i] : offsets[i + 1]].tobytes(), self.enc)
            self.held += len(chunk)

    def whole(self, stretches: list[str]) -> None:
        """Encode the stretches that are not known yet with the library."""
        new = list(dict.fromkeys(x for x in stretches if x not in self.joins))
        for text, coded in zip(new, self.enc.tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
            self.joins[text] = np.array(coded.ids, "<u4").tobytes()
            self.held += len(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.held > MEMO_CHARS:
            self.memo.clear()
            self.joins.clear()
            self.held = 0
        parts = []
        for text in texts:
            at = cuts(text)
            parts.append([text[a:b] for a, b in zip(at, at[1:], strict=False)])
        self.learn([c for chunks in parts for c in chunks])
        plans = [self._plan([self.memo[c] for c in chunks]) for chunks in parts]
        # each join (core before, text between, core after) with a piece of context on either side
        self.whole([(j[0].last[0] if j[0] else "") + j[1] + (j[2].first[0] if j[2] else "") for plan in plans for j in plan])
        return [self._joined(plan, text) for plan, text in zip(plans, texts, strict=True)]

    @staticmethod
    def _plan(cores: list[Core]) -> list[tuple[Core | None, str, Core | None]]:
        plan, before, open_ = [], None, []
        for c in cores:
            open_.append(c.head)
            if c.text:
                plan.append((before, "".join(open_), c))
                before, open_ = c, []
            open_.append(c.tail)
        return [*plan, (before, "".join(open_), None)]

    def _joined(self, plan: list, text: str) -> bytes:
        out = []
        for before, between, after in plan:
            ids = self._repaired(before.last if before else None, between, after.first if after else None)
            if ids is None:  # no agreement on the pieces: look at both cores, and then at the whole text
                self.widened += 1
                ids = self._repaired((before.text, before.ids) if before else None, between, (after.text, after.ids) if after else None)
            if ids is None:
                return self.enc.whole(text)
            out.append(ids)
            if after:
                out.append(after.ids)
        return b"".join(out)

    def _repaired(self, left: tuple[str, bytes] | None, between: str, right: tuple[str, bytes] | None) -> bytes | None:
        """Ids of the text between, if those of what stands on either side come out as they are known."""
        stretch = (left[0] if left else "") + between + (right[0] if right else "")
        self.whole([stretch])
        ids, a, b = self.joins[stretch], left[1] if left else b"", right[1] if right else b""
        if len(ids) >= len(a) + len(b) and ids.startswith(a) and ids.endswith(b):
            self.repaired += 1
            return ids[len(a) : len(ids) - len(b)]
        return None


_chunk_encoders: dict[str, ChunkEncoder] = {}


def _texts(part: pa.RecordBatch) -> list[str]:
    return [t or "" for t in part.column("text").to_pylist()]


def encode(docs: DataFrame, tokenizer_path: str, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int), in one pass; with_text adds decoded, the text that the ids give back."""

    def each(batches) -> Iterator[pa.RecordBatch]:
        enc = _chunk_encoders.setdefault(tokenizer_path, ChunkEncoder(tokenizer_path))
        back = decoder(tokenizer_path) if with_text else None
        for batch in batches:
            for part in slices(batch):
                packed = enc.encode(_texts(part))
                data = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
                offsets = np.r_[0, np.cumsum([len(p) // 4 for p in packed])].astype(np.int32)
                columns = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(data))]
                if back:
                    columns.append(pa.array(back.decode_rows(data, offsets), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, "doc_id long, ids array<int>" + ", decoded string" * with_text)


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with one more column, decoded: the text of its ids; null ids give a null text."""

    def each(batches) -> Iterator[pa.RecordBatch]:
        back = decoder(tokenizer_path)
        for batch in batches:
            texts = [None if ids is None else back.decode(ids) for ids in batch.column(ids_col).to_pylist()]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    from pyspark.sql.types import StringType

    return encoded.mapInArrow(each, encoded.drop("decoded").schema.add("decoded", StringType()) if "decoded" not in encoded.columns else encoded.schema)
