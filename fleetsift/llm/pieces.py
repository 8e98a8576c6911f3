"""SentencePiece encoding and decoding with a streaming Viterbi pass.

The model is of the merging kind: the pieces of a text are those that greedy merging by score leaves. A segmentation is that one exactly
if no two neighbours would have been merged otherwise, that is, if merging the text of the two alone gives the two back. So a path through the
piece lattice survives only over compatible neighbours, and each boundary keeps one backpointer: to the only piece that can end there. The pass
keeps the positions that a later piece can still start from, at most the longest piece, and commits ids as soon as the paths of all
of them run through one boundary. At an edge that no piece spans, such as before a space mark, this is at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_CACHED = 400_000
#: Characters up to which a segment is remembered; longer ones are streamed.
_SHORT = 64


def _runs(texts: Iterable[str | None], chars: int = 2_000_000) -> Iterator[list[str | None]]:
    """The texts in runs of about so many characters, which bounds what is held at once."""
    run, held = [], 0
    for text in texts:
        run.append(text)
        held += len(text or "")
        if held >= chars:
            yield run
            run, held = [], 0
    if run:
        yield run


class Pieces:
    """The vocabulary of a model file and what the pass remembers. Caches are emptied when full; they never change a result."""

    def __init__(self, model: bytes):
        vocabulary = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = vocabulary.vocab_size()
        self.text = [vocabulary.id_to_piece(i) for i in range(size)]
        special = [vocabulary.is_control(i) or vocabulary.is_unknown(i) or vocabulary.is_byte(i) or vocabulary.is_unused(i) for i in range(size)]
        self.ids = {self.text[i]: i for i in range(size) if not special[i]}
        self.score = [vocabulary.get_score(i) for i in range(size)]
        self.byte = [vocabulary.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = vocabulary.unk_id()
        self.by_byte = all(i != self.unknown for i in self.byte)
        self.longest = max(map(len, self.ids))
        back = {i: bytes([b]) for b, i in enumerate(self.byte)} if self.by_byte else {}
        self.octets = [back.get(i, b"" if special[i] else t.replace(SPACE, " ").encode()) for i, t in enumerate(self.text)]
        self.chars = {c for t in self.ids for c in t}
        # a space mark starts a piece or stands among space marks: no piece spans the edge before it
        self.marks_lead = not any(SPACE in t.lstrip(SPACE) for t in self.ids)
        self.segments = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if self.marks_lead else re.compile(r"(?s).+")
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.before = ("", [-1])
        # pieces that merging can reach, read from their end: each node is [what may stand before, the piece that starts here]
        self.endings: dict = {}
        for piece, i in self.ids.items():
            if self.merged(piece) == [piece]:
                below, node = self.endings, None
                for char in reversed(piece):
                    node = below.setdefault(char, [{}, None])
                    below = node[0]
                node[1] = i

    def merged(self, text: str) -> list[str]:
        """Greedy merging of a short text: the best-scored neighbours first, the leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.score[piece] > best):
                    best, at = self.score[piece], i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of two pieces gives the two back."""
        if len(self.pairs) > _CACHED:
            self.pairs.clear()
        a, b = self.text[left], self.text[right]
        known = self.pairs[left << 20 | right] = self.merged(a + b) == [a, b]
        return known

    def stream(self, segment: str) -> Iterator[int]:
        """Ids of a segment, committed while it is read; what is kept is bounded by the longest piece and the way to the last convergence."""
        longest = self.longest
        base = 0  # all positions up to here are committed
        ends = [-1]  # of each position from base: the piece that ends there; -1: none, the start; -2: a character without a piece
        for at in range(1, len(segment) + 1):
            chosen = self._ending(segment, at, base, ends)
            ends.append(chosen)
            if chosen == -2 or len(ends) > 4 * longest:
                meet = self._convergence(ends, at - base)
                if meet:
                    yield from self._back(segment, base, ends, meet)
                    # the piece before the boundary still decides what may follow it
                    ends = ends[meet:]
                    base += meet
        yield from self._back(segment, base, ends, len(ends) - 1)

    def _ending(self, segment: str, at: int, base: int, ends: list) -> int | None:
        """The piece that ends at ``at``: at most one has a compatible piece before it. None if there is none, -2 for a character without a piece."""
        pairs, below, start = self.pairs, self.endings, at
        while start > base:
            start -= 1
            node = below.get(segment[start])
            if node is None:
                break
            below, piece = node
            if piece is not None:
                before = ends[start - base]
                if before is not None:
                    fits = before < 0 or pairs.get(before << 20 | piece)
                    if fits or fits is None and self.compatible(before, piece):
                        return piece
        return None if segment[at - 1] in self.chars else -2

    def short(self, segment: str) -> list[int]:
        """Ids of a segment that is kept whole; what it shares with the segment before it is not searched again."""
        last, ends = self.before
        shared = 0
        for x, y in zip(last, segment, strict=False):
            if x != y:
                break
            shared += 1
        ends = ends[:shared + 1]
        for at in range(shared + 1, len(segment) + 1):
            ends.append(self._ending(segment, at, 0, ends))
        self.before = segment, ends
        return self._back(segment, 0, ends, len(segment))

    def _back(self, segment: str, base: int, ends: list, at: int) -> list[int]:
        out: list[int] = []
        while at > 0:
            piece = ends[at]
            if piece == -2:
                char = segment[base + at - 1].encode("utf-8", "surrogatepass")
                out.extend(reversed([self.byte[b] for b in char]) if self.by_byte else [self.unknown])
                at -= 1
            else:
                out.append(piece)
                at -= len(self.text[piece])
        out.reverse()
        return out

    def _convergence(self, ends: list, last: int) -> int:
        """The boundary that the paths of all positions run through from which a later piece can start."""
        if ends[last] == -2:
            return last
        paths = {p for p in range(max(0, last + 1 - self.longest), last + 1) if ends[p] is not None}
        while len(paths) > 1:
            top = max(paths)
            paths.remove(top)
            paths.add(top - (1 if ends[top] == -2 else len(self.text[ends[top]])) if top else 0)
        return paths.pop()

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each whole text: a space mark is put first, spaces become marks. Nothing for null and empty."""
        known = self.known
        for some in _runs(texts):
            cut = [self.segments.findall(SPACE + x.replace(" ", SPACE)) if x else () for x in some]
            new = {segment for segments in cut for segment in segments if segment not in known}
            if len(known) + len(new) > _CACHED:
                known.clear()
                new = {segment for segments in cut for segment in segments}
            for segment in sorted(new):  # sorted, as neighbours then share their beginnings
                if len(segment) <= _SHORT:
                    known[segment] = np.array(self.short(segment), np.int32).tobytes()
            for segments in cut:
                yield np.frombuffer(b"".join([known.get(x) or np.fromiter(self.stream(x), np.int32).tobytes() for x in segments]), np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes of all pieces, marks as spaces, without the first mark. Bytes that are no UTF-8 become U+FFFD."""
        text = b"".join([self.octets[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_WORKER: dict[int, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    """One vocabulary per worker process."""
    key = hash(model)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Pieces(model)
    return _WORKER[key]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(text: Column, model: bytes) -> Column:
    """array<int> of the whole text; empty for null and empty texts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = _pieces(model)
        for texts in batches:
            yield pd.Series(list(pieces.encode(texts)), dtype=object)

    return F.pandas_udf(run, "array<int>")(text)


def decode(ids: Column, model: bytes) -> Column:
    """The text of an array of ids; null ids and arrays count as none."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = _pieces(model)
        for rows in batches:
            yield pd.Series([pieces.decode([] if x is None else [int(i) for i in x if i is not None]) for x in rows], dtype=object)

    return F.pandas_udf(run, "string")(ids)


def encoded(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_ids, ids, exact for every row of ``docs``; exact tells whether decoding gives the text back, null as empty.

    The model is read once by the driver and sent along (half a megabyte). A text with the space mark itself is not exact.
    """
    model = read_model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            at = 0
            for texts in _runs(x.as_py() for x in batch.column("text")):
                ids = list(pieces.encode(texts))
                same = [pieces.decode(i.tolist()) == (x or "") for i, x in zip(ids, texts, strict=True)]
                sizes = np.array([len(i) for i in ids], np.int32)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(ids)), pa.array(sizes), lists, pa.array(same)],
                                                 names=["doc_id", "n_ids", "ids", "exact"])
                at += len(ids)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_ids int, ids array<int>, exact boolean")
