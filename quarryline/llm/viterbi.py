"""SentencePiece encoding and decoding by a streaming Viterbi search.

Texts are fed to one search. An automaton of all pieces runs along and names, at each character, the pieces that end there,
so a boundary's best path is known as soon as its character is read. Boundaries that no later piece can start from are
dropped: the window has the longest piece's characters at most, besides what is not yet committed. Whenever the paths to
all surviving boundaries meet in one boundary, the ids up to it are committed and leave the window. No piece has the space
mark behind another character, so at a space the paths always meet; in stretches without spaces they are looked at once a
window's length. What the search has committed for a stretch between two spaces is kept in a pool of bounded size, and is
not searched for again while it is there.

Scores are those of the model file. A BPE model's scores are merge ranks; they become log-probabilities by Zipf's law.
Characters without a piece become byte pieces. The space mark itself, as a character of a text, also becomes bytes, which
makes decoding exact for every text.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarryline.llm.common import text_slices
from quarryline.llm.units import UnitEncoder

SPACE = "▁"
#: Stands for the space mark as a character of a text; no text in UTF-8 has it.
HIDDEN = "\udc00"
#: Added to a merge rank before the logarithm.
ZIPF_SHIFT = 3.0
#: What a character in bytes costs beyond the worst piece.
BYTE_PENALTY = 10.0
#: Scores from here down mark pieces that a model never chooses.
NEVER = -1e8


class PieceModel:
    """Pieces of a SentencePiece model file with log-probabilities."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names, scores = [sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)]
        mark = sp.piece_to_id(SPACE)
        scores[mark] = max(scores[mark], min(s for s in scores if s > NEVER))
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)) and scores[i] > NEVER]
        ranks = all(scores[i] <= 0 and scores[i] == int(scores[i]) for i in normal)
        total = math.log(sum(1 / (ZIPF_SHIFT - scores[i]) for i in normal)) if ranks else 0.0
        self.pieces = {names[i]: (i, -math.log(ZIPF_SHIFT - scores[i]) - total if ranks else scores[i]) for i in normal if SPACE not in names[i][1:]}
        self.mark = self.pieces[SPACE][0]
        self.automaton = ahocorasick.Automaton()
        for piece, (number, score) in self.pieces.items():
            self.automaton.add_word(piece, (len(piece), score, number))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.pieces))
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.fallback = min(s for _, s in self.pieces.values()) - BYTE_PENALTY
        self.unknown = sp.unk_id()
        values = {b: bytes([a]) for a, b in self.bytes.items()}
        self.values = [values.get(i, b"" if sp.is_control(i) else names[i].replace(SPACE, " ").encode()) for i in range(n)]

    def spelt(self, char: str) -> list[int]:
        """Ids of a character that no piece has."""
        return [self.bytes.get(b, self.unknown) for b in (SPACE if char == HIDDEN else char).encode("utf-8", "surrogatepass")]


class StreamingViterbi:
    """A search over a stream of characters: ``feed`` returns the ids that have become certain, ``close`` the rest.

    Of paths with equal scores the one whose last piece is longest wins, at every boundary.
    """

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        #: The last characters that were read, where a later piece may begin, and how many were read.
        self.tail, self.read = "", 0
        #: Characters that may still be asked for and their place in the stream; the last certain boundary's place.
        self.text, self.origin, self.begin = "", 0, 0
        #: Of each boundary from there on: its best path's score, the boundary before it there, and the piece between.
        self.best: list[float] = [0.0]
        self.back: list[tuple[int, int]] = [(0, -1)]
        #: Number of ids committed, and what it was before each space mark.
        self.committed = 0
        self.ids_before: list[int] = []

    def _reach(self, boundary: int) -> None:
        """Opens boundaries up to ``boundary``, each reached from the one before it by a character in bytes."""
        best, back, fallback = self.best, self.back, self.model.fallback
        for b in range(len(best), boundary + 1):
            best.append(best[-1] + fallback)
            back.append((b - 1, -1))

    def _meeting(self, first: int) -> int:
        """The last boundary that the best paths to all boundaries from ``first`` on share."""
        back = self.back
        alive = set(range(first, len(back)))
        while len(alive) > 1:
            last = max(alive)
            alive.discard(last)
            alive.add(back[last][0])
        return alive.pop()

    def _commit(self, boundary: int) -> list[int]:
        """Ids of the best path to ``boundary``, which becomes the window's begin."""
        path, at, back, shift = [], boundary, self.back, self.begin - self.origin
        while at:
            start, found = back[at]
            if found >= 0:
                path.append(found)
            else:
                path += reversed(self.model.spelt(self.text[shift + start : shift + at]))
            at = start
        path.reverse()
        self.begin += boundary
        self.best = self.best[boundary:]
        self.back = [(0, -1)] + [(a - boundary, b) for a, b in back[boundary + 1 :]]
        self.committed += len(path)
        return path

    def feed(self, text: str) -> list[int]:
        self.text = self.text[self.begin - self.origin :] + text
        self.origin = self.begin
        out: list[int] = []
        known, text = len(self.tail), self.tail + text
        offset = self.read - known + 1
        self.tail, self.read = text[max(len(text) - self.model.longest + 1, 0) :], self.read + len(text) - known
        mark, longest, fallback = self.model.mark, self.model.longest, self.model.fallback
        best, back, look, top = self.best, self.back, 4 * longest, len(self.best)
        shift = offset - self.begin
        for end, (length, score, piece) in self.model.automaton.iter(text):
            if end < known:
                continue
            at = end + shift
            if at >= top:
                if at > top:
                    self._reach(at - 1)
                if piece == mark or at > look:
                    # No piece reaches over a space, so the boundary before it alone survives; elsewhere later pieces may
                    # start from as many boundaries as the longest piece has characters.
                    out += self._commit(self._meeting(at - 1 if piece == mark else at - longest))
                    if piece == mark:
                        self.best[0] = 0.0
                        self.ids_before.append(self.committed)
                    best, back, shift = self.best, self.back, offset - self.begin
                    at = end + shift
                    look = max(4 * longest, at + longest)
                best.append(best[-1] + fallback)
                back.append((at - 1, -1))
                top = at + 1
            total = best[at - length] + score
            if total > best[at]:
                best[at], back[at] = total, (at - length, piece)
        self._reach(self.origin + len(self.text) - self.begin)
        if len(self.best) > 4 * longest:
            out += self._commit(self._meeting(len(self.best) - longest))
        return out

    def close(self) -> list[int]:
        """The ids of what is left; the end of the stream is the only boundary that survives it."""
        return self._commit(self._meeting(len(self.best) - 1))


def encode_stretches(model: PieceModel, stretches: list[str], chunk: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all stretches in sequence, and the number of each; every stretch begins with the space mark, and later space
    marks in it are literal characters of the text. One search runs over all of them."""
    search = StreamingViterbi(model)
    found: list[int] = []
    waiting: list[str] = []
    size = 0
    for stretch in stretches:
        waiting.append(SPACE + stretch[1:].replace(SPACE, HIDDEN) if SPACE in stretch[1:] else stretch)
        size += len(stretch)
        if size >= chunk:
            whole = "".join(waiting)
            for k in range(0, len(whole), chunk):
                found += search.feed(whole[k : k + chunk])
            waiting, size = [], 0
    found += search.feed("".join(waiting)) + search.close()
    ends = np.append(np.array(search.ids_before, np.int64)[1:], search.committed) if stretches else np.zeros(0, np.int64)
    return np.array(found, np.int32), np.diff(ends, prepend=0)


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


@lru_cache(maxsize=2)
def load_encoder(path: str) -> UnitEncoder:
    """The encoder of a model, which a Python worker keeps with its pool from task to task."""
    model = load(path)
    return UnitEncoder(lambda units: encode_stretches(model, units), SPACE, SPACE)


def decode(model: PieceModel, ids: list[int]) -> str:
    """The text of ids; the space before the first word isn't part of it."""
    return b"".join(map(model.values.__getitem__, ids))[1:].decode("utf-8", "replace")


def sp_encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of each row's whole text.

    A null or empty text is the space mark alone, a long one is encoded whole. Ids come out in the text's order for every row, repeated and null doc_ids
    included; other columns are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(model_path)
        for batch in text_slices(batches):
            ids, offsets = encoder(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)), pa.array(np.diff(offsets))], ["doc_id", "ids", "n_tokens"]
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long")


def sp_decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, text_sha256, text) of rows of ``sp_encode``: the decoded text, and digests of both sides.

    Null ids give a null text; ids outside the model raise an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                lists = [None if x is None else x for x in (part.column("ids")[i].values for i in range(part.num_rows))]
                arrays = [None if x is None else x.to_numpy(zero_copy_only=False).astype("<u4") for x in lists]
                texts = [None if a is None else decode(model, a.tolist()) for a in arrays]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_tokens": pa.array([None if a is None else len(a) for a in arrays], pa.int64()),
                        "ids_crc32": pa.array([None if a is None else zlib.crc32(a.tobytes()) for a in arrays], pa.int64()),
                        "text_sha256": pa.array([None if t is None else hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                        "text": pa.array(texts, pa.string()),
                    }
                )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, text_sha256 string, text string")
