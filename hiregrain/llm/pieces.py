"""SentencePiece encoding and decoding of whole texts with a streaming Viterbi pass.

The pass walks over a text's characters and keeps, for every position inside a window, a backpointer to the start of the
best last piece. Pieces are at most ``longest`` characters, so only that many positions can still be reached from the
future. Whenever the paths from all of these meet in one boundary, what lies before it is decided: its ids are committed
and its positions forgotten. Memory follows the window, not the text.

What "best" means depends on the model. A unigram model takes the largest sum of scores. A BPE model has no such sum: its
result for every prefix ends in one certain piece, namely the one that the pairwise merges leave standing next to the last
piece of the shorter prefix. So the backpointer of a BPE model is the only piece that is compatible with its predecessor,
and the ids equal those of the merge procedure. Characters outside the vocabulary become byte pieces, or the unknown id.

Defined results: null and empty texts have no ids; U+2581 in a text reads as a space, as in the public implementation;
repeated rows are encoded once each; extra columns are carried.
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hiregrain.llm.common import map_texts, worker_cache

SPACE = "▁"  # fixed value: how vocabularies write a space
UNIGRAM, BPE = 1, 2  # fixed values: model types
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values: piece types
CACHE_CHUNKS = 800_000
CACHE_PAIRS = 2_000_000
LONGEST_CACHED = 48
COMMIT_EVERY = 64  # positions between two looks for a common boundary
MISFIT = 10.0  # a unigram model scores an unknown character this much below its worst piece


class Pieces:
    """Vocabulary, encoder and decoder of one model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.kind = model.trainer_spec.model_type
        spec = model.normalizer_spec
        if self.kind not in (UNIGRAM, BPE) or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("needs a unigram or BPE model without text normalisation")
        self.dummy = spec.add_dummy_prefix
        listed = [(p.piece, p.score, p.type) for p in model.pieces]
        self._fill(listed, model.trainer_spec.byte_fallback)

    @classmethod
    def of(cls, pieces: list[tuple[str, float]], kind: int = UNIGRAM, dummy: bool = True) -> Pieces:
        """A vocabulary from a list; id 0 is unknown. For tests and small vocabularies."""
        self = cls.__new__(cls)
        self.kind, self.dummy = kind, dummy
        self._fill([("<unk>", 0.0, UNKNOWN), *((p, s, NORMAL) for p, s in pieces)], False)
        return self

    def _fill(self, listed: list[tuple[str, float, int]], fallback: bool) -> None:
        self.ids = {p: i for i, (p, _, t) in enumerate(listed) if t == NORMAL}
        self.scores = [s for _, s, _ in listed]
        self.unknown = next(i for i, (_, _, t) in enumerate(listed) if t == UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(listed) if t == BYTE} if fallback else {}
        self.longest = max(map(len, self.ids), default=1)
        self.worst = min((s for _, s, t in listed if t == NORMAL), default=0.0) - MISFIT
        self.single = {p for p in self.ids if len(p) == 1}
        # Every path passes a boundary between a character and a space if no piece crosses one: texts can be cut there.
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.cut = (lambda s: [s]) if crossing else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        plain = [b"" if t in (UNKNOWN, CONTROL) else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() for p, _, t in listed]
        self.written = plain
        self.written[self.unknown] = " ⁇ ".encode()  # fixed value: how the public implementation writes it
        self.machine = ahocorasick.Automaton()
        for piece in self.ids:
            self.machine.add_word(piece, piece)
        self.machine.make_automaton()
        self.known: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    # Encoding

    def _merged(self, text: str) -> list[str]:
        """The merge procedure itself, on a text of at most two pieces."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                one = self.ids.get(parts[i] + parts[i + 1])
                if one is not None and (best is None or self.scores[one] > best):
                    best, at = self.scores[one], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _compatible(self, before: str, piece: str) -> bool:
        pair = (before, piece)
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self._merged(before + piece) == ([before, piece] if before else [piece])
        return known

    def stream(self, characters: Iterable[str]) -> Iterator[int]:
        """Ids of a stream of characters (spaces written as U+2581, dummy prefix included)."""
        window = ""  # characters since the last commit
        back = [0]  # back[i]: start of the best last piece of window[:i]
        score = [0.0]
        last = [""]  # the piece that ended at the last commit decides what may follow it
        merge = self.kind == BPE
        for character in characters:
            if character not in self.single and (merge or self.longest == 1):  # no piece holds it: every path has a boundary on both sides
                yield from self._path(window, back, len(window))
                yield from self._outside(character)
                window, back, score, last = "", [0], [0.0], [""]
                continue
            window += character
            end = len(window)
            best, start = None, end - 1
            for begin in range(max(0, end - self.longest), end):
                piece = window[begin:]
                one = self.ids.get(piece)
                if merge:
                    if one is not None and self._compatible(last[begin], piece):
                        best, start = 0.0, begin
                        break
                elif one is not None or begin == end - 1:
                    reached = score[begin] + (self.scores[one] if one is not None else self.worst)
                    if best is None or reached > best:
                        best, start = reached, begin
            back.append(start)
            score.append(best or 0.0)
            last.append(window[start:])
            if end % COMMIT_EVERY == 0:
                cut = self._boundary(back)
                if cut:
                    yield from self._path(window, back, cut)
                    window = window[cut:]
                    back = [0, *(b - cut for b in back[cut + 1 :])]
                    score = [s - score[cut] for s in score[cut:]]
                    last = last[cut:]
        yield from self._path(window, back, len(window))

    def _window(self, chunk: str) -> list[int]:
        """What :meth:`stream` gives for a chunk that fits into one window of a BPE model, without the bookkeeping.

        An automaton lists the pieces that end at each position; exactly one of them is compatible with its predecessor.
        """
        pairs, compatible = self.pairs, self._compatible
        back, last = [-1] * (len(chunk) + 1), [""] * (len(chunk) + 1)
        back[0] = 0
        for end, piece in self.machine.iter(chunk):
            end += 1
            if back[end] < 0:
                begin = end - len(piece)
                if back[begin] >= 0:
                    known = pairs.get((last[begin], piece))
                    if known or (known is None and compatible(last[begin], piece)):
                        back[end], last[end] = begin, piece
        if min(back) < 0:  # a character outside the vocabulary
            return list(self.stream(chunk))
        end, found = len(chunk), []
        while end:
            found.append(self.ids[last[end]])
            end = back[end]
        return found[::-1]

    def _boundary(self, back: list[int]) -> int:
        """Where the paths from all positions that a later piece can start at have met."""
        ends = set(range(max(0, len(back) - self.longest), len(back)))
        while len(ends) > 1:
            latest = max(ends)
            ends.discard(latest)
            ends.add(back[latest])
        return ends.pop()

    def _path(self, window: str, back: list[int], end: int) -> list[int]:
        found: list[int] = []
        while end > 0:
            start = back[end]
            one = self.ids.get(window[start:end])
            found.extend([one] if one is not None else reversed(list(self._outside(window[start:end]))))
            end = start
        return found[::-1]

    def _outside(self, character: str) -> Iterator[int]:
        if self.bytes:
            yield from (self.bytes[b] for b in character.encode("utf-8", "surrogatepass"))
        else:
            yield self.unknown

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian signed 32-bit numbers."""
        if not text:
            return b""
        written = (SPACE if self.dummy else "") + text.replace(" ", SPACE)
        chunks = self.cut(written)
        known = self.known
        if len(known) > CACHE_CHUNKS:
            known.clear()
        long = {}
        for chunk in set(chunks).difference(known):
            if len(chunk) > LONGEST_CACHED:
                long[chunk] = np.fromiter(self.stream(chunk), dtype="<i4").tobytes()
            else:
                known[chunk] = np.array(self._window(chunk) if self.kind == BPE else list(self.stream(chunk)), dtype="<i4").tobytes()
        known.update(long)
        packed = b"".join(map(known.__getitem__, chunks))
        for chunk in long:  # seldom met again
            del known[chunk]
        return packed

    # Decoding

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of a stream of ids; holds at most one unfinished character."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        first = self.dummy
        for one in ids:
            raw = self.written[one]
            if first and raw:
                raw, first = raw.removeprefix(b" "), False
            yield decoder.decode(raw)
        yield decoder.decode(b"", True)

    def decode(self, packed: bytes) -> str:
        raw = b"".join(map(self.written.__getitem__, np.frombuffer(packed, "<i4").tolist()))
        return (raw.removeprefix(b" ") if self.dummy else raw).decode("utf-8", "replace")


def worker_pieces(path: str) -> Pieces:
    return worker_cache(("pieces", path), lambda: Pieces(path))


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the text replaced by its ids (array of int)."""

    def work(texts: list, batch: pa.RecordBatch) -> dict:
        pieces = worker_pieces(model)
        made = [np.frombuffer(pieces.encode(t), "<i4") for t in texts]
        ends = np.cumsum([0, *map(len, made)], dtype=np.int32)
        return {ids: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, "<i4"), *made])))}

    return map_texts(docs, work, f"`{ids}` array<int>", text, 128)


def decode(encoded: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with the ids replaced by their text; null ids give an empty text."""

    def work(rows: list, batch: pa.RecordBatch) -> dict:
        pieces = worker_pieces(model)
        return {text: pa.array([pieces.decode(np.array(r or [], "<i4").tobytes()) for r in rows], pa.string())}

    return map_texts(encoded, work, f"`{text}` string", ids, 128)


def encoding_report(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_ids``, ``ids_crc32``, ``text_crc32`` and ``exact`` (decoding gives the text back)."""

    def work(texts: list, batch: pa.RecordBatch) -> dict:
        pieces = worker_pieces(model)
        made = {"n_ids": [], "ids_crc32": [], "text_crc32": [], "exact": []}
        for t in (x or "" for x in texts):
            packed = pieces.encode(t)
            made["n_ids"].append(len(packed) // 4)
            made["ids_crc32"].append(zlib.crc32(packed))
            made["text_crc32"].append(zlib.crc32(t.encode("utf-8", "surrogatepass")))
            made["exact"].append(pieces.decode(packed) == t.replace(SPACE, " "))
        return {k: pa.array(v, pa.bool_() if k == "exact" else pa.int64()) for k, v in made.items()}

    return map_texts(docs, work, "n_ids long, ids_crc32 long, text_crc32 long, exact boolean", text, 128)
