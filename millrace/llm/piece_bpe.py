"""Encoding and decoding with a merge-type sentencepiece model, exactly as the library does it.

Encoding is by backtracking instead of merging: the longest piece at each position (found with an
Aho-Corasick automaton) is taken when it is compatible with the piece before it, otherwise a shorter one is
tried, and a bit field keeps positions from which no way leads on. Two neighbours are compatible when merging
their joined text again gives just these two; a sequence of pieces whose neighbours are all compatible is the
one that merging the whole text would give. No piece holds a space mark behind another character (checked when
the model is read), so no merge crosses such a place: texts are cut there, and the ids of short segments are
remembered in a cache of bounded size.

Null texts are empty texts; an empty text has the end id only. Rows, ties and repeated rows are handled one by
one; other columns are kept as they are.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, portions

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values of the model format
CACHED_LENGTH, CACHED_SEGMENTS = 40, 300_000
CACHED_PAIRS = 300_000
# a run of space marks with what follows it, up to the next mark
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _bytes_one_by_one(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("one_by_one", _bytes_one_by_one)


class PieceModel:
    """The pieces of a model file with an encoder and a decoder; build it once per process with ``load``."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as format_pb2

        model = format_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        plain = rules.name == "identity" and not rules.precompiled_charsmap and rules.escape_whitespaces
        if not plain or rules.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep texts as they are can be used")
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("only merge-type models with byte pieces can be used")
        if any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = rules.add_dummy_prefix
        self.end_id = model.trainer_spec.eos_id
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte_id = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.id_of):
            raise ValueError("a piece with an inner space mark would join segments")
        self.automaton = ahocorasick.Automaton()
        for piece in self.id_of:
            if self.merge(piece) == [piece]:  # others never come out of merging
                self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.width = max(map(len, self.id_of))
        # for every beginning of a piece, the longest piece inside it
        self.within: dict[str, str] = {}
        for piece in sorted(self.automaton.keys(), key=len):
            self.within[piece] = piece
        for piece in self.automaton.keys():
            inner = ""
            for end in range(1, len(piece)):
                inner = self.within.setdefault(piece[:end], inner) or inner
        self.lines_apart = not any("\n" in piece for piece in self.id_of)
        self.surface = [self._surface(p, model.trainer_spec.unk_surface) for p in model.pieces]
        self.byte_ids = frozenset(self.byte_id.values())
        self.control_ids = frozenset(i for i, p in enumerate(model.pieces) if p.type == CONTROL)
        self.surface_of = {str(i): s for i, s in enumerate(self.surface)}
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    @staticmethod
    def _surface(piece, unknown: str) -> bytes:
        if piece.type == CONTROL:
            return b""
        if piece.type == UNKNOWN:
            return unknown.encode()
        if piece.type == BYTE:
            return bytes([int(piece.piece[1:-1], 16)])
        return piece.piece.replace(SPACE, " ").encode()

    # -- encoding -----------------------------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """Plain merging: the best-scored neighbours first, the leftmost among equals."""
        rank, parts = self.rank, list(text)
        following = [*range(1, len(parts)), -1]
        previous = list(range(-1, len(parts) - 1))
        queue = [(rank[j], i, j) for i, j in enumerate(map("".join, zip(parts, parts[1:], strict=False))) if j in rank]
        heapq.heapify(queue)
        while queue:
            _, at, joined = heapq.heappop(queue)
            right = following[at]
            if right < 0 or not parts[at] or parts[at] + parts[right] != joined:
                continue
            parts[at], parts[right] = joined, ""
            following[at] = after = following[right]
            if after >= 0:
                previous[after] = at
                if (wider := joined + parts[after]) in rank:
                    heapq.heappush(queue, (rank[wider], at, wider))
            if (before := previous[at]) >= 0 and (wider := parts[before] + joined) in rank:
                heapq.heappush(queue, (rank[wider], before, wider))
        return [p for p in parts if p]

    def compatible(self, left: str, right: str) -> bool:
        if len(self.pairs) > CACHED_PAIRS:
            self.pairs.clear()
        answer = self.pairs[left, right] = self.merge(left + right) == [left, right]
        return answer

    def longest(self, text: str, at: int) -> str:
        """The longest piece that starts at ``at``; a character outside the vocabulary stands alone."""
        window = text[at : at + self.width]
        return self.within.get(window[: self.automaton.longest_prefix(window)]) or window[0]

    def split(self, text: str) -> list[str]:
        """The pieces of one segment; characters outside the vocabulary stand alone."""
        size = len(text)
        failed = bytearray(size // 8 + 1)
        taken: list[str] = []
        pairs, within, at = self.pairs, self.within, 0
        piece = self.longest(text, 0)
        while True:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1:
                fits = True
                if taken:
                    fits = pairs.get((taken[-1], piece))
                    if fits is None:
                        fits = self.compatible(taken[-1], piece)
                if fits:
                    taken.append(piece)
                    if end == size:
                        return taken
                    at, piece = end, self.longest(text, end)
                    continue
            shorter = within.get(piece[:-1])
            while not shorter:  # nothing leads on from here: give up the piece that led here
                failed[at >> 3] |= 1 << (at & 7)
                if not taken:
                    raise ValueError("no sequence of pieces fits this text")
                given_up = taken.pop()
                at -= len(given_up)
                shorter = within.get(given_up[:-1])
            piece = shorter

    def _ids(self, segment: str) -> str:
        ids: list[int] = []
        for piece in self.split(segment):
            known = self.id_of.get(piece)
            ids += [known] if known is not None else [self.byte_id[b] for b in piece.encode()]
        return " ".join(map(str, ids))

    def _known(self, key: str, segment: str) -> str:
        """The ids of a segment whose ``key`` is not in the newer half of the cache."""
        ids = self.older.get(key)
        if ids is None:
            ids = self._ids(segment)
        if len(segment) <= CACHED_LENGTH:
            if len(self.known) >= CACHED_SEGMENTS:  # what was not used since goes with the older half
                self.older, self.known = self.known, {}
            self.known[key] = ids
        return ids

    def encode_text(self, text: str) -> str:
        """All ids of a text, the end id included, in decimal and joined by one space."""
        if not text:
            return str(self.end_id)
        words = text.replace("\n", " \n").split(" ") if self.prefix and self.lines_apart else [""]
        if "" in words or SPACE in text:  # runs of spaces, spaces at an end, or marks in the text itself
            segments = _SEGMENT.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))
            parts = [self._known(SPACE + s, s) for s in segments]
        else:  # a word is cut before each space, which it gets as its mark, and before each line end
            parts = list(map(self.known.get, words))
            if None in parts:
                parts = [
                    p if p is not None else self._known(w, w if w[0] == "\n" else SPACE + w)
                    for p, w in zip(parts, words, strict=True)
                ]
        parts.append(str(self.end_id))
        return " ".join(parts)

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.encode_text(text).split(" ")))

    # -- decoding -----------------------------------------------------------------------------------

    def decode_text(self, ids: str) -> str:
        """The text of decimal ids joined by one space."""
        tokens = ids.split(" ") if ids else []
        surface = self.surface_of
        raw = b"".join([surface[t] for t in tokens])
        if self.prefix and raw[:1] == b" " and self._starts_with_mark(tokens):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="one_by_one")

    def _starts_with_mark(self, tokens: list[str]) -> bool:
        """Whether the first token with a text is a piece that starts with the space mark."""
        for token in map(int, tokens):
            if token not in self.control_ids:
                return token not in self.byte_ids and token in self.marked
        return False

    @property
    def marked(self) -> frozenset[int]:
        found = self.__dict__.get("_marked")
        if found is None:
            found = self._marked = frozenset(i for p, i in self.id_of.items() if p[0] == SPACE)
        return found

    def decode(self, ids: list[int]) -> str:
        return self.decode_text(" ".join(map(str, ids)))


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``ids`` (array of int) and ``decoded`` for every text; see the module for nulls.

    ``model_path`` must exist on every executor. Helper names step aside for columns of the same name.
    """
    return _with_tokens(docs, model_path, text, digests=False)


def token_digests(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` in place of the text; ids never leave the task.

    A null or empty text has the end id only. Repeated rows are encoded one by one, texts of any length whole, in segments;
    other columns stay as they are, and a new column whose name is taken gets an underscore. An empty table stays empty.
    """
    return _with_tokens(docs, model_path, text, digests=True)


def _with_tokens(docs: DataFrame, model_path: str, text: str, digests: bool) -> DataFrame:
    columns = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    kept = [c for c in docs.columns if digests is False or c.lower() != text.lower()]
    outs = fresh(docs, *columns)
    kinds = ["long", "string", "string"] if digests else ["long", "array<int>", "string"]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept]
        + [f"`{n}` {k}" for n, k in zip(outs, kinds, strict=True)]
    )
    source = docs.withColumn(text, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    place = docs.columns.index(text)
    places = [i for i, c in enumerate(docs.columns) if c in kept]

    names = [docs.columns[i] for i in places] + outs

    def run(batches):
        model = load(model_path)
        for batch in portions(batches):
            counts, first, second = [], [], []
            for value in batch.column(place).to_pylist():
                ids = model.encode_text(value)
                decoded = model.decode_text(ids)
                counts.append(ids.count(" ") + 1)
                if digests:
                    first.append(hashlib.sha256(ids.encode()).hexdigest())
                    second.append(hashlib.sha256(decoded.encode()).hexdigest())
                else:
                    first.append(list(map(int, ids.split(" "))))
                    second.append(decoded)
            arrays = [batch.column(i) for i in places]
            arrays += [pa.array(counts, pa.int64())]
            arrays += [pa.array(first, pa.string() if digests else pa.list_(pa.int32())), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, schema)
