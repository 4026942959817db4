"""SentencePiece encoding and decoding (operator 4): one pass over the text, driven by an Aho-Corasick automaton.

The automaton holds the model's pieces. At each position the pieces that end there are found by following output
links, and each relaxes the best score of the position; the path of best scores is the encoding. For a unigram model a
piece adds its score (Viterbi). For a BPE model scores are merge ranks, of which a sum would mean nothing: there a piece adds 0 if
no merge crosses the joint with the piece before on the best path (`_Pairs`, remembered), and minus infinity otherwise,
which leaves exactly the segmentation that merging by rank gives. Characters without a piece fall back to bytes or to
the unknown id.

The model file is read once on the driver and sent to executors as a list of pieces (its size is that of the file);
the file itself need not exist there. Encoding is row by row in Arrow batches, with a bounded memory of words.
"""

from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Kinds of pieces and of models in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: An unknown character scores this much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Encoded stretches are remembered in two generations of about so many bytes each; a stretch takes UNIT_BYTES and its content.
WORD_BYTES, UNIT_BYTES = 110_000_000, 200
JOINT_MEMORY = 500_000


@dataclass
class PieceModel:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model_type: int = UNIGRAM
    dummy_prefix: bool = True
    squeeze: bool = False  # white space at the ends goes, runs become one space
    unknown: int = 0
    bytes_at: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.bytes_at = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + n]
            at += n


def load_model(path: str = DEFAULT_MODEL) -> PieceModel:
    """The pieces of a model file; refuses models whose normalisation isn't the identity."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, kinds, trainer, normaliser = [], [], [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append(piece.get(1, b"").decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    if normaliser.get(2):
        raise ValueError("the model has a normalisation table")
    if trainer.get(3, UNIGRAM) not in (UNIGRAM, BPE):
        raise ValueError("neither a unigram nor a BPE model")
    return PieceModel(pieces, scores, kinds, trainer.get(3, UNIGRAM), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)))


class _Pairs:
    """Whether merging by rank leaves the joint between two pieces alone."""

    def __init__(self, rank: dict[str, float]) -> None:
        self.rank = rank

    def merged(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            score, k = max((self.rank.get(a + b, -np.inf), -k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if score == -np.inf:
                break
            parts[-k : -k + 2] = [parts[-k] + parts[-k + 1]]
        return parts

    def alone(self, piece: str) -> bool:
        """Whether the piece is its own encoding."""
        return self.merged(piece) == [piece]

    def __call__(self, a: str, b: str) -> bool:
        return self.merged(a + b) == [a, b]


class Encoder:
    """Encodes and decodes with one model; built once a Python worker."""

    def __init__(self, model: PieceModel) -> None:
        import ahocorasick

        self.model, self.young, self.old, self.joints, self.held = model, {}, {}, {}, 0
        usable = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k in (NORMAL, USER_DEFINED) and p}
        self.usable, self.bpe = usable, model.model_type == BPE
        self.pairs = _Pairs({p: model.scores[i] for p, i in usable.items()})
        self.automaton = ahocorasick.Automaton()
        for piece, i in usable.items():
            if not self.bpe or self.pairs.alone(piece):
                self.automaton.add_word(piece, (i, len(piece), model.scores[i]))
        if usable:
            self.automaton.make_automaton()
        self.fallback_score = min((model.scores[i] for i in usable.values()), default=0.0) - UNKNOWN_PENALTY
        self.unit = self._units()
        self.texts = {i: x for i in range(len(model.pieces)) if (x := self._text(i)) is not None}

    def _text(self, i: int) -> str | None:
        """The text of a piece by itself; null for bytes that only count with others."""
        kind, piece = self.model.kinds[i], self.model.pieces[i]
        if kind == BYTE:
            return chr(int(piece[3:5], 16)) if int(piece[3:5], 16) < 128 else None
        return " ⁇ " if kind == UNKNOWN else "" if kind == CONTROL else piece.replace(MARK, " ")

    def _units(self) -> re.Pattern | None:
        """Stretches that may be encoded apart, as no piece spans two: before a mark, around a line feed, and between a
        word character and a following other character where no piece has these two side by side."""
        joint = {(a, b) for p in self.usable for a, b in zip(p, p[1:])}
        if any(b == MARK and a != MARK for a, b in joint) or any("\n" in x for x in joint):
            return None
        before: dict[str, set[str]] = {}
        for a, b in joint:
            if re.match(r"\w", a) and not re.match(r"\w", b) and b != MARK:
                before.setdefault(b, set()).add(a)
        glued = "|".join(f"(?<=[{re.escape(''.join(sorted(a)))}]){re.escape(b)}" for b, a in sorted(before.items()))
        more = f"(?:(?:{glued})[^\\w{MARK}\n]*\\w*)*" if glued else ""
        return re.compile(f"{MARK}*\\w+{more}|{MARK}*[^\\w{MARK}\n]+\\w*{more}|{MARK}+|\n")

    def _fallback(self, char: str) -> list[int]:
        at = self.model.bytes_at
        raw = char.encode("utf-8", "surrogatepass")
        return [at[b] for b in raw] if all(b in at for b in raw) else [self.model.unknown]

    def _viterbi(self, text: str) -> list[int]:
        """Ids of a stretch: the automaton's matches, in order of their ends, relax the best score of the position they end at.

        In a unigram model a piece adds its score. In a BPE model scores are merge ranks: a piece adds nothing where merging by
        rank leaves its joint with the last piece of the best path alone, and minus infinity elsewhere, so that one path has
        a finite score, the one that merging gives (test_bpe_path_is_unique tries all segmentations).
        """
        n, usable, bpe, fallback = len(text), self.usable, self.bpe, self.fallback_score
        joints, pieces, size = self.joints, self.model.pieces, len(self.model.pieces)
        nothing = float("-inf")
        best, begin, piece = [nothing] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        closed = 0
        for last, (i, length, score) in self.automaton.iter(text) if usable else ():
            end = last + 1
            while closed < last:  # a character without a piece of its own may also be unknown
                closed += 1
                if text[closed - 1] not in usable and best[closed - 1] + fallback > best[closed]:
                    best[closed], begin[closed], piece[closed] = best[closed - 1] + fallback, closed - 1, -1
            start = end - length
            if bpe:
                if best[end] > nothing or best[start] == nothing:  # the only path to the end is known, or there is none to the start
                    continue
                before = piece[start]
                if start and before >= 0:
                    fits = joints.get(before * size + i)
                    if fits is None:
                        if len(joints) > JOINT_MEMORY:
                            joints.clear()
                        fits = joints[before * size + i] = self.pairs(pieces[before], pieces[i])
                    score = 0.0 if fits else nothing
                else:
                    score = 0.0
            if best[start] + score > best[end]:
                best[end], begin[end], piece[end] = best[start] + score, start, i
        while closed < n:
            closed += 1
            if text[closed - 1] not in usable and best[closed - 1] + fallback > best[closed]:
                best[closed], begin[closed], piece[closed] = best[closed - 1] + fallback, closed - 1, -1
        out: list[int] = []
        while n:
            out += [piece[n]] if piece[n] >= 0 else self._fallback(text[begin[n] : n])[::-1]
            n = begin[n]
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts have none."""
        if not text:
            return []
        if self.model.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
            if not text:
                return []
        text = (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)
        one = self._viterbi
        if self.unit is None:
            return one(text)
        out: list[int] = []
        young, old = self.young, self.old
        for unit in self.unit.findall(text):
            found = young.get(unit)
            if found is None:
                found = old.get(unit)
                if found is None:
                    found = one(unit)
                if len(unit) <= 64:
                    self.held += UNIT_BYTES + len(unit) + 8 * len(found)
                    if self.held > WORD_BYTES:
                        self.old = old = young
                        self.young = young = {}
                        self.held = 0
                    young[unit] = found
            out += found
        return out

    def decode(self, ids: list[int] | None) -> str:
        """The text of ids: bytes are joined as UTF-8 (broken ones replaced), control ids have no text."""
        ids = ids if ids is not None else []
        try:  # bytes below 128 are characters of their own
            text = "".join(map(self.texts.__getitem__, ids))
            return text[1:] if self.model.dummy_prefix and text[:1] == " " else text
        except KeyError:
            pass
        parts, raw = [], bytearray()
        kinds, pieces = self.model.kinds, self.model.pieces
        for i in ids:
            if kinds[i] == BYTE:
                raw.append(int(pieces[i][3:5], 16))
                continue
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if kinds[i] == UNKNOWN:
                parts.append(" ⁇ ")
            elif kinds[i] != CONTROL:
                parts.append(pieces[i].replace(MARK, " "))
        if raw:
            parts.append(raw.decode("utf-8", "replace"))
        text = "".join(parts)
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


_ENCODERS: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    if shared.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.id] = Encoder(shared.value)
    return _ENCODERS[shared.id]


class _Shared:
    """A broadcast model with a key of its own."""

    def __init__(self, df: DataFrame, model: PieceModel) -> None:
        self.broadcast = df.sparkSession.sparkContext.broadcast(model)
        self.id = hashlib.sha256(repr((model.pieces, model.scores, model.kinds, model.model_type, model.dummy_prefix, model.squeeze)).encode("utf-8", "surrogatepass")).hexdigest()

    @property
    def value(self) -> PieceModel:
        return self.broadcast.value


def encode(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and n_tokens for every row; null and empty texts have no ids."""
    shared = _Shared(docs, model)

    def run(batches):
        encoder = _encoder(shared)
        for batch in batches:
            ids = [encoder.encode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long")


def decode(encoded: DataFrame, model: PieceModel, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows with ids; null ids are the empty text."""
    shared = _Shared(encoded, model)

    def run(batches):
        encoder = _encoder(shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encoder.decode(x) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    kind = encoded.select(id_col).schema[0].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"doc_id {kind}, text string")


def encode_digest(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text: doc_id, n_chars, n_tokens, ids, ids_sha256 (32-bit little-endian), lossless.

    lossless: decoding gives the text again. A text that has the mark U+2581 itself isn't, as the format writes spaces
    with it. A null text counts as empty. Other columns are not read; an empty table gives an empty result.
    """
    shared = _Shared(docs, model)

    def run(batches):
        encoder = _encoder(shared)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            ids = [np.array(encoder.encode(x), np.int32) for x in texts]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in texts], pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]))),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([encoder.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)], pa.bool_()),
                ],
                ["doc_id", "n_chars", "n_tokens", "ids", "ids_sha256", "lossless"],
            )

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"doc_id {kind}, n_chars long, n_tokens long, ids array<int>, ids_sha256 string, lossless boolean")
