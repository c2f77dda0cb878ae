"""SentencePiece BPE encoding by a prefix table, and decoding.

For every prefix of a text, BPE's encoding of that prefix ends in one particular token. The table stores that token for
each prefix, from left to right: among the tokens that end at a position (found by an automaton), the last one is that
which leaves a prefix whose own last token is compatible with it, that is, which BPE keeps apart from it. Following the
table backwards from the end gives the ids. The work is linear in the text, and a merge queue is run only where a word
begins with two marks or a model's texts cannot be split into words.

Two tokens are compatible if no merge across their boundary comes before the merges that hide the pieces next to it. The
test undoes the merges of both sides, latest first, and looks at each pair that met at the boundary.

Pieces hold the white-space mark only in front, so a text splits in front of marks into words that are encoded alone; a
bounded memory of words saves repeated work. Runs of several marks follow the merge order itself (their scores tie).
"""

from __future__ import annotations

import heapq
import re
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfund.llm.common import keyed, table

MARK = "▁"
#: Words whose ids a worker remembers; when full, it starts anew.
REMEMBERED_WORDS = 300_000
#: Only shorter words are remembered.
REMEMBERED_LENGTH = 48
_loaded: dict[bytes, PieceTable] = {}


class PieceTable:
    """The pieces of a BPE model, with what encoding and decoding need."""

    def __init__(self, model: bytes):
        _checked(model)
        library = sentencepiece.SentencePieceProcessor(model_proto=model)  # only to read the list of pieces
        self.surface: list[str] = []
        self.byte = np.full(library.get_piece_size(), -1, np.int16)
        self.ids: dict[str, int] = {}
        scores = []
        for k in range(library.get_piece_size()):
            piece = library.id_to_piece(k)
            scores.append(library.get_score(k))
            self.surface.append("" if library.is_control(k) else piece.replace(MARK, " "))
            if library.is_byte(k):
                self.byte[k] = int(piece[3:5], 16)
            elif library.is_unknown(k):
                self.surface[k] = " ⁇ "
            elif not library.is_control(k) and not library.is_unused(k):
                self.ids[piece] = k
        self.bytes = {int(b): k for k, b in enumerate(self.byte) if b >= 0}
        self.rank = {k: -scores[k] for k in self.ids.values()}
        self.words = all(MARK not in piece.lstrip(MARK) for piece in self.ids)
        self.piece = {k: p for p, k in self.ids.items()}
        #: The two pieces whose merge gives a piece; none for single characters.
        self.halves: dict[int, tuple[int, int]] = {}
        reached = []
        for piece, k in self.ids.items():
            tokens, last = self._merge(piece)
            if tokens != [k]:
                continue  # BPE never gives this piece
            reached.append(piece)
            if last:
                self.halves[k] = last
        #: Pieces whose halves were merged before them, as the compatibility test assumes; all but runs of marks.
        self.regular = {k for k in self.rank if all(self.rank[h] < self.rank[k] or h not in self.halves for h in self.halves.get(k, ())) and (len(self.piece[k]) == 1 or self.piece[k].strip(MARK))}
        self.automaton = ahocorasick.Automaton()
        for piece in reached:
            self.automaton.add_word(piece, (len(piece), self.ids[piece]))
        self.automaton.make_automaton()
        #: Pairs of tokens known to be compatible, and known not to be.
        self.fit: set[int] = set()
        self.unfit: set[int] = set()
        self.remembered: dict[str, list[int]] = {}
        self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall

    def _merge(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """BPE in merge order, best score first and leftmost on ties; unknown characters are negative code points. Also
        the two halves of the last merge."""
        token = [self.ids.get(c, -ord(c) - 1) for c in text]
        piece = list(text)
        after, before = [*range(1, len(text)), -1], [*range(-1, len(text) - 1)]
        queue: list[tuple[float, int, int, str]] = []

        def meet(a: int) -> None:
            if a >= 0 and (b := after[a]) >= 0 and (k := self.ids.get(piece[a] + piece[b])) is not None:
                heapq.heappush(queue, (self.rank[k], a, b, piece[a] + piece[b]))

        for a in range(len(text) - 1):
            meet(a)
        last = None
        while queue:
            _, a, b, merged = heapq.heappop(queue)
            if not piece[a] or after[a] != b or piece[a] + piece[b] != merged:
                continue
            last = (token[a], token[b])
            piece[a], token[a], piece[b] = merged, self.ids[merged], ""
            after[a] = after[b]
            if after[a] >= 0:
                before[after[a]] = a
            meet(before[a])
            meet(a)
        return [k for k, p in zip(token, piece, strict=True) if p], last

    def _apart(self, a: int, b: int, pair: int) -> bool:
        """Whether BPE leaves the boundary between the tokens ``a`` and ``b``; remembers it by the number ``pair``."""
        if a < 0:
            return True  # an unknown character merges with nothing
        if a in self.regular and b in self.regular:
            apart = self._undo(a, b)
        else:
            apart = self._merge(self.piece[a] + self.piece[b])[0] == [a, b]
        memory = self.fit if apart else self.unfit
        if len(memory) >= 2 * REMEMBERED_WORDS:
            memory.clear()
        memory.add(pair)
        return apart

    def _undo(self, left: int, right: int) -> bool:
        piece, ids, rank, halves = self.piece, self.ids, self.rank, self.halves
        # Rank and side of the merge that ended the pair now at the boundary; the final pair was ended by none.
        ended, on_left = float("inf"), False
        while True:
            joint = ids.get(piece[left] + piece[right])
            # On equal ranks the leftmost goes first: a merge inside the left token precedes one across the boundary.
            if joint is not None and (rank[joint] < ended or rank[joint] == ended and not on_left):
                return False
            a, b = halves.get(left), halves.get(right)
            if a is None and b is None:
                return True
            on_left = b is None or a is not None and rank[left] > rank[right]
            if on_left:
                ended, left = rank[left], a[1]
            else:
                ended, right = rank[right], b[0]

    def _word(self, word: str) -> list[int]:
        """Ids of a text without inner marks."""
        last, back, done = [0], [0], 0  # of each prefix: its last token, and where that begins
        fit, unfit, apart, many = self.fit, self.unfit, self._apart, len(self.surface)
        for at, (size, k) in self.automaton.iter(word):
            if at < done:
                continue  # the prefix that ends here has its token
            while done < at:  # no piece ends here: an unknown character
                last.append(-ord(word[done]) - 1)
                back.append(done)
                done += 1
            begin = at + 1 - size
            if begin:
                pair = last[begin] * many + k
                if pair not in fit and (pair in unfit or not apart(last[begin], k, pair)):
                    continue
            last.append(k)
            back.append(begin)
            done += 1
        for place in range(done, len(word)):
            last.append(-ord(word[place]) - 1)
            back.append(place)
        ids, end = [], len(word)
        while end:
            k = last[end]
            if k < 0:
                ids += [self.bytes[b] for b in reversed(chr(-k - 1).encode("utf-8", "surrogatepass"))]
            else:
                ids.append(k)
            end = back[end]
        ids.reverse()
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without begin and end ids."""
        if not text:
            return []
        text = MARK + text.replace(" ", MARK)
        if not self.words:
            return self._spelled(text)
        recall = self.remembered.get
        return list(chain.from_iterable([recall(word) or self._learn(word) for word in self.split(text)]))

    def _learn(self, word: str) -> list[int]:
        ids = self._spelled(word) if word.startswith(MARK + MARK) else self._word(word)
        if len(word) <= REMEMBERED_LENGTH:
            if len(self.remembered) >= REMEMBERED_WORDS:
                self.remembered.clear()
            self.remembered[word] = ids
        return ids

    def _spelled(self, text: str) -> list[int]:
        ids = [[k] if k >= 0 else [self.bytes[b] for b in chr(-k - 1).encode("utf-8", "surrogatepass")] for k in self._merge(text)[0]]
        return list(chain.from_iterable(ids))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: runs of byte pieces are read as UTF-8 (each byte that is none becomes U+FFFD), and the mark
        that encoding puts in front is taken off."""
        surface = self.surface
        codes = np.asarray(ids, np.int64)
        if not len(codes):
            return ""
        byte = self.byte[codes] >= 0
        if not byte.any():
            text = "".join([surface[k] for k in ids])
        else:
            parts, edges = [], np.concatenate([[0], np.flatnonzero(byte[1:] != byte[:-1]) + 1, [len(codes)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                parts.append(_utf8(self.byte[codes[a:b]].astype(np.uint8).tobytes()) if byte[a] else "".join([surface[k] for k in ids[a:b]]))
            text = "".join(parts)
        first = self.piece.get(next((k for k in ids if surface[k]), -1), "")
        return text[1:] if first.startswith(MARK) else text


def _utf8(data: bytes) -> str:
    text, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                text.append(data[at : at + size].decode())
            except UnicodeDecodeError:
                continue
            break
        else:
            size = 1
            text.append("�")
        at += size
    return "".join(text)


def _fields(message: bytes) -> dict[int, list[bytes | int]]:
    """The fields of a protocol-buffer message, by number: numbers, or the bytes of texts and messages."""
    found: dict[int, list[bytes | int]] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = number()
        if tag & 7 == 0:
            value: bytes | int = number()
        else:
            size = number() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            value, at = message[at : at + size], at + size
        found.setdefault(tag >> 3, []).append(value)
    return found


def _checked(model: bytes) -> None:
    """Refuses models whose texts are prepared in another way than ``encode`` does: it adds one mark in front, keeps all
    white space, turns spaces into marks and leaves characters as they are."""
    parts = _fields(model)
    trainer, normalizer = ({k: v[-1] for k, v in _fields(parts[n][-1]).items()} if n in parts else {} for n in (2, 3))
    asked = {
        "is no BPE model": trainer.get(3, 1) == 2,
        "has no bytes for unknown characters": trainer.get(35, 0) == 1,
        "puts the mark behind words": not trainer.get(24, 0),
        "normalises characters": not normalizer.get(2, b""),
        "adds no mark in front": normalizer.get(3, 1) == 1,
        "removes white space": normalizer.get(4, 1) == 0,
        "keeps spaces": normalizer.get(5, 1) == 1,
        "has pieces that users defined": all(_fields(piece).get(3, [1])[-1] != 4 for piece in parts.get(1, [])),
    }
    if wrong := [what for what, fine in asked.items() if not fine]:
        raise ValueError(f"this model {' and '.join(wrong)}: its texts are prepared differently")


def load(model: bytes) -> PieceTable:
    """The table of a model, made once in each Python process."""
    if model not in _loaded:
        _loaded[model] = PieceTable(model)
    return _loaded[model]


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_and_decode(docs: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, t, ids, decoded`` of each row: the ids of its whole text, and the text that those ids decode to.

    Null and empty texts have no ids and decode to the empty text. Rows are independent, so ties, repeated rows and other
    columns (not read) don't matter, and an empty table gives an empty result. ``model`` holds a model file's bytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as long as the model file, whatever the corpus

    def work(batches):
        pieces = load(shared.value)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = [pieces.encode(text) for text in part.column(2).to_pylist()]
                decoded = [pieces.decode(row) for row in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "t", "ids", "decoded"])

    return keyed(docs).mapInArrow(work, "doc_id long, t long, ids array<int>, decoded string")


def default_model() -> bytes:
    import public_tokenizers

    return read_model(public_tokenizers.path("piece_bpe_32k.model"))


def op9_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_and_decode(table(spark, sf_dir, "documents"), default_model())
    return digests(found)


def digests(found: DataFrame, *more: str) -> DataFrame:
    """The digest columns of ``encode_and_decode`` rows, and the columns named."""
    return found.select("doc_id", *more, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
