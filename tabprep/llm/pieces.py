"""SentencePiece encoding and decoding of whole texts with a merge-type vocabulary.

For every prefix of a word a table keeps the one last token its encoding can have: of the vocabulary matches that end
there (found by an Aho-Corasick automaton) it is the one whose pair with the last token before it is what merging
leaves. The ids are then read from the table backwards. Texts are decoded from their ids by the library.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
from pyspark.sql import DataFrame

from tabprep.llm.common import Memory, blocks, map_batches

SPACE = "▁"

def default_model() -> str:
    """The public model file; its path is only a default of the ``model`` parameters."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Encoder of one model file, for merge-type models with byte fallback and a leading space, and the library's decoder."""

    def __init__(self, model: str, remembered: int):
        import ahocorasick
        import sentencepiece

        self.source = source = sentencepiece.SentencePieceProcessor(model_file=model)
        size = source.vocab_size()
        self.pieces = [source.id_to_piece(i) for i in range(size)]
        is_byte = [source.is_byte(i) for i in range(size)]
        special = [source.is_control(i) or source.is_unknown(i) or source.is_unused(i) for i in range(size)]
        ordinary = [i for i in range(size) if not (is_byte[i] or special[i])]
        self.ids = {self.pieces[i]: i for i in ordinary}
        self.scores = {self.pieces[i]: source.get_score(i) for i in ordinary}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(size) if is_byte[i]}
        self.pattern = self._unit_pattern()
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) == 1 or self.merges(piece)[0] == [piece]:  # others are never left by merging
                self.automaton.add_word(piece, (len(piece), piece, {}))
        self.automaton.make_automaton()
        self.judged = 0
        self.id_texts = {piece: str(i) for piece, i in self.ids.items()}
        self.ends: dict[str, list[tuple[str, float]]] = {}
        self.starts: dict[str, list[tuple[str, float]]] = {}
        self.words = Memory(self._word, remembered)
        self.parts = Memory(self._part, remembered)

    def _unit_pattern(self) -> re.Pattern:
        """Units that no piece runs over the end of: spaces, signs, then letters and digits.

        Where a sign comes next that some piece has right behind a letter or digit, the unit goes on to the next space.
        """
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            raise ValueError("pieces must not run over the start of a word")
        behind: dict[str, set[str]] = {}
        for piece in self.ids:
            for a, b in zip(piece, piece[1:]):
                if a.isalnum() and not b.isalnum():
                    behind.setdefault(b, set()).add(a)
        stops = "".join(
            f"(?!(?<=[{''.join(map(re.escape, sorted(letters)))}]){re.escape(sign)})" for sign, letters in sorted(behind.items())
        )
        return re.compile(rf"(?=.){SPACE}*+(?:[^\w{SPACE}]|_)*+[^\W_]*+{stops}|{SPACE}*[^{SPACE}]+", re.DOTALL)

    def merges(self, text: str) -> tuple[list[str], list[tuple[float, int, str, str]]]:
        """Merging by its definition, best score first, leftmost on ties: what is left, and score, place and
        sides of every merge in turn."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []
        done = []

        def offer(left: int, right: int) -> None:
            joined = parts[left] + parts[right]
            if joined in self.scores:
                heapq.heappush(heap, (-self.scores[joined], left, joined))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            score, left, joined = heapq.heappop(heap)
            right = after[left] if parts[left] is not None else len(parts)
            if right >= len(parts) or parts[left] + parts[right] != joined:
                continue
            done.append((-score, left, parts[left], parts[right]))
            parts[left], parts[right] = joined, None
            after[left] = after[right]
            if after[left] < len(parts):
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        return [part for part in parts if part is not None], done

    def edge(self, token: str, at_end: bool) -> list[tuple[str, float]]:
        """The fragments that stand at one end of a token while it is merged, from a character on, each with the score
        at which it is merged away: the lowest score merged until then."""
        cache = self.ends if at_end else self.starts
        if token not in cache:
            out, lowest, now = [], float("inf"), token[-1] if at_end else token[0]
            for score, place, left, right in self.merges(token)[1]:
                lowest = min(lowest, score)
                if place + len(left) + len(right) == len(token) if at_end else place == 0:
                    out.append((now, lowest))
                    now = left + right
            cache[token] = [*out, (now, float("-inf"))]
        return cache[token]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging leaves the two tokens apart: no two fragments that meet at their border join first."""
        if right[0] == SPACE:  # only runs of spaces: their pieces share one score, so places decide
            return self.merges(left + right)[0] == [left, right]
        ends, starts, scores = self.edge(left, True), self.edge(right, False), self.scores
        i = j = 0
        while True:
            (a, until_a), (b, until_b) = ends[i], starts[j]
            score = scores.get(a + b)
            if score is not None and score > until_a and score >= until_b:
                return False
            if i + 1 == len(ends) and j + 1 == len(starts):
                return True
            if until_a >= until_b:
                i += 1
            else:
                j += 1

    def _judge(self, before: str, piece: str) -> bool:
        """``compatible``, of which the automaton remembers a bounded number of answers with its pieces."""
        self.judged += 1
        if self.judged > JUDGED:
            self.judged = 0
            for _, _, behind in self.automaton.values():
                behind.clear()
        return self.compatible(before, piece)

    def tokens(self, unit: str) -> list[str]:
        """Tokens of one unit by the prefix table. Characters outside the vocabulary stand alone."""
        last: list[str] = [""] * len(unit)
        for end, (size, piece, behind) in self.automaton.iter(unit):  # in order of their ends; behind what the piece may stand
            if last[end]:
                continue
            if size <= end:
                # characters outside the vocabulary have no match; the one just before may still be unset
                before = last[end - size] or unit[end - size]
                fits = behind.get(before)
                if fits is None:
                    fits = behind[before] = self._judge(before, piece)
                if not fits:
                    continue
            last[end] = piece
        out, end = [], len(unit)
        while end:
            token = last[end - 1] or unit[end - 1]
            out.append(token)
            end -= len(token)
        out.reverse()
        return out

    def unit_ids(self, unit: str) -> list[int]:
        out: list[int] = []
        for token in self.tokens(unit):
            known = self.ids.get(token)
            if known is None:
                out.extend(self.byte_ids[b] for b in token.encode())
            else:
                out.append(known)
        return out

    def _word(self, word: str) -> str:
        """The ids, as text, of what stands between two single spaces of a text, with the space before it."""
        return ",".join(map(self.parts.__getitem__, self.pattern.findall(SPACE + word)))

    def _part(self, unit: str) -> str:
        """The ids of a unit as text."""
        texts = [self.id_texts.get(token) for token in self.tokens(unit)]
        if None not in texts:
            return ",".join(texts)
        return ",".join(map(str, self.unit_ids(unit)))

    def units(self, text: str) -> list[str]:
        """The text with its leading space and marked spaces, cut where no token can run across."""
        return self.pattern.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for unit in self.units(text) for i in self.unit_ids(unit)]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The library's ``decode`` of the ids."""
        return self.source.decode(ids)

    def encode_text(self, text: str) -> tuple[np.ndarray, str, str]:
        """The ids, the ids joined by commas, and the text decoded from them."""
        if not text:
            return np.zeros(0, np.int32), "", ""
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            joined = ",".join(map(self.parts.__getitem__, self.units(text)))
        else:
            joined = ",".join(map(self.words.__getitem__, text.split(" ")))
        ids = np.fromstring(joined, np.int32, sep=",")
        return ids, joined, self.decode(ids)

    def forget(self) -> None:
        """Give up what is remembered of whole words, and the older half of the units: a worker lives on after the task."""
        self.words.clear()
        self.words.old, self.parts.old = {}, {}


#: Bytes of the texts that are encoded at once.
TOGETHER = 500_000
#: Words, and units of them, of which a worker remembers the ids (up to twice as many), and answers about pairs of tokens.
REMEMBERED, JUDGED = 300_000, 300_000
_codecs: dict[str, Codec] = {}


def codec(model: str, remembered: int = REMEMBERED) -> Codec:
    """The codec of a model file, built once in each Python worker."""
    if model not in _codecs:
        _codecs[model] = Codec(model, remembered)
    return _codecs[model]


def encode_documents(
    docs: DataFrame, model: str | None = None, with_ids: bool = False, remembered: int = REMEMBERED
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text, with ``ids`` and ``decoded`` if asked.

    Null and empty texts have no ids and decode to the empty text. Repeated rows each give a row, null ids stay null, other
    columns are ignored. ``model`` is the path of a model file that every executor can open. A worker remembers the ids of
    ``remembered`` words, about 200 bytes each; where that is below the default it gives up most of them behind every task.
    """
    path = model or default_model()
    fields = [("doc_id", "long"), ("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    fields += [("ids", "array<int>"), ("decoded", "string")] if with_ids else []

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches):
        own = codec(path, remembered)
        for keys, texts in blocks(batches, TOGETHER):
            rows = []
            for key, text in zip(keys, texts):
                ids, joined, decoded = own.encode_text(text or "")
                row = (key, len(ids), digest(joined), digest(decoded))
                rows.append(row + ((ids, decoded) if with_ids else ()))
            yield {name: column for (name, _), column in zip(fields, zip(*rows))}
        if remembered < REMEMBERED:
            own.forget()

    return map_batches(docs.select("doc_id", "text"), fields, run)
