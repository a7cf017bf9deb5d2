"""Token ids of byte-level BPE tokenizers, piece by piece, exactly as the library gives them.

The library's pre-tokenizer never lets a token cross from a non-white-space character to a
following white-space character, so a text can be cut into pieces: a run of other characters
with the one space before it, or a run of white space. Each distinct piece is encoded once per
worker and its ids are looked up afterwards. Texts that hold a special string are encoded whole,
because the library cuts at those first; so are all texts of a tokenizer of any other kind.
"""

from __future__ import annotations

import json
import os
import re
from array import array

#: The white-space characters of the pre-tokenizer's \s (Unicode White_Space).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Anything but single blanks and newlines between pieces takes the general pattern.
UNEVEN = re.compile("[\\x00\\t\\x0b-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f"
                    "\\u205f\\u3000]|[ \\n]{2}")
#: The same for Arrow's regular expressions.
UNEVEN_RE2 = ("[\\x00\\t\\x0b-\\r\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}"
              "\\x{202f}\\x{205f}\\x{3000}]|[ \\n]{2}")


def pieces(text: str) -> list[str]:
    """Cut a text into pieces; their concatenation is the text (empty pieces may occur)."""
    if UNEVEN.search(text):
        return PIECE.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the
    code points from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """One tokenizer in one worker. ``piece_ids`` encodes a piece, ``whole`` says whether a text
    must go to the library in one part."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                         and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                         and (spec.get("model") or {}).get("type") == "BPE")
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.n_vocab = self.tok.get_vocab_size(with_added_tokens=True)
        self._model, self._alphabet = self.tok.model, _byte_alphabet()
        # words of plain Latin letters, where the letter classes of all libraries agree
        self._plain = re.compile("[\\n -~\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u017f]*\\Z").match
        self._pre = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall

    def whole(self, text: str) -> bool:
        return not self.by_piece or any(s in text for s in self.special)

    def text_ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def piece_ids(self, piece: str) -> list[int]:
        if not piece:
            return []
        if not self._plain(piece):
            return self.text_ids(piece)
        bare = piece[1:] if piece[0] == " " else piece
        words = (piece,) if bare.isalpha() else self._pre(piece)
        if len(words) == 1:
            return self._word_ids(words[0])
        return [i for w in words for i in self._word_ids(w)]

    def _word_ids(self, word: str) -> list[int]:
        coded = word.encode().decode("latin-1").translate(self._alphabet)
        return [t.id for t in self._model.tokenize(coded)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, loaded once per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class PieceCache(dict):
    """key -> value, computed on a miss. ``pinned`` entries always stay. Of the others the last
    two generations of ``capacity`` entries are kept, and what the younger one asks for moves on
    from the older, so memory is bounded, frequent keys stay, and only speed depends on it."""

    def __init__(self, make, pinned: dict | None = None, capacity: int = 400_000):
        super().__init__(pinned or {})
        self._make, self._pinned, self._old, self.capacity = make, pinned or {}, {}, capacity

    def __missing__(self, piece):
        value = self._old.get(piece)
        if value is None:
            value = self._make(piece)
        if len(piece) <= 64:
            self[piece] = value
        return value

    def trim(self) -> None:
        if len(self) > self.capacity + len(self._pinned):
            self._old = dict(self)
            self.clear()
            self.update(self._pinned)


class BatchEncoder:
    """Ids of whole Arrow arrays of texts: pieces are split and told apart inside Arrow, each
    distinct piece of an array is looked up once, and the ids are gathered by numpy. What was
    encoded is remembered up to ``capacity`` pieces (then the frequent ones stay; only speed
    depends on it)."""

    #: Texts are taken together up to this many characters.
    CHUNK = 4 << 20

    def __init__(self, path: str, capacity: int = 700_000):
        self.enc, self.capacity = encoder(path), capacity
        self._latin = {c: chr(c).encode().decode("latin-1").translate(self.enc._alphabet)
                       for c in range(0xC0, 0x180)}
        self._reset()

    def _reset(self) -> None:
        import numpy as np
        self._known: dict[str, int] = {}
        self._ids, self._ends = array("I"), array("q", [0])
        self._uses = np.zeros(0, np.int32)

    def _trim(self) -> None:
        """Keep the pieces that several arrays asked for, at most half of the capacity."""
        import numpy as np
        keep = np.flatnonzero(self._uses > 1)
        if len(keep) > self.capacity // 2:
            keep = np.sort(keep[np.argsort(-self._uses[keep], kind="stable")[:self.capacity // 2]])
        names, ends, uses = list(self._known), np.array(self._ends), self._uses[keep]
        ids, ends = _gather(np.array(self._ids, np.uint32), ends[keep], np.diff(ends)[keep])
        self._known = {names[i]: n for n, i in enumerate(keep.tolist())}
        self._ids, self._ends = array("I", ids.tobytes()), array("q", ends.astype(np.int64).tobytes())
        self._uses = uses

    def _number(self, piece: str) -> int:
        at = self._known.get(piece)
        if at is not None:
            return at
        enc, word, ids = self.enc, piece[1:], self._ids
        if not enc._plain(piece):
            ids.extend(enc.text_ids(piece))
        elif piece[:1] == " " and word.isalpha():
            # a space and a word of Latin letters is one word of the pre-tokenizer
            if not word.isascii():
                word = word.translate(self._latin)
            ids.extend([t.id for t in enc._model.tokenize("\u0120" + word)])
        elif len(word) > 1 and word[-1] in ",.;:!?" and word[-2].isalpha():
            # a mark after a letter starts a word of the pre-tokenizer
            for a in (self._number(piece[:-1]), self._number(piece[-1])):
                ids.extend(ids[self._ends[a]:self._ends[a + 1]])
        else:
            ids.extend(enc.piece_ids(piece))
        self._ends.append(len(ids))
        at = self._known[piece] = len(self._known)
        return at

    def encode(self, texts):
        """``(ids, bounds)`` of an Arrow string array: text i has ``ids[bounds[i]:bounds[i+1]]``.
        Null texts count as empty."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        enc = self.enc
        if len(self._known) > self.capacity:
            self._trim()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, UNEVEN_RE2)
        for s in enc.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False)) if enc.by_piece else range(len(texts))
        whole: dict[int, list[int]] = {}
        plain = texts
        if len(odd):
            rows = texts.to_pylist()
            for i in odd:
                t = rows[i]
                if "\0" in t or enc.whole(t):
                    whole[int(i)], rows[i] = enc.text_ids(t), ""
                else:
                    rows[i] = "\0".join(PIECE.findall(t))
            mask = np.zeros(len(rows), bool)
            mask[list(odd)] = True
            cut = pa.array(rows, pa.large_string())
        plain = pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 ")
        if len(odd):
            plain = pc.if_else(pa.array(mask), cut, plain)
        cells = pc.split_pattern(plain, "\0")
        bounds = np.asarray(cells.offsets) - cells.offsets[0].as_py()
        coded = cells.flatten().dictionary_encode()
        number = np.fromiter(map(self._number, coded.dictionary.to_pylist()), np.int64,
                             len(coded.dictionary))
        if len(self._uses) < len(self._known):
            self._uses = np.concatenate([self._uses, np.zeros(len(self._known), np.int32)])
        self._uses[number] += 1
        at = number[np.asarray(coded.indices)] if len(number) else np.zeros(0, np.int64)
        ends = np.array(self._ends)
        ids, before = _gather(np.array(self._ids, np.uint32), ends[at], np.diff(ends)[at])
        bounds = before[bounds]
        for i in sorted(whole, reverse=True):      # rare: spliced in one by one
            ids = np.concatenate([ids[:bounds[i]], np.array(whole[i], np.uint32), ids[bounds[i]:]])
            bounds[i + 1:] += len(whole[i])
        return ids, bounds

    def documents(self, texts, end_id: int | None = None):
        """``(row, ids, bounds)`` for parts of an array of at most ``CHUNK`` characters (or one
        text): the part starts at ``row``; every text is closed by ``end_id`` if one is given."""
        import numpy as np
        import pyarrow.compute as pc
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
        row = 0
        while row < len(texts):
            done = size[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(size, done + self.CHUNK, "right")))
            ids, bounds = self.encode(texts.slice(row, stop - row))
            if end_id is not None:
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
            yield row, ids, bounds
            row = stop


def _gather(values, first, size):
    """The ranges ``values[first:first + size]`` one after the other, and where each starts."""
    import numpy as np
    before = np.concatenate([[0], size.cumsum()])
    step = np.repeat(first - before[:-1], size)
    return values[step + np.arange(before[-1])], before


_BATCH_ENCODERS: dict[str, BatchEncoder] = {}


def batch_encoder(path: str) -> BatchEncoder:
    """The worker's batch encoder for a tokenizer file; tasks of one worker share what it knows."""
    if path not in _BATCH_ENCODERS:
        _BATCH_ENCODERS[path] = BatchEncoder(path)
    return _BATCH_ENCODERS[path]
