"""Token ids of whole texts with public tokenizer files, remembering what words encode to.

Words repeat, so a text is cut where every tokenizer of the two kinds cuts it as well, and the library is asked only for the
chunks not met lately, many at a time:

* a byte-level BPE lets a single space begin a piece, and a single line break be one, when no white space is beside it;
* a tokenizer that lower-cases and drops white space cuts at every space.

Chunks keep whatever else they hold, so normalising, cutting into pieces and merging are all the library's. The ids are those
of ``Tokenizer.encode(text, add_special_tokens=False)``. Texts with a special token's string go to the library whole.

Arrow cuts the texts of a call and finds their distinct chunks, so each is looked up once a call. A word of Latin letters is
remembered without the marks behind it.
"""

from __future__ import annotations

import re
import struct
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space beside a space or a line break; Python's set holds Unicode's. Such texts are cut by the pattern below.
_LOOSE = re.compile(r"[ \n]\s|[^\S \n][ \n]")
_PAIRS = ("  ", " \n", "\n ", "\n\n")
_OTHER = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)")
#: Bytes of chunks and ids in a generation of an encoder's memory, and the longest chunk it keeps. A full generation becomes
#: the old one, from which chunks that occur again move on; the old one before it is forgotten.
REMEMBERED, LONGEST = 96 << 20, 64
_EACH = 120  # about what a remembered chunk takes beside its characters and ids
#: Words that the model alone may merge, and some that try a file.
_PROBE = "a I the Word antidisestablishmentarianism qzxj UPPER lowerUPPER ll s t end. end, a; Word: what? Oh! Été, naïve ÿ"
_PROBE += " t.. end.*** s$$$ Word!! a%, ll&&& x-- y)] z_ the### ªµº, I/ l` q~@ r^ s\\ t{|} u<=>+("
#: Marks that a run of, behind letters, is one piece of its own: ASCII's but for the apostrophe, which may begin a piece.
_MARKS, _MOST_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", 8
#: Chunks that the library is handed at a time.
BATCH = 1 << 14


def _word(stem: str) -> str | None:
    """The word of Latin letters that a chunk is, but for a line break before it."""
    word = stem[1:] if stem[:1] == "\n" else stem
    return word if word.isalpha() and (word.isascii() or max(word) <= "ÿ") else None


class Encoder:
    """Ids of whole texts as packed little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.drops_spaces = self.ids(["a b"]) == [b"".join(self.ids(["a", "b"]))]
        self._known: dict[str, bytes] = {"": b""}
        self._old: dict[str, bytes] = {}
        self._held = 0
        # Whether the model alone gives the ids of words and marks is tried for each file.
        self._merge, self.merges_words, probe = self.tokenizer.model.tokenize, False, _PROBE.split() + ["\nNext", "\nNext.**"] * (not self.drops_spaces)
        alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self._space, self._line = alphabet(" ")[0][0], alphabet("\n")[0][0]  # how the model spells them
        self._bytes = {c: alphabet(chr(c))[0][0] for c in range(0x80, 0x100)}
        self._mark = lru_cache(1 << 12)(self._spelled)
        try:
            stems = [x.rstrip(_MARKS) for x in probe]
            self.merges_words = [self._merged(s, _word(s)) + (self._mark(x[len(s) :]) if s != x else b"") for x, s in zip(probe, stems)] == self._asked(probe)
        except Exception:  # a model of another kind
            self.merges_words = False

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of texts by the library alone."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in found)]

    def _is_loose(self, text: str) -> bool:
        return text[-1:].isspace() or any(pair in text for pair in _PAIRS) or any(c in text for c in _OTHER) and _LOOSE.search(text) is not None

    def _spelled(self, *pieces: str) -> bytes:
        return array("I", [t.id for piece in pieces for t in self._merge(piece)]).tobytes()

    def _merged(self, stem: str, word: str) -> bytes:
        """Ids of a word of Latin letters, which is one piece, and a line break before it another: the library's model merges
        them without the steps before."""
        word = word.lower() if self.drops_spaces else word
        word = word if word.isascii() else word.translate(self._bytes)
        if self.drops_spaces:
            return self._spelled(word)
        return self._spelled(self._line, word) if stem[0] == "\n" else self._spelled(self._space + word)

    def _asked(self, new: list[str]) -> list[bytes]:
        """Ids of chunks inside a text by the library; those of a byte-level tokenizer begin with a space or a line break."""
        asked = new if self.drops_spaces else [x if x[:1] == "\n" else " " + x for x in new]
        return [ids for at in range(0, len(asked), BATCH) for ids in self.ids(asked[at : at + BATCH])]

    def _remember(self, chunk: str, ids: bytes) -> None:
        if len(chunk) <= LONGEST:
            self._known[chunk] = ids
            self._held += len(chunk) + len(ids) + _EACH

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks inside a text."""
        known, old = self._known.get, self._old.get
        found = list(map(known, chunks))
        others = []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            chunk = chunks[i]
            stem = chunk.rstrip(_MARKS)
            marks, word = chunk[len(stem) :], _word(stem) if self.merges_words else None
            if word is None or len(marks) > _MOST_MARKS:
                ids = old(chunk)
                if ids is None:
                    others.append(i)
                else:
                    found[i] = ids
                    self._remember(chunk, ids)
                continue
            ids = known(stem)
            if ids is None:
                ids = old(stem)
                ids = self._merged(stem, word) if ids is None else ids
                self._remember(stem, ids)
            found[i] = ids + self._mark(marks) if marks else ids
        for i, ids in zip(others, self._asked([chunks[i] for i in others])):
            found[i] = ids
            self._remember(chunks[i], ids)
        if self._held > REMEMBERED:
            self._old, self._known, self._held = self._known, {"": b""}, 0
        return found

    def _joined(self, cut: pa.ListArray) -> list[bytes]:
        """Ids of each list of chunks inside a text."""
        words = cut.flatten().dictionary_encode()
        ids = self._look_up(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        found = pa.array(ids, pa.large_binary()).take(words.indices)
        n = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
        ends = np.frombuffer(found.buffers()[1], np.int64)[np.concatenate([[0], np.cumsum(n)])].tolist()
        whole = memoryview(found.buffers()[2] or b"")
        return [bytes(whole[a:b]) for a, b in zip(ends, ends[1:])]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text: of what it begins with, and of the chunks inside. These go without the space they begin with."""
        fronts, insides, loose = [""] * len(texts), [""] * len(texts), {}
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                fronts[i] = text
            elif self.drops_spaces:
                insides[i] = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
            elif self._is_loose(text):
                fronts[i], *chunks = _CUT.split(text)
                loose[i] = [x[1:] if x[0] == " " else x for x in chunks]
            else:
                fronts[i], _, insides[i] = text.replace("\n", " \n").partition(" ")
        found = self._joined(pc.split_pattern(pa.array(insides, pa.large_string()), " "))
        if loose:
            for i, ids in zip(loose, self._joined(pa.array(list(loose.values()), pa.list_(pa.large_string())))):
                found[i] = ids
        full = [i for i, x in enumerate(fronts) if x]
        for i, ids in zip(full, self.ids([fronts[i] for i in full])):
            found[i] = ids + found[i]
        return found

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    return Encoder(path)
