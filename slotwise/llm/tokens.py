"""Whole texts to token ids with the tokenizers library, through a memo of chunks.

Both public tokenizers used here split a text before they merge, and no split piece reaches
over a change from a non-space to an ASCII white-space character. So a text's ids are the ids of
its chunks, one after another, and a chunk that was met before costs one dictionary look-up.
"""

from __future__ import annotations

import os
import re
from array import array

from slotwise.llm.common import kept, words_of

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space besides ASCII's; a run of white space that mixes both is not cut, the text is encoded whole.
_WIDE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_LED = re.compile(r"[\x20\t-\r]*[^\x20\t-\r]+|[\x20\t-\r]+").findall


# Words of these letters alone are one piece before merges, and no normaliser changes them but for case.
_PLAIN = {"bare": re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+").fullmatch, "led": re.compile(r" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch}


#: Letters that no normaliser splits or joins with what follows.
_LETTER = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]").fullmatch


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies spell a byte as its Latin-1 character if that prints, else as the next free one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class _Memo(dict):
    """chunk -> its ids; asks `find` for what it lacks, and keeps that while there is room."""

    def __init__(self, find, entries: int, longest: int):
        self.find, self.entries, self.longest = find, entries, longest

    def __missing__(self, chunk: str | bytes) -> bytes:
        ids, keep = self.find(chunk)
        if keep and len(self) < self.entries and len(chunk) <= self.longest:
            self[chunk] = ids
        return ids


class ChunkedTokenizer:
    """encode(texts) -> for each text the ids as little-endian unsigned 32-bit bytes, those that the library gives.

    chunks: "bare" if the tokenizer drops white space and lower-cases, "led" if a chunk keeps the white
    space before it, "whole" for any other tokenizer. memo_entries bounds the memo; chunks first met are
    the frequent ones, so a full memo just stops growing. A text that holds a special token's string is encoded
    whole; the string becomes the special id, as by the library's default, or with special_as_text, ordinary ids.
    """

    def __init__(self, path: str, chunks: str = "whole", memo_entries: int = 1_000_000, memo_chars: int = 40, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)), re.IGNORECASE).search if special else None
        self.mark = re.sub("[A-Za-z].*", "", os.path.commonprefix(special))  # what a text with one of them holds in any case
        self.model, self.chunks = self.tokenizer.model, chunks
        self.memo = _Memo(self._find, memo_entries, memo_chars)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _find(self, name: str | bytes) -> tuple[bytes, bool]:
        """A chunk's ids, and if they are worth keeping under its own name. Chunks of "bare" are UTF-8, since bytes are cut faster.

        A comma or stop after a plain letter is a piece of its own, so the word before it is looked up apart, and a bare
        plain word with capitals has the ids of the lower-case one. Of bare words both forms are kept from the second meeting
        on. A plain word goes to the library's merge model directly, anything else through all of its steps.
        """
        bare = self.chunks == "bare"
        chunk = name.decode() if bare else name
        if len(chunk) > 1 and chunk[-1] in ",." and _LETTER(chunk[-2]):
            before = name[:-1]
            met = bare and before in self.memo
            return self.memo[before] + self.memo[name[-1:]], met
        word = chunk.lower() if bare else chunk
        if _PLAIN[self.chunks](word):
            if word != chunk:
                low = word.encode()
                met = low in self.memo
                return self.memo[low], met
            return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_LETTERS))]).tobytes(), True
        return self._whole(chunk), True

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.chunks == "whole":
            return list(map(self._whole, texts))
        cut, get = words_of if self.chunks == "bare" else _LED, self.memo.__getitem__
        led, special, mark = self.chunks == "led", self.special, self.mark
        return [self._whole(t) if special and mark in t and special(t) or led and not t.isascii() and any(c in t for c in _WIDE) else b"".join(map(get, cut(t))) for t in texts]


_KEPT = kept("tokens")


def tokenizer(path: str, chunks: str) -> ChunkedTokenizer:
    """One per Python worker, so that the memo lasts over tasks."""
    if (path, chunks) not in _KEPT:
        _KEPT[path, chunks] = ChunkedTokenizer(path, chunks)
    return _KEPT[path, chunks]
