"""Token ids of whole texts with a public byte-level BPE file (tokenizers library, Python workers).

``Encoder.ids`` gives exactly the ids of ``Tokenizer.encode(text, add_special_tokens=False)``: a text
that holds one of the file's added tokens goes through that call, any other through ``Encoder.encode``.
``Encoder.encode`` reads special strings as ordinary text. It cuts a text where the file's split
pattern always cuts (before the last blank of a blank run), and keeps the ids of each distinct
piece, so a word that comes again costs one dictionary look-up. A store of ``MAX_PIECES`` entries is
set aside for an empty one, which takes what still comes up from it; the one set aside before goes.
So memory stays bounded and frequent pieces are kept.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

END_ID = 0
MAX_PIECES = 600_000
MAX_KEPT_CHARS = 64

# White space as the split pattern's \s has it (Unicode White_Space)
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(f"[{_WS}]+(?=[{_WS}][^{_WS}])|[{_WS}]+$|[{_WS}]?[^{_WS}]+")
# none of these in a text: it can be cut at every blank and before every line end
_RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")
_OTHER_WS = tuple("\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") + tuple(chr(c) for c in range(0x2000, 0x200B))
_MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"  # one split word, however many stand behind a word


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bpe = self.tokenizer.model.tokenize
        self.tokenizer.model._resize_cache(0)  # words are kept here
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.letters = _byte_letters()
        self.blank = self.letters[32]
        self.known: dict[str, bytes] = {}
        self.aside: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.line_end = self.word("\n")

    def word(self, word: str) -> bytes:
        """Ids of one word of the split pattern (little-endian unsigned 32-bit), by the library's BPE model."""
        if word.isascii() and (bare := word.removeprefix(" ")).isalpha():  # letters stand for themselves
            letters = self.blank + bare if len(bare) < len(word) else bare
        else:
            letters = word.encode("utf-8", "replace").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.bpe(letters)]).tobytes()

    def piece(self, piece: str) -> bytes:
        return b"".join([self.word(w) for w in self.split(piece)])

    def plain(self, lead: str, rest: str) -> bytes | None:
        """Ids of ``lead + rest`` if rest is letters with marks behind (two words of the split pattern)."""
        stem = rest.rstrip(_MARKS)
        if not stem.isalpha():
            return None
        tail = rest[len(stem):]
        ids = self.known.get(stem) if lead and tail else None
        if ids is None:
            ids = (self.aside.get(stem) if lead else None) or self.word(lead + stem)
            if lead and tail and len(stem) <= MAX_KEPT_CHARS:
                self.known[stem] = ids
        if tail not in self.marks:
            if len(self.marks) > 10_000:
                self.marks = {"": b""}
            self.marks[tail] = self.word(tail)
        return ids + self.marks[tail]

    def new(self, key: str) -> bytes:
        """Ids of a key of ``encode``."""
        if key[:1] == "\r":
            return self.piece(key[1:])
        if key[:1] == "\n":
            ids = self.plain("", key[1:])
            return self.piece(key) if ids is None else self.line_end + ids
        ids = self.plain(" ", key)
        return self.piece(" " + key) if ids is None else ids

    def ids(self, text: str) -> bytes:
        """Ids of a whole text, its added tokens as ids of their own."""
        if any(t in text for t in self.added):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return self.encode(text)

    def encode(self, text: str) -> bytes:
        """Ids of a text without an added token, or with such strings read as ordinary text."""
        known = self.known
        if len(known) > MAX_PIECES:
            self.aside, self.known = known, {}
            known = self.known
        odd = any(w in text for w in _RUNS) or not text.isascii() and any(w in text for w in _OTHER_WS)
        if odd:  # a blank run keeps its last blank for the word behind it
            pieces = ["\r" + p for p in _PIECES.findall(text)]
        else:
            pieces = text.replace("\n", " \n").split(" ")
            pieces[0] = "\r" + pieces[0]
        # keys: text behind a blank; "\n..." and "\r..." (without the mark) stand for themselves
        out = list(map(known.get, pieces))
        i, last, aside = -1, len(out), self.aside
        out.append(None)
        while (i := out.index(None, i + 1)) < last:
            p = pieces[i]
            ids = out[i] = aside.get(p) or self.new(p)
            if len(p) <= MAX_KEPT_CHARS:
                known[p] = ids
        out.pop()
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker, kept between tasks."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
