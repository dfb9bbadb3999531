"""Ids of the word-level BPE vocabulary (lower case, white space dropped), as its library gives them.

The library takes out its special strings, normalises (NFC, white space, lower case), cuts at white space and by a pattern
into runs of letters, single digits and runs of other signs, and merges inside those pieces only. So what stands between
white space is encoded alone, and the ASCII signs that end it are a piece of their own. A worker asks the library's model
once for each distinct piece and joins what it got. Only characters under U+0250 are cut or lowered here: there lower case
is one character for one (but for U+0130, which is left to the library) and nothing composes; all else goes through the
whole library.
"""

from __future__ import annotations

import re
from array import array

#: Characters that are left to the library: separators that only Python cuts at, and what lies beyond U+024F.
_OTHER = re.compile("[\x1c-\x1fİɐ-\U0010ffff]")
_SEPARATOR = re.compile("[\x1c-\x1f]")
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPECIAL = "<|"
#: Bytes that a worker's memory of pieces may take (counted as text, ids and 250 a piece), and the longest text that it
#: holds as one piece.
CACHE, LONGEST = 128 << 20, 256
#: The byte-level alphabet: printable bytes stand for themselves, the others for the characters from U+0100 on, in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - _PRINTABLE))}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def words_of(text: str) -> list[str]:
    """The outermost pieces of a text. A text with a control character that str.split() takes for white space stays one."""
    if _OTHER.search(text):
        return [text] if _SEPARATOR.search(text) else text.split()
    return (text if SPECIAL in text else text.lower()).split()


def stem(word: str) -> str:
    """A word without the signs at its end: they are a piece of their own after a letter or digit, so it is remembered alone."""
    core = word.rstrip(SIGNS)
    last = core[-1:]
    return core if core is not word and last.isalnum() and last < "ɐ" and last != "İ" and SPECIAL not in word else word


class Vocabulary:
    """The library's tokenizer with a memory of the pieces it has seen."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.model._resize_cache(0)  # its memory is this class
        self.model = self.library.model
        self.known: dict[str, bytes] = {}
        self.size, self.cache = 0, cache

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit numbers."""
        out: list[bytes | None] = []
        rest = []
        for w in words:
            if w.isascii() and (w.isalpha() and w.islower() or w and not w.strip(SIGNS)):  # one piece
                out.append(array("I", [t.id for t in self.model.tokenize(w)]).tobytes())
            elif w.isalpha() and not _OTHER.search(w) and w == w.lower():
                out.append(array("I", [t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(_BYTES))]).tobytes())
            else:
                out.append(None)
                rest.append(w)
        if rest:
            found = iter(self.library.encode_batch_fast(rest, add_special_tokens=False))
            out = [array("I", next(found).ids).tobytes() if x is None else x for x in out]
        return out

    def count_words(self, words: list[str]) -> list[int]:
        return [len(x) // 4 for x in self.encode_words(words)]

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text as the library cuts it, normalised; a text with special strings, or one that changes when it
        is normalised twice, stays one."""
        plain = self.library.normalizer.normalize_str(text)
        if SPECIAL in text or self.library.normalizer.normalize_str(plain) != plain:
            return [text]
        return [plain[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """All ids of each text, as little-endian unsigned 32-bit numbers."""
        known = self.known
        get = known.get
        rows, later, fresh = [], [], {}
        for t in texts:
            words = words_of(t)
            parts = list(map(get, words))
            rows.append(parts)
            if None in parts:
                for i, p in enumerate(parts):
                    if p is None:
                        w = words[i]
                        core = stem(w)
                        p = get(core)
                        if core is w:
                            fresh[w] = None
                            later.append((parts, i, w, ""))
                            continue
                        tail = w[len(core) :]
                        q = get(tail)
                        if p is None or q is None:
                            fresh[core] = fresh[tail] = None
                            later.append((parts, i, core, tail))
                        else:
                            parts[i] = p + q
        if fresh:
            new = list(fresh)
            fresh = dict(zip(new, self.encode_words(new)))
            for parts, i, core, tail in later:
                parts[i] = fresh[core] + fresh[tail] if tail else fresh[core]
            short = {w: x for w, x in fresh.items() if len(w) <= LONGEST}
            more = sum(map(len, short)) + sum(map(len, short.values())) + 250 * len(short)
            if self.size + more > self.cache:
                known.clear()
                self.size = 0
            known.update(short)
            self.size += more
        return [b"".join(parts) for parts in rows]


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each worker process and file; tasks of the same worker share its memory."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]
