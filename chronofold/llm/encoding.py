"""Token ids from the tokenizers library, with a bounded cache of space-delimited words.

Both vocabularies cut a text before every space or line feed that stands between two words, so ids of a
word are the same wherever it stands, and a text's ids are its words' ids one after the other. Texts in
which white space does anything else (runs, tabs, margins) go to the tokenizer whole. Tests compare with
the tokenizer on whole texts.
"""

from __future__ import annotations

import ctypes
import os

import numpy as np

#: Entries that a cache holds before it starts afresh; about 200 MB.
CACHE_ENTRIES = 800_000

#: Runs of white space that are more than one space or line feed between words (two line feeds are fine), and all other kinds of it.
_RUNS = ("  ", " \n", "\n ", "\n\n\n")
_OTHER = [chr(c) for c in range(1 << 16) if chr(c).isspace() and c not in (32, 10)]


def has_odd_space(text: str) -> bool:
    """Whether white space does more than part words. Searches for fixed strings, far quicker than a pattern."""
    return not text or text[0] in " \n" or text[-1] in " \n" or any(r in text for r in _RUNS) or any(c in text for c in _OTHER)


#: Signs that are no letters, digits or white space; behind a letter a run of them is cut off by both vocabularies.
SIGNS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Stands between words; no word of letters has it.
MARK = "!"
#: Below this, lower case and composed forms are the same for Python and the tokenizer.
LATIN_END = "\u0130"
#: Byte-level vocabularies write a byte that is not printable as the next free character from U+0100 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINTED)}
BYTE_CHARS.pop(32)


class WordEncoder:
    """Encodes texts to little-endian uint32 ids, as the library does with add_special_tokens=False.

    spaces_count: the vocabulary has ids for white space (byte-level BPE); else white space is dropped. Texts that hold an
    added token's string (which the library finds before it cuts words) go to the tokenizer whole.
    """

    def __init__(self, path: str, spaces_count: bool, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: A sign that all added tokens begin with ("" if none): most texts are told by one search.
        self.starts = os.path.commonprefix(self.added)[:1]
        self.spaces_count, self.entries = spaces_count, entries
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.mark = self.merges.encode(MARK, add_special_tokens=False).ids[0]
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0] if spaces_count else None
        self.cache: dict[str, bytes] = {"": b""}
        #: The previous generation: words in use move back from it.
        self.old: dict[str, bytes] = {}
        #: Ids of runs of signs that close a word.
        self.signs: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids straight from the tokenizer."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], lead: str) -> list[bytes]:
        """Ids of each word, from a few long texts in which a mark stands behind each word.

        Where white space is dropped, words of letters only go straight to the merges, which is the costly part.
        """
        if self.spaces_count:
            plain, between, run, mark = [w for w in words if w and w.isprintable()], "\n", self.tokenizer, self.feed
        else:
            # Most words are ASCII, whose bytes are written as they are; the others stand apart, as translating a text is slow.
            plain, between, run, mark = [w for w in words if w.isalpha() and (w.isascii() or max(w) < LATIN_END)], f" {MARK} ", self.merges, self.mark
        out: dict[str, bytes] = {}
        ascii_only, other = [w for w in plain if w.isascii()], [w for w in plain if not w.isascii()]
        for some in [x[i : i + 2000] for x in (ascii_only, other) for i in range(0, len(x), 2000)]:
            text = "".join([lead + w + between for w in some])
            if not self.spaces_count:
                text = text.lower() if text.isascii() else text.lower().encode().decode("latin-1").translate(BYTE_CHARS)
            ids = np.array(run.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            raw, at = ids.tobytes(), 0
            for w, cut in zip(some, (np.flatnonzero(ids == mark) * 4).tolist(), strict=True):
                out[w] = raw[at:cut]
                at = cut + 4
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self.whole([lead + w for w in rest])))
        return [out[w] for w in words]

    def _learn(self, words: set[str]) -> None:
        """Puts missing words into the cache; signs behind a last letter are tokens of their own."""
        cache, old = self.cache, self.old
        missing = [w for w in words if w not in cache]
        if not missing:
            return
        cache.update((w, old[w]) for w in missing if w in old)
        missing = [w for w in missing if w not in old]
        cores, tails = set(), []
        for w in missing:
            core = w.rstrip(SIGNS)
            # Beyond Latin, lower case or composition may end in a mark, which goes with the signs.
            if core and core != w and core[-1].isalpha() and core[-1] < LATIN_END:
                tails.append((w, core, w[len(core) :]))
                cores.add(core)
            else:
                cores.add(w)
        new = [w for w in cores if w not in cache]
        if self.spaces_count:  # behind a line feed a word has no space before it
            fed, spaced = [w for w in new if w[0] == "\n"], [w for w in new if w[0] != "\n"]
            feed = np.uint32(self.feed).tobytes()
            cache.update((w, feed + ids) for w, ids in zip(fed, self._words([w[1:] for w in fed], "")))
            cache.update(zip(spaced, self._words(spaced, " ")))
        else:
            cache.update(zip(new, self._words(new, "")))
        signs = list({t for _, _, t in tails} - self.signs.keys())
        self.signs.update(zip(signs, self.whole(signs)))
        cache.update((w, cache[core] + self.signs[tail]) for w, core, tail in tails)

    def _has_added(self, text: str) -> bool:
        """Whether a text, or what lower case makes of it, holds an added token's string."""
        return self.starts in text and any(a in text.lower() for a in self.added)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        return [np.frombuffer(x, "<u4") for x in self.encode_bytes(texts)]

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, four little-endian bytes each."""
        if len(self.cache) > self.entries // 2:
            self.old, self.cache = self.cache, {"": b""}
            self.signs.clear()
        return self._with_spaces(texts) if self.spaces_count else self._without_spaces(texts)

    def _with_spaces(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        whole = {i for i, t in enumerate(texts) if has_odd_space(t) or self._has_added(t)}
        for i, ids in zip(sorted(whole), self.whole([texts[i] for i in sorted(whole)])):
            out[i] = ids
        # A line feed goes with the word behind it; one is put before the text and its id taken away again.
        plain = [(i, ("\n" + t).replace("\n", " \n").split(" ")) for i, t in enumerate(texts) if i not in whole]
        every: set[str] = set()
        for _, words in plain:
            every.update(words)
        self._learn(every)
        get = self.cache.__getitem__
        for i, words in plain:
            out[i] = b"".join(map(get, words[1:]))[4:]
        return out

    def _without_spaces(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        whole = [i for i, t in enumerate(texts) if self._has_added(t)]
        for i, ids in zip(whole, self.whole([texts[i] for i in whole])):
            out[i] = ids
        held = set(whole)
        plain = [(i, (t.lower() if t.isascii() else t).replace("\n", " ").split(" ")) for i, t in enumerate(texts) if i not in held]
        every: set[str] = set()
        for _, x in plain:
            every.update(x)
        self._learn(every)
        get = self.cache.__getitem__
        for i, x in plain:
            out[i] = b"".join(map(get, x))
        return out

    def largest_id(self) -> int:
        """The greatest id that the vocabulary has."""
        return max(self.tokenizer.get_vocab(with_added_tokens=True).values())


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, spaces_count: bool) -> WordEncoder:
    """The encoder of this Python process for a vocabulary file."""
    if (path, spaces_count) not in _ENCODERS:
        _ENCODERS[path, spaces_count] = WordEncoder(path, spaces_count)
    return _ENCODERS[path, spaces_count]


def forget() -> None:
    """Drops this process's encoders and gives their memory back to the system.

    Spark's Python workers outlive a stage, so tasks that encode nothing call it: else caches stay beside what they need.
    """
    if _ENCODERS:
        _ENCODERS.clear()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps most of it otherwise
            trim(0)
