"""Token ids of whole texts, each distinct part of a word once, through a public tokenizer's own parts."""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa

#: Parts of words that each half of a worker's cache holds, at most.
CACHE_WORDS = 1 << 18
#: The vocabulary file used where none is given, and the folder it is in.
VOCABULARY, FOLDER = "word_bpe_49k.json", "/opt/tokenizers"

#: Words that normalising only turns to lower case (a fixed value of ``VOCABULARY``, as is the way that ``parts`` splits them).
SIMPLE = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")

#: What a byte of UTF-8 is: a space, newline or tab; of an ASCII letter, digit or sign; or of any other character.
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[0x21:0x7F] = SIGN
KINDS[ord("0") : ord("9") + 1] = DIGIT
KINDS[ord("A") : ord("Z") + 1] = KINDS[ord("a") : ord("z") + 1] = LETTER
KINDS[[*b" \n\t"]] = SPACE
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def parts(raw: bytes, added: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Where the parts of the words of UTF-8 text begin, and the parts. The text must end with three newlines.

    Words of ASCII and western European letters (``SIMPLE``) are turned to lower case and split as the tokenizer does:
    the endings 's, 't, 're, 've, 'm, 'll and 'd, else runs of letters, single digits and runs of signs.
    Any other word, and one with an ``added`` token, is one part as it stands.
    """
    data = np.frombuffer(raw, np.uint8)
    kind, low = KINDS[data], LOWER[data]
    lead = np.flatnonzero(data == 0xC3)  # of U+00C0 to U+00FF, all of them letters but the signs for times and division
    second = data[lead + 1]
    letter = (second != 0x97) & (second != 0xB7)
    kind[lead[letter]] = kind[lead[letter] + 1] = LETTER
    low[lead[letter & (second < 0x9F)] + 1] += 0x20

    starts = kind == DIGIT
    starts[0] = True
    starts[1:] |= kind[1:] != kind[:-1]
    starts &= kind != SPACE
    marks = np.flatnonzero(starts & (data == ord("'")))
    one, two = low[marks + 1], low[marks + 2]
    short = np.isin(one, [*b"stmd"])
    long = (np.isin(one, [*b"rv"]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for n, ending in ((2, marks[short]), (3, marks[long])):
        starts[ending + 1] = False
        starts[ending + n] = kind[ending + n] != SPACE

    at = np.flatnonzero(starts)
    others = [np.flatnonzero(kind == OTHER), *([m.start() for m in re.finditer(re.escape(x), raw)] for x in added)]
    others = np.concatenate(others).astype(np.int64)
    if len(others):
        first = kind[at - 1] == SPACE  # before the first byte is the last, a newline
        word = np.cumsum(first) - 1
        whole = np.zeros(len(at), bool)
        whole[word[np.searchsorted(at, others, "right") - 1]] = True
        whole = whole[word]
        keep = first | ~whole
        at, whole = at[keep], whole[keep]
        low[at[0] :] = np.where(np.repeat(whole, np.diff(at, append=len(data))), data[at[0] :], low[at[0] :])
    solid = kind != SPACE
    ends = np.cumsum(solid, dtype=np.int32)
    offsets = np.append(ends[at] - 1, ends[-1]).astype(np.int32)
    return at, pa.Array.from_buffers(pa.utf8(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(low[solid])])


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The path of a public tokenizer's file; ``public_tokenizers`` is installed with the tokenizers."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return os.path.join(FOLDER, name)
    return public_tokenizers.path(name)


class WordIds(dict):
    """part of a word -> its ids as little-endian uint32 bytes, computed when first asked for.

    Parts of ASCII and western European letters go straight to the tokenizer's
    model, spelled as its other parts would; all others take ``encode`` of the tokenizer. The cache has two halves:
    when the young one is full it replaces the old one, so frequent parts stay and memory is bounded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.has_added = re.compile("|".join(map(re.escape, self.added)) or "(?!)").search
        self.old: dict[str, bytes] = {}
        self.tokenize = self.tokenizer.model.tokenize
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.shown = {ord(c): split(c)[0][0] for c in map(chr, range(0x21, 0x100)) if SIMPLE.fullmatch(c)}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.compute(word)
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        if len(word) < 64:
            self[word] = ids
        return ids

    def compute(self, word: str) -> bytes:
        if SIMPLE.fullmatch(word) and not self.has_added(word):
            ids = [x.id for x in self.tokenize(word.translate(self.shown))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts, one text after the other, and where each text's begin (and the last one's end).

        Words end at spaces, newlines and tabs, across which no token of this kind of tokenizer reaches. The
        distinct parts of all texts are looked up once, so a call takes memory in proportion to its texts.
        """
        raw = [text.encode() for text in texts]
        at, found = parts(b"\n".join([*raw, b"\n\n\n"]), [x.encode() for x in self.added])
        found = found.dictionary_encode()
        distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(map(self.__getitem__, distinct), pa.large_binary()).take(found.indices)
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(at) + 1] // 4
        begin = np.cumsum([0, *(len(x) + 1 for x in raw)])
        return np.frombuffer(data or b"", "<u4")[: ends[-1]], ends[np.searchsorted(at, begin)]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text."""
        return self.encode_all([text])[0].tobytes()


_open: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This worker's cache for a vocabulary; it lives as long as the worker."""
    if path not in _open:
        _open[path] = WordIds(path)
    return _open[path]
