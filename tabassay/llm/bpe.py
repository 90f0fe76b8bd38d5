"""Public tokenizers applied to whole texts through a bounded memo.

A text is split at boundaries that its vocabulary never joins across, and the ids of the text are the
ids of its pieces, one after another. Only pieces that the memo lacks reach the library, in batches of
about equal size. Where the vocabulary lower-cases and splits by the word pattern below, texts in
Latin-1 are split into the very words that the library would make; all other texts are split at
blanks, tabs and line breaks, and long pieces again where a letter or digit meets punctuation; the library
does the rest.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np
import regex

BATCH_BYTES = 1 << 16
#: A piece longer than this is cut at every safe boundary that lies this far from the last.
LONG_PIECE = 4096
MEMO_PIECES = 400_000
MEMO_CHARS = 64

# The word pattern of the vocabulary, and the same within Latin-1.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER, _NUMBER, _SPACE = "a-zA-Z\xaa\xba\xb5\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t\n\x0b\x0c\r\x85\xa0"
_WORDS = re.compile(f"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")

_loaded: dict[str, tuple] = {}


def load(path: str):
    """The library's tokenizer for a ``tokenizers`` .json file."""
    return _load(path)[0]


def _load(path: str) -> tuple:
    """It and, for a vocabulary of the known kind, one that encodes ready-made words; once per worker process."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_file(path)
        whole.no_truncation()
        whole.no_padding()
        made = json.loads(whole.to_str())
        steps = [n["type"] for n in (made["normalizer"] or {}).get("normalizers", [])], [p["type"] for p in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
        words = None
        if steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and made["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": WORD_PATTERN} and all(t["content"].startswith("<|") for t in made["added_tokens"]):
            words = Tokenizer(whole.model)
            words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        _loaded[path] = whole, words
    return _loaded[path]


#: Punctuation after a letter or digit begins a word of WORD_PATTERN whatever stands before or after, and no
#: normal form joins it with what precedes it, unless that letter ends in a mark once it is normalised.
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?=\p{P})")


def blank_pieces(text: str) -> list[str]:
    """Split at blanks, tabs and line breaks only; other white space stays for the library to treat."""
    for c in "\n\t\r":
        if c in text:
            text = text.replace(c, " ")
    return text.split(" ")


def safe_pieces(piece: str, least: int = LONG_PIECE) -> list[str]:
    """A long piece cut at safe boundaries; one with a special string, or without such a boundary, stays whole."""
    if len(piece) <= least or "<|" in piece:
        return [piece]
    out, at = [], 0
    for m in _SAFE.finditer(piece):
        if m.start() - at >= least and unicodedata.category(unicodedata.normalize("NFC", piece[m.start() - 1]).lower()[-1])[0] in "LN":
            out.append(piece[at : m.start()])
            at = m.start()
    return [*out, piece[at:]]


def balanced(words: Iterable[str], most: int = BATCH_BYTES) -> Iterable[list[str]]:
    """Batches of about ``most`` bytes each, a longer word alone in its own."""
    batch, held = [], 0
    for w in words:
        n = len(w.encode("utf-8", "surrogatepass")) + 1
        if held and held + n > most:
            yield batch
            batch, held = [], 0
        batch.append(w)
        held += n
    if batch:
        yield batch


def id_bytes(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


class Memo:
    """piece -> what ``make`` derives from its ids, kept for further use and emptied when full."""

    def __init__(self, path: str, make: Callable[[np.ndarray], object], limit: int = MEMO_PIECES):
        self.whole, self.ready = _load(path)
        self.make, self.limit = make, limit
        self.words: dict[str, object] = {}
        self.others: dict[str, object] = {}

    def _encode_words(self, new: Iterable[str]) -> dict[str, object]:
        out, make = {}, self.make
        for batch in balanced(new):
            e = self.ready.encode(" ".join(batch), add_special_tokens=False)
            ids, ends = np.asarray(e.ids, np.uint32), np.cumsum(np.bincount(np.asarray(e.word_ids, np.int64), minlength=len(batch)))
            at = 0
            for word, end in zip(batch, ends.tolist(), strict=True):
                out[word] = make(ids[at:end])
                at = end
        return out

    def _encode_others(self, new: Iterable[str]) -> dict[str, object]:
        out, make = {}, self.make
        for batch in balanced(new):
            for piece, e in zip(batch, self.whole.encode_batch_fast(batch, add_special_tokens=False), strict=True):
                out[piece] = make(np.asarray(e.ids, np.uint32))
        return out

    def _values(self, memo: dict, pieces: list[str], encode: Callable) -> list:
        new = set(pieces).difference(memo)
        if new:
            if len(memo) + len(new) > self.limit:
                memo.clear()
                new = set(pieces)
            found = encode(new)
            memo.update(found)
            out = list(map(memo.__getitem__, pieces))
            for long in [p for p in found if len(p) > MEMO_CHARS]:
                del memo[long]
            return out
        return list(map(memo.__getitem__, pieces))

    def of(self, text: str) -> list:
        """The values of the pieces of a whole text, in order."""
        if self.ready is not None and "<|" not in text:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return self._values(self.words, _WORDS.findall(text.lower()), self._encode_words)
        pieces = blank_pieces(text)
        if self.ready is not None and max(map(len, pieces)) > LONG_PIECE:
            pieces = [part for p in pieces for part in safe_pieces(p)]
        return self._values(self.others, pieces, self._encode_others)
