"""Token ids of whole texts by the tokenizers library, with a cache of encoded chunks.

Encoding prose spends its time on words it has met before. A text is therefore cut at places where the
tokenizer's own pre-tokenizer always cuts (between white space and words, between a word and ASCII punctuation), each
distinct chunk is encoded once by the library, and ids are put together with numpy. Texts with characters for which
that can't be promised (unusual white space, special tokens) go to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Letters and digits of Latin scripts, but for the one (U+0130) that lower-casing makes a letter and a mark.
_A = "A-Za-z0-9" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x12F), (0x131, 0x24F)))
_P = r"!-&(-/:-@\[-`{-~"
_W = r" \t-\r"
_LEADING = re.compile(rf" ?[{_A}]+(?=[{_W}{_P}']|\Z)| ?[{_P}]+(?=[{_A}{_W}]|\Z)| ?[^{_W}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
_PLAIN = re.compile(rf"[{_A}]+(?=[{_W}{_P}']|\Z)|[{_P}]+(?=[{_A}{_W}]|\Z)|[^{_W}]+")
_ODD = re.compile("[" + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
_NOT_LATIN = re.compile(f"[^{chr(0)}-{chr(0x24F)}]")
_CONTROL = "\x1c\x1d\x1e\x1f"
#: Cached chunks; beyond that, those met once since the last clearing go.
CACHED = 400_000
#: New chunks that go to the library as one text, and the mark between them.
JOINED, MARK = 500, "~"


def _lower(text: str) -> str:
    """A-Z lower-cased, in texts of Latin letters alone; others stay as they are."""
    if text.isascii():
        return text.lower()
    try:
        return text.encode("latin-1").lower().decode("latin-1")  # bytes know no case but that of A-Z
    except UnicodeEncodeError:
        return text if _NOT_LATIN.search(text) else text.encode().lower().decode()


class _Codes(dict):
    """Chunk to code; a new chunk gets the next code and is listed in ``fresh``."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = code = len(self)
        self.fresh.append(chunk)
        return code


class Encoder:
    """Encodes as ``Tokenizer.encode(text, add_special_tokens=False)``.

    ``leading_space``: the pre-tokenizer joins a space to the word after it (byte-level BPE); without, white space is
    dropped and letters are lower-cased. ``special``: whether special tokens' strings in a text become their ids.
    """

    def __init__(self, path: str, leading_space: bool, special: bool = True) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.leading_space, self.cut = leading_space, (_LEADING if leading_space else _PLAIN).findall
        self._clear(_Codes(), np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _clear(self, codes: _Codes, flat: np.ndarray, size: np.ndarray) -> None:
        self.codes, self.flat, self.size = codes, flat, size
        self.start, self.met = np.cumsum(size) - size, np.zeros(len(size), np.int64)

    def _shrink(self) -> None:
        """Keeps the chunks met twice or more."""
        keep = self.met > 1 if (self.met > 1).sum() < CACHED // 2 else np.zeros(len(self.met), bool)
        codes, old = _Codes(), np.flatnonzero(keep)
        for chunk, code in self.codes.items():
            if keep[code]:
                codes[chunk] = len(codes)
        flat, _ = self._gather(old)
        self._clear(codes, flat, self.size[old])

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[codes]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[codes] - (ends - size), size) + np.arange(total)], size

    def _whole(self, text: str) -> bool:
        return bool(not text.isascii() and _ODD.search(text)) or any(c in text for c in _CONTROL) or any(s in text for s in self.special)

    def _alone(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks in a row, and each chunk's number of ids."""
        new = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        size = np.fromiter(map(len, new), np.int64, len(new))
        return np.fromiter((i for ids in new for i in ids), np.uint32, int(size.sum())), size

    def _joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same, where white space is dropped: many chunks go to the library as one text, with a mark of one id between them.

        If that id occurs more often than there are marks, a chunk has it too, and these chunks go one by one.
        """
        mark, *more = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        if more:
            return self._alone(chunks)
        runs = [chunks[i : i + JOINED] for i in range(0, len(chunks), JOINED)]
        parts = []
        for own, made in zip(runs, self.tokenizer.encode_batch_fast([f" {MARK} ".join(own) for own in runs], add_special_tokens=False), strict=True):
            ids = np.array(made.ids, np.uint32)
            ends = np.append(np.flatnonzero(ids == mark), len(ids))
            parts.append((ids[ids != mark], np.diff(ends, prepend=-1) - 1) if len(ends) == len(own) else self._alone(own))
        return np.concatenate([flat for flat, _ in parts]), np.concatenate([size for _, size in parts])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and each text's number of ids."""
        if len(self.codes) > CACHED:
            self._shrink()
        chunks: list[str] = []
        ends = []
        whole: dict[int, np.ndarray] = {}
        for i, text in enumerate(texts):
            if self._whole(text):
                whole[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                chunks += self.cut(text if self.leading_space else _lower(text))
            ends.append(len(chunks))
        codes = np.fromiter(map(self.codes.__getitem__, chunks), np.int64, len(chunks))
        if fresh := self.codes.fresh:
            flat, size = self._alone(fresh) if self.leading_space else self._joined(fresh)
            begin = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate([self.flat, flat])
            self.size, self.start = np.concatenate([self.size, size]), np.concatenate([self.start, begin])
            self.met = np.concatenate([self.met, np.zeros(len(size), np.int64)])
            self.codes.fresh = []
        self.met += np.bincount(codes, minlength=len(self.met))
        flat, size = self._gather(codes)
        sums = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])].astype(np.int64)
        counts = np.diff(sums)
        if whole:
            parts = []
            for i in range(len(texts)):
                parts.append(whole[i] if i in whole else flat[sums[i] : sums[i + 1]])
                counts[i] = len(parts[-1])
            flat = np.concatenate(parts)
        return flat, counts


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, leading_space: bool, special: bool = True) -> Encoder:
    """One encoder a worker process, so that its cache serves all its tasks."""
    key = (path, leading_space, special)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def blocks(texts: list[str | None], most: int = 1 << 20):
    """(first row, texts) in runs of about ``most`` characters; null is empty."""
    at, size, run = 0, 0, []
    for i, text in enumerate(texts):
        run.append(text or "")
        size += len(run[-1])
        if size >= most:
            yield at, run
            at, size, run = i + 1, 0, []
    if run:
        yield at, run
