"""Token ids by the tokenizers library, with a memo over words.

A byte-level BPE with the usual splitting pattern never lets a token cross a place where a single space stands between
two characters that are not white space: the space opens the next split. A text is cut there, each distinct piece is
encoded once by the library, and the ids of a text are those of its pieces in order. Pieces are found, hashed (twice, 64
bits each; both must agree) and made distinct over the bytes of many texts at once; only pieces that the memo lacks
become strings. Of these, words of plain Latin letters with ASCII marks are cut into the pattern's splits first, which
then go to the library's model one by one, each once. Texts that spell a special token, or hold white space beyond
ASCII's, go to the library whole. The memo is bounded and belongs to one Python worker.

All this holds for files of that kind alone (usual()): with a normaliser, another splitting, a model that isn't BPE or
drops merges at random, every text goes to the library whole. A file's truncation and padding are switched off."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np

from .common import MEMOS

_WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SAFE_CUT = re.compile(rb"(?<=[^\x09-\x0d\x20]) (?=[^\x09-\x0d\x20])")
_PLAIN = re.compile(r" (?!')[\x21-\x7eÀ-ÖØ-öø-ÿ]+(?:\n[\x21-\x7eÀ-ÖØ-öø-ÿ]+)*\Z")
_SPLITS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[^\n0-9A-Za-zÀ-ÖØ-öø-ÿ]+|\n")


def _spelling() -> dict[int, int]:
    """Byte-level vocabularies write a printable Latin-1 byte as itself and the others, in order, as U+0100 onwards."""
    same = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in same]
    return {b: 0x100 + k for k, b in enumerate(others)}


_SPELLING = _spelling()
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII punctuation but the apostrophe
MEMO_PIECES = 600_000
SLICE = 1 << 20  # bytes that are cut into pieces at once, in some sixty times their memory
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
#: What a byte counts in each of the two hashes.
_VALUES = np.random.default_rng(20_240_611).integers(1, 1 << 63, (2, 256), np.uint64) | np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse, modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.ones(n + (1 << 18), np.uint64)
            size = 1
            while size < len(p):
                m = min(size, len(p) - size)
                p[size : size + m] = p[:m] * np.uint64(pow(b, size, 1 << 64))
                size *= 2
            _POWERS.append(p)
    return _POWERS[0], _POWERS[1]


def usual(tokenizer) -> bool:
    """Whether a tokenizer is byte-level BPE with the usual splitting pattern and nothing before or inside it that looks
    beyond a split. Only the splitting's few settings are read as JSON; the vocabulary isn't held a second time."""
    splitting = json.loads(tokenizer.pre_tokenizer.__getstate__()) if tokenizer.pre_tokenizer else {}
    plain = splitting.get("type") == "ByteLevel" and splitting.get("use_regex", True) and not splitting.get("add_prefix_space", True)
    return plain and tokenizer.normalizer is None and type(tokenizer.model).__name__ == "BPE" and not tokenizer.model.dropout


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """A tokenizer file's ids for texts; see encode()."""

    def __init__(self, path: str, memo: int = MEMO_PIECES, size: int = SLICE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.usual = usual(self.tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.memo, self.slice = memo, size
        self.clear()

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.check: array = array("Q")
        self.parts: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.flat, self.starts, self.sizes = array("I"), array("q"), array("q")

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    @staticmethod
    def _spell(part: str) -> str:
        """The characters that stand for a split's bytes."""
        return part.encode().decode("latin-1").translate(_SPELLING)

    def _ids(self, spelt: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece. Pieces of plain letters and ASCII are cut into the pattern's splits here and their
        splits remembered; the library cuts others itself."""
        found: list = [None] * len(pieces)
        whole, parts, tails = [], self.parts, self.tails
        plain, cut, latin, keep = _PLAIN.match, _SPLITS.findall, _LATIN.match, len(self.parts) < self.memo // 2
        for k, piece in enumerate(pieces):
            word = piece.rstrip(_MARKS)
            if piece[0] == " " and (bare := word[1:]).isalpha() and (bare.isascii() or latin(bare)):  # a word, and marks that don't begin a contraction
                got = parts.get(bare)
                if got is None:
                    got = self._ids("\u0120" + (bare if bare.isascii() else self._spell(bare)))
                    if keep:
                        parts[bare] = got
                if len(word) != len(piece):
                    tail = piece[len(word) :]
                    end = tails.get(tail)
                    if end is None:
                        end = self._ids(tail)
                        if len(tails) < self.memo // 100:
                            tails[tail] = end
                    got = got + end
                found[k] = got
            elif plain(piece):
                splits = cut(piece, 1)
                splits[0] = " " + splits[0]
                found[k] = b"".join([self._ids(self._spell(part)) for part in splits])
            else:
                whole.append(k)
        if whole:
            for k, ids in zip(whole, self._raw([pieces[k] for k in whole]), strict=True):
                found[k] = array("I", ids).tobytes()
        return found

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and where each text's end."""
        out, sizes, some, size = [], [], [], 0
        for text in texts:
            if not self.usual or text and (_WIDE_SPACE.search(text) or any(s in text for s in self.special)):
                if some:
                    self._encode(some, out, sizes)
                    some, size = [], 0
                ids = np.array(self._raw([text or ""])[0], np.uint32)
                out.append(ids)
                sizes.append(np.array([len(ids)], np.int64))
                continue
            raw = (text or "").encode()
            if len(raw) > self.slice:
                if some:
                    self._encode(some, out, sizes)
                    some, size = [], 0
                each: list[np.ndarray] = []
                for part in _parts(raw, self.slice):
                    self._encode([part], out, each)
                sizes.append(np.concatenate(each).sum(keepdims=True))
                continue
            some.append(raw)
            size += len(raw)
            if size > self.slice:
                self._encode(some, out, sizes)
                some, size = [], 0
        if some:
            self._encode(some, out, sizes)
        return np.concatenate([np.empty(0, np.uint32), *out]), np.cumsum(np.concatenate([np.empty(0, np.int64), *sizes]))

    def _encode(self, raws: list[bytes], out: list, out_sizes: list) -> None:
        ends = np.cumsum([len(r) for r in raws])
        buffer = b"".join(raws)
        if not buffer:
            out_sizes.append(np.zeros(len(raws), np.int64))
            return
        b = np.frombuffer(buffer, np.uint8)
        blank = _BLANK[b]
        cut = b == 0x20
        cut[1:] &= ~blank[:-1]
        cut[:-1] &= ~blank[1:]
        begins = np.concatenate(([0], ends[:-1]))
        cut[begins[begins < len(b)]] = True
        starts = np.flatnonzero(cut)
        stops = np.append(starts[1:], len(b))
        power, inverse = _powers(len(b) + 1)
        names = []
        for value in _VALUES:
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(value[b] * power[: len(b)], out=sums[1:])
            names.append((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
        name, first, index = np.unique(names[0], return_index=True, return_inverse=True)
        check = names[1][first]
        place = np.fromiter(map(self.at.get, name.tolist(), repeat(-1)), np.int64, len(name))
        kept = len(self.starts), len(self.flat)
        known = np.flatnonzero(place >= 0)
        if len(known):  # a piece of another's hash is encoded anew
            place[known[np.frombuffer(self.check, np.uint64)[place[known]] != check[known]]] = -1
        absent = np.flatnonzero(place < 0)
        if len(absent):
            a, z = starts[first[absent]].tolist(), stops[first[absent]].tolist()
            ids = self._learn([buffer[i:j].decode() for i, j in zip(a, z, strict=True)])
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            place[absent] = np.arange(len(self.starts), len(self.starts) + len(ids))
            self.starts.frombytes((len(self.flat) + np.cumsum(n) - n).tobytes())
            self.sizes.frombytes(n.tobytes())
            self.check.frombytes(check[absent].tobytes())
            self.flat.frombytes(b"".join(ids))
        at, n, flat = np.frombuffer(self.starts, np.int64), np.frombuffer(self.sizes, np.int64), np.frombuffer(self.flat, np.uint32)
        place = place[index]
        if (names[1] != check[index]).any():  # two pieces of one hash in this slice: the library encodes its texts
            got = [np.array(x, np.uint32) for x in self._raw([r.decode() for r in raws])]
            out.append(np.concatenate(got))
            out_sizes.append(np.array([len(x) for x in got], np.int64))
        else:
            each = n[place]
            upto = np.cumsum(each)
            out.append(flat[np.repeat(at[place] - (upto - each), each) + np.arange(upto[-1])])
            total = np.concatenate(([0], upto))
            out_sizes.append(np.diff(total[np.searchsorted(starts, ends)], prepend=0))
        del at, n, flat
        if len(absent):
            if kept[0] > self.memo:  # full: what came first is the frequent part; this slice's pieces go again
                del self.starts[kept[0] :], self.sizes[kept[0] :], self.check[kept[0] :], self.flat[kept[1] :]
            else:
                self.at.update(zip(name[absent].tolist(), range(kept[0], kept[0] + len(absent)), strict=True))


def _parts(raw: bytes, size: int = SLICE) -> Iterator[bytes]:
    """A long text cut where a split begins, into parts of about a slice."""
    at = 0
    while at < len(raw):
        cut = _SAFE_CUT.search(raw, at + size)
        end = cut.start() if cut else len(raw)
        yield raw[at:end]
        at = end


_MEMO: dict[tuple[str, int, int], Encoder] = {}
MEMOS["tokens"] = lambda: (_MEMO.clear(), _POWERS.clear())


def encoder(path: str, memo: int = MEMO_PIECES, size: int = SLICE) -> Encoder:
    """This worker's encoder. memo: pieces that it remembers, about 200 bytes each; size: bytes it cuts at once. Less of
    either costs time, not correctness."""
    if (path, memo, size) not in _MEMO:
        MEMOS["tokens"]()
        _MEMO[path, memo, size] = Encoder(path, memo, size)
    return _MEMO[path, memo, size]
