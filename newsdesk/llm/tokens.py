"""Token ids of whole texts by the ``tokenizers`` library, with words that come again encoded once."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters on which the splitting rule below agrees with any tokenizer of this kind: printable ASCII and Latin letters.
_LATIN = r"\x21-\x7eÀ-ÖØ-öø-įı-ſ"
_PLAIN_TEXT = re.compile(rf"[{_LATIN} ]*")
#: Line ends, then the word pieces of the ``word_bpe`` vocabulary's own pre-tokenizer, for lower-cased plain text.
_PIECES = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\sa-z0-9ß-öø-ſ]+")
#: What a tokenizer does before its merges if that rule is to hold for it.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALISED = ["NFC", "Replace", "Lowercase"]


def _cuts_words(path: str) -> bool:
    """Whether the tokenizer lowers, splits and drops white space by the rule that ``pieces`` follows."""
    with open(path, encoding="utf-8") as file:
        read = json.load(file)
    steps = [n.get("type") for n in (read.get("normalizer") or {}).get("normalizers", [])]
    first = ((read.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return steps == _NORMALISED and first.get("type") == "Split" and first.get("pattern") == {"Regex": _SPLIT} and first.get("behavior") == "Removed" and first.get("invert") is True


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(words: pa.Array) -> tuple[list[str], np.ndarray]:
    """Words cut where the tokenizer cuts them anyway, no token reaching across: all pieces, and each word's number of them.

    Plain words are cut by the tokenizer's own rule, which makes more pieces repeat; words with other
    characters, or with what may be a special string, stay whole.
    """
    plain = pc.and_(pc.match_substring_regex(words, rf"^[{_LATIN}]+$"), pc.invert(pc.match_substring(words, "<|"))).to_numpy(zero_copy_only=False)
    sizes = np.ones(len(words), np.int64)
    sizes[pc.equal(words, "").to_numpy(zero_copy_only=False)] = 0
    cut = _PIECES.findall("\n".join(words.filter(pa.array(plain)).to_pylist()).lower()) if plain.any() else []
    # The line ends between words come back as pieces of their own.
    ends = np.flatnonzero(np.fromiter(map("\n".__eq__, cut), bool, len(cut)))
    sizes[plain] = np.diff(ends, prepend=-1, append=len(cut)) - 1 if plain.any() else 0
    odd = iter(words.filter(pa.array(~plain)).to_pylist())
    kept = iter(p for p in cut if p != "\n")
    if plain.all():
        return list(kept), sizes
    out: list[str] = []
    for is_plain, n in zip(plain.tolist(), sizes.tolist(), strict=True):
        out += islice(kept, n) if is_plain else filter(None, (next(odd),))
    return out, sizes


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


class Runs:
    """Distinct strings with a run of ids each, in arrays alone; beyond ``keep`` of them those not met for longest are forgotten."""

    #: Bytes of strings and ids beyond which all are forgotten: a few very long ones.
    MOST_BYTES = 64 << 20

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], keep: int) -> None:
        self.encode, self.keep, self.now = encode, keep, 0
        self._forget()

    def _forget(self) -> None:
        self.keys = pa.array([], pa.string())
        self.sizes, self.met, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)

    def _thin(self) -> None:
        """Only half of ``keep``, the latest met, stay known."""
        if self.keys.nbytes + self.flat.nbytes > self.MOST_BYTES:
            self._forget()
        elif len(self.keys) > self.keep:
            stay = np.sort(np.argsort(-self.met, kind="stable")[: self.keep // 2])
            self.flat = _gathered(self.flat, self.starts[stay], self.sizes[stay])
            self.keys, self.sizes, self.met = self.keys.take(pa.array(stay)), self.sizes[stay], self.met[stay]
            self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes

    def numbers(self, found: pa.Array) -> np.ndarray:
        """Places of distinct strings in ``starts`` and ``sizes``, which hold until the next call; new ones are encoded."""
        self._thin()
        self.now += 1
        at = pc.index_in(found, value_set=self.keys)
        fresh = found.filter(pc.is_null(at))
        at = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(fresh):
            at[at < 0] = len(self.keys) + np.arange(len(fresh))
            flat, sizes = self.encode(fresh)
            self.keys = pa.concat_arrays([self.keys, fresh])
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes.astype(np.int32)])
            self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
            self.met = np.concatenate([self.met, np.zeros(len(fresh), np.int32)])
        self.met[at] = self.now
        return at


class WordEncoder:
    """Ids of texts under a tokenizer that drops white space and never joins words across it.

    A word that comes again is not cut again, and a piece of it not encoded again; of each, what is kept
    is bounded by ``keep`` and kept in arrays, so that Python sees new ones only.
    """

    def __init__(self, path: str, keep: int = 400_000) -> None:
        if not _cuts_words(path):
            raise ValueError(f"{path} doesn't split words as this encoder does")
        # Its own, not the cached one, so that it goes with the encoder.
        self.encode = tokenizer.__wrapped__(path)
        vocabulary = self.encode.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words, self.pieces = Runs(self._of_words, keep), Runs(self._of_pieces, keep)

    def _of_words(self, fresh: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut, counts = pieces(fresh)
        coded = pa.array(cut, pa.string()).dictionary_encode()
        number = self.pieces.numbers(coded.dictionary)[coded.indices.to_numpy()]
        sizes = self.pieces.sizes[number]
        of_word = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return _gathered(self.pieces.flat, self.pieces.starts[number], sizes), np.diff(of_word)

    def _of_pieces(self, fresh: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._encoded(fresh[k : k + 2_000].to_pylist()) for k in range(0, len(fresh), 2_000)]
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([each for _, each in parts])

    def _encoded(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and how many each has.

        Plain pieces are encoded as one text with spaces between and parted after each token that ends
        a word; should that not give as many parts as pieces, each piece is encoded on its own.
        """
        if self.ends.any() and _PLAIN_TEXT.fullmatch(text := " ".join(fresh)) and "<|" not in text:
            # Without offsets, which take a quarter of the time.
            ids = np.array(self.encode.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(fresh) and last[-1] == len(ids) - 1:
                return ids, np.diff(last, prepend=-1)
        lists = [e.ids for e in self.encode.encode_batch_fast(fresh, add_special_tokens=False)]
        sizes = np.array([len(x) for x in lists], np.int64)
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The uint32 ids of all texts, one after the other, and how many each has; null and empty texts have none.

        Arrow cuts the texts at ASCII white space, numbers their distinct words and finds the known ones; only new ones reach Python.
        """
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        offsets = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        number = self.words.numbers(coded.dictionary)[coded.indices.to_numpy()]
        counts = self.words.sizes[number]
        ids = _gathered(self.words.flat, self.words.starts[number], counts)
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[offsets - offsets[0]]
        return ids, np.diff(ends)
