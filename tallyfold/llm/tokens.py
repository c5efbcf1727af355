"""Token ids of whole texts by the tokenizers library, with a bounded memory of words already encoded.

Both vocabularies split a text into words before merging bytes, so the ids of a
text are the ids of its space-separated chunks one after another. A chunk is
encoded by the library once and remembered, letters and a full stop or comma after
them as the two words that they are; a text in which that does not hold (runs of
white space, the text of a special token) is encoded whole. The ids are those of
``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import os
import unicodedata
from functools import cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks remembered by one Python worker; beyond that the memory starts anew.
CACHE_WORDS = 1_200_000
_GROUP = 400
_MARK = "\x01"
#: One-character ends that both vocabularies split from the letters before.
_TAILS = (".", ",")


def _stays_letters(c: str) -> bool:
    """Whether letters are still letters alone after composition and lower-casing."""
    return unicodedata.normalize("NFC", c).lower().isalpha()


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids of texts as bytes of ``kind`` (little-endian, 16 bits for a vocabulary of up to 65536, else 32), by the tokenizer file at ``path``.

    Two kinds of files are known: byte-level BPE whose words keep the space before
    them, and BPE with word ends that drops white space.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        # ASCII letters need no normalisation and no splitting: the same merges on words between spaces
        self.bare = Tokenizer(self.tok.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.tok.get_vocab()
        self.keeps_space = "Ġa" in vocab
        self.space = " " if self.keeps_space else ""
        self.edge = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.kind = np.dtype("<u2" if len(self.edge) <= 65536 else "<u4")
        self.edge[[i for t, i in vocab.items() if (t.startswith("Ġ") if self.keeps_space else t.endswith("</w>"))]] = True
        self.mark = self.tok.encode(_MARK, add_special_tokens=False).ids
        self.tails = dict(zip(_TAILS, self._plain(list(_TAILS))))
        self.known: dict[str, bytes | None] = {}
        self.first: dict[str, bytes | None] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, ids: np.ndarray, letters: bool) -> list[bytes]:
        """The ids of a joined group, cut where a chunk starts."""
        if self.keeps_space:
            at = np.flatnonzero(self.edge[ids])
            skip = 0
        elif letters:
            at = np.flatnonzero(self.edge[ids]) + 1
            at = np.concatenate([[0], at[:-1]]) if len(at) else at
            skip = 0
        else:
            at = np.concatenate([[-1], np.flatnonzero(ids == self.mark[0])])
            skip = 1
        data, ends, size = ids.astype(self.kind).tobytes(), [*at[1:].tolist(), len(ids)], self.kind.itemsize
        return [data[size * (i + skip) : size * j] for i, j in zip(at.tolist(), ends)]

    def _joined(self, chunks: list[str], letters: bool) -> None:
        """Encode chunks in groups, one text for each; where the parts cannot be told apart, one by one."""
        groups = [chunks[i : i + _GROUP] for i in range(0, len(chunks), _GROUP)]
        joint = " " if self.keeps_space or letters else f" {_MARK} "
        self._keep(groups, self.tok.encode_batch_fast([self.space + joint.join(g) for g in groups], add_special_tokens=False), letters)

    def _letters(self, chunks: list[str]) -> None:
        """Encode chunks of ASCII letters."""
        groups = [chunks[i : i + _GROUP] for i in range(0, len(chunks), _GROUP)]
        texts = ["Ġ" + " Ġ".join(g) for g in groups] if self.keeps_space else [" ".join(g).lower() for g in groups]
        self._keep(groups, self.bare.encode_batch_fast(texts, add_special_tokens=False), True)

    def _keep(self, groups: list[list[str]], encoded: list, letters: bool) -> None:
        for group, e in zip(groups, encoded):
            parts = self._parts(np.array(e.ids, dtype="<u4"), letters)
            if len(parts) != len(group) or not letters and (len(self.mark) != 1 or any(_MARK in c for c in group)):
                parts = self._plain([self.space + c for c in group])
            self.known.update(zip(group, parts))

    def _learn(self, new: set[str]) -> None:
        """Remember the ids of chunks after a space; None for one that may depend on its neighbours."""
        known, keeps = self.known, self.keeps_space
        letters, tailed, rest = set(), [], []
        for c in new:
            if c.isalpha() and (c.isascii() or keeps or _stays_letters(c)):
                letters.add(c)
            elif c[-1:] in _TAILS and c[:-1].isalpha() and (c.isascii() or keeps or _stays_letters(c[:-1])):
                tailed.append(c)
            elif "<|" in c or keeps and (not c or c[0].isspace()):
                known[c] = None  # runs of white space, or the text of a special token
            elif not c:
                known[c] = b""
            else:
                rest.append(c)
        letters.update(b for b in (c[:-1] for c in tailed) if b not in known)
        self._letters([c for c in letters if c.isascii()])
        self._joined([c for c in letters if not c.isascii()], True)
        self._joined(rest, False)
        tails = self.tails
        for c in tailed:
            known[c] = known[c[:-1]] + tails[c[-1]]

    def flat(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's ids start and the last end); ``end_id`` is appended to each text."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        if len(self.first) > CACHE_WORDS // 10:
            self.first.clear()
        known, first = self.known, self.first
        # lower-casing A-Z early changes nothing for a vocabulary that lower-cases anyway
        lists = pc.split_pattern(texts, " ") if self.keeps_space else pc.ascii_split_whitespace(pc.ascii_lower(texts))
        at = lists.offsets.to_numpy().astype(np.int64)
        chunks = lists.values.slice(at[0], at[-1] - at[0])
        at = at - at[0]
        coded = chunks.dictionary_encode()
        index, unique = coded.indices.to_numpy().astype(np.int64), _strings(coded.dictionary)
        self._learn(set(filterfalse(known.__contains__, unique)))
        parts = list(map(known.__getitem__, unique))
        if self.keeps_space:
            heads = _strings(chunks.take(pa.array(at[:-1])))
            new = sorted({c for c in heads if c not in first})
            for c, ids in zip(new, self._plain(new)):
                first[c] = None if "<|" in c or c.isspace() else ids
            place = {c: len(parts) + i for i, c in enumerate(dict.fromkeys(heads))}
            parts += [first[c] for c in place]
            index[at[:-1]] = [place[c] for c in heads]
        none = [i for i, p in enumerate(parts) if p is None]
        whole = np.unique(np.searchsorted(at, np.flatnonzero(np.isin(index, none)), side="right") - 1) if none else []
        parts = [p or b"" for p in parts]
        if end_id is not None:
            index = np.insert(index, at[1:], len(parts))
            at = at + np.arange(len(at))
            parts.append(np.array([end_id], self.kind).tobytes())
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // self.kind.itemsize
        n = size[index]
        to = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat((np.cumsum(size) - size)[index] - to[:-1], n) + np.arange(to[-1])
        ids, at = np.frombuffer(b"".join(parts), self.kind)[place], to[at]
        if len(whole):  # texts with a chunk that depends on its neighbours
            each = np.split(ids, at[1:-1])
            end = b"" if end_id is None else parts[-1]
            for i, x in zip(whole, self._plain([texts[int(i)].as_py() for i in whole])):
                each[i] = np.frombuffer(x + end, self.kind)
            ids, at = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return ids, at

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        if not texts:
            return []
        ids, at = self.flat(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, at[1:-1])]


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    return Encoder(path)


def text_slices(texts: pa.Array, most: int = 4 << 20):
    """(first, last + 1) of runs of texts with at most ``most`` bytes, one text at least."""
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy())])
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi
