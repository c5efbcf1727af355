"""Cached encoding against the library; packing and token files against whole encodings."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyfold.llm import packing, rans, tokenfiles, tokens
from tallyfold.llm.shared import Scratch

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", " ", "  ", "a  b", " a", "a ", "a\n b", "a\n \nb", "x <|endoftext|> y", "don't  it's", "İstanbul İ. foo,", "ΑΣ ΟΔΟΣ. x", "é a ́b", "a\x01b \x01 c", "\tq w\r\n e", "。 中文, 日本.", "a\n\n\nb c", "\x85 a \x85b", "ǅ ǆ. ʰ, ª", "word.\nNext line, of."]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_give_the_ids_of_whole_texts(path):
    rng = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", ".", ",", "'s", "é", "İ", "1", "<|", "\x01", " ", "́", "中", "word", "Σ"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(5000)]
    enc, tok = tokens.encoder(path), Tokenizer.from_file(path)
    for text, got, want in zip(texts, enc.encode(texts), tok.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(got, enc.kind).tolist() == want.ids, repr(text)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 10)
    enc, tok = tokens.Encoder(BYTE), Tokenizer.from_file(BYTE)
    for k in range(5):
        text = " ".join(f"w{k}q{i}" for i in range(40))
        assert np.frombuffer(enc.encode([text])[0], enc.kind).tolist() == tok.encode(text, add_special_tokens=False).ids
        assert len(enc.known) <= 50


def check_packing(rows, out, end_id=0, capacity=1024):
    """Every id in exactly one piece, gapless sequences, padding nowhere."""
    tok = Tokenizer.from_file(BYTE)
    ids = [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, end_id], "<u4")) for i, t in rows]
    want = sorted(str((i, k, int(x))) for i, v in ids for k, x in enumerate(v))
    by_doc = {}
    for i, v in ids:
        by_doc.setdefault(i, []).append(v)
    got = []
    for r in out:
        v = next(v for v in by_doc[r.doc_id] if len(v) == r.doc_tokens and zlib.crc32(v[r.start : r.start + r.length].tobytes()) == r.ids_crc32)
        got += [str((r.doc_id, r.start + k, int(x))) for k, x in enumerate(v[r.start : r.start + r.length])]
    assert sorted(got) == want
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and at & (at - 1) == 0


def test_packing(spark, docs, odd):
    for df in (docs.select("doc_id", "text").repartition(3), odd.select("doc_id", "text")):
        df = df.cache()
        check_packing([tuple(r) for r in df.collect()], packing.pack(df, tokenizer=BYTE).collect())
    assert packing.pack(odd.where("false"), tokenizer=BYTE).count() == 0


def test_level_keeps_the_sum_of_squares_smallest():
    rng = np.random.default_rng(2)
    p = packing.Packer(32, lambda w: None)
    for _ in range(3000):
        size = int(rng.integers(1, 32))
        best = {}
        for h in [0, *[h for h in range(1, 33 - size) if p.levels[h]]]:
            after = p.levels.copy()
            after[h] -= h > 0
            after[h + size] += h + size < 32
            best[h] = int((after[1:32] ** 2).sum())
        chosen = p.level_for(size)
        assert best[chosen] == min(best.values()) and chosen == max(h for h in best if best[h] == best[chosen])
        p.add(1, np.zeros(size, "<u4"))
    assert p.open == p.levels.sum() == sum(map(len, p.windows.values()))


def test_many_open_windows_are_closed():
    out = []
    p = packing.Packer(64, out.append, most_open=5)
    rng = np.random.default_rng(3)
    total = 0
    for k in range(400):
        n = int(rng.integers(1, 200))
        total += n
        p.add(k, np.arange(n, dtype="<u4"))
    p.close()
    sizes = [sum(len(x[2]) for x in w) for w in out]
    assert sum(sizes) == total and all(s & (s - 1) == 0 for s in sizes) and p.open == 0


class Sink:
    def __init__(self):
        self.data = b""

    def write(self, x):
        self.data += x

    def close(self):
        pass


class Source:
    def __init__(self, data):
        self.data, self.at = data, 0

    def size(self):
        return len(self.data)

    def seek(self, at):
        self.at = at

    def read(self, n):
        return self.data[self.at : self.at + n]


@pytest.mark.parametrize("sizes", [[], [0], [1], [3, 0, 5], [rans.BLOCK], [rans.BLOCK * 3 + 1], [rans.BLOCK * rans.GROUP + 7, 2, 40_000]])
def test_rans_round_trip(sizes):
    rng = np.random.default_rng(len(sizes))
    parts = [(rng.zipf(1.3, n) % 49_000).astype(np.uint32) for n in sizes]
    whole = np.concatenate([np.zeros(0, np.uint32), *parts])
    table = rans.Table(*np.unique(whole, return_counts=True))
    sink = Sink()
    w = rans.Writer(sink, table)
    for k, x in enumerate(parts):
        w.add(None if k == 1 else k, x)
    w.close()
    r = rans.Reader(Source(sink.data))
    assert list(r.documents()) == [(None if k == 1 else k, len(x), zlib.crc32(x.astype("<u4").tobytes())) for k, x in enumerate(parts)]
    for lo in range(0, len(r.blocks), 3):
        assert (r.read(lo, lo + 2) == whole[lo * rans.BLOCK : (lo + 2) * rans.BLOCK]).all()
    if len(whole) > 100:
        assert len(sink.data) < 4 * len(whole)
        for at in (len(rans.MAGIC) + 9, int(r.blocks[0, 0]) + 600, len(sink.data) - 30):
            bad = bytearray(sink.data)
            bad[at] ^= 1
            with pytest.raises(ValueError, match="damaged"):
                rans.Reader(Source(bytes(bad))).read(0, 1)


def test_table_sums_to_its_range_and_rejects_unknown_ids():
    t = rans.Table(np.array([9, 2, 70_000]), np.array([1, 10**12, 5]))
    assert t.freq.sum() == 1 << rans.BITS and t.freq.min() >= 1
    for bad in (3, 70_001):
        with pytest.raises(ValueError):
            t.index(np.array([bad], np.uint32))


@pytest.mark.parametrize("file_tokens", [10**9, 3000])
def test_token_files(spark, odd, file_tokens):
    folder = Scratch(spark, "test").path("files")
    tokenfiles.write_token_files(odd, folder, tokenizer=WORD, file_tokens=file_tokens, task_bytes=100_000)
    got = [tuple(r) for r in tokenfiles.read_token_files(spark.newSession(), folder).collect()]
    tok, start = Tokenizer.from_file(WORD), 0
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    want = []
    for r in rows:
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
    got.sort(key=lambda r: r[1])
    for r in got:
        assert r[1] == start
        start += r[2]
    assert sorted(map(str, want)) == sorted(str((r[0], *r[2:])) for r in got) and [r[0] for r in got] == [r[0] for r in want]


def test_token_files_of_an_empty_table(spark, odd):
    folder = Scratch(spark, "test").path("files")
    tokenfiles.write_token_files(odd.where("false"), folder, tokenizer=WORD)
    assert tokenfiles.read_token_files(spark, folder).count() == 0
