"""Archives and images: exact round trips, ranges, retries."""

import hashlib
import os
import zipfile
import zlib

import pytest

from tallyfold.llm import media
from tallyfold.llm.shared import Scratch, list_files


@pytest.mark.parametrize("data", [b"", b"a", b"x" * 64, b"x" * 65, os.urandom(10_000), bytes(range(256)) * 9])
def test_image_round_trip(data):
    png = media.to_png(data)
    payload, n = media.from_png(png)
    assert payload[:n] == data and n == len(data) and len(payload) % 64 == 0 and len(payload) >= 64 and not any(payload[n:])
    assert media.feature(payload) == media.feature(payload)
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(png[:45] + bytes([png[45] ^ 1]) + png[46:])


def test_table_round_trip(spark, odd):
    archives = media.store(odd, Scratch(spark, "t").path("a"), archive_bytes=4000)
    got = media.digests(media.read_members(spark, archives, range_bytes="1000")).collect()
    want = []
    for r in odd.select("doc_id", "text").collect():
        data = (r.text or "").encode()
        p = media.padded(data)
        want.append((r.doc_id, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    same = {}
    for r in got:
        assert same.setdefault(r.payload_sha256 + str(r.n_bytes), (r.media_sha256, r.feature, r.media_bytes)) == (r.media_sha256, r.feature, r.media_bytes)


def test_empty_table(spark, odd):
    archives = media.store(odd.where("false"), Scratch(spark, "t").path("a"))
    assert media.digests(media.read_members(spark, archives)).count() == 0


def test_members_are_read_again_from_their_offset(tmp_path):
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w") as z:
        for k in range(3):
            z.writestr(f"{k}/x.png", os.urandom(500))
    infos = zipfile.ZipFile(path).infolist()

    class Flaky:
        def __init__(self, fails):
            self.f, self.fails = open(path, "rb"), fails

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            if self.fails:
                self.fails -= 1
                raise OSError("lost")
            return self.f.read(n)

    opened = []

    def reopen(uri):
        opened.append(uri)
        return Flaky(1 if len(opened) == 1 else 0)

    data, _ = media.read_member(path, infos[1], Flaky(1), 3, reopen)
    assert data == zipfile.ZipFile(path).read("1/x.png") and len(opened) == 2
    with pytest.raises(OSError):
        media.read_member(path, infos[1], Flaky(9), 2, lambda _: Flaky(9))


def test_a_damaged_member_fails_or_is_a_row_with_its_error(spark, docs):
    scratch = Scratch(spark, "t")
    archives = media.store(docs.limit(20).coalesce(1), scratch.path("a"))
    (uri,) = list_files(scratch.path("a"), ".zip")
    path = uri.removeprefix("file://")
    info = zipfile.ZipFile(path).infolist()[3]
    with open(path, "r+b") as f:
        f.seek(info.header_offset + 30 + len(info.filename) + 100)
        f.write(b"\xff\x00\xff\x00")
    rows = media.read_members(spark, archives, on_error="null").collect()
    assert len(rows) == 20 and [r.offset for r in rows if r.error] == [info.header_offset] and all(r.media for r in rows if not r.error)
    with pytest.raises(Exception, match="damaged"):
        media.read_members(spark, archives).collect()
