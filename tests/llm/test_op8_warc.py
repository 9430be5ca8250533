import io

from veinstone.llm import warc


def archive(compressed):
    records = [warc.page_record(k, f"http://x/{k}", (f"<p>{k}" * (40 + k % 7 * 100)).encode(), None, "2024-01-01T00:00:00Z") for k in range(50)]
    return [warc.member(r) if compressed else r for r in records]


def test_salvage():
    for compressed in (True, False):
        data = archive(compressed)
        starts = [sum(map(len, data[:k])) for k in range(51)]
        blob = bytearray(b"".join(data))
        for k in (5, 20, 49):
            middle = starts[k] + len(data[k]) * 3 // 4
            blob[middle : middle + 5] = bytes(x ^ 255 for x in blob[middle : middle + 5])
        found = list(warc.salvage(io.BytesIO(bytes(blob)), len(blob)))
        assert {r.headers["WARC-Record-ID"] for r in found if isinstance(r, warc.Record)} == {f"<urn:page:{k}>" for k in range(50) if k not in (5, 20, 49)}
        assert [(g.start, g.end) for g in found if isinstance(g, warc.Gap)] == [(starts[k], starts[k + 1]) for k in (5, 20, 49)]


def test_cut_and_mixed_archives():
    data = b"".join(archive(True)[:3])
    cut = list(warc.salvage(io.BytesIO(data[:-30]), len(data) - 30))
    assert [type(x) for x in cut] == [warc.Record, warc.Record, warc.Gap]
    mixed = b"junk" + archive(False)[0] + b"\x1f\x8b\x08 not a member" + archive(True)[1]
    kinds = [type(x) for x in warc.salvage(io.BytesIO(mixed), len(mixed))]
    assert kinds == [warc.Gap, warc.Record, warc.Gap, warc.Record] and list(warc.salvage(io.BytesIO(b""), 0)) == []


def ids(found):
    return [r.get("warc-record-id").strip("<>").rpartition(":")[2] for r in found if isinstance(r, warc.Record)]


def salvaged(blob):
    return list(warc.salvage(io.BytesIO(bytes(blob)), len(blob)))


def test_members_of_several_records():
    plain = archive(False)[:10]
    starts = [sum(map(len, plain[:k])) for k in range(11)]
    # One bad byte in a sound member: all others are read, and the gap tells where it is.
    blob = bytearray(b"".join(plain))
    blob[starts[4] + len(plain[4]) // 2] ^= 255
    data = warc.member(bytes(blob)) + archive(True)[11]
    found = salvaged(data)
    assert ids(found) == [str(k) for k in (0, 1, 2, 3, 5, 6, 7, 8, 9, 11)]
    gap = [g for g in found if isinstance(g, warc.Gap)][0]
    assert (gap.start, gap.inner_start, gap.inner_end) == (0, starts[4], starts[5]) and gap.end == found[0].end
    # Cut short, and with a wrong checksum: the records whose digests hold are read.
    whole = warc.member(b"".join(plain))
    for broken in (whole[:-6], whole[:-8] + b"\0" * 8):
        found = salvaged(broken + archive(True)[11])
        assert ids(found) == [*map(str, range(10)), "11"] and sum(isinstance(g, warc.Gap) for g in found) == 1
    # A bad byte in the compressed data: what comes before it is read.
    broken = bytearray(whole)
    broken[len(whole) * 2 // 3] ^= 255
    found = salvaged(bytes(broken) + archive(True)[11])
    assert ids(found)[:3] == ["0", "1", "2"] and ids(found)[-1] == "11" and len(ids(found)) < 11
    assert [g for g in found if isinstance(g, warc.Gap)][0].inner_start > 0


def test_foreign_records():
    lower = b"WARC/1.0\r\nwarc-type: resource\r\nwarc-record-id: <urn:x:7>\r\ncontent-length: 3\r\n\r\nabc\r\n\r\n"
    bare = b"WARC/1.1\r\nContent-Length: 0\r\nX: a\r\n b\r\n\r\n\r\n\r\n"
    revisit = b"WARC/1.1\r\nWARC-Type: revisit\r\nContent-Length: 4\r\n\r\nHTTP\r\n\r\n"
    big = warc.record_bytes({"WARC-Type": "metadata", "X": "y" * (3 << 20)}, b"z")
    for data in (lower + bare + revisit + big, warc.member(lower + bare + revisit + big)):
        found = salvaged(data)
        assert [r.get("WARC-TYPE") for r in found] == ["resource", None, "revisit", "metadata"]
        assert found[0].block == b"abc" and found[1].headers["X"] == "a b" and len(found[3].get("x")) == 3 << 20
    # Nothing vouches for a block without a digest in a damaged member.
    assert [type(x) for x in salvaged(warc.member(lower)[:-4])] == [warc.Gap]
    # A length that says too much doesn't hide what follows.
    wrong = lower.replace(b"length: 3", b"length: 99999999")
    assert ids(salvaged(wrong + lower)) == ["7"] and ids(salvaged(warc.member(wrong + lower))) == ["7"]


def test_quarantine_log(spark, tmp_path):
    data = bytearray(b"".join(archive(True)))
    data[5000:5010] = b"\0" * 10
    (tmp_path / "a.warc.gz").write_bytes(bytes(data))
    (tmp_path / "b.warc").write_bytes(b"WARC/1.0\r\nContent-Length: 1\r\n\r\nx\r\n\r\n")
    archives = spark.createDataFrame([(f"file://{tmp_path}/{name}",) for name in ("a.warc.gz", "b.warc")], "archive string")
    found = warc.read_pages(archives)
    log = warc.quarantine(found).collect()
    assert len(log) == 1 and log[0].gap and log[0].end > log[0].start and log[0].archive.endswith("a.warc.gz")
    assert found.where("gap IS NULL").count() == 50 and found.where("record_type IS NULL AND gap IS NULL").count() == 1


def test_round_trip(spark, odd_folder, tmp_path):
    pages = spark.read.parquet(f"{odd_folder}/pages.parquet")
    archives = warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=500)
    found = warc.read_pages(archives).collect()
    assert all(r.gap is None for r in found)
    kinds = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to) for r in found)
    assert kinds == [(-1, "response", None), (-1, "revisit", 2), (0, "response", None), (1, "revisit", 0), (2, "response", None), (3, "revisit", 2), (7, "response", None), (7, "response", None)]
    assert {r.payload_bytes for r in found if r.page_id == 7} == {18_000}
    whole = warc.read_archives(archives).collect()
    assert {r.record_type for r in whole} == {"response", "revisit"} and any("http://a" in r.headers for r in whole)
