import glob
import hashlib
import io

import pytest
import zstandard
from pyspark.sql import functions as F

from cartulary.llm import common, warc


def pages(spark):
    big, other = "<p>" + "x" * 1200, "<p>é" + "y" * 1500
    rows = [(1, "http://a", big), (2, "http://b", "small"), (3, None, "small"), (4, "http://d", None), (5, "http://e\r\nX: y", big), (6, "http://f", other), (7, "http://g", big), (8, "h", ""), (6, "again", other), (None, "n", big), (9, "i", "z" * 1000), (10, "j", "z" * 1000), (11, "k", "z" * 999), (12, "l", "z" * 999), (13, "m", "\r\n\r\nWARC/1.1\r\n" + "q" * 300_000)]
    return rows, spark.createDataFrame([(*r, 5) for r in rows], "page_id bigint, url string, html string, digest int").repartition(3)


def want(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == data and j is not None]
        to = max(same) if len(data) >= 1000 and i is not None and max(same) != i else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to else "response", to, None if to else data))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("frame", "bundle"), [(500, 2000), (3000, 1 << 22), (warc.FRAME_BYTES, warc.BUNDLE_BYTES)])
def test_round_trip(spark, tmp_path, frame, bundle):
    rows, df = pages(spark)
    path = str(tmp_path / "out")
    warc.write(df, path, frame_bytes=frame, bundle_bytes=bundle)
    got = warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").collect()
    assert sorted([(*r[:5], None if r.payload is None else bytes(r.payload)) for r in got], key=repr) == want(rows)
    ids = spark.createDataFrame([(13,), (5,), (77,)], "page_id bigint")
    found = {r.page_id: warc.parse(bytes(r.record)) for r in warc.fetch(spark, path, ids).collect()}
    assert set(found) == {13, 5} and found[5]["refers_to"] == 7 and len(found[13]["payload"]) == 300_014
    places = {(r.bundle, r.frame, r.offset): r.page_id for r in warc.locate(spark, path).collect()}
    assert len(places) == len(rows) and sum(r.records for r in warc.manifest(spark, path).collect()) == len(rows)
    assert any(offset for _, _, offset in places) == (frame > 500)  # records share frames
    common.discard(spark, path)
    assert not (tmp_path / "out").exists()


def bundle(records, frame_bytes):
    to = io.BytesIO()
    writer = warc.Writer(to, frame_bytes)
    for i, data in records:
        writer.add(i, data)
    writer.finish()
    return to


def test_a_bundle_is_plain_zstandard():
    to = bundle([(1, b"first"), (-1, b"minus"), (2, b"second" * 100), (None, b"none"), (2, b"third")], 20)
    reader = warc.Bundle(to)
    assert reader.get(2) == [b"second" * 100, b"third"] and reader.get(3) == [] and reader.get(-1) == [b"minus"]
    assert reader.entries == [(1, 0, 0), (-1, 0, 5), (2, 1, 0), (None, 2, 0), (2, 2, 4)]
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(to.getvalue()), read_across_frames=True).read()
    assert whole == b"firstminus" + b"second" * 100 + b"nonethird"
    with pytest.raises(ValueError):
        warc.Bundle(io.BytesIO(to.getvalue()[:-1] + b"\0"))
    assert warc.Bundle(bundle([], 20)).entries == []


def test_a_record_costs_its_frame_and_the_end(spark, tmp_path):
    """Bytes read of a large bundle for one record, counted."""
    df = spark.range(3000).selectExpr("id as page_id", "concat('u', id) as url", "concat(sha2(string(id), 512), sha2(string(-id), 512), repeat(sha2(string(id * 7), 512), 40)) as html").coalesce(1)
    path = f"file:{tmp_path}/out"
    warc.write(df, path, frame_bytes=10_000)
    (row,) = warc.manifest(spark, path).collect()
    assert row.records == 3000 and row.frames > 500 and row.bytes > 400_000
    (got,) = warc.fetch(spark, path, spark.createDataFrame([(1234,)], "page_id bigint")).collect()
    data = (tmp_path / "out" / row.bundle).read_bytes()
    reader = warc.Bundle(io.BytesIO(data))
    end = reader.bytes_read  # footer and index
    assert got.page_id == 1234 and warc.parse(bytes(got.record))["target_uri"] == "u1234"
    reader.get(1234)
    assert got.bundle_bytes_read == reader.bytes_read and reader.bytes_read - end < 4000
    assert got.bundle_bytes_read < row.bytes / 8


def test_shared_folder_and_empty_table(spark):
    rows, df = pages(spark)
    assert warc.round_trip(df).count() == len(rows)
    assert warc.round_trip(df.where(F.lit(False))).count() == 0
    folder = common.ensure_checkpoint_dir(spark).removeprefix("file:")
    assert not glob.glob(f"{folder}/warc-*")  # the archives are gone


def test_what_a_lost_attempt_left_is_not_read(spark, tmp_path):
    rows, df = pages(spark)
    path = str(tmp_path / "out")
    warc.write(df, path)
    (tmp_path / "out" / "bundles" / "half.warc.zst").write_bytes(b"half a bundle")
    assert warc.read(spark, path).count() == len(rows)
