import struct

from pyspark.sql import functions as F

from cartulary.functions.images import dimensions, image_size

PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480)
GIF = b"GIF89a" + struct.pack("<HH", 10, 20)
JPEG = b"\xff\xd8" + b"\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xff\xc2" + struct.pack(">HBHH", 17, 8, 300, 200)
WEBP = b"RIFF" + b"\0" * 4 + b"WEBP" + b"VP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
LOSSLESS = b"RIFF" + b"\0" * 4 + b"WEBP" + b"VP8L" + b"\0" * 4 + b"\x2f" + struct.pack("<I", 6 | 8 << 14)
AVIF = struct.pack(">I", 20) + b"ftypavif" + b"\0" * 8 + struct.pack(">I", 20) + b"ispe" + b"\0" * 4 + struct.pack(">II", 30, 40)


def test_formats():
    assert dimensions(PNG) == ("png", 640, 480) and dimensions(GIF) == ("gif", 10, 20) and dimensions(JPEG) == ("jpeg", 200, 300)
    assert dimensions(WEBP) == ("webp", 100, 50) and dimensions(LOSSLESS) == ("webp", 7, 9)
    assert dimensions(AVIF) == ("avif", 30, 40) and dimensions(AVIF[:-1]) is None and dimensions(AVIF[:20]) is None
    assert [dimensions(x) for x in (b"", b"text", PNG[:20], JPEG[:12], b"\xff\xd8")] == [None] * 5


def test_column(spark):
    df = spark.createDataFrame([(PNG,), (None,), (b"x",)], "c binary").select(image_size(F.col("c")).alias("s"))
    assert [tuple(r.s) for r in df.collect()] == [("png", 640, 480), (None, None, None), (None, None, None)]
