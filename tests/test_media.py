import struct
import wave

import numpy as np
import pytest

from tidemark.sources import media as M


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def movie(w=640, h=360, turn=(65536, 0, 0, 0, 65536), rate=600, ticks=1800, frames=90, version=0, kind=b"vide", wide=False):
    matrix = struct.pack(">9i", *turn, 0, 0, 0, 1 << 30)
    tkhd = box(b"tkhd", bytes([version, 0, 0, 7]), bytes(20 if version == 0 else 32), bytes(16), matrix, struct.pack(">II", w << 16, h << 16))
    mdhd = box(b"mdhd", bytes([version, 0, 0, 0]), bytes(8 if version == 0 else 16), struct.pack(">II" if version == 0 else ">IQ", rate, ticks), bytes(4))
    hdlr = box(b"hdlr", bytes(8), kind, bytes(13))
    stbl = box(b"stbl", box(b"stts", struct.pack(">IIII", 0, 1, frames, ticks // frames)))
    moov = box(b"moov", box(b"mvhd", bytes(4), bytes(8), struct.pack(">II", 1000, 3000), bytes(80)), box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, box(b"minf", stbl))))
    data = struct.pack(">I4sQ", 1, b"mdat", 16 + 50) + bytes(50) if wide else box(b"mdat", bytes(50))
    return box(b"ftyp", b"isom0000") + data + moov


def test_headers():
    for version in (0, 1):
        assert M.header(movie(version=version)) == (640, 360, None, 3.0, 30.0)
    assert M.header(movie(turn=(0, 65536, 0, -65536, 0)))[2] == -90 and M.header(movie(turn=(0, -65536, 0, 65536, 0)))[2] == 90
    assert M.header(movie(turn=(-65536, 0, 0, 0, -65536)))[2] == -180 and M.header(movie(wide=True))[:2] == (640, 360)
    broken = (None, None, None, -1.0, None)
    whole = movie()
    assert all(M.header(x) == broken for x in (b"", b"abc", whole[:-1], whole[:200], movie(kind=b"soun"), bytes(500), b"\xff" * 500))
    for at in range(0, len(whole), 3):  # a damaged byte never raises
        M.header(whole[:at] + b"\xff" + whole[at + 1 :])


def test_headers_of_files(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(movie())
    (tmp_path / "b.mov").write_bytes(b"none")
    got = {r.path.rsplit("/", 1)[1]: r for r in M.media_headers(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert (got["a.mp4"].width, got["a.mp4"].duration) == (640, 3.0) and (got["b.mov"].width, got["b.mov"].duration) == (None, -1.0)
    assert M.media_headers(spark.createDataFrame([("x", None)], "path string, content binary")).first().duration == -1.0


def test_npz(spark, tmp_path):
    for i in range(5):
        np.savez(tmp_path / f"v{i}.npz", track_ids=np.arange(i), embeddings=np.full((i, 3), i / 2), other=np.arange(99))
    M.register(spark)
    read = lambda schema, path=tmp_path: spark.read.format("npz").schema(schema).option("filesPerPartition", 2).load(str(path))
    df = read("path string, embeddings array<double>, track_ids long")
    assert df.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, df.collect())) == sorted((f"v{i}.npz", [i / 2] * 3, t) for i in range(5) for t in range(i))
    assert read("other long").count() == 5 * 99
    with pytest.raises(Exception, match="different lengths"):
        read("other long, track_ids long").collect()
    (tmp_path / "none").mkdir()
    assert read("path string, other long", tmp_path / "none").count() == 0
    with pytest.raises(ValueError):
        M.mounted("s3a://bucket/x")
    assert M.mounted("file:///a/b") == "/a/b" and M.mounted("/a") == "/a"


def test_wav_blocks(spark, tmp_path):
    pcm = np.arange(-50, 50, dtype="<i2") * 300
    for name, channels in (("mono", 1), ("stereo", 2)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as f:
            f.setparams((channels, 2, 10, 0, "NONE", ""))
            f.writeframes(pcm.tobytes())
    M.register(spark)
    heads = spark.read.format("wav").load(str(tmp_path)).collect()
    assert sorted(map(tuple, heads)) == [("mono.wav", 10, 1, 100), ("stereo.wav", 10, 2, 50)]
    rows = spark.read.format("wav").schema("path string, at double, pcm array<double>").option("seconds", 3).load(str(tmp_path)).orderBy("path", "at").collect()
    assert [r.at for r in rows] == [0.0, 3.0, 6.0, 9.0, 0.0, 3.0]
    assert [x for r in rows if r.path == "mono.wav" for x in r.pcm] == (pcm / 32768).tolist() == [x for r in rows if r.path == "stereo.wav" for x in r.pcm]


def test_files_written_by_key(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i % 3}", i, [float(i)] * 2) for i in range(20)], "k string, i long, v array<double>")
    assert M.write_npz(rows, "k", "i", ["i", "v"], str(tmp_path / "z")) == 3
    assert np.load(tmp_path / "z" / "k1.npz")["i"].tolist() == list(range(1, 20, 3)) and len(list((tmp_path / "z").iterdir())) == 3
