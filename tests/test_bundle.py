"""Bundles: raw vector files, one or many, and files that were changed on the way."""

import numpy as np
import pytest

from tessera.operators import snapshot as sn
from tessera.plans import imports
from tessera.session import table
from tessera.sources import bundle


@pytest.fixture
def written(spark, sf, tmp_path):
    vectors = table(spark, sf, "embeddings").selectExpr("vec_id as vector_id", "embedding as vector")
    bundle.write(imports._chunks(spark, sf), vectors.repartition(3), f"file://{tmp_path}/b", "model-1")
    return tmp_path / "b"


def problems(spark, folder):
    return {r["name"].split("/")[0]: r["problem"] for r in bundle.file_problems(spark, f"file://{folder}").where("problem is not null").collect()}


def test_round_trip(spark, sf, written, monkeypatch):
    monkeypatch.setattr(bundle, "RANGE_BYTES", 4 * 64 * 7)  # ranges that end within files
    want = {r["vec_id"]: r["embedding"] for r in table(spark, sf, "embeddings").collect()}
    b = bundle.read(spark, f"file://{written}")
    got = {r["vector_id"]: r["vector"] for r in b.vectors.collect()}
    assert got == want and b.dims == 64
    assert sn.offset_gaps(b.vectors, b.dims).first()["contiguous"]
    assert sum(p.stat().st_size for p in (written / "vectors.f32").iterdir() if p.name.startswith("part-")) == len(want) * 256
    assert problems(spark, written) == {}


def test_one_raw_file_made_elsewhere(spark, written):
    """A payload as one file, as other programs write it."""
    parts = sorted(p for p in (written / "vectors.f32").iterdir() if p.name.startswith("part-"))
    data = b"".join(p.read_bytes() for p in parts)
    for p in (written / "vectors.f32").iterdir():
        p.unlink()
    (written / "vectors.f32").rmdir()
    (written / "vectors.f32").write_bytes(data)
    rows = bundle.raw_vectors(spark, f"file://{written}", 64).orderBy("offset").collect()
    assert np.array_equal(np.array([r["vector"] for r in rows], "<f4").ravel(), np.frombuffer(data, "<f4"))
    assert [r["offset"] for r in rows] == list(range(0, len(data), 256))


@pytest.mark.parametrize(("what", "change", "problem"), [
    ("vectors.f32", lambda d: d[:-1] + bytes([d[-1] ^ 1]), "sha256"),
    ("vectors.f32", lambda d: d[:-4], "bytes"),
    ("chunks.ndjson", lambda d: d + b"{}", "bytes"),
    ("vectors.ndjson", lambda d: d.replace(b"model-1", b"model-2"), "sha256"),
    ("chunks.ndjson", None, "missing"),
])
def test_changed_files_are_told(spark, written, what, change, problem):
    part = max((p for p in (written / what).iterdir() if p.name.startswith("part-")), key=lambda p: p.stat().st_size)
    data = part.read_bytes()
    part.unlink()
    for crc in (written / what).glob(f".{part.name}.crc"):
        crc.unlink()
    if change is not None:
        part.write_bytes(change(data))
    assert problems(spark, written) == {what: problem}


def test_a_cut_vector_is_refused(spark, written):
    part = max((p for p in (written / "vectors.f32").iterdir() if p.name.startswith("part-")), key=lambda p: p.stat().st_size)
    part.write_bytes(part.read_bytes()[:-3])
    with pytest.raises(ValueError, match="broken vector"):
        bundle.raw_vectors(spark, f"file://{written}", 64)
