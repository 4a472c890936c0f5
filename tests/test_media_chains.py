import numpy as np
import pytest

from unitloom.operators import images, nested, provenance, sealing
from unitloom.plans.capabilities import Capabilities
from unitloom.sources import container, registry
from unitloom.streaming import recompute_stream, violations_stream


def noise(width, height, seed=1, opaque=True):
    x = np.random.default_rng(seed).integers(0, 256, (height, width, 4), dtype=np.uint8)
    if opaque:
        x[:, :, 3] = 255
    return x


def frame(spark, *arrays):
    return spark.createDataFrame([(f"i{k}", x.shape[1], x.shape[0], bytearray(x.tobytes())) for k, x in enumerate(arrays)], images.PIXELS)


def test_png_and_tiles(spark):
    whole = frame(spark, noise(150, 100), noise(70, 65, 2, False))
    again = images.from_png(images.to_png(whole))
    assert again.exceptAll(whole).count() == 0
    tiles = images.cut(whole)
    assert tiles.count() == 6 + 4
    assert images.join_tiles(images.load(images.store(tiles))).exceptAll(whole).count() == 0
    assert images.grid_faults(whole.select("image", "width", "height"), tiles).collect() == []
    assert {r["message"] for r in images.grid_faults(whole.select("image", "width", "height"), tiles.where("tx > 0").unionByName(tiles.where("ty > 0"))).collect()} == {"the tile is missing", "the tile is there more than once"}
    with pytest.raises(images.ImageError, match="JPEG"):
        images.decode_png(b"\xff\xd8\xff\xe0")


def test_patch_and_diff(spark):
    base = np.zeros((128, 128, 4), dtype=np.uint8)
    tiles = images.cut(frame(spark, base))
    red = np.full((2, 2, 4), 255, dtype=np.uint8)
    new, touched = images.patch(tiles, 63, 0, 2, 2, red.tobytes(), "i0")
    assert sorted((r["tx"], r["ty"]) for r in touched.collect()) == [(0, 0), (1, 0)]
    assert [(r["tx"], r["ty"]) for r in images.diff(tiles, new).collect()] == [(0, 0), (1, 0)]


def test_palette_and_thumbnail(spark):
    x = np.zeros((40, 50, 4), dtype=np.uint8)
    x[:, :, 3] = 255
    x[:10] = [255, 17, 0, 255]
    p = images.palette(images.pixels(frame(spark, x))).orderBy("rank").collect()
    assert [(r["r"], r["g"], r["pixels"], r["percent"]) for r in p] == [(0, 0, 1500, 75.0), (240, 16, 500, 25.0)]
    assert [images.thumb_edge(n) for n in (1600, 384, 30, 150)] == [128, 128, 30, 50]
    mix = np.array([[[255, 255, 255, 255], [0, 0, 0, 255]]], dtype=np.uint8)
    assert images.shrink(mix, 1)[0, 0].tolist() == [188, 188, 188, 255]
    clear = np.array([[[255, 0, 0, 255], [0, 255, 0, 0]]], dtype=np.uint8)
    assert images.shrink(clear, 1)[0, 0].tolist() == [255, 0, 0, 128]
    assert images.thumbnails(frame(spark, noise(150, 90))).select("width", "height").first() == (50, 30)
    assert images.summarise(frame(spark, x, noise(9, 9, 3, False))).orderBy("image").select("tiles", "opaque").collect() == [(1, True), (1, False)]


def history(spark, identity=None):
    rows = [("s", i, "t", f"a{i}", "2024-01-01T00:00:00Z", None, None, None) for i in range(4)]
    return provenance.link(spark.createDataFrame(rows, "subject string, seq int, tool string, action string, timestamp string, content_hash string, key string, signature string"))


def test_chains(spark):
    chain = history(spark)
    assert provenance.verify(chain).select("entries", "unsigned", "broken_at").first() == (4, 4, None)
    assert provenance.verify(chain.where("seq <> 1")).first()["broken_at"] == 1
    edited = chain.withColumn("action", provenance.F.when(chain.seq == 2, "x").otherwise(chain.action))
    assert provenance.verify(edited).first()["broken_at"] == 3
    assert provenance.verify(chain.where("seq > 0")).first()["broken_at"] == 0


def test_signatures(spark):
    # The first test vector of RFC 8032.
    identity = provenance.Identity(bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60"))
    assert identity.key == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    signature = identity.sign(b"")
    assert signature.startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46b")
    assert provenance.verify_signature(identity.key, signature, b"") and not provenance.verify_signature(identity.key, signature, b"x")
    row = spark.createDataFrame([("s", 0, "t", "a", "now", None, None, identity.key, None)], "subject string, seq int, tool string, action string, timestamp string, prev_hash string, content_hash string, key string, signature string")
    data = bytes(row.select(provenance.canonical().alias("c")).first()["c"])
    signed = row.withColumn("signature", provenance.F.lit(identity.sign(data)))
    assert provenance.verify(signed).select("signed", "broken_at").first() == (1, None)
    assert provenance.verify(signed.withColumn("action", provenance.F.lit("b"))).first()["why"] == "the signature does not match"


def test_sealing(spark):
    ring = sealing.KeyRing()
    ring.declare("a", "long enough")
    ring.declare("b", "other words")
    leaves = nested.flatten(spark.createDataFrame([(1, '{"x":1,"db":{"user":"u","pw":"p"},"y":2}')], "id int, body string"), ["id"], "body")
    public, sealed = sealing.seal_paths(leaves, ["id"], ["db"], "a", ring)
    sealed = spark.createDataFrame(sealed.collect(), sealed.schema)
    assert public.count() == 2 and sealed.count() == 2
    back, rest = sealing.unseal_paths(public, sealed, ["id"], "a", ring)
    assert back.exceptAll(leaves.select(*back.columns)).count() == 0 and rest.count() == 0
    shut = sealing.KeyRing(ring.slots)
    with pytest.raises(sealing.SealError):
        sealing.unseal_paths(public, sealed, ["id"], "a", shut)
    with pytest.raises(sealing.SealError):
        shut.declare("a", "a new phrase")
    with pytest.raises(sealing.SealError):
        ring.declare("c", "short")
    with pytest.raises(sealing.SealError):
        sealing.refuse_export(sealed)
    shut.unlock("a", "wrong words")
    assert sealing.unseal_paths(public, sealed, ["id"], "a", shut)[0].where("path is null").count() == 2


def test_capabilities():
    wanted = Capabilities(True, ("read:/srv/data", "write:/tmp/out"), ("HOME",), 512)
    assert len(wanted.exceeds(Capabilities(False, ("read:/srv", "read:/tmp"), (), 256))) == 4
    assert wanted.exceeds(Capabilities(True, ("write:/",), ("*",), 512)) == []
    assert not wanted.allows("read", "/srv/database") and wanted.allows("read", "/tmp/out/x") and not wanted.allows("write", "/srv/data/../x")
    assert [s for s, *_ in Capabilities(True, ("odd", "read:/", "write:../x"), ("*",)).lint()] == ["error", "warning", "warning", "warning", "note"]


def test_container(spark, tmp_path):
    parts = [container.Chunk("META", b"m"), container.Chunk("DATA", children=[container.Chunk("SECT", bytes(5000)), container.Chunk("SECT", b"two" * 200)]), container.Chunk("SUMM", children=[container.Chunk("TEXT", b"s")])]
    path = str(tmp_path / "a.bin")
    container.write(path, "MT", parts)
    with pytest.raises(FileExistsError):
        container.write(path, "MT", parts)
    data = open(path, "rb").read()
    head, found = container.unpack(data)
    assert head.tag == "MT" and found == parts
    _, some, whole = container.unpack_some(data, lambda c: len(c) >= 1)
    assert not whole and len(some[1].children) == 1
    for bad in (data[:-1], data[:-1] + bytes([data[-1] ^ 1]), data[:30], b"x" * 99):
        with pytest.raises(container.ContainerError):
            container.unpack(bad)
    rows = container.read_containers(spark, path).collect()
    assert [r["path"] for r in rows] == ["META[0]", "DATA[1]", "DATA[1]/SECT[0]", "DATA[1]/SECT[1]", "SUMM[2]", "SUMM[2]/TEXT[0]"]
    assert container.info(spark, path).first()["tag"] == "MT" and container.tally(container.read_containers(spark, path)).count() == 5
    value = {"b": [1, 2.5, None, True, "x", b"y", {}], "a": -(2**63)}
    assert container.decode_value(container.encode_value(value)) == value
    for bad in (container.encode_value(value)[:-1], container.encode_value(1) + b"x", b"\x09"):
        with pytest.raises(container.ContainerError):
            container.decode_value(bad)


def test_registry():
    assert registry.preferred("json")[0].name == "config" and registry.preferred("json")[1] == ["table"]
    assert registry.preferred("json", "table")[0].name == "table" and registry.extension("x.bin", b"\x89PNG\r\n\x1a\n") == "png"
    with pytest.raises(registry.UnsupportedSource):
        registry.preferred("jpg")
    assert "&lt;b&gt;" in registry.preview_html("<b>", {"rows": 1})


def test_streams(spark, tmp_path):
    from unitloom.operators.rules import FieldRule
    from unitloom.plans.spec import ColumnSpec, TableSpec

    spark.createDataFrame([(1, 6.0, 2.0), (2, -6.0, 0.0)], "id int, a double, b double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, a double, b double").parquet(str(tmp_path / "in"))
    spec = TableSpec.of([ColumnSpec("id", "int"), ColumnSpec("a", "float", "m"), ColumnSpec("b", "float", "s"), ColumnSpec("v", "float", "m/s", "a / b")])
    for name, frame_ in (("v", recompute_stream(stream, spec)), ("w", violations_stream(stream, [FieldRule("a", "float", min=0)], ["id"]))):
        query = frame_.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(60)
    assert sorted(r["v"] for r in spark.table("v").collect()) == [float("-inf"), 3.0] and spark.table("w").count() == 1
