import numpy as np
from pyspark.sql import functions as F

from ridgework.functions import geocode, ids

CASES = [(0, 0, 0, 0), (1, -1, 5, 0), (4095, 8388607, -8388608, 7), (0, -8388608, 8388607, -8), (7, 123456, -654321, -1)]


def test_pack_round_trip(spark):
    df = spark.createDataFrame(CASES, "g int, x int, y int, s int").withColumn("ix", ids.pack("g", "x", "y", "s"))
    p = ids.unpack("ix")
    got = df.select(*p.values(), ids.with_seq("ix", -3).alias("o")).collect()
    assert sorted((r[0], r[1], r[2], r[3]) for r in got) == sorted(CASES)
    assert [r[0] for r in df.select(ids.unpack(ids.with_seq("ix", -3))["seq"]).collect()] == [-3] * len(CASES)


def test_tiles_floor(spark):
    df = spark.createDataFrame([(-1,), (0,), (511,), (512,), (-513,)], "x int")
    assert [r[0] for r in df.select(ids.tile("x", 9)).collect()] == [-1, 0, 0, 1, -2]
    # level 0 has no shift, level 1 one half base tile, level 2 five
    assert [r[0] for r in spark.createDataFrame([(8,), (7,)], "x int").select(ids.chunk_tile("x", 1, 4)).collect()] == [0, -1]
    assert [r[0] for r in spark.createDataFrame([(40,), (39,)], "x int").select(ids.chunk_tile("x", 2, 4)).collect()] == [0, -1]


def test_hex_and_bits(spark):
    df = spark.createDataFrame([(-1,), (0,), (255,), (-(2**63),)], "v long")
    r = df.select("v", ids.hex_id("v").alias("h"), ids.hex_to_id(ids.hex_id("v")).alias("b"), ids.bit_reversed("v").alias("r")).collect()
    assert [x.h for x in r] == ["f" * 16, "0" * 16, "00000000000000ff", "8000000000000000"]
    assert all(x.v == x.b for x in r)
    assert [x.r for x in r] == [-1, 0, -72057594037927936, 1]
    assert ids.hex_limit("", True) == 2**63 - 1 and ids.hex_limit("ff", False) == -(2**56) and ids.hex_limit("0", True) == 2**60 - 1


def test_scalars(spark):
    df = spark.createDataFrame([(1.9999,), (-1.9999,), (8.2,)], "v float")
    assert [r[0] for r in df.select(ids.millimetres("v")).collect()] == [1999, -1999, 8199]
    assert spark.range(1).select(ids.wrapped_x(F.lit(180), 360), ids.wrapped_x(F.lit(-181), 360), ids.lon_normal(F.lit(190.0)), ids.lon_epoch(F.lit(190.0)), ids.unit_factor(F.lit("ft"))).first()[:] == (-180, 179, -170.0, 1, 0.3048)


def test_cell_ids():
    got = geocode.cell_ids(np.array([0.0, 0.0, 90.0]), np.array([0.0, 90.0, 0.0]))
    assert got[0] == 0x1000000000000001 and got[1] == 0x3000000000000001 and got[2] == 0x5000000000000001
    rng = np.random.default_rng(0)
    lat, lon = rng.uniform(-90, 90, 2000), rng.uniform(-180, 180, 2000)
    a, b = geocode.cell_ids(lat, lon).view("u8"), geocode.cell_ids(lat + 1e-9, lon).view("u8")
    assert len(set(a.tolist())) == 2000 and np.median((a ^ b).astype(float)) < 2**40  # neighbours share long prefixes
    assert set((a >> np.uint64(61)).tolist()) == {0, 1, 2, 3, 4, 5}


def test_lines():
    assert geocode.line_wkb([]) is None
    one = geocode.line_wkb([{"x": 1, "y": 2}])
    assert len(one) == 9 + 32 and one[:5] == b"\1\2\0\0\0"
