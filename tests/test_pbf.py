import zlib

import pytest

from tessera.sources import pbf


def vint(n):
    n &= (1 << 64) - 1
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def zig(n):
    return n << 1 if n >= 0 else (-n << 1) - 1


def msg(*parts):
    return b"".join(vint(k << 3 | (0 if isinstance(v, int) else 2)) + (vint(v) if isinstance(v, int) else vint(len(v)) + v) for k, v in parts)


def deltas(values):
    return b"".join(vint(zig(b - a)) for a, b in zip([0, *values], values))


def pack(values):
    return b"".join(map(vint, values))


def file_of(*blocks):
    out = b""
    for kind, block in blocks:
        blob = msg((2, len(block)), (3, zlib.compress(block)))
        head = msg((1, kind), (3, len(blob)))
        out += len(head).to_bytes(4, "big") + head + blob
    return out


def test_elements_and_centres(spark, tmp_path):
    names = [b"", b"name", b"Cafe", b"amenity", b"cafe", b"Park", b"leisure", b"park", b"disused:shop", b"x"]
    dense = msg((1, deltas([1, 2, 3])), (8, deltas([100_000_000, 100_000_200, 100_000_000])), (9, deltas([1_060_000_000, 1_060_000_000, 1_060_000_400])), (10, pack([1, 2, 3, 4, 0, 0, 0])))
    way = msg((1, 10), (2, pack([1, 6])), (3, pack([5, 7])), (8, deltas([1, 2, 3, 1])))
    plain = msg((1, zig(7)), (2, pack([8])), (3, pack([9])), (8, zig(-100)), (9, zig(-200)))
    relation = msg((1, 20), (2, pack([6])), (3, pack([7])), (8, pack([0])), (9, deltas([10])), (10, pack([1])))
    block = msg((1, msg(*[(1, n) for n in names])), (2, msg((2, dense))), (2, msg((3, way), (1, plain), (4, relation))))
    data = file_of((b"OSMHeader", b"h"), (b"OSMData", block))
    (tmp_path / "a.pbf").write_bytes(data + data[:9])
    rows = pbf.elements(spark, str(tmp_path / "a.pbf"))
    got = {(r.kind, r.id): r for r in rows.collect()}
    assert set(got) == {("node", 1), ("node", 2), ("node", 3), ("node", 7), ("way", 10), ("relation", 20)}
    assert got["node", 2].lat == pytest.approx(10.00002) and got["way", 10].refs == [1, 2, 3, 1] and got["node", 7].lon == pytest.approx(-2e-5)
    places = {r.external_id: r for r in pbf.points_of_interest(rows).collect()}
    assert (places["node/1"].category, places["node/1"].raw_name, places["node/7"].status) == ("amenity:cafe", "Cafe", "permanently_closed")
    assert places["way/10"].lat == pytest.approx(10 + 2e-5 / 3) and places["way/10"].lon == pytest.approx(106 + 4e-5 / 3)
    assert places["relation/20"].lat == pytest.approx(10 + 2e-5 / 3)
