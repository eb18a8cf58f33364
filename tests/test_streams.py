import io
import random

import pytest

from tessera.sources import pbf
from tessera.sources.streams import lines_of, ndjson_lines, pbf_elements

from .test_pbf import deltas, file_of, msg, pack


def test_spans_share_no_line_and_miss_none():
    rng = random.Random(1)
    data = b"\n".join(bytes(rng.choices(b"ab ", k=rng.choice([0, 1, 5, 40]))) for _ in range(60))
    for tail in (b"", b"\n"):
        whole = data + tail
        want = [x for x in whole.split(b"\n")]
        want = want[:-1] if want[-1] == b"" else want
        for split in (1, 3, 17, 10_000):
            got = [p for a in range(0, len(whole), split) for p in lines_of(io.BytesIO(whole), a, min(a + split, len(whole)))]
            assert [x for _, x in got] == want and all(whole[at : at + len(x)] == x for at, x in got)


def drained(spark, folder, checkpoint, out, split=64):
    q = ndjson_lines(spark, str(folder), split).writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start(str(out))
    q.awaitTermination()
    return spark.read.parquet(str(out)) if any(out.rglob("*.parquet")) else None


def test_a_restart_in_mid_file_gives_each_line_once(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    lines = ['{"place_id": "%d", "title": "Quán %s"}' % (i, "x" * (i % 50)) for i in range(90)]
    with open(folder / "a.json", "w") as f:
        f.write("\n".join(lines[:30]) + "\n" + lines[30][:9])  # the last line isn't whole yet
    rows = drained(spark, folder, tmp_path / "c", out)
    assert sorted(r.line for r in rows.collect()) == sorted(lines[:30])
    with open(folder / "a.json", "a") as f:
        f.write(lines[30][9:] + "\n\n  \n" + "\n".join(lines[31:60]) + "\n")
    (folder / "b.json").write_text("\n".join(lines[60:]) + "\n")
    rows = drained(spark, folder, tmp_path / "c", out)
    assert sorted(r.line for r in rows.collect()) == sorted(lines)
    data = {p: (folder / p).read_bytes() for p in ("a.json", "b.json")}
    assert all(data[r.file.rpartition("/")[2]][r.at : r.at + len(r.line.encode())] == r.line.encode() for r in rows.collect())
    assert drained(spark, folder, tmp_path / "c", out).count() == len(lines)  # nothing new
    (folder / "a.json").write_text("changed\n" * 500)
    with pytest.raises(Exception, match="isn't the file"):
        drained(spark, folder, tmp_path / "c", out)


def test_one_extract_over_many_tasks(spark, tmp_path):
    blocks = []
    for b in range(40):
        ids = list(range(b * 100, b * 100 + 100))
        dense = msg((1, deltas(ids)), (8, deltas([i * 10 for i in ids])), (9, deltas([i * 20 for i in ids])), (10, pack([0] * 100)))
        way = msg((1, b), (2, pack([1])), (3, pack([2])), (8, deltas(ids[:3])))
        blocks.append((b"OSMData", msg((1, msg((1, b""), (1, b"amenity"), (1, b"cafe"))), (2, msg((2, dense))), (2, msg((3, way))))))
    data = file_of((b"OSMHeader", b"h"), *blocks)
    (tmp_path / "a.pbf").write_bytes(data + data[:50])
    rows = pbf_elements(spark, str(tmp_path / "a.pbf"), split=300)
    assert rows.rdd.getNumPartitions() > 5
    key = lambda df: sorted((r.kind, r.id, r.lat, r.lon, r.refs, sorted((r.tags or {}).items())) for r in df.collect())
    assert key(rows) == key(pbf.elements(spark, str(tmp_path / "a.pbf"))) and rows.count() == 4040
    (tmp_path / "none").mkdir()
    assert pbf_elements(spark, str(tmp_path / "none")).count() == 0
