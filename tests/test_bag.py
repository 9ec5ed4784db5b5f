"""Recorded logs: written, indexed, pruned by topic and time, merged, decoded."""

import random
import struct

import pytest

from atlasfold.sources import bag

SCAN = "Header header\nfloat32 step\nint32 N=5\nfloat64[] ranges\nuint8[3] colour\nPoint[] points\nstring[2] names\nbool on\nduration age\n===\nMSG: std_msgs/Header\nuint32 seq\ntime stamp\nstring frame_id\n===\nMSG: geometry/Point\nfloat64 x\nfloat64 y\n"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def packed(k):
    name = f"frame{k}".encode()
    return (
        struct.pack("<IIII", k, 100 + k, 5, len(name)) + name + struct.pack("<fI", 0.5, k % 3) + struct.pack(f"<{k % 3}d", *range(k % 3)) + bytes([1, 2, k % 256])
        + struct.pack("<I", 1) + struct.pack("<dd", k, -k) + struct.pack("<I", 1) + b"a" + struct.pack("<I", 0) + struct.pack("<?ii", k % 2 == 0, 2, 7)
    )


@pytest.fixture(params=["none", "bz2"])
def folder(request, tmp_path):
    g = random.Random(1)
    messages = [(g.choice(["scan", "odom", "rare"] if 300 <= i < 320 else ["scan", "odom"]), "lab/Scan", 1_000_000_000 * (i + g.randint(0, 3)) + i, packed(i)) for i in range(900)]
    for k in range(3):
        pieces = list(bag.bag_bytes(iter(messages[300 * k : 300 * k + 300]), {"lab/Scan": SCAN}, request.param, 4000))
        (tmp_path / f"{k}.bag").write_bytes(pieces[-1] + b"".join(pieces[1:-1]))
    pieces = list(bag.bag_bytes(iter(()), {}))
    (tmp_path / "empty.bag").write_bytes(pieces[-1] + b"".join(pieces[1:-1]))
    return str(tmp_path), messages


def test_all_messages_come_back_in_order(spark, folder):
    path, messages = folder
    found = rows(bag.in_order(bag.read_log(spark, path)))
    assert [r["time_ns"] for r in found] == sorted(m[2] for m in messages)
    assert sorted((r["topic"], r["type"], r["time_ns"], bytes(r["data"])) for r in found) == sorted(messages)
    assert [(c.topic, c.definition) for c in bag.connections(path)] == [("odom", SCAN), ("rare", SCAN), ("scan", SCAN)]


def test_filters_prune_chunks_by_the_index(spark, folder):
    path, messages = folder
    log = bag.read_log(spark, path)
    every = log.rdd.getNumPartitions()
    cases = [
        (log.where("topic = 'rare'"), lambda m: m[0] == "rare"),
        (log.where("topic in ('rare', 'none')"), lambda m: m[0] == "rare"),
        (log.where("time_ns >= 400000000000 and time_ns < 420000000000"), lambda m: 400 * 10**9 <= m[2] < 420 * 10**9),
        (log.where("time_ns > 880000000000 and topic = 'odom' and length(data) > 0"), lambda m: m[2] > 880 * 10**9 and m[0] == "odom"),
    ]
    for df, right in cases:
        assert sorted((r["topic"], r["type"], r["time_ns"], bytes(r["data"])) for r in rows(df)) == sorted(m for m in messages if right(m))
        assert df.rdd.getNumPartitions() < every / 5
    assert rows(log.where("topic = 'nowhere'")) == [] and rows(log.where("topic = 'rare' and topic = 'scan'")) == []
    # a chunk that the index rules out is not opened: its bytes may be spoilt
    (c, chunks), own = bag.read_index(f"{path}/2.bag"), f"{path}/2.bag"
    raw = bytearray(open(own, "rb").read())
    raw[chunks[0].at + 40 : chunks[0].at + 200] = b"\xff" * 160
    open(own, "wb").write(raw)
    assert len(rows(log.where("topic = 'rare'"))) == sum(m[0] == "rare" for m in messages)


def test_messages_are_decoded_by_their_definition(spark, folder):
    path, messages = folder
    found = rows(bag.decoded(bag.read_log(spark, path).where("topic = 'rare'"), SCAN))
    assert found
    for r in found:
        m = r["message"]
        k = m["header"]["seq"]
        assert m["header"] == {"seq": k, "stamp": (100 + k) * 10**9 + 5, "frame_id": f"frame{k}"} and m["step"] == 0.5 and m["ranges"] == [float(x) for x in range(k % 3)]
        assert bytes(m["colour"]) == bytes([1, 2, k % 256]) and m["points"] == [{"x": k, "y": -k}] and m["names"] == ["a", ""] and m["on"] == (k % 2 == 0) and m["age"] == 2 * 10**9 + 7


def test_what_is_no_closed_bag_raises(tmp_path):
    (tmp_path / "a.bag").write_bytes(b"#ROSBAG V1.2\n" + b" " * 5000)
    with pytest.raises(ValueError, match="no bag"):
        bag.read_index(str(tmp_path / "a.bag"))
    (tmp_path / "b.bag").write_bytes(next(bag.bag_bytes(iter([("t", "x", 1, b"")]), {})))
    with pytest.raises(ValueError, match="not closed"):
        bag.read_index(str(tmp_path / "b.bag"))
    with pytest.raises(ValueError, match="definition"):
        bag.spark_type(bag.parse_definition("Unknown x"), "Unknown")


def put(folder, name, messages):
    pieces = list(bag.bag_bytes(iter(messages), {}, "none", 300))
    (folder / f".{name}").write_bytes(pieces[-1] + b"".join(pieces[1:-1]))
    (folder / f".{name}").rename(folder / name)


def test_a_subscription_goes_on_where_it_was(spark, tmp_path):
    came, seen = tmp_path / "in", {"all": [], "newest": []}
    came.mkdir()
    sent = [(("a", "b", "c")[i % 3], "t", 10**9 * i + 3, str(i).encode()) for i in range(120)]

    def run(kind):
        stream = bag.subscribe(spark, str(came), ["a", "b"], kind == "newest")
        keep = lambda df, _: seen[kind].append(rows((bag.conflated(df) if kind == "newest" else df).select("topic", "time_ns", "data")))
        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / kind)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    for k in range(3):
        put(came, f"{k}0.bag", sent[40 * k : 40 * k + 30])
        put(came, f"{k}1.bag", sent[40 * k + 30 : 40 * k + 40])
        for kind in seen:
            run(kind)
        run("all")  # nothing new: nothing comes again
    got = sorted((r["topic"], r["time_ns"], bytes(r["data"])) for batch in seen["all"] for r in batch)
    assert got == sorted((t, w, d) for t, _, w, d in sent if t != "c")
    newest = [sorted((r["topic"], r["time_ns"]) for r in batch) for batch in seen["newest"] if batch]
    assert newest == [sorted((t, max(w for u, _, w, _ in sent[40 * k : 40 * k + 40] if u == t)) for t in "ab") for k in range(3)]
