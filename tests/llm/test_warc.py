import base64
import bisect
import hashlib
import random

import pytest
from quillmark.llm.warc import cut_points, filesystem, read_manifest, read_warc, write_warc

PAGES = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://c/ x\r\ny", None), (4, "http://d", ""), (5, "u", "é" * 5000), (5, "u", "é" * 5000), (None, "n", "same"), (9, "z", "other"), (0, "q", "last")]


def want(rows, least=0):
    out = []
    groups = {}
    for p, u, h in rows:
        groups.setdefault(h or "", []).append(p)
    seen = set()
    for p, u, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (h or "").encode()
        first = min([x for x in groups[h or ""] if x is not None], default=None)
        response = len(body) < least or (p == first and (p, h) not in seen)
        seen.add((p, h))
        out.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else first))
    return sorted(out, key=str)


def got(spark, folder):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_warc(spark, folder).collect()], key=str)


def test_round_trip(spark):
    frame = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    folder = write_warc(frame)
    assert got(spark, folder) == want(PAGES)
    payloads = {r.page_id: r.payload for r in read_warc(spark, folder).collect() if r.payload is not None}
    assert bytes(payloads[5]).decode() == "é" * 5000


def test_shorter_payloads_are_all_responses(spark):
    frame = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    assert got(spark, write_warc(frame, min_revisit_bytes=5)) == want(PAGES, 5)


def test_files_are_the_same_whatever_the_partitions(spark):
    rows = [(i, f"http://h/{i}", "x" * (i % 50) * 100) for i in range(300)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    one = write_warc(frame.repartition(3), shard_bytes=100_000, roll_bytes=4000)
    two = write_warc(frame.repartition(7), shard_bytes=100_000, roll_bytes=4000)
    assert read_manifest(one) == read_manifest(two) and len(read_manifest(one)) > 5
    fs, path = filesystem(one)
    for f in read_manifest(one):
        with fs.open_input_stream(f"{path}/{f['file']}", compression=None) as s:
            assert hashlib.sha1(s.read()).hexdigest() == f["sha1"]
    ids = [r.page_id for r in read_warc(spark, one).collect()]
    assert sorted(ids) == list(range(300))


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert read_warc(spark, write_warc(empty)).count() == 0
    more = spark.createDataFrame([(1, "u", "h", 4, "s")], "page_id bigint, url string, html string, id int, sha1 string")
    assert got(spark, write_warc(more)) == want([(1, "u", "h")])


def test_cuts_of_skewed_ids_are_exact_and_few_jobs(spark):
    rng = random.Random(1)
    ids = sorted({rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(200)} | {10**12 + k for k in range(400)} | {-(1 << 63), (1 << 63) - 1})
    rows = [(i, None, "x" * rng.randint(0, 40)) for i in ids]
    frame = spark.createDataFrame([(i, len(t)) for i, _, t in rows], "id bigint, bytes bigint")
    cuts = cut_points(frame, "id", "bytes", 300, bins=8)
    shards = {}
    for i, _, t in rows:
        shards[bisect.bisect_right(cuts, i)] = shards.get(bisect.bisect_right(cuts, i), 0) + len(t)
    assert len(cuts) > 20 and cuts == sorted(set(cuts)) and max(shards.values()) <= 300
    assert got(spark, write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string"), shard_bytes=300)) == want(rows)


def test_files_roll_without_options(spark):
    rng = random.Random(2)
    rows = [(i, "u", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=200_000))) for i in range(40)]
    files = read_manifest(write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string")))
    assert [f["file"] for f in files] == ["part-00000-00000.warc.gz", "part-00000-00001.warc.gz", "part-00000-00002.warc.gz"]


def test_ids_must_be_integers(spark):
    with pytest.raises(ValueError):
        write_warc(spark.createDataFrame([("a", "u", "h")], "page_id string, url string, html string"))
