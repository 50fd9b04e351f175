import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from quillmark.llm.shards import assign_shards, hilbert_index, write_shards

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_curve_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = np.arange(1 << bits)
        grid = np.stack(np.meshgrid(*[side] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = hilbert_index(grid, bits)
        assert sorted(place) == list(range(len(grid)))
        path = grid[np.argsort(place)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def rows(n):
    return [(i, None if i % 11 == 0 else f"é{i % 7}" * (i % 90), ["en", "de", None][i % 3], "hot" if i % 3 else f"s{i % 5}", i % 90 * 3) for i in range(n)]


def check(spark, data, shards=16):
    got = assign_shards(spark.createDataFrame(data, SCHEMA).repartition(3), shards).collect()
    text = Counter((d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in data)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == text
    count = Counter(r.shard for r in got)
    assert max(count.values(), default=0) - min((count[s] for s in range(shards)), default=0) <= 1
    for s in count:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.cell for r in order] == sorted(r.cell for r in got)
    return sorted(map(str, got))


def test_law_of_rows(spark):
    for n in (0, 1, 15, 16, 17, 700):
        check(spark, rows(n))
    assert check(spark, rows(300)) == check(spark, rows(300)[::-1])


def test_repeated_rows_nulls_and_one_hot_cell(spark):
    check(spark, [(7, "same", "en", "s", 4)] * 50 + [(None, None, None, None, None)] * 5)


def test_hot_cell_over_many_buckets(spark):
    frame = spark.createDataFrame([(i, "t", "en", "s", 4) for i in range(500)], SCHEMA)
    got = assign_shards(frame, 7, rows_per_bucket=16).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(7) for k in range(71 + (s < 3))]


def test_missing_dimensions_and_clashing_names(spark):
    frame = spark.createDataFrame([(1, "a", 9, 8)], "doc_id bigint, text string, Shard int, offset int")
    row = assign_shards(frame).first()
    assert (row.shard, row.slot) == (0, 0)


def test_files_hold_runs_of_the_curve_and_filters_meet_few(spark, tmp_path):
    rng = random.Random(4)
    data = [(i, "x", rng.choice(["de", "en", "es", "fr"]), f"site{rng.randint(0, 19):02d}", int(2 ** rng.uniform(3, 14))) for i in range(4000)]
    bounds = write_shards(spark.createDataFrame(data, SCHEMA), f"file://{tmp_path}/out", 16).collect()
    assert sorted(r.rows for r in bounds) == [250] * 16
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == 4000
    inside = {s: [r for r in back.where(F.col("shard") == s).collect()] for s in range(16)}
    for r in bounds:
        assert (r.min_source, r.max_source) == (min(x.source for x in inside[r.shard]), max(x.source for x in inside[r.shard]))
    meets = lambda c, value: sum(r[f"min_{c}"] <= value <= r[f"max_{c}"] for r in bounds)
    assert sum(meets("source", f"site{k:02d}") for k in range(20)) / 20 <= 9
    assert sum(meets("n_chars", 2**k) for k in range(3, 14)) / 11 <= 9
    both = sum(r.min_source <= "site03" <= r.max_source and r.min_n_chars <= 40 <= r.max_n_chars for r in bounds)
    assert 1 <= both <= 6
