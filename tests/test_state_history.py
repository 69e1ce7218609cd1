"""Bucketed state (what a commit writes, crashes, replays) and the indexed history (what a batch reads, compaction)."""

import json

import pytest
from pyspark.sql import functions as F

from jobsmith.session import work_path
from jobsmith.sources import key_index
from jobsmith.sources import state as st
from jobsmith.sources.folders import list_names, read_text
from jobsmith.streaming import history as hi

POST = "url string, ordinal long, description string, posted_date string"
DETAIL = "canonical_url string, ordinal long, description string, posted_date string, status string"
FIELDS = ["description", "posted_date"]


def posts(spark, *rows):
    return spark.createDataFrame([(u, n, d, "") for u, n, d in rows], POST)


def run(spark, base, batch_id, *rows, details=(), **kw):
    return hi.enrich_batch(posts(spark, *rows), batch_id, base, spark.createDataFrame(list(details), DETAIL), FIELDS, "url", "ordinal", **kw)


def content(df):
    return [(r["url"], r["description"]) for r in df.orderBy("version", "origin", "ordinal").collect()]


def test_state_keeps_its_order(spark):
    base = work_path(spark, "st-order")
    with pytest.raises(RuntimeError):
        run(spark, base, 0, ("a", 1, "d"))
    hi.seed_state(posts(spark, ("a", 10**16, "d")), base, FIELDS)  # ordinals of any size
    with pytest.raises(FileExistsError):
        hi.seed_state(posts(spark, ("a", 1, "d")), base, FIELDS)
    for bid, (url, n) in enumerate([("z", 900), ("y", 5), ("x", 7)]):
        run(spark, base, bid, (url, n, "d"))
    assert [u for u, _ in content(st.read_state(spark, base))] == ["a", "z", "y", "x"]


def test_a_batch_writes_its_buckets_only(spark):
    base = work_path(spark, "st-cow")
    seed = [(f"u{i}", i, "text " * 5) for i in range(2000)]
    first = hi.seed_state(posts(spark, *seed), base, FIELDS, buckets=50)
    assert first.rows_written == 2000 and first.touched == 50
    sizes = {r["b"]: r["count"] for r in posts(spark, *seed).groupBy(st.bucket_of("url", 50).alias("b")).count().collect()}
    one = run(spark, base, 0, ("u7", 1, "new"))
    bucket = st.touched_buckets(posts(spark, ("u7", 1, "")), first)
    assert one.touched == 1 and one.rows_written == sizes[bucket[0]] < 100
    # every other bucket is the folder it was
    assert {b: f for b, f in one.folders.items() if b != bucket[0]} == {b: f for b, f in first.folders.items() if b != bucket[0]}
    more = run(spark, base, 1, *[(f"u{i}", i, "new") for i in range(3)], ("fresh", 9, "new"))
    touched = st.touched_buckets(posts(spark, *[(f"u{i}", i, "") for i in range(3)], ("fresh", 9, "")), first)
    assert more.rows_written == sum(sizes.get(b, 0) for b in touched) + 1
    got = dict(content(st.read_state(spark, base)))
    assert len(got) == 2001 and [got[k] for k in ("u7", "u0", "fresh", "u9")] == ["new", "new", "new", "text " * 5]


def test_replays_crashes_and_old_versions(spark, monkeypatch):
    base = work_path(spark, "st-crash")
    hi.seed_state(posts(spark, ("a", 1, "old"), ("b", 2, "old")), base, FIELDS, buckets=4)
    done = run(spark, base, 0, ("a", 1, "one"))
    assert run(spark, base, 0, ("a", 1, "one")) == done  # replayed after its commit

    def crash(*args):
        raise OSError("gone")

    with monkeypatch.context() as m:  # between data and manifest
        m.setattr(st, "write_new", crash)
        with pytest.raises(OSError):
            run(spark, base, 1, ("a", 1, "two"))
    assert content(st.read_state(spark, base)) == [("a", "one"), ("b", "old")]
    run(spark, base, 1, ("a", 1, "two"))
    assert content(st.read_state(spark, base)) == [("a", "two"), ("b", "old")]
    assert content(st.read_state(spark, base, version=1)) == [("a", "one"), ("b", "old")]
    # a commit that another one overtook
    stale = st.manifest(spark, base, 1)
    rows = st.read_state(spark, base, 1)
    with pytest.raises(RuntimeError):
        st.commit_state(rows, rows.limit(0), base, stale, ["0"])
    for bid in range(2, 6):
        run(spark, base, bid, ("a", 1, f"v{bid}"))
    assert st.versions(spark, base) == [4, 5, 6]
    with pytest.raises(RuntimeError):
        st.read_state(spark, base, version=1)
    assert content(st.read_state(spark, base, version=4)) == [("a", "v3"), ("b", "old")]
    named = {p for v in (4, 5, 6) for p in st.manifest(spark, base, v).paths()}
    there = {f"data/{c}/{b}" for c in list_names(spark, f"{base}/data") for b in list_names(spark, f"{base}/data/{c}") if b.startswith("bucket=")}
    # what the crash left behind is named by no manifest and harms nobody
    assert named <= there and len(there - named) <= 1


def test_blank_and_null_keys_are_added(spark):
    base = work_path(spark, "st-blank")
    hi.seed_state(posts(spark, ("a", 1, "x"), ("", 2, "short"), (None, 3, "n")), base, FIELDS, buckets=3)
    m = run(spark, base, 0, ("", 5, "b1"), ("", 6, "b2"), (None, 7, "n2"))
    assert m.touched == 0 and m.rows_written == 3
    assert sorted(content(st.read_state(spark, base)), key=str) == sorted(
        [("a", "x"), ("", "short"), (None, "n"), ("", "b1"), ("", "b2"), (None, "n2")], key=str)
    long = "d" * 200
    base = work_path(spark, "st-blank-long")
    hi.seed_state(posts(spark, ("", 2, long), ("", 3, "s")), base, FIELDS, buckets=3)
    assert run(spark, base, 0, ("", 5, "skipped: the first blank row is long")).rows_written == 0


def test_state_equals_one_pass(spark):
    """Batches over buckets give what one enrichment over everything gives."""
    from jobsmith.operators.enrich import enrich_run

    import random
    rng = random.Random(3)
    base = work_path(spark, "st-one")
    state = [(f"k{i % 12}", i, "s" * rng.choice([3, 150])) for i in range(20)] + [("", 50, "b")]
    arriving = [(rng.choice([f"k{rng.randrange(25)}", "", None]), 100 + i, "p" * rng.choice([0, 5, 150])) for i in range(60)]
    details = [(f"k{i}", i, "d" * 120, "today", rng.choice(["success", "failed"])) for i in range(25)]
    hi.seed_state(posts(spark, *state), base, FIELDS, buckets=5)
    for bid in range(4):
        run(spark, base, bid, *arriving[bid * 15:bid * 15 + 15], details=details)
    whole, _ = enrich_run(posts(spark, *arriving), posts(spark, *state), spark.createDataFrame(details, DETAIL), FIELDS, "url", "ordinal")
    key = lambda r: (r["url"] or "", r["url"] is None, r["ordinal"], r["description"], r["posted_date"])
    assert sorted(map(key, st.read_state(spark, base).collect())) == sorted(map(key, whole.collect()))


HIST = "ordinal long, url string, title string"


def batch(spark, *urls):
    return spark.createDataFrame([(i, u, f"t{u}") for i, u in enumerate(urls)], HIST)


def seen(spark, path):
    return sorted((r["url"], r["run_id"], r["batch_id"]) for r in hi.read_history(spark, path, None).collect())


def test_unseen_keys_read_no_history(spark):
    path = work_path(spark, "hi-index")
    assert hi.history_batch(batch(spark, *[f"a{i}" for i in range(500)]), 0, path, "url", "ordinal", run_id="r") == []
    assert hi.history_batch(batch(spark, *[f"b{i}" for i in range(500)]), 1, path, "url", "ordinal", run_id="r") == []
    assert hi.history_batch(batch(spark, "c1", "c2", "c1"), 2, path, "url", "ordinal", run_id="r") == []
    # a key that is known leads to the partition that holds it, and to no other
    assert hi.history_batch(batch(spark, "b7", "d1"), 3, path, "url", "ordinal", run_id="r") == ["run_id=r/batch_id=1"]
    assert [x for x in seen(spark, path) if x[0] in ("b7", "d1", "c1")] == [("b7", "r", 1), ("c1", "r", 2), ("d1", "r", 3)]


def test_partitions_without_an_index_are_read(spark):
    path = work_path(spark, "hi-none")
    hi.history_batch(batch(spark, "u1"), 0, path, "url", "ordinal")
    from jobsmith.sources.folders import delete
    delete(spark, f"{path}/_index/run_id=run/batch_id=0")
    assert hi.history_batch(batch(spark, "u2"), 1, path, "url", "ordinal") == ["run_id=run/batch_id=0"]


def test_compaction_changes_nothing(spark):
    path = work_path(spark, "hi-compact")
    for bid, urls in enumerate([("u1", "u2"), ("u2", "u3"), ("u4",), ()]):
        hi.history_batch(batch(spark, *urls), bid, path, "url", "ordinal", run_id="007", first_seen="t")
    before = seen(spark, path)
    assert [x[0] for x in before] == ["u1", "u2", "u3", "u4"]
    name = hi.compact_history(spark, path, "url")
    assert hi.history_parts(spark, path) == [name]
    assert [x[0] for x in seen(spark, path)] == [x[0] for x in before] and [x[2] for x in seen(spark, path)] == [x[2] for x in before]
    # replays find their rows in the snapshot
    hi.history_batch(batch(spark, "u2", "u3"), 1, path, "url", "ordinal", run_id="007", first_seen="t")
    assert [x[0] for x in seen(spark, path)] == ["u1", "u2", "u3", "u4"]
    assert hi.history_batch(batch(spark, "new"), 9, path, "url", "ordinal", run_id="007") == []
    again = hi.compact_history(spark, path, "url")
    assert again != name and hi.history_parts(spark, path) == [again]
    assert [x[0] for x in seen(spark, path)] == ["new", "u1", "u2", "u3", "u4"]
    assert hi.compact_history(spark, path, "url") is None


def test_compaction_that_crashed(spark, monkeypatch):
    path = work_path(spark, "hi-crash")
    for bid in range(3):
        hi.history_batch(batch(spark, f"u{bid}"), bid, path, "url", "ordinal")
    before = seen(spark, path)
    with monkeypatch.context() as m:
        m.setattr(hi, "move", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            hi.compact_history(spark, path, "url")
    assert seen(spark, path) == before  # nothing counts yet
    with monkeypatch.context() as m:
        m.setattr(hi, "delete", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            hi.finish_compaction(spark, path)
    assert seen(spark, path) == before  # snapshot and old partitions side by side
    hi.finish_compaction(spark, path)
    assert seen(spark, path) == before and len(hi.history_parts(spark, path)) == 1
    assert json.loads(read_text(spark, f"{path}/_replaced/0.json"))["by"] == hi.history_parts(spark, path)[0]


def test_key_index_is_a_filter(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"))
    bits = key_index.filter_bits(3000)
    index = key_index.build(keys, "k", bits).withColumn("part", F.lit("p"))
    assert bits == 65536 and index.count() == 2
    probe = spark.range(0, 9000).select(F.concat(F.lit("k"), "id").alias("k"))
    found = {r["k"] for r in key_index.candidates(probe, "k", index, [bits], ["part"]).collect()}
    known = {f"k{i}" for i in range(3000)}
    assert known <= found and len(found - known) < 60  # no key is missed, few are taken for known
    assert key_index.filter_bits(0) == key_index.SLOT_BITS


def test_f3_joined_rows_are_written_where_they_are(spark, tmp_path):
    """A commit's rows come out of a join on their key: they are not moved by bucket once more, and files are small."""
    import glob

    import pyarrow.parquet as pq
    from jobsmith.sources import state as st
    rows = spark.range(400).selectExpr("concat('u', id) url", "id ordinal").repartition(3, "url")
    for dealt in (False, True):
        at = str(tmp_path / str(dealt))
        folder, n = st._write(rows, at, "url", 4, dealt=dealt)
        files = glob.glob(f"{at}/{folder}/bucket=*/*.parquet")
        assert n == 400 and sum(pq.read_metadata(f).num_rows for f in files) == 400
        assert {pq.read_metadata(f).row_group(0).column(0).compression for f in files} == {"ZSTD"}
        tasks = {f.rsplit("part-", 1)[1][:5] for f in files}
        assert not dealt or (len(files) <= 3 * 4 and len(tasks) <= 3)


def test_f3_details_without_success_do_not_travel(spark):
    from jobsmith.operators.enrich import successful_only
    d = spark.createDataFrame([("a", 1, "t", "p", "success"), ("b", 2, "t", "p", "failed"), ("c", 3, "t", "p", None)],
                              "canonical_url string, ordinal long, description string, posted_date string, status string")
    assert [(r["canonical_url"], r["description"], r["posted_date"]) for r in successful_only(d).orderBy("ordinal").collect()] == [
        ("a", "t", "p"), ("b", None, None), ("c", None, None)]
