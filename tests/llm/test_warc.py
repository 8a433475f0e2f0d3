"""Archives against what was written, to the byte whatever the partitions are; damage and broken runs are noticed."""

import gzip
import hashlib
import os

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from brindle.llm import warc

from .conftest import sf


def expected(rows, least=1000):
    """(id, payload bytes, digest, type, refers to) of [(id, url, html)], sorted; one response for each payload of ``least`` bytes or more."""
    data = [(i, (h or "").encode()) for i, _, h in rows]
    top, left = {}, {}
    low = lambda i: (i is not None, i or 0)
    for i, p in data:
        if p not in top or low(i) > low(top[p]):
            top[p] = i
    out = []
    for i, p in data:
        sha = hashlib.sha1(p).hexdigest()
        if len(p) < least or (i == top[p] and not left.setdefault(p, 0)):
            left[p] = 1
            out.append((i, len(p), sha, "response", None))
        else:
            out.append((i, len(p), sha, "revisit", top[p]))
    return sorted(out, key=KEY)


KEY = lambda r: tuple(str(x) for x in r)


def digests(records):
    return sorted((tuple(r) for r in records.select("id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=KEY)


def test_query_equals_plain_version(spark):
    pages = [(p.page_id, p.url, p.html) for p in spark.read.parquet(f"{sf('sf0.01')}/pages.parquet").collect()]
    got = sorted((tuple(r) for r in warc.op11_sharded_warc(spark, sf("sf0.01")).collect()), key=KEY)
    assert got == expected(pages)


LONG = "x" * 1200
ROWS = [
    (5, "http://a/", LONG),
    (9, "http://b/", LONG),
    (9, "http://b/", LONG),
    (7, "http://c d\r\nX: y\x00\x7f/é", LONG + "é\U0001f600\r\n\r\nWARC/1.1\r\n"),
    (1, None, LONG),
    (None, "http://n/", LONG),
    (None, "", "null id"),
    (2, "http://e/", None),
    (3, "http://e/", ""),
    (4, "http://s/", "short"),
    (4, "http://s/", "short"),
    (6, "http://t/", "y" * 999),
    (8, "http://t/", "y" * 999),
    (10, "http://u/", "y" * 1000),
    (11, "http://u/", "y" * 1000),
    (12, "http://big/", "<p>word</p>" * 300_000),
    (None, "http://o/", "z" * 2000),
    (None, "http://o/", "z" * 2000),
]
SCHEMA = "page_id long, url string, html string, row int, payload string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, 1, "p") for r in ROWS], SCHEMA)


def test_awkward_pages_come_back(spark, pages, tmp_path):
    store = f"{tmp_path}/a"
    warc.write(pages, store, file_bytes=300, shard_bytes=4000)
    records = warc.read(spark, store)
    warc.verify(records)
    assert digests(records) == expected(ROWS)
    back = warc.pages(spark, store).collect()
    assert sorted(((r.id, r.url, bytes(r.payload).decode()) for r in back), key=KEY) == sorted(((i, u, h or "") for i, u, h in ROWS), key=KEY)
    files = sorted(f for f in os.listdir(store) if f.endswith(".gz"))
    assert len(files) > 5 and not os.path.exists(f"{store}/_temporary") and not os.path.exists(f"{store}/_manifest")
    assert {r.file for r in spark.read.parquet(f"{store}/manifest").collect()} == set(files)
    with pytest.raises(ValueError):
        warc.write(pages, store)


def contents(store):
    return {f: open(f"{store}/{f}", "rb").read() for f in os.listdir(store) if f.endswith(".gz")}


def test_same_bytes_whatever_the_partitions(spark, tmp_path):
    table = spark.read.parquet(f"{sf('sf0.01')}/pages.parquet")
    table = table.unionByName(table.withColumn("page_id", F.col("page_id") + 1000)).unionByName(table.where("page_id < 9"))
    found = []
    for k, df in enumerate([table.coalesce(1), table.repartition(7), table.orderBy(F.rand(3)).repartition(3)]):
        spark.conf.set("spark.sql.shuffle.partitions", 3 + 2 * k)
        try:
            warc.write(df, f"{tmp_path}/{k}", file_bytes=20_000, shard_bytes=150_000)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        found.append(contents(f"{tmp_path}/{k}"))
    assert found[0] == found[1] == found[2] and len(found[0]) > 10
    assert max(map(len, found[0].values())) < 20_000 + 30_000


def test_each_record_is_a_member_and_files_are_in_order(spark, tmp_path):
    table = spark.read.parquet(f"{sf('sf0.01')}/pages.parquet")
    warc.write(table, f"{tmp_path}/a", file_bytes=5_000, shard_bytes=100_000)
    ids = []
    for name, data in sorted(contents(f"{tmp_path}/a").items()):
        parsed = [h for m in warc.members(iter([data])) for h, _ in warc.parse(m)]
        assert len(list(warc.members(iter([data])))) == len(parsed) and parsed[0]["warc-filename"] == name
        assert b"".join(warc.members(iter([data]))) == gzip.decompress(data)
        ids += [int(h["x-page-id"]) for h in parsed[1:]]
    assert ids == sorted(r.page_id for r in table.collect())


def damage(path, old, new):
    data = gzip.decompress(open(path, "rb").read())
    assert old in data
    open(path, "wb").write(gzip.compress(data.replace(old, new, 1)))


def test_damage_is_noticed(spark, pages, tmp_path):
    for k, (old, new) in enumerate([(b"short", b"shirt"), (b"X-Page-Id: 4", b"X-Page-Id: 3")]):
        store = f"{tmp_path}/{k}"
        warc.write(pages, store)
        damage(f"{store}/part-00000-00000.warc.gz", old, new)
        with pytest.raises(PythonException):
            warc.read(spark, store).collect()
    with pytest.raises(PythonException):
        path = f"{store}/part-00000-00000.warc.gz"
        data = open(path, "rb").read()
        open(path, "wb").write(data[:-9])
        warc.read(spark, store).collect()


def test_a_broken_run_leaves_no_archive_and_a_commit_can_be_repeated(spark, pages, tmp_path, monkeypatch):
    store = f"{tmp_path}/a"
    with monkeypatch.context() as m:
        m.setattr(warc, "_commit", lambda *a: None)
        warc.write(pages, store)
    assert not os.path.exists(f"{store}/manifest") and os.listdir(f"{store}/_temporary")
    stray = open(f"{store}/_temporary/0-part-00000-00000.warc.gz", "wb")
    stray.write(b"what a lost attempt has left")
    stray.close()
    # One file has its name already.
    first = spark.read.parquet(f"{store}/_manifest").first()
    os.rename(f"{store}/{first.temporary}", f"{store}/{first.file}")
    warc._commit(spark, store)
    assert digests(warc.read(spark, store)) == expected(ROWS)


def test_verify_misses_no_response(spark, pages, tmp_path):
    warc.write(pages, f"{tmp_path}/a")
    records = warc.read(spark, f"{tmp_path}/a", payload=False)
    warc.verify(records)
    with pytest.raises(ValueError):
        warc.verify(records.where("id is null or id <> 9"))
    with pytest.raises(ValueError):
        warc.verify(records.unionByName(records.where("id = 3")))


def test_a_third_of_all_pages_equal_and_ids_of_text(spark, tmp_path):
    rows = [(f"p/{i:04d} é", "http://u", "same " * 300 if i % 3 == 0 else f"page {i} " * 150) for i in range(600)]
    warc.write(spark.createDataFrame(rows, "page_id string, url string, html string"), f"{tmp_path}/a", shard_bytes=20_000)
    records = warc.read(spark, f"{tmp_path}/a", payload=False)
    warc.verify(records)
    kinds = {r.record_type: r["count"] for r in records.groupBy("record_type").count().collect()}
    assert kinds == {"response": 401, "revisit": 199}
    assert {r.refers_to for r in records.where("record_type = 'revisit'").collect()} == {"p/0597 é"}


def test_empty_table(spark, pages, tmp_path):
    warc.write(pages.limit(0), f"{tmp_path}/a")
    assert warc.read(spark, f"{tmp_path}/a").count() == 0 and not contents(f"{tmp_path}/a")
