import base64
import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import common, warc


def pages_table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    made = [(i, f"http://host{i % 7}.org/p/{i}", "<html>é " + " ".join(rng.choices(words, k=rng.randint(5, 400))) + "</html>") for i in range(300)]
    made += [(1000 + i, "http://copy.org/", made[5][2]) for i in range(120)]
    made += [(2000, None, "null url"), (2001, "bad\r\nurl x", "line\r\n\r\nbreaks WARC/1.1"), (2002, "u", None), (2003, "u", ""), (2004, "big", "x" * 3_000_000), (None, "n", "no id")]
    return made


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def written(spark, table, **options):
    root = common.fresh_path(spark, "warc")
    manifest = warc.write_archives(warc.label_copies(table), root, **options)
    return root, manifest


def test_round_trip(spark, rows):
    root, manifest = written(spark, pages_table(spark, rows), archive_bytes=200_000, sample_bytes=50_000)
    assert manifest.count() > 3
    assert manifest.agg(F.sum("n_records")).first()[0] == len(rows)
    got = {r["page_id"]: r for r in warc.read_archives(spark, root).collect()}
    last = {}
    for i, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), i if i is not None else -1)
    for i, url, html in rows:
        r, payload = got[i], (html or "").encode()
        winner = last[html or ""]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), digest(html))
        if i is None or winner == i:
            assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, payload)
        else:
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", winner, None)
        assert r["url"] == (None if url is None else warc._uri(url))
    assert got[1119]["record_type"] == "response"
    assert got[5]["refers_to"] == 1119


def test_small_payloads_are_never_revisits(spark):
    table = pages_table(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")])
    labels = {r["page_id"]: r["refers_to"] for r in warc.label_copies(table, min_revisit_bytes=3).collect()}
    assert labels == {1: None, 2: None, 3: 4, 4: None}


def test_the_dictionary_leads_and_records_stand_alone(spark, rows):
    import zstandard

    root, manifest = written(spark, pages_table(spark, rows[:300]).coalesce(1), sample_bytes=200_000)
    (path,) = [r["archive"] for r in manifest.collect()]
    with open(path, "rb") as f:
        data = f.read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.DICTIONARY_MAGIC
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj()
    assert d.decompress(data[8 + size :]).startswith(b"WARC/1.1\r\n")
    # One frame is one record, and without the dictionary it is none.
    assert d.eof and len(d.unused_data) > 0
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompressobj().decompress(data[8 + size :])
    plain = sum(len(warc.build_record(i, u, h.encode(), digest(h), None, len(h.encode()), "d")) for i, u, h in rows[:300])
    assert len(data) < plain / 2


def test_odd_tables(spark):
    root, manifest = written(spark, pages_table(spark, []))
    assert manifest.count() == 0
    assert warc.read_archives(spark, root).count() == 0
    again = pages_table(spark, [(7, "u", "same"), (7, "u", "same")]).withColumns({"digest": F.lit("x"), "winner": F.lit(1), "payload": F.lit(2)})
    root, _ = written(spark, again)
    assert [r["record_type"] for r in warc.read_archives(spark, root).collect()] == ["response", "response"]


def records_of(manifest):
    for r in manifest.collect():
        with open(r["archive"], "rb") as f:
            yield r["archive"], list(warc.read_records(f))


def test_record_ids_are_unique_and_revisits_name_them(spark, rows):
    table = pages_table(spark, [*rows, *rows[:3], (None, "n", "no id"), (None, "n", "no id"), (7000, "u", rows[7][2]), (7000, "v", rows[7][2]), (8, "other payload", "of an id that repeats")])
    _, manifest = written(spark, table, archive_bytes=100_000, sample_bytes=20_000)
    headers = [h for _, found in records_of(manifest) for h, _ in found]
    ids = [h["warc-record-id"] for h in headers]
    assert len(set(ids)) == len(ids) == len(rows) + 8
    by_id = {h["warc-record-id"]: h for h in headers}
    named = [h for h in headers if "warc-refers-to" in h]
    assert len(named) > 100
    for h in named:
        target = by_id[h["warc-refers-to"]]
        assert (target["warc-type"], target["x-page-id"], target["warc-payload-digest"]) == ("response", h["x-refers-to-page-id"], h["warc-payload-digest"])


def test_every_archive_has_a_dictionary(spark, rows):
    for few in (rows[:1], rows[:5], [(i, "u", "same " * 5) for i in range(40)], [(1, "u", "y" * 400_000)]):
        root, manifest = written(spark, pages_table(spark, few))
        for r in manifest.collect():
            with open(r["archive"], "rb") as f:
                assert struct.unpack("<I", f.read(4))[0] == warc.DICTIONARY_MAGIC
        assert sorted((r["page_id"], r["payload_digest"]) for r in warc.read_archives(spark, root).collect()) == sorted((i, digest(t)) for i, _, t in few)


def test_damage_raises(spark, tmp_path):
    import io

    record = warc.build_record(1, "u", b"payload", digest("payload"), None, 7, "d")
    import zstandard

    data = zstandard.ZstdCompressor().compress(record)
    assert len(list(warc.read_records(io.BytesIO(data)))) == 1
    cut = zstandard.ZstdCompressor().compress(record[:-6])
    with pytest.raises(ValueError, match="cut short"):
        list(warc.read_records(io.BytesIO(cut)))
    headers, block = next(warc.read_records(io.BytesIO(data)))
    with pytest.raises(ValueError, match="digest"):
        warc._parse(headers, block[:-1] + b"X")
