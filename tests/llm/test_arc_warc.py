import base64
import gzip
import hashlib
import io
import random

import pytest

from logquarry.llm.archives import (
    arc_header,
    arcs_to_warcs,
    converted_pages,
    index_arcs,
    iso_date,
    opened,
    read_arc,
    read_warc,
    unzipped,
    version_block,
    warc_records,
)


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http(body, *fields):
    return b"HTTP/1.0 200 OK\r\n" + b"".join(f + b"\r\n" for f in fields) + b"\r\n" + body


def arc(version, records, eol=b"\n"):
    out = version_block("old.arc", version, "19990101000000")
    for url, date, mime, block in records:
        fields = {"ip": "1.2.3.4", "result": 200, "checksum": "-", "location": "-", "offset": 0, "file": "old.arc"}
        header = arc_header(version, url="U", date=date, mime=mime, length=len(block), **fields)
        out += header.replace(b"U ", url.encode() + b" ", 1) + block + eol
    return out


RECORDS = [
    ("http://a/x y", "20010203040506", "text/html", http(b"same \x00\xff bytes\n\nURL 1 2 3 4\n")),
    ("dns:a", "20010203", "text/dns", b"20010203\na. 60 IN A 1.2.3.4\n"),
    ("http://b/", "19991231235959", "text/html", http(b"same \x00\xff bytes\n\nURL 1 2 3 4\n", b"Server: z")),
    ("http://c/", "20020101000000", "text/plain", http(b"")),
    ("http://d/", "20020101000001", "text/plain", http(b"")),
]


@pytest.mark.parametrize("version", [1, 2])
def test_records_by_declared_length(version):
    found = list(read_arc(io.BytesIO(arc(version, RECORDS))))
    assert [r.number for r in found] == list(range(6))
    assert [(r.fields["url"], r.fields["date"], r.fields["mime"], r.block) for r in found[1:]] == RECORDS
    packed = gzip.compress(arc(version, RECORDS[:2])) + gzip.compress(b"")
    assert len(list(read_arc(unzipped(io.BytesIO(packed))))) == 3


def test_broken_files_are_told():
    data = arc(1, RECORDS)
    with pytest.raises(ValueError, match="declared length"):
        list(read_arc(io.BytesIO(data[:-5])))
    with pytest.raises(ValueError, match="header"):
        list(read_arc(io.BytesIO(arc(1, RECORDS[:1]) + b"nonsense\n")))
    with pytest.raises(ValueError, match="version 3"):
        list(read_arc(io.BytesIO(data.replace(b"1 0 logquarry", b"3 0 logquarry", 1))))


def test_dates():
    assert iso_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert iso_date("2001020304") == "2001-02-03T04:00:00Z"
    assert iso_date("2001") == "2001-01-01T00:00:00Z"


def test_conversion(spark, tmp_path):
    paths = []
    for version in (1, 2):
        for suffix, pack in ((".arc", bytes), (".arc.gz", gzip.compress)):
            paths.append(f"{tmp_path}/v{version}{suffix}")
            with open(paths[-1], "wb") as file:
                file.write(pack(arc(version, RECORDS)))
    arcs = spark.createDataFrame([(p,) for p in paths], "path string")
    assert index_arcs(arcs).count() == 16
    warcs = arcs_to_warcs(arcs, revisit_bytes=1)
    assert warcs.count() == 4
    kinds = {}
    for (path,) in warcs.collect():
        with opened(path) as stream:
            records = list(read_warc(unzipped(stream)))
        assert len(records) == 6 and records[0][0]["warc-type"] == "warcinfo"
        for (fields, block), (url, date, _, original) in zip(records[1:], RECORDS, strict=True):
            assert fields["warc-target-uri"] == url and fields["warc-date"] == iso_date(date)
            kinds.setdefault(url, []).append(fields["warc-type"])
            if fields["warc-type"] != "revisit":
                assert block == original and fields["warc-block-digest"] == f"sha1:{sha(original)}"
            else:
                assert original.startswith(block) and fields["warc-refers-to-target-uri"] == "http://b/"
                assert fields["warc-refers-to-date"] == "1999-12-31T23:59:59Z"
    assert kinds["dns:a"] == ["resource"] * 4 and kinds["http://c/"] == kinds["http://d/"] == ["response"] * 4
    assert sorted(kinds["http://b/"]) == ["response"] + ["revisit"] * 3 and kinds["http://a/x y"] == ["revisit"] * 4
    read = warc_records(warcs).collect()
    ids = {r.record_id for r in read if r.record_type == "response"}
    assert len(ids) == 9 and all(r.refers_to_id in ids for r in read if r.record_type == "revisit")
    assert {r.payload_digest for r in read} == {sha(b""), sha(b"same \x00\xff bytes\n\nURL 1 2 3 4\n")}
    again = arcs_to_warcs(arcs, revisit_bytes=1)
    assert {r.record_id for r in warc_records(again).collect()} == {r.record_id for r in read}


def plain(rows):
    first, out = {}, []
    for i, _, html in sorted(rows):
        body = (html or "").encode()
        seen = first.setdefault(body, i)
        out.append((i, len(body), sha(body), "response" if seen == i else "revisit", None if seen == i else seen))
    return out


def test_pages(spark):
    rng = random.Random(13)
    bodies = [None, "", "x", "é\r\n\r\nHTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n", "long " * 200_000, "\x00\x01", "<p>"]
    urls = [None, "http://a/ b\n", "http://c/é?x=1#y", "", "http://d/"]
    rows = [(i - 20, rng.choice(urls), rng.choice(bodies) if i % 3 else "hot") for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df = df.selectExpr("*", "1 as path", "2 as number", "3 as digest", "4 as first", "5 as key").repartition(5)
    assert sorted(tuple(r)[:5] for r in converted_pages(df).collect()) == plain(rows)
    odd = [(None, "u", "x"), (1, "u", "x"), (1, "u", "x")]
    got = converted_pages(spark.createDataFrame(odd, "page_id long, url string, html string")).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=repr) == [
        (1, "response", None), (1, "revisit", 1), (None, "revisit", 1)
    ]
    assert converted_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_ids_of_other_types(spark):
    ids = ["b", "a", "", " x: y\r\n", "é%41", "10", "9", None]
    rows = [(i, f"http://h/{n}", "same" if n % 2 else f"own {n}") for n, i in enumerate(ids)]
    got = converted_pages(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert {(r.page_id, r.url) for r in got} == {(i, url) for i, url, _ in rows}
    # Compared as strings: the smallest of the odd places is the response.
    least = min(i for n, i in enumerate(ids) if n % 2 and i is not None)
    assert {r.page_id for r in got if r.record_type == "response"} == {*ids[::2], least}
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {least}
    dates = converted_pages(spark.sql("SELECT DATE'2024-01-02' AS page_id, 'u' AS url, 'h' AS html"))
    assert [str(r.page_id) for r in dates.collect()] == ["2024-01-02"] and dates.schema["page_id"].dataType.simpleString() == "date"
