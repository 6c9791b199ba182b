"""Folders of legacy archives: both versions, gzipped and plain, foreign header lines, wrong lengths, identifiers."""

import gzip

from pyspark.sql import functions as F

from lineweave.llm import warc

ONE = "filedesc://IA-1.arc 127.0.0.1 19990101000000 text/plain 76\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n"
TWO = b"filedesc://x.arc 0.0.0.0 20050506070809 text/plain 200 - - 0 x.arc 128\n2 0 someone\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
HTTP = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n<html>\n\n\r\nhttp://not/a header 1 2\n\xff\x00</html>"


def _arc1(*records):
    head = ONE.replace(" 76\n", f" {len(ONE.split(chr(10), 1)[1])}\n").encode()
    return head + b"\n" + b"".join(line.encode() + b"\n" + body + b"\n" for line, body in records)


def _line(url, n, ip="1.2.3.4", date="19990203040506", kind="text/html"):
    return f"{url} {ip} {date} {kind} {n}"


def _read(spark, path):
    return sorted(((r["file"].rsplit("/", 1)[-1], r["offset"], r["version"], r["fields"], bytes(r["body"]), r["error"]) for r in warc.read_arcs(spark, str(path)).collect()), key=lambda x: x[:2])


def test_folders_of_both_versions(spark, tmp_path):
    plain = _arc1((_line("http://a.b/c d", len(HTTP)), HTTP), (_line("dns:a.b", 0, kind="text/dns"), b""), (_line("http://long/", 300_000), b"y" * 299_999 + b"\n"))
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "one.arc").write_bytes(plain)
    body = TWO.split(b"\n", 1)[1]
    two = [TWO.replace(b" 128\n", f" {len(body)}\n".encode()) + b"\n", f"http://e/ 1.1.1.1 20050506070809 text/html 404 abc http://f/ 99 x.arc {len(HTTP)}\n".encode() + HTTP + b"\n"]
    (tmp_path / "in" / "deep" / "two.arc.gz").write_bytes(b"".join(map(gzip.compress, two)))  # a gzip member for each record
    (tmp_path / "in" / "empty.arc").write_bytes(b"")
    (tmp_path / "in" / "other.txt").write_bytes(b"no archive")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)  # plain files are read in many blocks
    try:
        got = _read(spark, tmp_path / "in")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [("one.arc", r.offset, 1, r.fields, r.body, None) for r in warc.parse_arc(plain)] + [("two.arc.gz", r.offset, 2, r.fields, r.body, None) for r in warc.parse_arc(b"".join(two))]
    assert got == want and len(got) == 6
    assert got[1][3]["url"] == "http://a.b/c d" and got[1][4] == HTTP and got[2][4] == b""
    assert got[5][3] == {"url": "http://e/", "ip": "1.1.1.1", "date": "20050506070809", "type": "text/html", "status": "404", "checksum": "abc", "location": "http://f/", "offset": "99", "filename": "x.arc", "length": str(len(HTTP))}
    for size in (1, 3, 50):
        reader = warc.ArcReader()
        again = [r for k in range(0, len(plain), size) for r in reader.feed(plain[k : k + size])] + list(reader.close())
        assert again == list(warc.parse_arc(plain))


def test_faults_are_told_and_reading_goes_on(spark, tmp_path):
    good = (_line("http://good/", 5), b"12345")
    cases = {
        "garbage.arc": _arc1(good, ("http://bad/ 1.2.3.4 no length", b"lost\nlost 1 2 3 4 5"), good),
        "declares_more.arc": _arc1((_line("http://more/", 12), b"12345"), good, good),
        "declares_less.arc": _arc1((_line("http://less/", 2), b"12345"), good),
        "truncated.arc": _arc1(good)[:-4],
        "unknown.arc": _arc1(good).replace(b"\n1 0 Alexa", b"\n9 0 Alexa"),
        "headless.arc": f"{good[0]}\n12345\n".encode(),
    }
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    got = {name: [r for r in _read(spark, tmp_path) if r[0] == name] for name in cases}
    told = {name: [(r[3].get("url", "").split(":")[0] if r[3] else None, r[4], r[5] is None) for r in rows][1:] for name, rows in got.items()}
    assert told["garbage.arc"] == [("http", b"12345", True), (None, b"", False), ("http", b"12345", True)]
    assert told["declares_more.arc"][0] == ("http", b"12345\nhttp:/", True) and told["declares_more.arc"][1:] == [(None, b"", False), ("http", b"12345", True)]
    assert told["declares_less.arc"] == [("http", b"12", True), (None, b"", False), ("http", b"12345", True)]
    assert told["truncated.arc"] == [("http", b"12", False)] and "declares 5 bytes" in got["truncated.arc"][1][5]
    assert "unknown ARC version 9" in got["unknown.arc"][0][5] and told["unknown.arc"] == [(None, b"", False)]
    assert [(r[3], "unknown" in r[5]) for r in got["headless.arc"]] == [({}, True)]


def test_converted_folder_has_a_record_for_each(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.arc", "b.arc"):
        (tmp_path / "in" / name).write_bytes(_arc1((_line("http://x/", len(HTTP)), HTTP), (_line("dns:x", 3), b"abc"))[:-2])
    faults = warc.convert_arcs(warc.read_arcs(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    assert faults.where(F.col("error").contains("declares 3")).count() == 2 == faults.count()
    made = [r for part in (tmp_path / "out").glob("part-*.gz") for r in warc.parse_warc([gzip.decompress(part.read_bytes())])]
    assert sorted(r.headers["WARC-Type"] for r in made) == sorted(["warcinfo", "response", "resource"] * 2)
    assert len({r.headers["WARC-Record-ID"] for r in made}) == 6
    assert {r.headers["WARC-Payload-Digest"] for r in made if r.headers["WARC-Type"] == "response"} == {"sha1:" + warc.sha1(HTTP.split(b"\r\n\r\n", 1)[1])}
    assert all(r.headers["WARC-Truncated"] == "unspecified" for r in made if r.headers["WARC-Type"] == "resource")
    (tmp_path / "none").mkdir()
    assert warc.read_arcs(spark, str(tmp_path / "none")).count() == 0


def test_repeated_pages_have_identifiers_of_their_own(spark, tmp_path):
    again = (1, "http://a", "x")  # repeats a response that is referred to, whole
    rows = [again, again, (1, "http://b", "x"), (1, "http://a", "y"), (1, "http://b", "y"), (None, None, "x"), (2, None, "x"), (2, None, "x"), (None, None, "z"), (None, None, "z"), (3, "u", "w")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for k in range(3):
        for least in (0, 100):
            path = tmp_path / f"{k} {least}"
            warc.write_archives(df.repartition(3 + k), str(path), least)
            made = [r.headers for part in path.glob("part-*.gz") for r in warc.parse_warc([gzip.decompress(part.read_bytes())])]
            assert len(made) == len(rows) and len({h["WARC-Record-ID"] for h in made}) == len(rows) - (least == 0)
            responses = {h["WARC-Record-ID"]: h["WARC-Payload-Digest"] for h in made if h["WARC-Type"] == "response"}
            revisits = [h for h in made if h["WARC-Type"] == "revisit"]
            assert len(revisits) == (0 if least else 3) and all(responses[h["WARC-Refers-To"]] == h["WARC-Payload-Digest"] for h in revisits)
