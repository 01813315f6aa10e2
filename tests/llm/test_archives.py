"""Legacy archives by hand, their conversion, and the round trip of pages against brute force."""

import glob
import gzip
import hashlib
import os
import random

from melodex.llm import archives

HTTP = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n"


def arc(version, *records, name="x.arc", date="19990102030405"):
    about = f"{version} 0 Somebody\n{archives.ARC_FIELDS[version]}\n".encode()
    more = b"" if version == 1 else b" 200 - - 0 x.arc"
    out = f"filedesc://{name} 0.0.0.0 {date} text/plain".encode() + more + b" %d\n" % len(about) + about
    for line, block in records:
        out += b"\n" + line.encode() + b" %d\n" % len(block) + block
    return out + b"\n"


def read(spark, folder, name, data, reader):
    os.makedirs(f"{folder}/{name}")
    with open(f"{folder}/{name}/a", "wb") as f:
        f.write(data)
    return reader(spark, f"{folder}/{name}").orderBy("offset").collect()


def test_record_lines_of_both_versions(spark, tmp_path):
    trap = HTTP + b"\nhttp://no.record/ 1.2.3.4 20000101000000 text/html 5\nhello\n"
    one = arc(1, ("http://a/ 1.2.3.4 20010203040506 text/html", trap), ("http://b/x y 1.2.3.4 20010203 text/html; charset=x", b""), ("dns:a 1.2.3.4 20010203040506 text/dns", b"a. 1 IN A 1.2.3.4\n"))
    for name, data in (("plain", one), ("packed", gzip.compress(one)), ("members", gzip.compress(one[:150]) + gzip.compress(one[150:]))):
        info, a, b, dns = read(spark, tmp_path, name, data, archives.read_arc)
        assert info.url == "filedesc://x.arc" and {r.archive for r in (info, a, b, dns)} == {"x.arc"} and {r.error for r in (info, a, b, dns)} == {None}
        assert (a.url, a.ip, a.date, a.mime, a.status, a.version, bytes(a.head), bytes(a.payload)) == ("http://a/", "1.2.3.4", "20010203040506", "text/html", None, 1, HTTP, trap[len(HTTP) :])
        assert (b.url, b.mime, b.head, bytes(b.payload)) == ("http://b/x y", "text/html; charset=x", None, b"") and dns.head is None
    two = arc(2, ("http://a/ 1.2.3.4 20010203040506 text/html 404 abc - 120 x.arc", HTTP + b"gone"), ("- - - - - - - - x.arc", b"\xff\x00"))
    info, a, b = read(spark, tmp_path, "two", two, archives.read_arc)
    assert (info.version, a.version, a.status, bytes(a.payload), a.error) == (2, 2, 404, b"gone", None) and (b.url, b.ip, b.date, b.mime, b.status, bytes(b.payload)) == (None, None, None, None, None, b"\xff\x00")


def test_damage(spark, tmp_path):
    """A line that is none, a record cut short, an unknown version, an empty archive."""
    data = arc(1, ("http://a/ 1.2.3.4 20010203040506 text/html", HTTP + b"a")) + b"noise\nmore noise\n" + b"http://b/ 1.2.3.4 20010203040506 text/html 900\n" + HTTP + b"cut"
    info, a, bad, b = read(spark, tmp_path, "damaged", data, archives.read_arc)
    assert bytes(a.payload) == b"a" and bad.url is None and bad.error == "17 bytes without a record line"
    assert bytes(b.payload) == b"cut" and b.error == f"{900 - len(HTTP) - 3} bytes are missing"
    (odd,) = read(spark, tmp_path, "odd", b"filedesc://x 0.0.0.0 19990102 text/plain 6\n9 0 x\n", archives.read_arc)
    assert odd.version == 1 and odd.error == "unknown version, read as 1"
    assert read(spark, tmp_path, "none", b"", archives.read_arc) == [] and read(spark, tmp_path, "nothing", b"", archives.read_warc) == []
    bad, one, rest = read(spark, tmp_path, "warc", b"\r\n\r\nlost\r\nWARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nWARC\r\n\r\n", archives.read_warc)
    assert bad.error == "6 bytes without a record" and one.fields["warc-type"] == "resource" and bytes(one.payload) == b"WAR" and rest.error == "5 bytes without a record"


def test_conversion(spark, tmp_path):
    """Types, dates, identifiers and digests that ARC lacks; equal payloads under two heads; what is no HTTP."""
    same, other = b"<p>" + b"same " * 30, b"HTTP/1.1 200 Fine\n\n"
    for k, (version, more) in enumerate(((1, ""), (2, " 200 - - 0 y.arc"))):
        records = [(f"http://{k}/a 1.2.3.4 2001020304 text/html{more}", HTTP + same), (f"http://{k}/b 1.2.3.4 99999999999999 text/html{more}", other + same), (f"ftp://{k}/c - - text/plain{more}", same), (f"http://{k}/d - 20010203040506 text/html{more}", HTTP + b"short")]
        os.makedirs(f"{tmp_path}/arc/{k}")
        with open(f"{tmp_path}/arc/{k}/x.arc", "wb") as f:
            f.write(arc(version, *records, name=f"{k}.arc"))
    archives.convert(spark, f"{tmp_path}/arc/*", f"{tmp_path}/warc")
    rows = archives.read_warc(spark, f"{tmp_path}/warc")
    found = {r.fields.get("warc-target-uri") or r.fields["warc-filename"]: r for r in rows.collect()}
    assert len(found) == 10 and {r.error for r in found.values()} == {None} and len({r.fields["warc-record-id"] for r in found.values()}) == 10
    a, d, c = found["http://0/a"], found["http://1/d"], found["ftp://0/c"]
    digest = hashlib.sha256(same).hexdigest()
    assert (a.fields["warc-type"], a.fields["warc-date"], a.fields["warc-payload-digest"], bytes(a.payload)) == ("response", "2001-02-03T04:00:00Z", f"sha256:{digest}", same)
    assert a.fields["warc-block-digest"] == "sha256:" + hashlib.sha256(HTTP + same).hexdigest()
    assert (found["http://0/b"].fields["warc-type"], bytes(found["http://0/b"].head), bytes(found["http://0/b"].payload), found["http://0/b"].fields["warc-date"]) == ("revisit", other, b"", "1999-01-02T03:04:05Z")
    for url in ("http://0/b", "http://1/a", "http://1/b"):
        f = found[url].fields
        assert (f["warc-refers-to"], f["warc-refers-to-target-uri"], f["warc-refers-to-date"], f["warc-profile"]) == (a.fields["warc-record-id"], "http://0/a", "2001-02-03T04:00:00Z", archives.REVISIT)
    assert (c.fields["warc-type"], c.fields["content-type"], found["ftp://1/c"].fields["warc-refers-to"]) == ("resource", "text/plain", c.fields["warc-record-id"])
    assert d.fields["warc-type"] == "response" and found["http://0/d"].fields["warc-type"] == "response"
    info = found["1.arc"].fields
    assert info["warc-type"] == "warcinfo" and d.fields["warc-warcinfo-id"] == info["warc-record-id"] and b"2 0 Somebody" in bytes(found["1.arc"].payload)
    told = archives.resolved(rows).collect()
    assert len(told) == 8 and all(r.intact for r in told) and sum(r.payload_digest == digest for r in told) == 6
    whole = gzip.open(next(iter(sorted(glob.glob(f"{tmp_path}/warc/*.gz"))))).read()
    assert whole.startswith(b"WARC/1.1\r\n") and whole.endswith(b"\r\n\r\n")
    # A revisit whose response is lost keeps its row, without bytes and digest.
    lost = archives.resolved(rows.where(rows.fields["warc-target-uri"] != "http://0/a")).where("record_type = 'revisit'")
    assert sorted((r.url, r.payload_bytes, r.payload_digest) for r in lost.collect())[1:] == [("http://0/b", None, None), ("http://1/a", None, None), ("http://1/b", None, None)]


def test_archives_of_one_name(spark, tmp_path):
    """Two archives that say the same of themselves keep their records apart, and one of each pair revisits the other."""
    body = [b"<p>" + bytes([65 + k]) * 200 for k in range(3)]
    for k in range(2):
        os.makedirs(f"{tmp_path}/arc/{k}")
        with open(f"{tmp_path}/arc/{k}/same.arc", "wb") as f:
            f.write(arc(1, *[(f"http://{k}/{n} 1.2.3.4 20010203040506 text/html", HTTP + b) for n, b in enumerate(body)]))
    archives.convert(spark, f"{tmp_path}/arc/*", f"{tmp_path}/warc")
    told = archives.resolved(archives.read_warc(spark, f"{tmp_path}/warc")).collect()
    assert len({r.record_id for r in told}) == 6 and sorted((r.url, r.record_type) for r in told) == [(f"http://{k}/{n}", "revisit" if k else "response") for k in range(2) for n in range(3)]


def brute(rows):
    first, out = {}, []
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (h or "").encode()
        d = hashlib.sha256(b).hexdigest()
        again = len(b) >= 100 and d in first
        out.append((i, len(b), d, "revisit" if again else "response", first[d] if again else None, True))
        first.setdefault(d, i)
    return out


def test_round_trip(spark):
    """Nulls, empty and very long payloads, record lines and separators inside payloads, repeats, odd URLs, clashing columns, no rows."""
    rng = random.Random(8)
    pool = ["", "short", "a" * 99, "b" * 100, "é" * 50, "<p>\r\n\r\nWARC/1.1\r\n\r\n" * 9, "filedesc://x 0.0.0.0 19990102 text/plain 6\n1 0 x\n\n" * 5, "\x00\n\n\r\n\r\n" * 30, None, "long " * 400_000]
    urls = [None, "", "http://a/", "http://a b\n/é", "x" * 5000]
    rows = [(rng.choice([k, k, k, k // 2, None]), rng.choice(urls), rng.choice(pool[:9])) for k in range(300)] + [(1000, "u", pool[9]), (2000, "u", pool[9]), (3000, "u", pool[9] + "!")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, record_type string, offset int")
    key = lambda r: tuple((x is not None, x) for x in r)
    got = archives.round_trip(df.repartition(5))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)
    assert archives.round_trip(df.limit(0)).collect() == []


def test_hot_payload_is_dealt(spark):
    """Many copies of one payload revisit one response, and their decisions are spread by place."""
    df = spark.range(3000).selectExpr("id AS page_id", "'u' AS url", "if(id % 3 = 0, repeat(string(id), 40), repeat('copy', 40)) AS html")
    got = {r.page_id: r for r in archives.round_trip(df).collect()}
    assert len(got) == 3000 and sum(r.record_type == "revisit" for r in got.values()) == 1999 and {r.refers_to for r in got.values()} == {None, 1}
