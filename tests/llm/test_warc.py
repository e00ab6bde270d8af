"""WARC archives: exact round trip, any split, damaged files."""

import gzip
import hashlib
import io
import random
import zlib

import duckdb
import helpers as H
import pytest

from heatloom.llm import queries, warc

SCHEMA = "page_id long, url string, html string, digest string, n_bytes long, copy string, path string, size string, first string, _id string"


def pages(seed=1):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abc <>é語\r\n") for _ in range(n))
    rows = [(i, f"http://h/{i % 7}", text(rng.randint(0, 400))) for i in range(120)]
    big, same = text(60_000), text(150)
    rows += [(200 + i, "http://h/big", big) for i in range(3)] + [(300 + rng.randint(0, 20), f"u{i % 3}", same) for i in range(60)]
    rows += [(400, None, None), (401, "a\r\nWARC-Type: x bé", "x" * 100), (402, "", "x" * 100), (None, "n", "x" * 100), (None, None, None),
             (403, "u", "y" * 99), (404, "u", "y" * 99), (None, "u", "z" * 120), (None, "u", "z" * 120)]
    rows += [(500, "twin", "t" * 300)] * 5 + [(500, "other", "t" * 300), (501, "twin", "t" * 300)]
    rows += [(600, "u", "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" * 20)]
    return rows


def brute(rows):
    ids = {}
    for i, u, t in rows:
        ids.setdefault(t or "", []).append(((i is None, i or 0), (u is None, u or "")))
    seen, out = {}, []
    for i, u, t in sorted(rows, key=lambda r: ((r[0] is None, r[0] or 0), (r[1] is None, r[1] or ""))):
        p = (t or "").encode()
        later = len(p) >= 100 and p in seen
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if later else "response", seen[p] if later else None, None if later else p))
        seen.setdefault(p, i)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 1, 1, *["x"] * 5) for r in rows], SCHEMA)


def plain(df):
    return [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect()]


@pytest.mark.parametrize("split, groups", [(1 << 20, 50_000), (300, 50_000), (7777, 0)])
def test_round_trip(spark, monkeypatch, split, groups):
    rows = pages()
    monkeypatch.setattr(warc.write_warc, "__defaults__", (*warc.write_warc.__defaults__[:-1], groups))
    got = plain(warc.archived_pages(frame(spark, rows).repartition(3), split))
    want = brute(rows)
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_archives_are_plain_warc(spark, tmp_path):
    """Any gzip reader sees the records; ids are unique, references point to responses, archives roll over."""
    rows = pages()
    archives = warc.write_warc(frame(spark, rows).repartition(2), f"file://{tmp_path}/a", archive_bytes=20_000)
    listed = {(r["path"].rpartition("/")[2], r["size"]) for r in archives.collect()}
    assert len(listed) > 2
    assert {(r["path"].rpartition("/")[2], r["size"]) for r in warc.list_archives(spark, f"{tmp_path}/a").collect()} == listed
    n = sum(gzip.decompress((tmp_path / "a" / name).read_bytes()).count(b"WARC/1.1\r\nWARC-Type: ") for name, _ in listed)
    assert n == sum(r["records"] for r in archives.collect()) == len(rows) + len(listed)
    read = warc.read_warc(archives, 4096).collect()
    assert len(read) == n and len({r["record_id"] for r in read}) == n
    responses = {r["record_id"]: r["payload_digest"] for r in read if r["record_type"] == "response"}
    assert all(responses[r["refers_to"]] == r["payload_digest"] for r in read if r["record_type"] == "revisit")
    assert "http://h/0" in {r["target_uri"] for r in read} and len({(r["path"], r["offset"]) for r in read}) == n


def test_nothing(spark):
    assert warc.archived_pages(frame(spark, [])).count() == 0
    assert warc.read_warc(spark.createDataFrame([], "path string, size long")).count() == 0


def test_sql(spark):
    rows = pages()
    c = duckdb.connect()
    c.execute("create table pages (page_id bigint, url varchar, html varchar)")
    c.executemany("insert into pages values (?, ?, ?)", rows)
    H.same_rows(c.execute(queries.WARC_SQL).fetchall(), [r[:5] for r in brute(rows)])


def records():
    return [warc.record(str(i), 0, "u", b"payload %d " % i * (i * 50), hashlib.sha256(b"").hexdigest(), i, None, warc.DATE) for i in range(12)]


def ranges(data, split, step):
    out = []
    for s in range(0, len(data), split):
        out += [(o, f["warc-record-id"]) for o, f, _ in warc.records_in(io.BytesIO(data), len(data), s, min(len(data), s + split), step)]
    return out


@pytest.mark.parametrize("split, step", [(1, 50), (13, 1 << 20), (100, 7), (1 << 20, 1)])
def test_every_record_has_one_owner(split, step):
    parts = [warc.member(r) for r in records()]
    starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
    got = ranges(b"".join(parts), split, step)
    assert got == [(s, f"<urn:page:id:{i}:0>") for i, s in enumerate(starts)]


def test_damage_and_false_magic_cost_only_the_damaged_record():
    parts = [warc.member(r) for r in records()]
    parts[3] = parts[3][:-9] + bytes([parts[3][-9] ^ 255]) + parts[3][-8:]  # wrong checksum
    parts[5] = parts[5][: len(parts[5]) // 2]
    junk = warc.MAGIC + b"\0" * 30 + warc.MAGIC[:2]
    other = gzip.compress(b"not a record") + gzip.compress(b"WARC/1.1\r\nno header end")
    data = junk + b"".join(parts[:7]) + junk + other + b"".join(parts[7:]) + parts[0][:20]
    for split in (17, 1000, 1 << 20):
        got = [i for _, i in ranges(data, split, 64)]
        assert got == [f"<urn:page:id:{i}:0>" for i in range(12) if i not in (3, 5)]


def test_records_inside_payloads_are_no_records():
    inner = warc.member(records()[2])
    rng = random.Random(1)
    noise = bytes(rng.randrange(256) for _ in range(5000))  # stored as it is by deflate
    outer = warc.member(warc.record("outer", 0, None, noise + inner + noise, "d", 1, None, warc.DATE))
    assert [i for _, i in ranges(outer, 100, 64)] == ["<urn:page:id:outer:0>"]
    assert inner in zlib.decompress(outer, 31)
