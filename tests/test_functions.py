"""Names, locations, durations, schedules, exclusions, chunking, codecs, parity."""

import hashlib
import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packlake.functions import chunking, codec, durations, ignore, location, names, parity


def noise(length, seed):
    out, x = bytearray(), seed or 1
    for _ in range(length):
        x ^= x << 13 & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= x << 17 & 0xFFFFFFFFFFFFFFFF
        out.append(x & 0xFF)
    return bytes(out)


def test_archive_names(spark):
    rows = [
        ("photo-set-1-20260717T020000Z-3f2b8c1e-0000-4000-8000-000000000000.tar.lz4",),
        ("../up/x-20260717T020000Z-3f2b8c1e-0000-4000-8000-000000000000.tar.lz4",),
        (".hidden-20260717T020000Z-3f2b8c1e-0000-4000-8000-000000000000.tar.lz4",),
        ("not-an-archive.txt",),
        ("job-20261317T020000Z-3f2b8c1e-0000-4000-8000-000000000000.tar.lz4",),
        (".tar.lz4",),
        (None,),
    ]
    name = F.col("n")
    got = spark.createDataFrame(rows, "n string").select(names.parsed_job(name), names.parsed_created(name), names.renamed(name, "photo-set-1", "other")).collect()
    assert got[0][0] == "photo-set-1" and got[0][1] == datetime(2026, 7, 17, 2)
    assert got[0][2] == "other-20260717T020000Z-3f2b8c1e-0000-4000-8000-000000000000.tar.lz4"
    assert all(r[0] is None and r[1] is None and r[2] is None for r in got[1:])


def test_small_functions(spark):
    got = spark.sql("select 1").select(
        *[names.retry_delay(F.lit(n)) for n in (1, 2, 3, 4, 9)], names.piece_length(F.lit(100_003)), names.piece_length(F.lit(1)), names.first_token(F.lit(" abc  file.tar")), names.unescaped_mount(F.lit("/a\\040b"))
    ).first()
    assert list(got) == [60, 300, 900, 3600, 3600, 1564, 2, "abc", "/a b"]


def test_locations(spark):
    rows = [("ssh://me@host1:2022/srv/copies",), ("ssh://-x=y/path",), ("relative/path",), ("ssh://host1/two%20words/no%231",), ("/mnt/a",), ("/mnt/../a",), ("ssh://u:p@h/x",)]
    u = F.col("u")
    where = location.parsed(u)
    got = spark.createDataFrame(rows, "u string").select(where.alias("w"), location.error(u).alias("e"), location.shown(where).alias("s"), location.folder_name(u).alias("f"), location.sibling(u, "new").alias("n")).collect()
    assert tuple(got[0]["w"]) == ("ssh", "host1", "me", 2022, "/srv/copies") and got[0]["e"] is None and got[0]["s"] == rows[0][0]
    assert got[0]["f"] == "copies" and got[0]["n"] == "ssh://me@host1:2022/srv/new"
    assert got[3]["w"]["path"] == "/two words/no#1" and got[3]["s"] == rows[3][0]
    assert [r["e"] is None for r in got] == [True, False, False, True, True, False, False]
    inside = spark.sql("select 1").select(*[location.contains(F.lit(a), F.lit(b)) for a, b in (("/a", "/a/b"), ("/a", "/ab"), ("/a/", "/a"), ("/a/b", "/a"))]).first()
    assert list(inside) == [True, False, True, False]


def test_durations_and_cron():
    assert [durations.seconds(x) for x in ("12h", "7d", "6w", "1d 6h", "90 min")] == [43_200, 604_800, 3_628_800, 108_000, 5400]
    for bad in ("", "5", "h", "5 parsecs", "1d x"):
        with pytest.raises(ValueError):
            durations.seconds(bad)
    now = datetime(2026, 7, 17, 12, 45)
    slot = lambda c: durations.Cron(c).previous(now)
    assert slot("0 * * * *") == datetime(2026, 7, 17, 12) and slot("0 2 1 * *") == datetime(2026, 7, 1, 2) and slot("45 12 * * *") == now
    assert slot("0 2 * * sun") == datetime(2026, 7, 12, 2) and slot("0 0 29 2 *") == datetime(2024, 2, 29)
    assert len(durations.Cron("*/15 * * * *").slots(datetime(2026, 1, 1), datetime(2026, 1, 1, 0, 59))) == 4
    for bad in ("* * * *", "61 * * * *", "*/0 * * * *"):
        with pytest.raises(ValueError):
            durations.Cron(bad)


def test_exclusions(spark):
    lines = ["*.tmp", "/build/", "!keep.tmp", "**/cache/**", "docs/*.txt", "# comment", ""]
    rows = [("a.tmp", 0, 1), ("x/keep.tmp", 0, 0), ("build", 1, 1), ("build/keep.tmp", 0, 1), ("src/build", 1, 0), ("a/cache/b/c", 0, 1), ("docs/a.txt", 0, 1), ("x/docs/a.txt", 0, 0), ("build.txt", 0, 0)]
    df = spark.createDataFrame([(p, bool(d)) for p, d, _ in rows], "p string, d boolean")
    got = [r[0] for r in df.select(ignore.excluded(F.col("p"), F.col("d"), lines)).collect()]
    assert got == [bool(x) for *_, x in rows]


SIZES = (256, 1024, 4096)


def test_chunks_tile_and_resist_inserts():
    data = noise(200_000, 7)
    cut = lambda d: chunking.cut_points(d, *SIZES)
    ends = cut(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and all(256 <= s <= 4096 for s in sizes[:-1]) and 500 < sum(sizes) / len(sizes) < 2500
    ids = lambda d: {hashlib.sha256(d[a:b]).digest() for a, b in zip([0, *cut(d)], cut(d))}
    changed = data[:100] + b"fourteen bytes" + data[100:]
    assert len(ids(changed) - ids(data)) <= 2
    assert cut(b"") == [] and cut(b"x") == [1]


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_rolling_hash_is_the_sum_of_shifted_words(data):
    h = chunking.rolling(data)
    for i in range(0, len(data), 97):
        want = 0
        for j in range(max(0, i - 63), i + 1):
            want += int(chunking.GEAR[data[j]]) << (i - j)
        assert int(h[i]) == want % 2**64


def test_chunked_frame(spark):
    data = noise(20_000, 3)
    rows = chunking.chunked(spark.createDataFrame([("a", data), ("b", data), ("c", None)], "path string, bytes binary"), "path", "bytes", *SIZES, keep_bytes=True).collect()
    for p in "ab":
        assert b"".join(r["bytes"] for r in sorted((r for r in rows if r["path"] == p), key=lambda r: r["seq"])) == data
    assert not [r for r in rows if r["path"] == "c"]


def test_codec():
    import io

    assert codec.stored_form(b"a" * 1000)[1] and not codec.stored_form(noise(1000, 5))[1] and codec.stored_form(b"") == (b"", False)
    packed, flag = codec.stored_form(b"ab" * 500)
    assert codec.restored(packed, 1000, flag) == b"ab" * 500
    assert b"".join(codec.unframe(io.BytesIO(codec.frame(b"xyz" * 99)))) == b"xyz" * 99


def test_parity_heals_any_two():
    rng = random.Random(23)
    for size in (0, 1, 129, 9001, 20_480):
        data = rng.randbytes(size)
        sealed, hashes = parity.seal(data)
        for bad in [()] + [tuple(rng.sample(range(66), k)) for k in (1, 2) for _ in range(12)] + [(64, 65)]:
            pieces = list(sealed)
            for i in bad:
                pieces[i] = rng.choice([None, rng.randbytes(len(pieces[i])), pieces[i][:-1]])
            assert parity.unseal(pieces, hashes, size) == (data, len(bad))


def test_parity_does_not_guess():
    pieces, hashes = parity.seal(b"x" * 5000)
    for i in (1, 2, 3):
        pieces[i] = None
    with pytest.raises(ValueError, match="3 of 66"):
        parity.unseal(pieces, hashes, 5000)
