"""Empty tables, repeated rows, clashing columns and digests of the operators."""

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import cotraining, html_pages, jaccard, licenses, media, mixing, packing, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
#: Names that operators use inside or return.
CLASH = "h long, node long, size long, score double, predicted int, labels string, sequence_id long, held_out string, media string, n_words string, component string"
TEXTS = [None, "", " \t\n", "a", "one two three four five six seven", "Ünï çødé 漢字", "x " * 3000, "under the MIT license, you idiot!!! go"]


def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s", None if i % 2 else 5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, *rows, (None, "no id", None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark, docs):
    return docs.selectExpr("*", *(f"cast(null as {k.split()[1]}) {k.split()[0]}" for k in CLASH.split(", ")))


LABELS = "doc_id long, quality int, toxic int"
RUNS = {
    "jaccard": lambda s, d, l: jaccard.join(d),
    "quality": lambda s, d, l: cotraining.score(v := cotraining.views(d), cotraining.fit(v, l)),
    "media": lambda s, d, l: media.read_media(media.to_media(d)),
    "packing": lambda s, d, l: packing.pack(d, path()).drop("sequence_id", "offset"),
    "mixing": lambda s, d, l: mixing.mix(d).select("doc_id", "size", "source_size", "target"),
    "toxicity": lambda s, d, l: toxicity.score(d, toxicity.fit(d, l)),
    "flagged": lambda s, d, l: toxicity.flagged(d.drop("doc_id"), toxicity.fit(d, l)).select("text", "predicted"),
    "licenses": lambda s, d, l: licenses.scan(d),
    "substrings": lambda s, d, l: substrings.dedup(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_tables(spark, docs, odd, name):
    """No rows give no rows; extra columns of any name change nothing; repeated rows have equal results."""
    labels = spark.createDataFrame([(1, 0, 1), (None, 1, 0), (3, None, None)], LABELS)
    run = RUNS[name]
    assert run(spark, docs.limit(0), labels.limit(0)).count() == 0
    got = Counter(map(repr, run(spark, docs, labels).collect()))
    assert got == Counter(map(repr, run(spark, odd, labels).collect()))
    if name not in ("packing",):
        assert got.total() == 2 * len(TEXTS) + 1 and sorted(got.values()).count(1) <= 1


def test_pages(spark):
    page = "<html><body><nav><a href=/>Home</a></nav><article>" + "<p>It was a long and quiet day near the old river, and nobody spoke of it.</p>" * 6 + "</article><footer>All rights reserved</footer></body></html>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "plain"), (4, "x", "<div>" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert html_pages.extract(df.limit(0)).count() == 0
    got = Counter(map(tuple, html_pages.extract(df).select("page_id", "url", "text", "n_chars").collect()))
    more = df.selectExpr("*", "'t' text", "7 n_chars", "1 label", "html path")
    assert got == Counter(map(tuple, html_pages.extract(more).select("page_id", "url", "text", "n_chars").collect()))
    assert got.total() == len(rows) and all(n == len(t) for _, _, t, n in got)
    assert got[(2, None, "", 0)] == got[(None, "v", "", 0)] == 1 and max(got.values()) == 2


def unfiltered(png: bytes) -> bytes:
    """Samples of an 8-bit grey PNG, one byte after another."""
    at, parts, head = 8, b"", None
    while at < len(png):
        (n,), kind = struct.unpack(">I", png[at : at + 4]), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + n]
        assert struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        head = body if kind == b"IHDR" else head
        parts += body if kind == b"IDAT" else b""
        at += 12 + n
    wide, high, depth, colour = struct.unpack(">IIBB", head[:10])
    assert (depth, colour) == (8, 0)
    raw, out, above = zlib.decompress(parts), b"", [0] * wide
    for y in range(high):
        kind, line, row = raw[y * (wide + 1)], raw[y * (wide + 1) + 1 : (y + 1) * (wide + 1)], []
        for x in range(wide):
            a, b, c = row[x - 1] if x else 0, above[x], above[x - 1] if x else 0
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((line[x] + (0, a, b, (a + b) // 2, nearest)[kind]) % 256)
        out, above = out + bytes(row), row
    return out


def test_media_digests(spark):
    texts = [None, "", "a", "b", "a", "é" * 500, "long text of words " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = media.to_media(df)
    pngs = {r.doc_id: bytes(r.media) for r in stored.collect()}
    got = {r.doc_id: r for r in media.read_media(stored).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert unfiltered(pngs[i]) == payload
        r = got[i]
        assert (r.payload_sha256, r.media_sha256, r.media_bytes, r.payload_bytes) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(pngs[i]).hexdigest(), len(pngs[i]), len(payload))
    assert got[2].feature == got[4].feature and got[2][3:] == got[4][3:]


@pytest.mark.parametrize("high", [32, 70])
def test_cosine_hash(high):
    """The low frequencies of a plain cosine transform, written as a sum of cosines over the means of a 32 x 32 grid."""
    from math import cos, pi
    from statistics import median

    image = np.random.default_rng(high).integers(0, 256, (high, media.UNIT)).astype(np.uint8)
    edge = lambda n, k: k * n // 32
    grid = [[image[edge(high, y) : edge(high, y + 1), edge(media.UNIT, x) : edge(media.UNIT, x + 1)].mean() for x in range(32)] for y in range(32)]
    low = [sum(grid[y][x] * cos(pi / 32 * (y + 0.5) * v) * cos(pi / 32 * (x + 0.5) * u) for y in range(32) for x in range(32)) for v in range(8) for u in range(1, 9)]
    bits = "".join("01"[int(x > median(low))] for x in low)
    assert media.cosine_hash(image) == f"{int(bits, 2):016x}"


def test_pipeline_of_no_rows(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_pipeline_tells_rows_apart(spark, tmp_path):
    """Different texts that share an id all pass; repeated rows are one document, and take no words of another's run."""
    import corpus_pipeline as p

    word = lambda k: "".join(chr(97 + int(c)) for c in str(k * 7919))
    text = lambda a, n=60: " ".join(word(k) for k in range(a, a + n))
    rows = [(1, text(1)), (1, text(1000)), (1, text(1)), (2, text(2000)), (2, text(1)), (3, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).selectExpr("*", "1 component_id", "2 kept", "3 predicted")
    one = p.cut(p.one_of_each(spark, df, ""), "test-edges")
    assert one.columns == list(p.COLUMNS)
    assert sorted((r.doc_id, r.text) for r in one.collect()) == sorted([(1, text(1)), (1, text(1000)), (2, text(2000)), (3, "")])
    same = spark.createDataFrame([(7, text(1), "en", s, 0) for s in ("a", "a", "b", None)] + [(8, text(500), "en", "a", 0)], SCHEMA)
    want = Counter()
    for r in mixing.mix(same).collect():
        want[r.doc_id] += r.taken
    got = Counter()
    for r in p.mixed(spark, same, "").collect():
        got[r.doc_id] += len(r.text.split())
        assert r.text in (text(1) if r.doc_id == 7 else text(500))
    assert +got == +want
