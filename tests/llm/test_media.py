import hashlib
import wave as stdlib_wave
import zlib
from io import BytesIO

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import media


def test_against_brute_force(spark, odd, none):
    got = media.media(odd).collect()
    assert len(got) == odd.count()
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        file = media.wave(payload)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(file), hashlib.sha256(file).hexdigest(), media.feature_of(payload))
    assert media.media(none).count() == 0


def test_files_are_sound():
    with stdlib_wave.open(BytesIO(media.wave(b"\x80\x81" * 64))) as file:
        assert (file.getnchannels(), file.getsampwidth(), file.readframes(999)) == (1, 1, b"\x80\x81" * 64)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=6000))
def test_cuts(data):
    ends = media.cut_points(data, media.gear_table(), 64, 6, 512)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert ends[-1] == len(data) and all(s <= 512 for s in sizes) and all(s >= 64 for s in sizes[:-1])


def test_cuts_follow_the_content():
    """Behind an insertion the cuts fall on the same bytes again."""
    import random

    rng = random.Random(0)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    chunks = lambda d: {d[a:b] for a, b in zip([0, *media.cut_points(d, media.gear_table())], media.cut_points(d, media.gear_table()), strict=False)}
    a, b = chunks(data), chunks(data[:1000] + b"inserted" + data[1000:])
    assert len(a) > 40 and len(a & b) > 0.9 * len(a)


def test_equal_chunks_are_stored_once(spark, tmp_path, prose):
    text = "\n".join(prose(40, words=200))
    docs = spark.createDataFrame([(i, f"{i} " + text) for i in range(6)], "doc_id long, text string").repartition(3)
    files = media.store(docs, f"file://{tmp_path}/packs")
    rows = media.deduplicated(files).collect()
    places = {(c.pack, c.at) for r in rows for c in r["list"]}
    digests = {bytes(c.digest) for r in rows for c in r["list"]}
    assert len(places) == len(digests) < sum(len(r["list"]) for r in rows) / 4
