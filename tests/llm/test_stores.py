import hashlib
import random
import tarfile
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import media, packing


def test_png():
    for n in (0, 1, 63, 64, 65, 5000):
        payload = media.padded(bytes(random.Random(n).randrange(256) for _ in range(n)))
        image = media.to_png(payload)
        assert len(payload) % 64 == 0 and payload and media.from_png(image) == payload
        assert media.png_header(image[: media.HEADER]) == (64, len(payload) // 64, 8)


def test_media(docs, no_docs, tmp_path):
    rows = media.media_columns(docs, f"file://{tmp_path}/shards").collect()
    assert len(rows) == docs.count()
    texts = docs.select("doc_id", "text").collect()
    want = {}
    for r in texts:
        data = (r["text"] or "").encode()
        p = media.padded(data)
        want[r["doc_id"]] = (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), 64, len(p) // 64)
    for r in rows:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["width"], r["height"]) == want[r["doc_id"]]
        assert r["media_sha256"] == r["digest"]
    members = set()
    for path in (tmp_path / "shards").iterdir():
        with tarfile.open(path) as tar:
            for m in tar:
                assert hashlib.sha256(tar.extractfile(m).read()).hexdigest() == m.name.removesuffix(".png")
                members.add(m.name)
    assert len(members) == len({w[2] for w in want.values()})
    assert media.media_columns(no_docs, f"file://{tmp_path}/none").count() == 0


def test_clashing_columns_and_very_long_texts(spark, tmp_path):
    """Names that the operators use themselves, a text of half a million words, ties and repeats."""
    long = " ".join(f"w{k % 5000}" for k in range(500_000))
    names = "digest shard length offset start rank doc_tokens sequence_id n_bytes feature".split()
    df = spark.createDataFrame([(1, long), (2, "same"), (3, "same"), (3, "same"), (4, "")], "doc_id long, text string").withColumns({c: F.lit("clash") for c in names})
    media_rows = media.media_columns(df, f"file://{tmp_path}/shards").collect()
    assert sorted((r["doc_id"], r["n_bytes"]) for r in media_rows) == [(1, len(long)), (2, 4), (3, 4), (3, 4), (4, 0)]
    assert len({(r["digest"], r["feature"], r["media_sha256"]) for r in media_rows if r["doc_id"] in (2, 3)}) == 1
    pieces = packing.pack(df).collect()
    mine = sorted((r["start"], r["length"]) for r in pieces if r["doc_id"] == 1)
    assert sum(n for _, n in mine) == next(r["doc_tokens"] for r in pieces if r["doc_id"] == 1) > 500_000
    assert [a for a, _ in mine] == [0, *np.cumsum([n for _, n in mine])[:-1]] and all(n == 1024 for _, n in mine[:-1])
    assert sorted(r["doc_id"] for r in pieces if r["doc_id"] > 1) == [2, 3, 3, 4]
    assert len({(r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces)


def test_encoder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing.Encoder("byte_bpe_50k", most=50)
    r = random.Random(4)
    parts = ["word", "Straße", " ", "  ", "\n", "\t", "\u00a0", "\u2028", "\x1c", "don't", "日本", "😀", "123", "...", "<|endoftext|>", "\x00", "a" * 300, "é"]
    for _ in range(400):
        text = "".join(r.choice(parts) + r.choice(["", " ", " "]) for _ in range(r.randint(0, 12)))
        want = whole.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == np.asarray(want, "<u4").tobytes()


def test_packing(docs, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, size=256).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for doc_id in {i for i, _ in texts}:
        mine = sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["start"])
        given = [t for i, t in texts if i == doc_id]
        ids = [*whole.encode(given[0] or "", add_special_tokens=False).ids, 0]
        assert sum(r["length"] for r in mine) == len(ids) * len(given)
        for r in mine:
            piece = np.asarray(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(piece) and r["doc_tokens"] == len(ids)
    packs = {}
    for r in rows:
        packs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in packs.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 256
    assert packing.pack(no_docs).count() == 0


def test_shortest_pack_first():
    r = random.Random(5)
    for size in (16, 64, 1024):
        histogram = {n: r.randint(1, 500) for n in r.sample(range(1, size + 1), min(size, 40))}
        patterns = packing.shortest_pack_first(histogram, size)
        used = {}
        for pattern, count in patterns:
            assert sum(pattern) <= size and count > 0
            for n in pattern:
                used[n] = used.get(n, 0) + count
        assert used == histogram
    assert packing.shortest_pack_first({}, 1024) == []


def test_ranks(spark):
    pieces = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), (F.col("id") % 3 + 5).alias("length"), F.lit(1).cast("long").alias("ids_crc32"))
    rows = packing.ranked(pieces, 7).collect()
    for n in (5, 6, 7):
        ranks = sorted(r["rank"] for r in rows if r["length"] == n)
        assert ranks == list(range(len(ranks)))
