"""Media columns, language and site quality against plain versions of their definitions, one row at a time."""

import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from rainfold.llm import audio, bpe, host_quality, language, mixing, token_counts

CLASHES = [f"'c' AS {name}" for name in ("media", "payload", "ids", "stats", "lang_pred", "codec", "n_bytes", "size", "host", "text__", "held_out", "evidence")]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mulaw(code):
    code = ~code & 0xFF
    size = (((code & 15) * 2 + 33) << ((code >> 4) & 7)) - 33
    return -size * 4 if code & 128 else size * 4


def alaw(code):
    code ^= 0x55
    segment, step = (code >> 4) & 7, code & 15
    size = step * 2 + 1 if segment == 0 else (step * 2 + 33) << (segment - 1)
    return size * 8 if code & 128 else -size * 8


def adpcm(data):
    value = index = 0
    out = [0]
    for byte in data:
        for code in (byte & 15, byte >> 4):
            step = int(audio.IMA_STEPS[index])
            move = step // 8 + step // 4 * (code & 1) + step // 2 * (code >> 1 & 1) + step * (code >> 2 & 1)
            value = max(-32768, min(32767, value + (-move if code & 8 else move)))
            index = max(0, min(88, index + int(audio.IMA_MOVES[code])))
            out.append(value)
    return out


def media_of(text):
    """(container, PCM at 16 kHz) of a text."""
    raw = (text or "").encode()
    raw += b" " * (-len(raw) % 192 or 192 * (not raw))
    kind = zlib.crc32(raw) % 3
    tag, align, bits, extra, data, samples = [(7, 1, 8, b"\0\0", raw, len(raw)), (6, 1, 8, b"\0\0", raw, len(raw)), (17, 196, 4, struct.pack("<HH", 2, 385), b"".join(b"\0\0\0\0" + raw[a : a + 192] for a in range(0, len(raw), 192)), len(raw) // 192 * 385)][kind]
    per_block = 385 if kind == 2 else 1
    fmt = struct.pack("<HHIIHH", tag, 1, 8000, 8000 * align // per_block, align, bits) + extra
    parts = b"".join(n + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2) for n, x in ((b"fmt ", fmt), (b"fact", struct.pack("<I", samples)), (b"data", data)))
    pcm = [mulaw(b) for b in raw] if kind == 0 else [alaw(b) for b in raw] if kind == 1 else [v for a in range(0, len(raw), 192) for v in adpcm(raw[a : a + 192])]
    taps = np.round(np.sinc(np.arange(-16, 17) / 2) * np.hamming(33) * 2**14).astype(int).tolist()
    wide = []
    for i in range(2 * len(pcm)):
        total = sum(taps[i - 2 * j + 16] * pcm[j] for j in range(max(0, (i - 16 + 1) // 2), min(len(pcm), (i + 16) // 2 + 1)) if 0 <= i - 2 * j + 16 < 33)
        wide.append(max(-32768, min(32767, math.floor(total / 2**14 + 0.5))))
    return b"RIFF" + struct.pack("<I", 4 + len(parts)) + b"WAVE" + parts, wide


def test_media_and_features(spark, docs):
    texts = [None, "", "a", "short words", "é" * 200, *[r["text"] for r in docs.where("length(text) < 900").limit(12).collect()]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in audio.media_digest(df).collect()}
    assert len({r["codec"] for r in rows.values()}) == 3
    for i, text in enumerate(texts):
        media, pcm = media_of(text)
        assert (rows[i]["media_bytes"], rows[i]["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        changes = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:], strict=False))
        assert rows[i]["feature"] == f"samples={len(pcm)};peak={max(map(abs, pcm))};crossings={changes};energy={sum(x * x for x in pcm)}"
        assert rows[i]["pcm_crc32"] == zlib.crc32(struct.pack(f"<{len(pcm)}h", *pcm))


def test_language_of_each_text(docs):
    known = language.learn(docs.where(~language.held_out()))
    packers = {k: zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for k, v in known.items()}
    got = {r["doc_id"]: r for r in language.language_report(docs).collect()}
    same = 0
    for r in docs.collect():
        words = "".join(c if c.isalpha() or not (c.isascii() or c.isspace() or c.isnumeric()) else " " for c in (r["text"] or "").lower())
        raw = language.plain(r["text"] or "")
        if not any(c.isalpha() for c in words):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        sizes = {k: sum(len(p.compress(raw[a : a + language.BLOCK])) for a in range(0, len(raw), language.BLOCK)) for k, p in packers.items()}
        ranked = sorted(sizes, key=lambda k: (sizes[k], k))
        want = 1 - sizes[ranked[0]] / sizes[ranked[1]]
        same += (got[r["doc_id"]]["lang_pred"], round(got[r["doc_id"]]["score"], 9)) == (ranked[0], round(want, 9))
        assert got[r["doc_id"]]["rejected"] == (got[r["doc_id"]]["score"] < language.MARGIN)
    assert same >= 0.98 * len(got)  # a compressor of fixed level and a precomputed dictionary may part a few texts


def test_language_ties(spark):
    both = {"b": b"the same words here " * 20, "a": b"the same words here " * 20}
    rows = language.classify(spark.createDataFrame([(1, "the same words here again")], "doc_id bigint, text string"), both).collect()
    assert (rows[0]["lang_pred"], rows[0]["score"], rows[0]["rejected"]) == ("a", 0.0, True)
    with pytest.raises(ValueError, match="over 256 languages"):
        language.learn(spark.range(300).selectExpr("id AS doc_id", "'some words' AS text", "cast(id AS string) AS lang"))


def posteriors(rows):
    """rows: (host, path, p, evidence) of judged documents; the quality of each by the formulas, sites as dictionaries."""
    hosts, paths = defaultdict(list), defaultdict(list)
    for host, path, p, _ in rows:
        hosts[host].append(p)
        paths[host, path].append(p)
    prior = sum(p for _, _, p, _ in rows) / len(rows)

    def strength(groups):
        groups = list(groups)
        within = sum(m * (1 - m) / n for n, _, m in groups) / len(groups)
        between = max(sum((t / n - m) ** 2 for n, t, m in groups) / len(groups) - within, 1e-4)
        return max(1.0, min(sum(m * (1 - m) for _, _, m in groups) / len(groups) / between - 1, 10_000.0))

    a = strength((len(v), sum(v), prior) for v in hosts.values())
    shrunk = {h: (sum(v) + a * prior) / (len(v) + a) for h, v in hosts.items()}
    b = strength((len(v), sum(v), shrunk[h]) for (h, _), v in paths.items())

    def logit(p):
        p = min(max(p, 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p))

    out = []
    for host, path, p, evidence in rows:
        of_host = (sum(hosts[host]) - p + a * prior) / (len(hosts[host]) - 1 + a)
        of_path = (sum(paths[host, path]) - p + b * of_host) / (len(paths[host, path]) - 1 + b)
        out.append(1 / (1 + math.exp(-(evidence + host_quality.SITE_WEIGHT * (logit(of_path) - logit(prior))))))
    return out


def test_quality_of_sparse_hosts(spark, sf_dir, docs):
    """Real URLs: very many hosts with few documents each, against the formulas."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("n"), "url")
    n = pages.count()
    placed = docs.withColumn("n", F.pmod(F.xxhash64("doc_id"), F.lit(n))).join(pages, "n")
    host, path = host_quality.url_levels(F.col("url"))
    got = host_quality.quality(placed, labels, host, path).collect()
    assert len(got) == docs.count() and len({r["host"] for r in got}) >= 2
    some = [r for r in got if r["evidence"] is not None]
    want = posteriors([(r["host"], r["path"], 1 / (1 + math.exp(-r["evidence"])), r["evidence"]) for r in some])
    assert [r["quality"] for r in some] == pytest.approx(want, abs=1e-9)
    assert all(r["rejected"] == (r["quality"] < host_quality.REJECT_BELOW) for r in got)


@pytest.mark.parametrize("query", [audio.media_digest, bpe.encoded_digest, language.language_report, token_counts.token_count_report, mixing.mix_report, lambda df: host_quality.quality_report(df, df.selectExpr("doc_id", "1 AS quality"))])
def test_names_that_clash_and_repeated_rows(spark, query):
    rows = [(1, "a few words of text", "en", "s"), (1, "a few words of text", "en", "s"), (None, None, None, None), (2, "", "en", "t"), (3, "other words, and more of them", "fr", "s")]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    want = Counter(map(repr, query(plain).collect()))
    assert sum(want.values()) == 5
    assert Counter(map(repr, query(plain.selectExpr("*", *CLASHES)).collect())) == want
    assert query(plain.selectExpr("*", *CLASHES).limit(0)).count() == 0
