"""Each operator against brute force, on the smallest tables and on odd rows."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rainfold.llm import audio, bpe, chat, host_quality, language, mixing, near_duplicates, sharding, token_counts, topk

LONG = "word soup, 'tis naïve…  \n\n12 34\t" * 1500 + "x" * 30000 + " end   "
TEXTS = [None, "", " ", "a", "Hello world", "Hello world", "éÉ  ß\u3000漢字 🙂\ud7ff", LONG, "a b c d", "A B C D e", "<|endoftext|> x<|endoftext|>", "12,5 % !!", "\u0558 odd \x1c\x1f"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, repeated, very long texts; null ids and sources; a repeated row; columns whose names clash."""
    rows = [(i, t, ["en", "fr", None][i % 3], ["s", "t", None][i % 3], 1, 2, "k") for i, t in enumerate(TEXTS)]
    rows += [(3, "a", "en", "s", 1, 2, "k"), (None, "no id at all", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, key__ string")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", ["odd", "docs", "none"])
def test_audio_keeps_every_byte(name, request):
    df = request.getfixturevalue(name)
    rows = audio.media_digest(df).collect()
    assert len(rows) == df.count()
    by_id = defaultdict(set)
    for r in df.collect():
        by_id[r["doc_id"]].add(r["text"])
    for r in rows:
        want = []
        for t in by_id[r["doc_id"]]:
            raw = (t or "").encode()
            raw_n, raw = len(raw), raw + b" " * ((-len(raw)) % 192 or 192 * (not raw))
            want.append((raw_n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:])))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in want


def test_audio_codecs(tmp_path):
    mu, a = audio.mulaw_table(), audio.alaw_table()
    assert (mu[0], mu[0x7F], mu[0x80], mu[0xFF]) == (-32124, 0, 32124, 0) and (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    assert audio.compress(a, "alaw") == bytes(range(256))
    # one sample at a time, as the format is defined
    block = np.random.default_rng(1).integers(0, 256, (5, 196), np.uint8)
    block[:, 2] %= 89
    got = audio.decode_adpcm(block)
    for row, out in zip(block, got, strict=True):
        value, index, plain = struct.unpack("<h", row[:2].tobytes())[0], int(row[2]), []
        plain.append(value)
        for byte in row[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(audio.IMA_STEPS[index])
                move = (step >> 3) + (step >> 2) * bool(code & 1) + (step >> 1) * bool(code & 2) + step * bool(code & 4)
                value = max(-32768, min(32767, value - move if code & 8 else value + move))
                index = max(0, min(88, index + int(audio.IMA_MOVES[code])))
                plain.append(value)
        assert plain == out.tolist()
    tone = (8000 * np.sin(np.arange(4000) / 9)).astype(np.int16)
    wide = audio.resample(tone, 2, 1)
    assert len(wide) == 8000 and np.abs(wide[100:-100:2].astype(int) - tone[50:-50]).max() <= 60
    assert len(audio.resample(tone, 3, 2)) == 6000
    for codec in audio.TAGS:
        media = audio.wave(codec, bytes(range(192)))
        assert audio.parse_wave(media)[0] == codec and struct.unpack_from("<I", media, 4)[0] == len(media) - 8


def encoder(name="byte_bpe_multi_50k.tiktoken"):
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(public_tokenizers.path(name)), special_tokens={})


@pytest.mark.parametrize("name", ["odd", "docs", "none"])
def test_bpe_as_the_library(name, request):
    df, lib = request.getfixturevalue(name), encoder()

    def want(t):
        ids = lib.encode_ordinary(t or "")
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    assert Counter(map(tuple, bpe.encoded_digest(df).collect())) == Counter((r["doc_id"], *want(r["text"])) for r in df.collect())


@pytest.mark.parametrize("size,overlap", [(40, 15), (64, 30), (7, 6)])
def test_bpe_stitches(odd, size, overlap):
    lib = encoder()
    some = odd.where("text is not null").withColumn("text", F.substring("text", 1, 3000))
    got = bpe.encode(some, chunk_chars=size, overlap=overlap).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((r["doc_id"], tuple(lib.encode_ordinary(r["text"]))) for r in some.collect())


@pytest.mark.parametrize("name", ["odd", "docs", "none"])
def test_token_counts_as_the_library(name, request):
    df, lib = request.getfixturevalue(name), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = token_counts.token_count_report(df).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), n := len(lib.encode(r["text"] or "", add_special_tokens=False).ids), n > 512) for r in df.collect())
    assert Counter(map(tuple, rows)) == want


def test_language(odd, docs, none):
    rows = language.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    got = language.classify(odd, language.learn(docs)).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {0, 1, 2, 11}
    assert language.language_report(none).count() == 0
    assert {r["lang_pred"] for r in language.classify(odd, {}).collect()} == {"und"}


def test_language_blocks_are_whole_texts(spark):
    dictionaries = {"x": b"alpha beta gamma delta " * 40, "y": b"uno dos tres cuatro " * 40}
    tail = spark.createDataFrame([(1, "zzz " * 10000 + "uno dos tres cuatro " * 2000)], "doc_id bigint, text string")
    assert language.classify(tail, dictionaries).first()["lang_pred"] == "y"


@pytest.mark.parametrize("name", ["odd", "docs", "none"])
def test_shards(name, request):
    df = request.getfixturevalue(name)
    rows = sharding.shard_report(df).collect()
    n = df.count()
    assert len(rows) == n
    assert sorted(r["row_number"] for r in rows) == list(range(n))
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    for s in range(8):
        assert sorted(by[s]) == list(range(n // 8 + (s < n % 8)))
    plain = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == plain
    again = sharding.shard_report(df.repartition(3)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 37, 121, 1000])
def test_feistel_is_a_permutation(spark, n):
    side = math.isqrt(n - 1) + 1
    steps = sharding.longest_walk(spark.range(1), n, side)
    got = spark.range(n).select(sharding.walk(F.col("id"), F.lit(n).cast("long"), F.lit(side).cast("long"), steps).alias("p")).collect()
    assert sorted(r["p"] for r in got) == list(range(n))


def brute_top(vectors, k):
    """vectors: (id, list) of usable rows."""
    out = []
    for q, v in vectors:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in vectors if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def test_top_k(spark, sf_dir):
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = [(r["vec_id"], [math.floor(256 * float(x)) for x in r["embedding"]]) for r in emb.collect()]
    assert sorted(map(tuple, topk.search_report(emb).collect())) == sorted(brute_top(vectors, 5))


def test_top_k_odd_rows(spark):
    nan, rng = float("nan"), np.random.default_rng(3)
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [float("inf"), 0.0]), (50, []), (5, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, [-5.0, 1.0])]
    rows += [(100 + i, rng.integers(-3, 4, 2).astype(float).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("clash"))
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    assert sorted(map(tuple, topk.search_report(df).collect())) == sorted(brute_top(usable, 5))
    assert topk.search_report(df.limit(0)).count() == 0


def test_top_k_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 300, 3).tolist()) for i in range(120)]
    rows += [(150, [2.0**18, 1.0, -0.3]), (151, [-(2.0**30) - 0.001, 5.5, 0.0]), (200, [3.0e38, -1e-9, 2.0]), (201, [1e300, 1.0, 1.0]), (202, [1e300, 1.0, 2.0]), (250, [-1.7e308, 7.0]), (203, [0.0, 0.0, 2.0**52 + 1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    exact = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in rows]
    want = [(q, r, i, s if -(2**63) <= s < 2**63 else None) for q, r, i, s in brute_top(exact, 5)]
    got = [tuple(r) for r in topk.search_report(df).collect()]
    assert sorted(got, key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2]) and {150, 200, 250} <= {r[0] for r in got}


def test_top_k_over_a_grid(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    monkeypatch.setattr(topk, "CELL_PAIRS", 1)
    down, across = topk.grid_sides(2000, 40)
    assert down > 1 and across > 1
    rng = np.random.default_rng(9)
    rows = [(i, rng.integers(-9, 9, 3).astype(float).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(map(tuple, topk.search_report(df).collect())) == sorted(brute_top([(i, [int(256 * x) for x in v]) for i, v in rows], 5))


def test_language_sample_spans_texts(spark):
    opening = "the same opening passage " * 60
    rows = [(i, "de", opening + f"frühling{i % 5} " * 120 + "ende " * 300) for i in range(20)] + [(99, "fr", "court texte")]
    known = language.learn(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"))
    assert all(w in known["de"].decode() for w in ("opening", "frühling", "ende")) and known["fr"] == b"court texte"
    assert len(known["de"].decode()) <= 20 * (language.SAMPLE_CHARS + 4)


def test_threshold_stops_early(monkeypatch):
    rng = np.random.default_rng(5)
    block = rng.integers(0, 10, (4000, 3)).astype(np.float64)
    block[17] = block[23] = 1000
    lists = topk.Lists(np.arange(4000), block)
    scored = []
    monkeypatch.setattr(lists, "block", type("Counted", (), {"dtype": block.dtype, "__getitem__": lambda self, at: scored.append(len(at)) or block[at]})())
    ids, _ = lists.best(-1, np.array([1, 2, 3]), 2)
    assert sorted(ids) == [17, 23] and sum(scored) < 400


@pytest.mark.parametrize("name", ["odd", "docs", "none"])
def test_mix(name, request):
    df = request.getfixturevalue(name)
    rows = mixing.mix_report(df).collect()
    assert len(rows) == df.count()
    words = re.compile(r"[^\x20\x09-\x0D]+")
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], len(words.findall(r["text"] or ""))) for r in df.collect())
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total, fixed = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            break
        fixed |= {s: 3 * sizes[s] for s in over}
    taken = Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(fixed.get(r["source"], level * weight[r["source"]]), abs=1e-5)
        assert r["taken"] // max(1, r["size"]) in (int(r["target"] // max(1, sizes[r["source"]])), int(r["target"] // max(1, sizes[r["source"]])) + 1) or not r["size"]
        taken[r["source"]] += r["taken"]
    for r in rows:
        assert abs(taken[r["source"]] - r["target"]) <= 1
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix_report(df.repartition(3)).collect()))


def test_mix_prefers_weight(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"), F.lit(10).cast("long").alias("size"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.25).alias("weight"))
    rows = mixing.mix(df).where("source = 'a'").collect()
    part = sum(r["taken"] for r in rows if r["doc_id"] % 2 == 0) / sum(r["taken"] for r in rows)
    assert 0.6 < part < 0.9


def test_chat(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    extra = spark.createDataFrame([(900001, 0, "user", None), (900001, 1, "assistant", "\\</turn>###\\"), (900001, 1, "assistant", "\\</turn>###\\"), (None, None, None, None), (900002, 0, "a:b\n", "")], table.select("conv_id", "turn", "role", "text").schema).withColumn("segments", F.lit(1))
    for df in (table, table.select("conv_id", "turn", "role", "text").withColumn("segments", F.lit(2)).unionByName(extra), extra.limit(0)):
        by = defaultdict(list)
        for r in df.collect():
            by[r["conv_id"]].append((-1 if r["turn"] is None else r["turn"], r["role"] or "", r["text"] or ""))
        by[-7] = [(0, "user", "\\### Assistant: </turn> ok"), (1, "assistant", "\\### Assistant: </turn> ok")]
        got = {r["conv_id"]: r for r in chat.chat_report(df).collect()}
        assert got.keys() == by.keys()
        for conv, turns in by.items():
            turns.sort()
            learnt = "".join(t for _, role, t in turns if role == "assistant")
            said = "".join(f"{role}\n{t}\n" for _, role, t in turns)
            r = got[conv]
            assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert got[-7]["order_ok"]
    parts = [t for _, t in [(r["conv_id"], "".join(s["text"] for s in r["segments"])) for r in chat.segments(extra).collect()]]
    assert all(p.count("</turn>") == 1 and p.count("###") == 1 for p in parts)


@pytest.mark.parametrize("text", ["#### Title", "#####", "######", "##", "</</turn>", "</turn></turn>", "\\###", "#\\###\\#", "\\", "</turn", ""])
def test_chat_escapes_overlapping_marks(text):
    made = chat.escape(text, chat.TEMPLATE["control"])
    assert chat.unescape(made) == text and not any(mark in made for mark in chat.TEMPLATE["control"])
    marks = ["aba", "ab", "aa"]
    for odd in ("ababa", "aaaa", "abaaba\\aba"):
        made = chat.escape(odd, marks)
        assert chat.unescape(made) == odd and not any(mark in made for mark in marks)


def test_chat_sql_agrees(spark, tmp_path):
    import duckdb

    from rainfold.llm import oracles

    said = ["#### a", "##### b \\ </</turn>", "##", "######", None, "é###\n"]
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", said[(c + k) % len(said)]) for c in range(6) for k in range(4)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    df.write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    want = con.sql(oracles.CHAT)
    got = chat.chat_report(df).select(*want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def word_sets(rows):
    out = []
    for i, t in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out.append((i, {tuple(words[a : a + 5]) for a in range(max(1, len(words) - 4))} if words else set()))
    return out


def brute_components(rows):
    """(doc_id, size of its set, least doc_id reachable) of each row; rows are told apart by their place, not by their id."""
    sets, root = word_sets(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            inverted[x].append(k)
    seen = set()
    for members in inverted.values():
        for a in members:
            for b in members:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    p, q = sets[a][1], sets[b][1]
                    if 100 * len(p & q) >= 80 * len(p | q):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    least = {}
    for k, (i, _) in enumerate(sets):
        least.setdefault(find(k), []).append(i)
    return Counter((i, len(s), min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, s) in enumerate(sets))


def test_jaccard_components(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter(map(tuple, near_duplicates.component_report(docs).collect())) == brute_components(rows)


def test_jaccard_chains_and_short_texts(spark):
    """Chains of near copies, sizes about powers of two, exact edges of the threshold, copies, odd rows."""
    rng, rows, k = np.random.default_rng(7), [], 0
    for n in (1, 2, 4, 5, 6, 7, 8, 9, 12, 13, 15, 16, 17, 20, 31, 33, 40, 64, 100, 127, 128, 129, 160, 300):
        base = [f"w{n}_{i}" for i in range(n)]
        for _ in range(12):
            rows.append((k, " ".join(base)))
            k += 1
            base = list(base)
            at = int(rng.integers(0, len(base)))
            if rng.random() < 0.5:
                base[at] = f"x{k}"
            else:
                base = base[: max(1, len(base) - max(1, n // 9))]
    rows += [(k + i, "one passage that very many texts share " * 2 + " ".join(f"u{i}_{j}" for j in range(int(rng.integers(2, 20))))) for i in range(150)]
    rows += [(9001, None), (9002, ""), (9003, "  "), (3, rows[3][1]), (9004, "É a B c D"), (9005, "É A b C d"), (9006, "é a b c d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("rep", F.lit(1)).repartition(5)
    assert Counter(map(tuple, near_duplicates.component_report(df).collect())) == brute_components(rows)
    assert near_duplicates.component_report(df.limit(0)).count() == 0


def test_jaccard_names_sets_not_ids(spark):
    """Null ids, one id with several texts and chains through both, whatever the order of the rows."""
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:k], "x", *words[k + 1 :]]) for k in (5, 20, 40)]
    rows = [(8, " ".join(words)), (None, near[0]), (7, near[1]), (7, "another text of a few words that stands alone"), (7, near[2]), (None, None), (5, "ANOTHER text of a few words that stands alone"), (None, "no id and no copy of this one"), (None, "no id and no copy of this one")]
    chain = list(words)
    for k in range(12):  # each linked with the next one only, every other one without an id
        chain = [*chain[4:], *[f"c{k}_{i}" for i in range(4)]]
        rows.append((None if k % 2 else 100 - k, " ".join(chain)))
    want = brute_components(rows)
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "doc_id bigint, text string").repartition(3)
        assert Counter(map(tuple, near_duplicates.component_report(df).collect())) == want


def test_jaccard_splits_large_buckets(spark, monkeypatch):
    """Buckets cut into blocks and salted keys lose no link, in families some of whose members are linked and some are not."""
    monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", 7)
    monkeypatch.setattr("rainfold.operators.graph.HEAVY_ROWS", 4)
    rng, rows = np.random.default_rng(13), []
    for family in range(3):
        base = [f"f{family}_{i}" for i in range(120)]
        for k in range(50):
            own = list(base)
            for at in rng.choice(120, int(rng.integers(1, 5)), replace=False):
                own[at] = f"m{family}_{k}_{at}"
            rows.append((family * 1000 + k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(map(tuple, near_duplicates.component_report(df).collect())) == brute_components(rows)


def test_one_of_each_keeps_distinct_texts(spark):
    rows = [(5, "one text of five words or more", "a"), (5, "quite another text that shares the id", "b"), (5, "one text of five words or more", "c"), (None, "One TEXT of five words or more", "d"), (None, None, "e"), (None, None, "e"), (6, "", "f"), (6, "", "f"), (None, "alone and without an id it is", "g"), (9, "same text twice under the very id", "h"), (9, "same text twice under the very id", "h")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = Counter(tuple(r) for r in near_duplicates.one_of_each(df, ["doc_id", "text", "source"]).collect())
    first = [r for r in got if r[1] == rows[0][1]]
    assert len(first) == 1 and first[0] in (rows[0], rows[2]) and got[first[0]] == 1
    del got[first[0]]
    assert got == Counter({rows[1]: 1, rows[4]: 2, rows[6]: 2, rows[8]: 1, rows[9]: 1})
    assert near_duplicates.one_of_each(df.limit(0), ["doc_id"]).count() == 0


def test_part_keys_meet():
    """The guarantee behind the join: linked sets share a key, at the very edge of the threshold."""
    rng = np.random.default_rng(11)
    for _ in range(400):
        a = int(rng.integers(1, 400))
        own = np.unique(rng.integers(0, 2**63, a).astype(np.uint64))
        drop = int(rng.integers(0, a // 5 + 1))
        add = max(0, int((len(own) - drop) / 0.8) - len(own))
        other = np.unique(np.concatenate([own[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
        if len(other) and near_duplicates.linked(own, other):
            assert set(near_duplicates.part_keys(own)) & set(near_duplicates.part_keys(other))
            p, q = near_duplicates.sketch(own), near_duplicates.sketch(other)
            least = min(len(p), len(q))
            apart = int(np.bitwise_count(near_duplicates.fold(p, least) ^ near_duplicates.fold(q, least)).sum())
            assert apart <= len(np.setxor1d(own, other))


def test_quality(spark, sf_dir, odd, docs, none):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    half = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    judged = host_quality.quality(docs, half, *host_quality.document_levels())
    rows = judged.select("doc_id", F.col("quality").alias("q"), "rejected").join(labels.join(half, "doc_id", "left_anti"), "doc_id").collect()
    assert sum(r["rejected"] == (r["quality"] == 0) for r in rows) >= 0.97 * len(rows)
    assert not [r for r in rows if r["rejected"] and r["quality"] == 1]
    got = host_quality.quality_report(odd, labels).collect()
    assert len(got) == odd.count()
    assert {r["doc_id"] for r in got if r["evidence"] is None} == {0, 1, 2}
    assert host_quality.quality_report(none, labels.limit(0)).count() == 0
    assert not host_quality.quality_report(docs, labels.limit(0)).where("rejected and evidence is not null").count()


def test_sparse_sites_shrink(spark):
    rows = [("big", "big/a", 0.9)] * 500 + [("big", "big/b", 0.9)] * 500 + [("low", "low/a", 0.1)] * 400 + [("tiny", "tiny/a", 0.0)]
    sites = {r["path"]: r for r in host_quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    tiny = sites["tiny/a"]
    rate = (tiny["total_host"] + tiny["host_strength"] * tiny["prior"]) / (tiny["n_host"] + tiny["host_strength"])
    assert 0.2 < rate < tiny["prior"]
    host, path = spark.createDataFrame([("http://User@Ab.example.com:80/x/y?z",)], "u string").select(*host_quality.url_levels(F.col("u"))).first()
    assert (host, path) == ("ab.example.com", "ab.example.com/x")
