"""Vector codes, decontamination and collocations against brute force, on the smallest tables and on odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from rainfold.llm import decontaminate, phrases, vector_codes


def lloyd(rows, parts=8, entries=16, rounds=6):
    """(code, error) of rows (vec_id, label, vector) and the codebooks, one row at a time."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(rows[0][2]) // parts
    whole = [[math.floor(4096 * x) for x in r[2]] for r in rows]
    books = [[v[p * width : (p + 1) * width] for v in whole[:entries]] for p in range(parts)]

    def nearest(v):
        out = [min((sum((a - b) ** 2 for a, b in zip(v[p * width :], e, strict=False)), i) for i, e in enumerate(books[p])) for p in range(parts)]
        return [i for _, i in out], sum(d for d, _ in out)

    for _ in range(rounds):
        held = defaultdict(list)
        for v in whole:
            for p, e in enumerate(nearest(v)[0]):
                held[p, e].append(v[p * width : (p + 1) * width])
        for (p, e), some in held.items():
            books[p][e] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    return [(r, *nearest(v)) for r, v in zip(rows, whole, strict=True)], books


@pytest.mark.parametrize("wide", [1.0, 1e9, 1e30])
def test_vector_codes(spark, sf_dir, wide):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding").limit(150).collect()]
    rows = [(i, None if i % 7 == 0 else label, v) for i, label, v in rows]
    rows += [rows[20], rows[20], (None, 3, rows[5][2]), (1000, 3, [x * wide for x in rows[7][2]]), (5, 1, [x / 3 for x in rows[9][2]])]
    bad = [(2000, 1, None), (2001, 1, [float("nan")] * 64), (2002, 1, [None] * 64), (2003, 1, [float("inf")] * 64), (2004, 9, [1.0] * 63), (2005, 9, [])]
    schema = "vec_id bigint, label int, embedding array<double>"
    got = vector_codes.code_report(spark.createDataFrame(rows + bad, schema)).collect()
    want, books = lloyd(rows)
    sums = Counter()
    for r, _, error in want:
        sums[r[1]] += error
    short = lambda x: x if x < 1 << 63 else None
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    plain = [(r[0], r[1], "".join(f"{e:02x}" for e in code), short(error), short(sums[r[1]]), digest) for r, code, error in want]
    assert Counter(map(tuple, got)) == Counter([*plain, (2004, 9, None, None, short(sums[9]), digest), (2005, 9, None, None, short(sums[9]), digest)])
    kept = spark.createDataFrame(rows[:40], schema)
    coded, books = vector_codes.compress(vector_codes.usable(kept), parts=4, entries=3)
    back = vector_codes.reconstruct(coded, books).collect()
    assert all(r["vector"] == [x / 4096 for p, e in enumerate(r["code"]) for x in books.entries[p][e]] for r in back)


def test_vector_codes_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id bigint, label int, embedding array<float>, code string, error int, state int")
    assert vector_codes.code_report(none).count() == 0


def test_only_changes_are_summed(spark, sf_dir):
    vectors = vector_codes.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    start = [[math.floor(4096 * x) for x in r["vector"]] for r in vectors.orderBy("vec_id").limit(16).collect()]
    books = vector_codes.Codebooks([[v[p * 8 : p * 8 + 8] for v in start] for p in range(8)])
    rows, first, _ = vector_codes._round(vectors, books, 4096, True)
    again, moved, _ = vector_codes._round(rows, books, 4096, False)  # the same codebooks: nothing moves
    assert first.count() > 1000 and moved.count() == 0 and again.count() == vectors.count()


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(docs, items):
    windows = defaultdict(set)
    for name, text in items:
        w = tokens(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows[tuple(w[i : i + n])].add(name)
    lengths, out = {len(w) for w in windows}, []
    for doc_id, text in docs:
        w, hit, names = tokens(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    names |= got
        ids = ",".join(sorted(str(x) for x in names if x is not None))
        out.append((doc_id, len(w), len(hit), sum(x is not None for x in names), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


LONG = " ".join(f"w{i % 977}" for i in range(40000))
ITEMS = [
    (1, " ".join(f"w{i}" for i in range(100, 130))), (2, "one"), (3, "Two, words"), (4, "a b c d e f g"), (5, "É1 ünï ßtraße a-b_c 漢字"), (6, None), (7, " .,"), (8, "same same same same same same same same same same same same"),
    (9, "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod"), (10, "LOREM ipsum dolor sit amet, consectetur adipiscing elit sed do other end"), (None, "nobody knows who wrote this"), (9, "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod"),
]
DOCS = [
    (1, LONG), (2, None), (3, ""), (4, "one"), (5, "x two words one y"), (6, "A b c d E f g"), (7, "a b c d e f"), (8, "É1 ünï ßtraße a b c 漢字"), (9, "same " * 300), (10, "same " * 9), (11, "nobody knows who wrote this"),
    (12, "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do nothing"), (12, "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do nothing"), (None, "lorem ipsum dolor sit amet consectetur adipiscing elit sed"), (13, "z " * 50 + "ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod " + "q " * 50), (14, "é1 ünï ßtraße a b c 漢字"),
]


@pytest.mark.parametrize("few", [decontaminate.BROADCAST_MARKS, 0])
def test_contamination(spark, few, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_MARKS", few)
    docs = spark.createDataFrame([(*d, 1, "x") for d in DOCS], "doc_id bigint, text string, n_words int, digest string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    made = decontaminate.contamination(docs, items, broadcast_hashes=few)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in made.collect()) == Counter((d, n, h, ids) for (d, n, h, _, digest, _), ids in ((x, ids_of(x)) for x in contaminated(DOCS, ITEMS)))
    if few:
        assert Counter(map(tuple, decontaminate.contamination_report(docs, items).collect())) == Counter(contaminated(DOCS, ITEMS))
        assert decontaminate.contamination_report(docs.limit(0), items).count() == 0
        assert {r["n_hit"] for r in decontaminate.contamination_report(docs, items.limit(0)).collect()} == {0}


def ids_of(row):
    """The list whose digest a row has, found among the few lists there are."""
    names = [str(i) for i, _ in ITEMS if i is not None]
    for k in range(1 << len(set(names))):
        some = ",".join(sorted(x for i, x in enumerate(sorted(set(names))) if k >> i & 1))
        if hashlib.sha256(some.encode()).hexdigest() == row[4]:
            return some
    raise AssertionError(row)


def test_every_window_gives_a_shared_fingerprint(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(40):
        span = [rng.choice("abc") for _ in range(10)]
        for side in range(2):
            rows.append((i, side, [rng.choice("abc") for _ in range(rng.randrange(30))] + span + [rng.choice("abc") for _ in range(rng.randrange(30))]))
    df = spark.createDataFrame(rows, "pair int, side int, words array<string>")
    for n in (1, 2, 3, 7, 9, 10):
        marks = defaultdict(set)
        for r in decontaminate.with_fingerprints(df, [n]).select("pair", "side", "marks").collect():
            marks[r["pair"], r["side"]] = {m["h"] for m in r["marks"]}
        assert all(marks[i, 0] & marks[i, 1] for i in range(40))


def mined(docs, max_words=5, least=100, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, max_words + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        many = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        rows, held = [], Counter()
        for x, b in many.items():
            for k in range(2, len(x)):
                for i in range(len(x) - k + 1):
                    held[x[i : i + k]] = max(b, held[x[i : i + k]])
        for g, a in many.items():
            if held[g] < a:
                score, k = min((1000 * a * totals[lang] // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return out


@pytest.mark.parametrize("block", [50, 1_000_000])
def test_collocations(spark, sf_dir, block, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", block)
    odd = [(None, None), ("en", ""), ("en", "word"), ("en", "a\x0bb\x0cc\x00 \x1c d 　e\tf " * 3), ("x", "aa aa aa aa aa aa"), (None, "New  York, new york; NEW\tYORK! É é"), ("fr", "x y " * 3000), ("en", "Ü ü " * 4)]
    given = [*odd, *odd, *[(r["lang"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]]
    docs = spark.createDataFrame([(*d, 1, "p", 2) for d in given], "lang string, text string, a int, phrase string, n int")
    for max_words, least, top in ((5, 4, 50), (3, 1, 10), (5, 100, 2000)):
        assert Counter(map(tuple, phrases.collocations(docs, max_words, least, top).collect())) == Counter(mined(given, max_words, least, top))
    assert phrases.collocations(docs.limit(0)).count() == 0
