"""Each operator against brute force on a small fixture with nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF
from tokenizers import Tokenizer

from llm import bpe, line_dedup, lm_scoring, near_dedup, packing, quality_rules, sstable, token_counts, topk, toxicity
from llm.common import components
from llm.encoding import TextEncoder, default_tokenizer

WORDS = "the of and river stone cloud lamp green orbit candle harbour violet machine silent meadow copper".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = [r.choice(WORDS) + (r.choice("abcdefgh") * r.randint(0, 2)) for _ in range(n)]
    return "\n".join(" ".join(out[k : k + 14]) + "." for k in range(0, n, 14))


BASE = prose(1, 140)
TEXTS = [
    None, "", " ", "one two", "one two", BASE, BASE, BASE.upper(), BASE.replace("river", "rivers", 1), BASE + " tail words here", prose(2, 120), prose(3, 60) + "\n" + prose(2, 56),
    "x  y\t z \n\n q", "<|endoftext|> a <|endoftext|>b", "don't  we'll it's 12ab9 — é ü ßpf　wide", "###$$ " * 60, "again and again " * 40, prose(4, 6000), "#", "a\x00b \x00c", prose(5, 70), prose(5, 70) + "x",
]
ROWS = [(k * 3 + 1, t, "kept", k) for k, t in enumerate(TEXTS)] + [(None, BASE, "n", 0), (4, "", "again", 9)]
SCHEMA = "doc_id long, text string, kept string, id long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder(library):
    texts = [*TEXTS, " lead", "trail ", "a\n b", "a \nb", "a  b", "  x", "tab\there now", "it's O'Neil 'tis ''s"]
    got = TextEncoder(default_tokenizer()).encode(texts)
    for t, g in zip(texts, got):
        assert np.frombuffer(g, "<u4").tolist() == ids_of(library, t), t


def test_bpe(docs, empty, library):
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(docs).collect())
    want = collections.Counter()
    for k, t, *_ in ROWS:
        ids = ids_of(library, t)
        want[(k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert got == want
    assert bpe.encode_digests(empty).count() == 0
    codec = bpe.codec(default_tokenizer())
    odd = ["aaaaaaaaaaaaa", "banana bandana", "ééééé", "퟿😀😀"]
    assert codec.encode(odd) == [ids_of(library, t) for t in odd]
    assert [codec.decode(i) for i in codec.encode(odd)] == odd


def test_encode_ids(docs, empty, library):
    got = bpe.encode_ids(docs.withColumn("ids", docs["kept"])).collect()
    assert collections.Counter((r.doc_id, r.id, tuple(r.ids)) for r in got) == collections.Counter((k, j, tuple(ids_of(library, t))) for k, t, _, j in ROWS)
    assert bpe.encode_ids(empty).count() == 0


def test_sstable(spark, docs, empty, library, tmp_path):
    folder = str(tmp_path / "t")
    manifest = sstable.write_tables(docs, folder, block_bytes=256)
    assert manifest.agg({"docs": "sum"}).first()[0] == len(ROWS)
    rows = sorted(sstable.read_tables(spark, folder).collect(), key=lambda r: r.start)
    want = sorted(((k is not None, k or 0, t or ""), ids_of(library, t) + [2]) for k, t, *_ in ROWS)
    assert [r.id if r.id is not None else None for r in rows] == [k[1] if k[0] else None for k, _ in want]
    at = 0
    for r, (_, ids) in zip(rows, want):
        assert r.start == at and sorted(np.frombuffer(r.ids, "<u4").tolist()) == sorted(ids)
        at += len(ids)
    asked = spark.createDataFrame([(16,), (4,), (999,), (None,)], "id long")
    found = collections.Counter(r.id for r in sstable.lookup(spark, folder, asked).collect())
    assert found == {16: 1, 4: 2, None: 1}
    sstable.write_tables(empty, str(tmp_path / "e"))
    assert sstable.read_tables(spark, str(tmp_path / "e")).count() == 0


def test_rolled_files(spark, docs, library, tmp_path):
    """Small files and very long keys: the same rows, in order, and found by key."""
    rows = [("k" * 70_000 + str(k), t) for k, t in enumerate(TEXTS)]
    folder = str(tmp_path / "rolled")
    manifest = sstable.write_tables(spark.createDataFrame(rows, "doc_id string, text string").coalesce(1), folder, block_bytes=64, file_bytes=256).collect()
    assert len(manifest) > 3 and sorted(m.first_key for m in manifest) == [m.first_key for m in sorted(manifest, key=lambda m: m.start)]
    got = sorted(sstable.read_tables(spark, folder, "string").collect(), key=lambda r: r.start)
    assert [(r.id, np.frombuffer(r.ids, "<u4").tolist()) for r in got] == [(k, ids_of(library, t) + [2]) for k, t in sorted(rows)]
    found = sstable.lookup(spark, folder, spark.createDataFrame([(rows[5][0],), ("none",)], "id string"), "string").collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in found] == [ids_of(library, TEXTS[5]) + [2]]


def test_bloom_and_damage(tmp_path):
    path = str(tmp_path / "a.sst")
    w = sstable.Writer(path, block_bytes=64)
    keys = [sstable.key_bytes(k) for k in range(0, 400, 2)]
    for k in keys:
        w.add(k, np.array([70_000, 1], "<u4").tobytes())
    w.close()
    r = sstable.Reader(path)
    assert all(r.get(k) == [np.array([70_000, 1], "<u4").tobytes()] for k in keys)
    assert sum(r.may_hold(sstable.key_bytes(k)) for k in range(1, 2000, 2)) < 60
    raw = bytearray(open(path, "rb").read())
    raw[20] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError):
        list(sstable.Reader(path).block(0))


def test_length_histogram(spark, docs, empty, library):
    n = np.array([len(ids_of(library, t)) for _, t, *_ in ROWS])
    table = token_counts.length_table(token_counts.length_counts(docs), width=16)
    for r in table.collect():
        assert (r.n_docs, r.docs_at_most, r.tokens_at_most, r.truncated_tokens, r.total_tokens) == ((n == r.length).sum(), (n <= r.length).sum(), n[n <= r.length].sum(), np.minimum(n, r.length).sum(), n.sum())
    limits = spark.createDataFrame([(0,), (7,), (100,), (10**7,), (None,)], "context_limit long")
    got = {r.context_limit: r.truncated_tokens for r in token_counts.at_limits(table, limits).collect()}
    assert got == {None: None} | {k: np.minimum(n, k).sum() for k in (0, 7, 100, 10**7)}
    assert token_counts.length_quantile(table, 0.5).first().length == np.sort(n)[(len(n) + 1) // 2 - 1]
    assert token_counts.length_table(token_counts.length_counts(empty)).count() == 0


def test_quality_counts(spark, docs, empty):
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def base(t):
        w = word.findall(t or "")
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = collections.Counter(tri)
        covered = {j for i, x in enumerate(tri) if c[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if word.search(x)]
        out = (len(w), sum(map(len, w)), sum((t or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        return *out, out[0] < 50 or 100 * out[4] > 50 * out[0]

    labels = spark.createDataFrame([(16, 1, 0), (31, 1, 0), (None, 1, 0), (49, 0, 1)], "doc_id long, quality int, toxic int")
    ratios = quality_rules.fit_ratios(docs, labels, buckets=256)
    rows = quality_rules.judge(docs.select("doc_id", "text"), ratios).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert collections.Counter((r.doc_id, *(r[n] for n in names)) for r in rows) == collections.Counter((k, *base(t)) for k, t, *_ in ROWS)
    assert all(not r.kept for r in rows if r.base_failed) and any(r.kept for r in rows)
    assert not np.any(quality_rules.fit_ratios(empty, labels, buckets=16))
    assert quality_rules.judge(empty, ratios).count() == 0

    # the ratio, from shares of equal buckets, and where documents are cut
    grams = {(k, j): [*([w] for w in t), *([a, b] for a, b in zip(t, t[1:]))] for j, (k, x, *_) in enumerate(ROWS) for t in [word.findall((x or "").lower())]}
    every = sorted({tuple(g) for gs in grams.values() for g in gs})
    one = spark.createDataFrame([g for g in every if len(g) == 1], "a string").select("a", quality_rules.bucket(256, "a").alias("b")).collect()
    two = spark.createDataFrame([g for g in every if len(g) == 2], "a string, c string").select("a", "c", quality_rules.bucket(256, "a", "c").alias("b")).collect()
    place = {(r.a,): r.b for r in one} | {(r.a, r.c): r.b for r in two}
    raw, target = np.ones(256), np.ones(256)
    for (k, _), gs in grams.items():
        for g in gs:
            raw[place[tuple(g)]] += 1
            target[place[tuple(g)]] += k in (16, 31)
    want = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert np.allclose(ratios, want)
    scores = sorted((r.doc_id or -1, r.ngram_score) for r in rows)
    mine = {(k, j): np.mean([want[place[tuple(g)]] for g in gs]) if gs else 0.0 for (k, j), gs in grams.items()}
    assert np.allclose(scores, sorted((k or -1, x) for (k, _), x in mine.items()), atol=1e-5)
    cut = quality_rules.fit_threshold(docs, spark.createDataFrame([(16, 1), (31, 1), (52, 0), (None, 0)], "doc_id long, quality int"), ratios)
    passed = {k: x for (k, j), x in mine.items() if not base(ROWS[j][1])[-1]}
    good = np.percentile([passed[k] for k in (16, 31)], 1)
    assert abs(cut - min(good, (good + passed[52]) / 2)) < 1e-5
    assert quality_rules.fit_threshold(docs, labels.where("quality = 1"), ratios) == -0.15
    clash = quality_rules.judge(docs.withColumn("n_words", docs["id"]).withColumn("kept", docs["id"]), ratios)
    assert collections.Counter((r.doc_id, r.n_words) for r in clash.collect()) == collections.Counter((k, base(t)[0]) for k, t, *_ in ROWS) and clash.columns.count("kept") == 1


def test_toxicity(spark, empty):
    r = random.Random(3)
    rows = [(k, prose(100 + k, 60) + ("" if k % 4 else " " + " ".join(r.sample(["vile", "scum", "moron", "rotten"], 1 + k % 3))), int(k % 4 == 0)) for k in range(400)]
    docs = spark.createDataFrame([x[:2] for x in rows] + [(None, None), (1000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if k < 300], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.thresholds[0] < model.thresholds[1]
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    held = [k for k, *_ in rows if k >= 300]
    assert np.mean([got[k].toxic == (k % 4 == 0) for k in held]) > 0.97
    assert got[None].kept and got[1000].kept and 0 <= got[0].expected_severity <= 2
    assert toxicity.keep_clean(docs, labels).count() < docs.count()
    none = toxicity.fit(empty, labels)
    assert toxicity.score(empty, none).count() == 0 and not toxicity.score(docs, none).where("toxic").count()


def test_ordinal_gradient_recovers_order():
    r = np.random.default_rng(0)
    x = [np.flatnonzero(r.random(6) < 0.5) for _ in range(1500)]
    true = np.array([3.0, 2.0, 1.0, 0.0, -1.0, -2.0])
    z = np.array([true[i].sum() for i in x]) + r.logistic(size=len(x))
    grades = (z > 1).astype(int) + (z > 3.5)
    w, t = toxicity.fit_ordinal(x, grades, 6, 3)
    assert list(np.argsort(-w)) == list(range(6)) and t[0] < t[1]


def test_ordinal_likelihood():
    """What is fitted is a minimum of the penalized likelihood, written out row by row; scores follow from it."""
    r = np.random.default_rng(4)
    x = [np.flatnonzero(r.random(5) < 0.4) for _ in range(300)]
    z = np.array([np.array([2.0, 1.0, 0.0, -1.0, -2.0])[i].sum() for i in x]) + r.logistic(size=len(x))
    grades = (z > 0.5).astype(int) + (z > 2)
    w, t = toxicity.fit_ordinal(x, grades, 5, 3, steps=3000, rate=0.02)
    share = np.bincount(grades) / len(grades)
    weight = np.sqrt((1 / share[grades]) / np.mean(1 / share[grades]))
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def loss(w, t):
        total = 0.0
        for own, g, k in zip(x, grades, weight):
            up = [1.0, *(sigmoid(w[own].sum() - c) for c in t), 0.0]
            total -= k * np.log(up[g] - up[g + 1])
        return total / weight.sum() + 0.0003 / 2 * (w**2).sum()

    best = loss(w, t)
    for _ in range(40):
        assert best <= loss(w + r.normal(size=5) * 0.05, t + r.normal(size=2) * 0.05) + 1e-6
    model = toxicity.OrdinalModel({"a": 2.0, "b": -1.0}, np.array([0.5, 1.5]))
    up = [sigmoid(1.0 - 0.5), sigmoid(1.0 - 1.5)]
    assert np.allclose(model.at_least(np.array([1.0]))[0], up)


def test_severity_scores(spark, docs):
    model = toxicity.OrdinalModel({"again": 2.0, "and": -1.0}, np.array([0.5, 1.5]))
    clash = docs.withColumn("severity", docs["id"]).withColumn("toxic", docs["id"])
    got = collections.Counter((x.doc_id, x.severity, round(x.expected_severity, 9), x.kept) for x in toxicity.score(clash, model).collect())
    want = collections.Counter()
    for k, text, *_ in ROWS:
        z = sum({"again": 2.0, "and": -1.0}.get(w, 0.0) for w in toxicity.features(text))
        up = [1 / (1 + np.exp(-(z - c))) for c in (0.5, 1.5)]
        p = [1 - up[0], up[0] - up[1], up[1]]
        want[(k, int(np.argmax(p)), round(sum(up), 9), bool(up[0] < 0.5))] += 1
    assert got == want
    only = spark.createDataFrame([(16, 1), (31, 1)], "doc_id long, toxic int")
    assert not toxicity.score(docs, toxicity.fit(docs, only)).where("toxic").count()


def test_lm_scoring(spark, docs, empty, monkeypatch):
    trusted = spark.createDataFrame([(31,), (16,), (None,)], "doc_id long")
    clashing = docs.withColumn("target", docs["kept"]).withColumn("n_tokens", docs["id"])
    got = {(r.doc_id, r.n_tokens): r for r in lm_scoring.score_documents(clashing, trusted, class_words=20).collect()}
    own = [(k, lm_scoring.words_of(t)) for k, t, *_ in ROWS]
    n = collections.Counter(w for _, ws in own for w in ws)
    vocab = {w: j + 2 for j, w in enumerate(sorted(sorted(n, key=lambda w: (-n[w], lm_scoring.HASHES[w]))[:20], key=lm_scoring.HASHES.__getitem__))}
    size = len(vocab) + 2
    counts, other = np.zeros((2, size, size)), [collections.Counter(), collections.Counter()]
    seqs = [(k, [0] + [vocab.get(w, 1) for w in ws], ws) for k, ws in own]
    for k, s, ws in seqs:
        for a, b in zip(s, s[1:]):
            counts[1, a, b] += 1
            counts[0, a, b] += k in (31, 16)
        other[1].update(w for w in ws if w not in vocab)
        if k in (31, 16):
            other[0].update(w for w in ws if w not in vocab)
    loss = []
    for c in counts:
        uni = (c.sum(axis=0) + 1) / (c.sum(axis=0) + 1).sum()
        loss.append(-np.log((c + 8 * uni) / (c.sum(axis=1, keepdims=True) + 8)))
    for k, s, ws in seqs:
        r = got[(k, len(ws))]
        if not ws:
            assert r.ce_difference is None
            continue
        sums = []
        for m, c in zip(loss, other):
            inside = [-np.log((c[w] + 1) / (sum(c.values()) + len(other[1]))) for w in ws if w not in vocab]
            sums.append((sum(m[x, y] for x, y in zip(s, s[1:])) + sum(inside)) / len(ws))
        assert abs(r.target_loss - sums[0]) < 1e-4 and abs(r.ce_difference - (sums[0] - sums[1])) < 1e-4, k
    assert len(got) == len({(k, len(ws)) for k, ws in own})
    assert lm_scoring.score_documents(empty, trusted).count() == 0
    assert lm_scoring.score_documents(docs, trusted.limit(0)).where("target_loss is not null").count() > 0


def test_topk(spark):
    r = random.Random(5)
    rows = [(k, [r.uniform(-1, 1) for _ in range(20)], k) for k in range(300)] + [(300, None, 0), (301, [None] * 20, 0), (302, [float("nan")] * 20, 0), (303, [0.5] * 3, 0), (None, [0.1] * 20, 0), (350, [0.0] * 20, 0)]
    rows += [(400 + k, rows[7][1], 0) for k in range(7)] + [(500, [1e9] * 20, 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank long").repartition(3)
    got = collections.defaultdict(list)
    for x in topk.topk(v.where("vec_id % 50 = 0"), v, query_block=3, candidate_block=64).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    q = {k: [int(np.floor(256 * x)) for x in e] for k, e, _ in rows if k is not None and e and all(x is not None and np.isfinite(x) for x in e)}
    for k in [k for k in q if k % 50 == 0]:
        best = sorted(((-sum(a * b for a, b in zip(q[k], q[j])), j) for j in q if j != k and len(q[j]) == len(q[k])))[:5]
        assert sorted(got[k]) == [(n + 1, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(best)], k
    assert topk.topk(v.where("vec_id < 0"), v).count() == 0


def shingles(t, n):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(sets, percent):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ks = sorted(sets)
    for i, a in enumerate(ks):
        for b in ks[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in ks}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, docs, empty, size):
    got = near_dedup.near_duplicates(docs, size=size).collect()
    sets = {k: shingles(t, size) for k, t, *_ in ROWS[::-1] if k is not None and t}
    want = brute_components(sets, 80)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        elif r.doc_id in want:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id]), r
    assert len(got) == len(ROWS)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicate_group(spark):
    """A group of near copies around the threshold, where pivots alone lose links."""
    r = random.Random(8)
    base = prose(50, 120).split()
    rows = []
    for k in range(120):
        w = list(base)
        for _ in range(r.choice([1, 3, 4, 5, 6])):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()}
    assert got == brute_components({k: shingles(t, 4) for k, t in rows}, 80)


def test_registers():
    a = np.unique(np.random.default_rng(1).integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[:3600], np.random.default_rng(2).integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2)]))
    x, y = near_dedup.registers(a), near_dedup.registers(b)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((x == y).mean() - true) < 0.12
    few = near_dedup.densified(near_dedup.registers(a[::800]))
    assert (few != near_dedup.EMPTY).all()


def test_lines(spark, docs, empty):
    got = {(r.doc_id, k) for r in line_dedup.removed_lines(docs).collect() for k in r.removed}
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")
    lines = sorted({(k, i, norm(x)) for k, t, *_ in ROWS if k is not None and t is not None for i, x in enumerate(t.split("\n")) if norm(x)})
    first = {}
    for k, i, x in lines:
        first.setdefault(x, (k, i))
    sets = {at: {x[j : j + 5] for j in range(max(1, len(x) - 4))} for x, at in first.items()}
    comp = brute_components(sets, 80)
    assert got == {(k, i) for k, i, x in lines if comp[first[x]] != (k, i)}
    out = line_dedup.without_duplicates(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert line_dedup.removed_lines(empty).count() == 0


def test_packing(docs, empty, library):
    rows = packing.pack(docs, window=64, shard_docs=5).collect()
    want = collections.Counter((k, tuple(ids_of(library, t) + [0])) for k, t, *_ in ROWS)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r.sequence_id].append(r)
    for g in groups.values():
        g.sort(key=lambda r: r.offset)
        n = sum(r.length for r in g)
        assert [r.offset for r in g] == [0, *np.cumsum([r.length for r in g])[:-1]] and n <= 64 and n & (n - 1) == 0
    assert sum(len(r.ids) // 4 for r in rows) == sum(len(i) * c for (_, i), c in want.items())
    single = {k: i for (k, i), c in want.items() if k not in (4, None)}
    for k, ids in single.items():
        own = sorted((r.start, r) for r in rows if r.doc_id == k)
        assert [x for _, r in own for x in np.frombuffer(r.ids, "<u4").tolist()] == list(ids) and own[0][1].doc_tokens == len(ids)
    assert packing.pack(empty).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (None, 1)], "a long, b long")
    got = {r.id: r.component_id for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}


def linked_sets(sets, percent):
    """brute_components by counting shared members, for many small sets."""
    holders = collections.defaultdict(list)
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in sorted(sets):
        common = collections.Counter(o for g in sets[k] for o in holders[g])
        for o, n in common.items():
            if 100 * n >= percent * (len(sets[k]) + len(sets[o]) - n):
                x, y = find(k), find(o)
                parent[max(x, y)] = min(x, y)
        for g in sets[k]:
            holders[g].append(k)
    return {k: find(k) for k in sets}


def test_pipeline(spark, library):
    """Each stage on what the one before kept, against brute force, and run() as all of them."""
    import corpus_pipeline
    from llm.common import materialize

    source = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "toxicity", "line_dedup", "near_dedup", "packing"]
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}

    # quality: words, repeated windows and the ratio's cut
    now, before = materialize(stages["quality"](spark, source, SF), "quality"), texts(source)
    ratios = quality_rules.fit_ratios(source, labels)
    cut = quality_rules.fit_threshold(source, labels, ratios)
    scores = {r.doc_id: r.ngram_score for r in quality_rules.with_score(source, ratios).collect()}
    word, want = re.compile(r"[^\x20\x09-\x0D]+"), {}
    for k, t in before.items():
        w = word.findall(t or "")
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = collections.Counter(tri)
        covered = {j for i, x in enumerate(tri) if c[x] > 1 for j in (i, i + 1, i + 2)}
        if len(w) >= 50 and 100 * len(covered) <= 50 * len(w) and scores[k] >= cut:
            want[k] = t
    assert texts(now) == want and now.columns == source.columns and 0 < len(want) < len(before)

    # toxicity: the fitted weights
    model, before = toxicity.fit(now, labels), want
    now = materialize(stages["toxicity"](spark, now, SF), "toxicity")
    want = {k: t for k, t in before.items() if model.at_least(np.array([sum(model.weights.get(w, 0.0) for w in toxicity.features(t))]))[0, 0] < 0.5}
    assert texts(now) == want and now.columns == source.columns

    # lines: all pairs of lines
    before, now = want, materialize(stages["line_dedup"](spark, now, SF), "lines")
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")
    first = {}
    for k in sorted(before):
        for i, x in enumerate((before[k] or "").split("\n")):
            if norm(x):
                first.setdefault(norm(x), (k, i))
    comp = linked_sets({at: {x[j : j + 5] for j in range(max(1, len(x) - 4))} for x, at in first.items()}, 80)
    want = {}
    for k, t in before.items():
        old = (t or "").split("\n")
        left = [x for i, x in enumerate(old) if not norm(x) or comp[first[norm(x)]] == (k, i)]
        if left == old or word.search("\n".join(left)):
            want[k] = "\n".join(left)
    assert texts(now) == want and now.columns == source.columns
    assert all(r.n_chars == len(r.text) for r in now.collect() if r.text != before[r.doc_id])

    # documents: all pairs of documents
    before, now = want, materialize(stages["near_dedup"](spark, now, SF), "near")
    comp = brute_components({k: shingles(t, 5) for k, t in before.items()}, 80)
    want = {k: t for k, t in before.items() if comp[k] == k or not shingles(t, 5)}
    assert texts(now) == want and now.columns == source.columns

    # packing: every id once, sequences without gaps; and all stages together
    pieces = [stages["packing"](spark, now, SF).collect(), corpus_pipeline.run(spark, SF).collect()]
    for rows in pieces:
        own, groups = collections.defaultdict(list), collections.defaultdict(list)
        for r in rows:
            own[r.doc_id].append(r)
            groups[r.sequence_id].append(r)
        assert {k: [x for r in sorted(rs, key=lambda r: r.start) for x in np.frombuffer(r.ids, "<u4").tolist()] for k, rs in own.items()} == {k: ids_of(library, t) + [0] for k, t in want.items()}
        for g in groups.values():
            g.sort(key=lambda r: r.offset)
            n = sum(r.length for r in g)
            assert [r.offset for r in g] == [0, *np.cumsum([r.length for r in g])[:-1]] and n <= 1024 and (n == 1024 or n & (n - 1) == 0)


def crowded_lines(seed: int, words: int, families: int, edits: tuple[int, int]) -> list[str]:
    """400 lines of one template: families of near twins, each with its own words in the template's places."""
    r = random.Random(seed)
    base = [f"{r.choice(WORDS)}{r.randrange(1000)}" for _ in range(words)]
    out = []
    for f in range(families):
        own = list(base)
        for _ in range(r.randint(*edits)):
            own[r.randrange(12, words)] = f"fam{f}x{r.randrange(10**6)}"
        for _ in range(400 // families):
            line = list(own)
            if families < 400:
                line[r.randrange(12, words)] = f"w{r.randrange(10**6)}"
            out.append(" ".join(line))
    return out


@pytest.mark.parametrize("words, families, edits", [(90, 100, (12, 20)), (60, 400, (3, 8))])
def test_crowded_band(spark, words, families, edits):
    """Lines that all share bands, where two pivots alone lose links."""
    texts = crowded_lines(9, words, families, edits)
    got = {r.doc_id: r.component for r in line_dedup.duplicate_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    comp = brute_components({k: {x[j : j + 5] for j in range(len(x) - 4)} for k, x in enumerate(texts)}, 80)
    sizes = collections.Counter(comp.values())
    assert 1 < len(sizes) < 400
    mine, want = collections.defaultdict(set), collections.defaultdict(set)
    for k, c in comp.items():
        if sizes[c] > 1:
            want[c].add(k)
    for k, c in got.items():
        mine[c].add(k)
    assert {frozenset(x) for x in mine.values()} == {frozenset(x) for x in want.values()}


def test_shared_bands(spark):
    """Crowded bands go another way and give the same."""
    r = random.Random(3)
    rows = {(r.randrange(2000), b) for b in [7] * 900 + [r.randrange(500) for _ in range(1500)]}
    df = spark.createDataFrame(sorted(rows), "key long, band long")
    by = collections.defaultdict(set)
    for k, b in rows:
        by[b].add(k)
    want = {(b, k, min(x)) for b, x in by.items() if len(x) > 1 for k in x}
    for limit in (100_000, 50):
        assert {tuple(x) for x in line_dedup.shared_bands(df, 64, limit).collect()} == want


def test_pipeline_lines(spark):
    """A mostly duplicated document keeps the first copy of a line; only documents without a word left go."""
    import corpus_pipeline

    r = random.Random(12)
    line = lambda: " ".join(f"{r.choice(WORDS)}{r.randrange(10**6)}" for _ in range(9))
    common, once, own = [line() for _ in range(14)], line(), line()
    texts = {1: common, 2: [*common, once], 3: [once, own], 4: common, 5: [""], 6: [" "], 7: ["a few words"], 8: None}
    docs = spark.createDataFrame([(k, None if t is None else "\n".join(t)) for k, t in texts.items()], "doc_id long, text string")
    seen, want = set(), {}
    for k, t in texts.items():
        left = None if t is None else [x for x in t if not x.strip() or x not in seen]
        seen.update(t or [])
        if left == t or any(x.strip() for x in left):
            want[k] = None if t is None else "\n".join(left)
    assert {x.doc_id: x.text for x in corpus_pipeline.lines(spark, docs, SF).collect()} == want


def token(r: random.Random, n: int) -> str:
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))


KINDS = {
    "prose": lambda r: " ".join(r.choice(WORDS) + r.choice(["", "s", "ed", "ing"]) + str(r.randrange(50)) for _ in range(r.randint(12, 50))),
    "unspaced": lambda r: "".join(chr(r.randrange(0x4E00, 0x5E00)) for _ in range(r.randint(40, 120))),
    "address": lambda r: "https://" + "/".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789-") for _ in range(r.randint(3, 12))) for _ in range(r.randint(6, 14))),
    "ones": lambda r: " ".join(token(r, 1) for _ in range(7)) + " " + token(r, 80),
    "numbers": lambda r: "28 11 14 03 25 ok " + token(r, 72),
    "few": lambda r: " ".join(token(r, r.randint(1, 3)) for _ in range(r.randint(6, 8))) + " " + token(r, r.randint(50, 75)),
    "log": lambda r: f"2024-01-{r.randrange(31):02d} 12:{r.randrange(60):02d}:33 get ok https://" + token(r, r.randint(50, 62)),
    "tokens": lambda r: token(r, 30) + " " + token(r, 35),
    "long": lambda r: " ".join(token(r, 1) for _ in range(7)) + " " + token(r, 140),
    "short": lambda r: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(r.randint(4, 9))),
}


def test_line_recall(spark):
    """Of pairs of lines of each kind at 80 % or more, edited at random places, nearly all end in one component."""
    rows, each = [], 300
    for place, kind in enumerate(sorted(KINDS)):
        r, due = random.Random(kind), place * each
        while due < (place + 1) * each:
            line = KINDS[kind](r)
            x, grams = line, lambda t: {t[j : j + 5] for j in range(max(1, len(t) - 4))}
            for _ in range(20):
                at = r.randrange(len(x))
                y = x[:at] + r.choice([KINDS[kind](r)[:2], ""]) + x[at + r.randint(0, 2) :]
                n = len(grams(line) & grams(y))
                if 100 * n < 80 * len(grams(line) | grams(y)):
                    break
                x = y
            if x != line:
                rows += [(2 * due, line.lower()), (2 * due + 1, x.lower())]
                due += 1
    found = line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = collections.defaultdict(set)
    for x in found:
        by[x.component].add(x.doc_id // 2)
    # lines of a few one-character words can be alike by chance, others are of one pair
    linked = collections.Counter(p // each for x in by.values() for p in x)
    assert {kind: linked[k] >= 0.97 * each for k, kind in enumerate(sorted(KINDS))} == dict.fromkeys(sorted(KINDS), True), linked
    assert all(len(x) == 1 for x in by.values())


def test_lines_with_clashing_names(spark):
    rows = [(1, "a line of words", 5, "x", 1), (2, "a line of words\nown", 6, "y", 2), (None, "a line of words", 7, "z", 3), (3, None, 8, "n", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id long, removed string, id int")
    got = {(r.doc_id, r.text, r["__id"], r.removed, r.id) for r in line_dedup.without_duplicates(docs).collect()}
    assert got == {(1, "a line of words", 5, "x", 1), (2, "own", 6, "y", 2), (None, "a line of words", 7, "z", 3), (3, None, 8, "n", 4)}


def test_long_line(spark):
    """A line of many pieces, twice with a small edit, and one that ends in separators other than newline."""
    line = " ".join(f"w{k * 7919 % 100_003}" for k in range(40_000))
    rows = [(1, line), (2, line[:5000] + "x" + line[5001:]), (3, "a b\u2028c d e f g"), (4, "a b\u2028c d e f g"), (5, "\n\n \n")]
    got = {x.doc_id: x.removed for x in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: [0], 4: [0]}
