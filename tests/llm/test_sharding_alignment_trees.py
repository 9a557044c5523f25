"""Virtual slots, pair bitmaps and metric trees against brute force, on fixtures with nulls, ties, repeats and long texts."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from llm import alignment, metric_trees, queries, slots
from llm.common import table

# ---- fixed virtual slots

SHARD_ROWS = [(k, "x" * (k * 37 % 501), k % 3, k) for k in range(900)] + [(None, "no id " * 20, 1, k) for k in range(400)] + [(7, None, 2, 0), (8, "", 2, 0), (9, "é" * 20_000, 2, 0)] + [(11, "again", 0, 0)] * 5
SHARD_SCHEMA = "doc_id long, text string, shard int, slot long"


def sizes(rows):
    return [len((r[1] or "").encode()) + 1 for r in rows]


def test_slots_are_even_and_gapless(spark, tmp_path):
    docs = spark.createDataFrame(SHARD_ROWS, SHARD_SCHEMA).repartition(5)
    folder = str(tmp_path / "maps")
    got = slots.assigned(docs, shards=8, slots=256, map_folder=folder).collect()
    assert collections.Counter((r.doc_id, r.text, r.slot) for r in got) == collections.Counter((r[0], r[1], r[3]) for r in SHARD_ROWS)
    load, places = collections.Counter(), collections.defaultdict(list)
    for r in got:
        load[r.shard] += len((r.text or "").encode()) + 1
        places[r.shard].append(r.place)
        # the next version moves rows into the new shard only
        assert r.next_shard in (r.shard, 8) and 0 <= r.virtual_slot < 256
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(places) == 8
    # no shard is further from an even one than the largest row
    assert max(load.values()) <= sum(load.values()) / 8 + max(sizes(SHARD_ROWS))
    versions = [slots.load_map(spark, folder, v) for v in range(1, got[0].map_version + 2)]
    assert [m.shards for m in versions] == [8] * (len(versions) - 1) + [9]
    assert slots.load_map(spark, folder).version == got[0].map_version + 1
    # a slot belongs to one shard, but for heavy ones, which have parts: that of the null key and that of the long text
    held = collections.defaultdict(set)
    for r in got:
        held[r.virtual_slot].add(r.shard)
    hot = set(versions[-2].slot[versions[-2].part > 0].tolist())
    assert {r.virtual_slot for r in got if r.doc_id in (None, 9)} == hot and all(len(v) == 1 for k, v in held.items() if k not in hot)
    at = {(s, p): x for s, p, x in zip(versions[-2].slot.tolist(), versions[-2].part.tolist(), versions[-2].shard.tolist())}
    assert all(at[r.virtual_slot, 0] == r.shard for r in got if r.virtual_slot not in hot)
    assert all(r.first_shard == versions[0].shard[r.virtual_slot] for r in got)


def test_slots_hot_key(spark):
    """A third of all rows share one key; the other keys are one slot each."""
    rows = [(1, "same " * 20)] * 300 + [(k, f"text {k} " * 10) for k in range(2, 602)]
    got = slots.assigned(spark.createDataFrame(rows, "doc_id long, text string"), shards=4, slots=64).collect()
    load = collections.Counter()
    for r in got:
        load[r.shard] += len(r.text) + 1
    assert max(load.values()) < 1.05 * sum(load.values()) / 4 and len({r.shard for r in got if r.doc_id == 1}) == 4


def test_slots_empty(spark):
    got = slots.assigned(spark.createDataFrame([], SHARD_SCHEMA))
    assert got.count() == 0 and {"shard", "place", "virtual_slot"} <= set(got.columns)


def test_maps():
    r = np.random.default_rng(0)
    weight = r.integers(1, 1000, 512)
    first = slots.first_map(512, 16)
    even = slots.rebalanced(first, weight)
    load = np.bincount(even.shard, weight, 16)
    assert even.version == 2 and load.max() - load.min() <= weight[even.shard == load.argmax()].min() and 0 < (even.shard != first.shard).mean() < 0.5
    more = slots.grown(even, weight)
    moved = more.shard != even.shard
    assert more.shards == 17 and (more.shard[moved] == 16).all() and abs(np.bincount(more.shard, weight, 17)[16] - weight.sum() / 17) < 200
    assert (slots.rebalanced(even, weight).shard == even.shard).all()


def test_write_shards(spark, tmp_path):
    docs = spark.createDataFrame(SHARD_ROWS, SHARD_SCHEMA)
    m = slots.write_shards(docs, str(tmp_path / "out"), str(tmp_path / "maps"), shards=4, slots=128)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert collections.Counter((r.doc_id, r.text, r.slot) for r in back.collect()) == collections.Counter((r[0], r[1], r[3]) for r in SHARD_ROWS)
    load = {r.shard: r.b for r in back.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("b")).collect()}
    assert set(load) == {0, 1, 2, 3} and max(load.values()) <= sum(load.values()) / 4 + max(sizes(SHARD_ROWS))
    assert slots.load_map(spark, str(tmp_path / "maps")).shard.tolist() == m.shard.tolist()


def test_slots_query(spark):
    got = queries.op11_virtual_slots(spark, SF).collect()
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert len(got) == len(docs)
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    load = collections.Counter()
    for r in got:
        load[r.shard] += r.size
    assert max(load.values()) <= sum(load.values()) / 16 + max(r.size for r in got) and sorted((r.shard, r.slot) for r in got) == [(s, k) for s in sorted(load) for k in range(sum(x.shard == s for x in got))]


# ---- pair bitmaps

_R = random.Random(3)
_WORDS = [f"{w}{x}" for w in "river über stone 雲と猫 don't naïve lamp-post 12ab hello".split() for x in ("", "s", "ing", "42")]
ALIGN_TEXTS = [
    None, "", " ", "\n", "  ", "a", "hello world", "hello world", "hello  world", " lead", "trail ", "line\nline\n\nline", "\nfirst", "tab\tand more　spaces", "<|endoftext|> <s> </s> <0x41>", "no▁way here", "a\x00b \x00c", "😀😀 é é ﬁ",
    "don't we'll it's 12ab9 — ß", "x" * 400 + " " + "ab" * 300, "一二" * 200, "the the the the", "\r\n\x0b mixed \x1c ends \x85", "a\n b", "a \nb", "zero​width",
    *[" ".join(_R.choice(_WORDS) for _ in range(_R.randint(1, 90))) for _ in range(40)], "\n".join(" ".join(_R.choice(_WORDS) for _ in range(9)) for _ in range(600)),
]
ALIGN_ROWS = [(k * 2 + 1, t, k) for k, t in enumerate(ALIGN_TEXTS)] + [(None, "hello world", 0), (3, "hello again", 1)]


def brute_alignment(texts):
    """n_a, n_b, groups and links of each text, whole texts at a time, without units."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    pa_, pb = alignment.default_paths()
    a, b = Tokenizer.from_file(pa_), SentencePieceProcessor(model_file=pb)
    a.encode_special_tokens = True
    codes = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(x): x for x in codes} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in codes)}
    out = []
    for text in texts:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        bx = [bytes(letter[c] for c in a.id_to_token(i)) for i in x]
        by = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not text or not b"".join(bx) == b"".join(by) == (" " + text).encode():
            out.append(([], []))
            continue
        ends_x, ends_y = np.cumsum([len(t) for t in bx]).tolist(), np.cumsum([len(t) for t in by]).tolist()
        groups = collections.defaultdict(lambda: ([], []))
        both = sorted(set(ends_x) & set(ends_y))
        for side, (ids, ends) in enumerate(((x, ends_x), (y, ends_y))):
            for i, e in zip(ids, ends):
                groups[next(k for k in both if k >= e)][side].append(i)
        out.append(([groups[k] for k in both], [(i, j) for k in both for i in groups[k][0] for j in groups[k][1]]))
    return out


def expected_alignment(rows):
    found = brute_alignment([r[1] for r in rows])
    count = collections.Counter(p for _, links in found for p in set(links))
    best = collections.Counter()
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = collections.Counter()
    for r, (groups, links) in zip(rows, found):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n = [count[p] for p in links]
        out[(r[0], sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(c == best[p[0]] for c, p in zip(n, links)), sum(n), hashlib.sha256(text.encode()).hexdigest() if groups else "")] += 1
    return out


def as_rows(df):
    return collections.Counter((r[0], r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"buckets": 3, "chunk_docs": 4}, {"buckets": 64, "chunk_docs": 30, "chunk_bytes": 2000}])
def test_alignment(spark, options):
    docs = spark.createDataFrame(ALIGN_ROWS, "doc_id long, text string, n_a long").repartition(3)
    assert as_rows(alignment.align(docs, **options)) == expected_alignment(ALIGN_ROWS)


def test_alignment_query(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert as_rows(queries.op12_alignment(spark, SF)) == expected_alignment(rows)


def test_alignment_empty(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id string, text string")).count() == 0
    assert as_rows(alignment.align(spark.createDataFrame([("k", None), (None, "")], "doc_id string, text string"))) == collections.Counter({("k", 0, 0, 0, 0, 0, 0, ""): 1, (None, 0, 0, 0, 0, 0, 0, ""): 1})


def test_large_group():
    """A group of many tokens on both sides is counted by distinct ids."""
    own = alignment.Aligner(*alignment.default_paths())
    n = 120
    a, b = np.r_[np.full(n, 5), 7], np.r_[np.full(n, 9), 8, 8]
    unit, pair, links = own._pairs(a, b, np.array([n + 1]), np.array([n + 2]), np.zeros(1, np.int64))
    assert dict(zip(pair.tolist(), links.tolist())) == {5 * own.n_b + 9: n * n, 5 * own.n_b + 8: 2 * n, 7 * own.n_b + 9: n, 7 * own.n_b + 8: 2} and (unit == 0).all()


def test_planes():
    """Planes or-ed together are a pair's documents; weighted by their places they are its links."""
    r = np.random.default_rng(1)
    for width in (1, 7, 300, 4096):
        links = r.integers(0, 9, (20, width)) * (r.random((20, width)) < r.random((20, 1)))
        total, documents = np.zeros_like(links), np.zeros(links.shape, bool)
        for k in range(4):
            pair, low = np.nonzero(links >> k & 1)
            counts = np.bincount(pair, minlength=20)
            got_counts, got_low = alignment.decode_plane(alignment.encode_plane(counts, low, width), 20, width)
            assert (got_counts == counts).all() and (got_low == low).all()
            total[np.repeat(np.arange(20), got_counts), got_low] += 1 << k
            documents[np.repeat(np.arange(20), got_counts), got_low] = True
        assert (total == links).all() and (documents.sum(axis=1) == (links > 0).sum(axis=1)).all()


def test_pair_table(spark):
    docs = spark.createDataFrame(ALIGN_ROWS, "doc_id long, text string, n_a long").repartition(2)
    paths = alignment.default_paths()
    rows = alignment.index(docs, "doc_id", "text", 5, paths, 8, 1 << 20)
    n_b = alignment.aligner(paths).n_b
    got = {(r.a, r.b): (r.n_docs, r.n_links, r.best) for r in alignment.pair_table(alignment.pair_counts(rows.where(F.col("bucket") != alignment.LAST), n_b), n_b).collect()}
    found = brute_alignment([r[1] for r in ALIGN_ROWS])
    docs_of, links_of = collections.Counter(p for _, x in found for p in set(x)), collections.Counter(p for _, x in found for p in x)
    best = {i: max(n for (j, _), n in docs_of.items() if j == i) for i, _ in docs_of}
    assert got == {p: (n, links_of[p], n == best[p[0]]) for p, n in docs_of.items()}


# ---- metric trees


def brute_codes(rows, parts, entries, rounds, scale=256):
    """codes, errors and codebooks by comparing every part with every entry in Python's integers."""
    from fractions import Fraction

    kept = [(k, [math.floor(Fraction(float(np.float32(x)) if not isinstance(x, float) else x) * scale) for x in v]) for k, v in rows]
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    step = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * step : (p + 1) * step]
    books = [[cut(v, p) for _, v in kept[:entries]] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    code_of = lambda v: [min(range(len(b)), key=lambda e: (far(cut(v, p), b[e]), e)) for p, b in enumerate(books)]
    for _ in range(rounds):
        codes = [code_of(v) for _, v in kept]
        nxt = []
        for p, b in enumerate(books):
            mine = collections.defaultdict(list)
            for (_, v), c in zip(kept, codes):
                mine[c[p]].append(cut(v, p))
            nxt.append([[sum(x) // len(x) for x in zip(*mine[e])] if e in mine else b[e] for e in range(len(b))])
        books = nxt
    codes = [code_of(v) for _, v in kept]
    errors = [min(2**63 - 1, sum(far(cut(v, p), books[p][c[p]]) for p in range(parts))) for (_, v), c in zip(kept, codes)]
    return [k for k, _ in kept], ["".join(f"{x:02x}" for x in c) for c in codes], errors, books


def vectors_of(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, code string, error long")


def f32(x):
    return float(np.float32(x))


@pytest.mark.parametrize("block", [5, 64, 4096])
def test_codes(spark, block):
    r = random.Random(5)
    rows = [(k * 3 % 401, [f32(r.gauss(0, 0.2)) for _ in range(8)], k % 4 if k % 5 else None, "x", k) for k in range(300)]
    rows += [(900, [0.25] * 8, 1, "tie", 0), (901, [0.25] * 8, 1, "tie", 0), (None, [0.5] * 8, 2, "null id", 0), (3, [f32(0.1)] * 8, 3, "again", 0), (902, [f32(300.5)] * 8, 1, "far", 0)] + [(1000 + k, [0.0] * 8, 7, "hot", 0) for k in range(150)]
    odd = [(950, None, 1, "", 0), (951, [None] * 8, 1, "", 0), (952, [float("nan")] * 8, 1, "", 0), (953, [float("inf")] + [0.0] * 7, 1, "", 0), (954, [0.0] * 7, 1, "", 0), (955, [], 1, "", 0)]
    df = vectors_of(spark, rows + odd).repartition(3)
    coded, books = metric_trees.compress(df, parts=4, entries=12, rounds=2, block=block)
    got = collections.Counter((x.id, x.code, x.error) for x in coded.collect())
    ids, codes, errors, want = brute_codes([(x[0], x[1]) for x in rows], 4, 12, 2)
    assert got == collections.Counter(zip(ids, codes, errors))
    assert [b.tolist() for b in books] == want
    total = collections.Counter()
    label = {}
    for x in rows:
        label[x[0], tuple(x[1])] = x[2]
    for x in metric_trees.with_label_errors(coded).collect():
        total[x.label, x.label_error] += x.error
    assert all(k[1] == v for k, v in total.items()) and len(total) == 6


def test_codes_of_large_components(spark):
    """Components whose square or product exceeds 64 bits or a double are compared exactly."""
    r = random.Random(6)
    rows = [(k, [r.choice([1.0, -1e300, 1.7e308, 3.4e38, 0.5, 2.0**40]) * (1 if k % 3 else r.random()) for _ in range(4)], 1, "", 0) for k in range(40)] + [(100 + k, [r.random() for _ in range(4)], 1, "", 0) for k in range(40)]
    coded, books = metric_trees.compress(vectors_of(spark, rows, "double").repartition(2), parts=2, entries=6, rounds=2, block=16)
    ids, codes, errors, want = brute_codes([(x[0], x[1]) for x in rows], 2, 6, 2)
    assert collections.Counter((x.id, x.code, x.error) for x in coded.collect()) == collections.Counter(zip(ids, codes, errors))
    assert [b.tolist() for b in books] == want
    assert {x.label_error for x in metric_trees.with_label_errors(coded).collect()} == {2**63 - 1}


def test_codes_small_tables(spark):
    coded, books = metric_trees.compress(vectors_of(spark, []))
    assert coded.count() == 0 and books == []
    coded, books = metric_trees.compress(vectors_of(spark, [(4, [f32(k / 7) for k in range(32)], None, "", 0)]))
    assert [(x.id, x.code, x.error) for x in metric_trees.with_label_errors(coded).collect()] == [(4, "00" * 16, 0)] and all(b.shape == (1, 2) for b in books)


def test_tree():
    """Balls hold their points, cached sums are theirs, and far balls are owned without a look at their points."""
    r = np.random.default_rng(2)
    centers = r.integers(-5000, 5000, (12, 4))
    points = np.concatenate([c + r.integers(-8, 9, (120, 4)) for c in centers])
    tree = metric_trees.Tree(points, leaf=16)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    for k in range(len(tree.start)):
        own = points[tree.order[tree.start[k] : tree.end[k]]]
        assert (own.sum(axis=0) == tree.sums[k]).all()
        assert np.sqrt(((own - tree.center[k]) ** 2).sum(axis=1)).max() <= tree.radius[k] * (1 + 1e-9) + 1e-9
        if tree.left[k] >= 0:
            assert (tree.start[tree.left[k]], tree.end[tree.right[k]]) == (tree.start[k], tree.end[k]) and tree.end[tree.left[k]] == tree.start[tree.right[k]]
    code, n, total = tree.assign(points, centers)
    assert (code == metric_trees.nearest(points, centers)).all() and (n == np.bincount(code, minlength=12)).all()
    assert all((total[e] == points[code == e].sum(axis=0)).all() for e in range(12))
    seen = []
    original = metric_trees.nearest
    metric_trees.nearest = lambda p, *a, **k: seen.append(len(p)) or original(p, *a, **k)
    try:
        tree.assign(points, centers)
    finally:
        metric_trees.nearest = original
    assert sum(seen) < 0.05 * len(points)
